"""Operator 10: secret scans over a trigram inverted index (DataFrame functions only).

From each rule's regex a Boolean query over trigrams is derived: an OR of ANDs that any match must satisfy. The
index has a posting (trigram, document) for the trigrams that queries name; a document whose postings satisfy a
rule's query is a candidate of it, one bit a rule. Candidates meet their texts by a hash of id and text: by broadcast as
long as there are at most `SMALL` of them, by a shuffled join beyond. Rules without a mandatory trigram scan every text.

Spans are in code points, end exclusive. Matches are leftmost and don't overlap within a rule; those that fail the
rule's least length are dropped. Null or empty text: no spans. Repeated rows: each has its row. Other columns are
ignored. Empty table: no rows. Very long texts: searched whole, their spans added up in chunks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import documents, stored

SMALL = 1 << 20  # candidates, of two numbers each, that are broadcast
CHUNK = 64  # matches whose places are added up in one array


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    fold: bool = False  # letters in either case
    group: int = 0  # what `least` measures
    least: int = 1

    def pattern(self) -> str:
        return f"(?i){self.regex}" if self.fold else self.regex


# The first three are the contract's. Runs of hex digits are taken from the least length on, which finds the same
# runs; an access key likewise.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


def _strings(part) -> set[str] | None:
    """All strings that a part of a parsed regex matches, if they are few."""
    out: set[str] = {""}
    for op, arg in part:
        name = str(op)
        if name == "LITERAL":
            more = {chr(arg)}
        elif name == "IN" and len(arg) <= 4 and all(str(o) == "LITERAL" for o, _ in arg):
            more = {chr(c) for _, c in arg}
        elif name == "SUBPATTERN":
            more = _strings(arg[3])
        elif name == "BRANCH":
            each = [_strings(x) for x in arg[1]]
            more = None if None in each else set().union(*each)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            more = _strings(arg[2])
            more = None if more is None else more | ({""} if arg[0] == 0 else set())
        else:
            more = None
        if more is None or len(out) * len(more) > 256:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(regex: str) -> list[set[str]]:
    """Alternatives, each a set of trigrams that a match has all of, in lower case; [] if none is mandatory."""
    parts = list(re._parser.parse(regex))
    runs, k = [], 0
    while k < len(parts):
        end = k
        while end < len(parts) and _strings(parts[k : end + 1]) is not None:
            end += 1
        if end > k:
            runs.append(_strings(parts[k:end]))
        k = max(end, k + 1)
    queries = []
    for strings in runs:
        sets = [frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        if all(sets):
            queries.append([set(a) for a in set(sets) if not any(b < a for b in sets)])
    return sorted(min(queries, key=len), key=sorted) if queries else []


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index's rows (trigram, doc) for these trigrams; docs: doc, text."""
    low = docs.select("doc", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc, rules: the indexed rules (bits, by number) whose query the document satisfies."""
    clauses = [(n, sorted(c)) for n, r in enumerate(rules) for c in trigram_query(r.regex)]
    seen = {t: f"t{k}" for k, t in enumerate(sorted({t for _, c in clauses for t in c}))}
    hits = index.groupBy("doc").agg(*[F.bool_or(F.col("trigram") == t).alias(name) for t, name in seen.items()])
    mask = F.lit(0)
    for n, clause in clauses:
        whole = reduce(lambda a, b: a & b, [F.col(seen[t]) for t in clause])
        mask = mask.bitwiseOR(F.when(whole, F.lit(1 << n)).otherwise(F.lit(0)))
    return hits.select("doc", mask.alias("rules")).where("rules != 0")


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches, from the lengths of the matches and of what lies between them."""
    rx = F.lit(rule.pattern())
    matches = F.regexp_extract_all(text, rx, F.lit(0))
    measured = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else matches
    rows = F.arrays_zip(F.split(text, rule.pattern(), -1).alias("gap"), matches.alias("hit"), measured.alias("part"))
    rows = F.transform(rows, lambda r: F.struct(F.length(r["gap"]).alias("gap"), F.length(F.coalesce(r["hit"], F.lit(""))).alias("hit"), (r["hit"].isNotNull() & (F.length(r["part"]) >= rule.least)).alias("due")))
    # chunk by chunk, so that a text of many matches doesn't copy one long array for each
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, CHUNK))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, row):
        start = acc["at"] + row["gap"]
        end = start + row["hit"]
        return F.struct(end.alias("at"), F.when(row["due"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    def chunk(acc, c):
        done = F.aggregate(c, F.struct(acc["at"].alias("at"), empty.alias("spans")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["parts"], F.array(done["spans"])).alias("parts"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("parts"))
    return F.aggregate(chunks, first, chunk, lambda acc: F.flatten(acc["parts"]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, small: int = SMALL) -> DataFrame:
    """doc_id and, per rule, an array of (start, end) by the rule's kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("doc"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    found = stored(candidates(postings(docs, trigrams), rules), "secret-candidates")
    docs = docs.join(F.broadcast(found) if found.count() <= small else found.hint("merge"), "doc", "left")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    columns = []
    for n, rule in enumerate(rules):
        due = F.col("text").rlike(rule.pattern())
        if queries[rule.kind]:
            due = (F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << n)) != 0) & due
        columns.append(F.when(due, spans_of(F.col("text"), rule)).otherwise(empty).alias(rule.kind))
    return docs.select("doc_id", *columns)


def listed(found: list[tuple[int, str]]) -> Column:
    """kind:start:end of all, by start, then by kind as listed, joined by commas."""

    def named(n: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("name")))

    each = [named(n, kind) for n, kind in found]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: s["name"]), ",")


def op10_secret_scan(spark, sf_dir):
    found = scan(documents(spark, sf_dir))
    kinds = [(n, r.kind) for n, r in enumerate(RULES)]
    return found.select("doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE], F.sha2(listed(kinds[: len(BASE)]), 256).alias("base_sha256"), listed(kinds).alias("spans"))


QUERIES = {"op10_secret_scan": op10_secret_scan}


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, r in enumerate(RULES):
        rx = quote(("(?i)" if r.fold else "") + r.regex)
        part = f"regexp_extract_all(t, {rx}, {r.group})" if r.group else "m"
        parts.append(
            f"SELECT row, '{r.kind}' AS kind, {n} AS n, start, start + length(hit) AS stop FROM (SELECT row, hit, part, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start "
            f"FROM (SELECT row, unnest(m) AS hit, unnest({part}) AS part, unnest(string_split_regex(t, {rx})[1:len(m)]) AS gap, unnest(range(len(m))) AS k FROM (SELECT row, t, regexp_extract_all(t, {rx}) AS m FROM d) WHERE len(m) > 0) WINDOW w AS (PARTITION BY row ORDER BY k)) WHERE length(part) >= {r.least}"
        )
    name = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg({name}, ',' ORDER BY start, n) FILTER (n < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({name}, ',' ORDER BY start, n) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (row) GROUP BY row, doc_id"""


SQL = {"op10_secret_scan": _sql()}
