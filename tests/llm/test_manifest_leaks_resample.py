"""Operators 11 to 13 against brute force on small, awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanecast.llm import common, decontaminate, manifest, resample
from lanecast.llm.words import Powers
from tests.llm.test_training_data import LONG, ROWS, SCHEMA, SF, TEXTS

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))


# --- ranks by ranges


def test_numbered_is_row_number(spark):
    rows = [("a", 3)] * 40 + [("a", None)] * 3 + [("b", k % 7) for k in range(50)] + [("c", 1)]
    got = common.numbered(common.stored(spark.createDataFrame(rows, "g string, v long").repartition(5), "rows"), "g", [F.col("v").asc_nulls_first()]).collect()
    for g in "abc":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and {r["size"] for r in mine} == {len(mine)}
        assert [r["v"] for r in mine] == sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v or 0))


# --- operator 11


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text -> list of the contract's columns."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(value, r))

    def tree(nodes):
        """(top, siblings of each leaf by level: (left, right))"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
                paths[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            nodes, at = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [a // 16 for a in at]
        return nodes[0], paths

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in sources[s]]) for s in names]
    root, tops = tree([t for t, _ in trees])
    out = []
    for s, (top, paths), above in zip(names, trees, tops):
        for r, path in zip(sources[s], paths):
            whole = path + above
            x = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                x = leaf((*r[:4], r[4] and low(r[4])))
            for left, right in whole:
                x = H(left, x, right)
            out.append((r[0], leaf(r), top, root, H(*[left + right for left, right in whole]), x, x == root))
    return out


def in_order(rows):
    return sorted(map(str, rows))


def test_manifest_equals_brute_force(spark, docs, empty):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in ROWS]
    many = [(k, f"s{'é' if k % 11 == 0 else k % 3}" if k % 7 else None, "en", k, f"Text {k}") for k in range(700)]
    twice = [(1, "x", None, None, "Same Text")] * 40 + [(2, "y", "en", 1, "")]
    for some in (rows, many, twice, many[:1], [(k, f"only{k:03}", None, 0, "A") for k in range(40)]):
        d = spark.createDataFrame(some, "doc_id long, source string, lang string, n_chars long, text string")
        got = manifest.verify(d).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
        assert in_order(map(tuple, got)) == in_order(brute_manifest(some))
    assert manifest.verify(docs).count() == len(ROWS) and manifest.verify(empty).count() == 0


def test_proofs_of_some_leaves(spark):
    rows = [(k, "s" if k % 4 else "t", None, k, f"text {k}") for k in range(900)]
    m = manifest.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    want = {r[0]: r for r in brute_manifest(rows)}
    asked = m.leaves.where("doc_id IN (0, 1, 17, 899)").select("gid", "rank", "doc_id")
    got = m.proofs(asked).withColumn("proof", manifest.siblings_digest(F.col("path"))).withColumn("back", manifest.folded(F.col("path"), F.col("found"))).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 17, 899}
    for r in got:
        assert (r["found"], r["subroot"], r["proof"], r["back"]) == (want[r["doc_id"]][1], want[r["doc_id"]][2], want[r["doc_id"]][4], m.root)
    assert m.proofs(asked.limit(0)).count() == 0


def test_records_are_content_addressed(spark):
    d = spark.createDataFrame([(1, "x", None, None, "same")] * 64, "doc_id long, source string, lang string, n_chars long, text string")
    m = manifest.manifest(d)
    assert m.tree.records[1].count() == 1 and len(m.tree.records[1].first()["children"]) == 16 and m.tree.height == 2


# --- operator 12


def brute_leaks(docs, items, window=10):
    tests = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            tests.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for x, ids in tests.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= ids
        found = sorted(str(i) for i in found - {None})
        out.append((d, len(w), len(hit), ",".join(found)))
    return out


def flat(found):
    return [(r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["starts"], r["ends"])), ",".join(r["items"])) for r in found.collect()]


PASSAGE = "The quick brown Fox jumps over 13 lazy dogs, near the old river-bank at dawn"
ITEMS = [(1, PASSAGE), (2, "quick Brown fox jumps over 13 lazy dogs near the, OLD"), (30, "one two"), (4, ""), (5, None), (None, "three four five"), (7, "ünïcödé 漢字"), (1, "MIT"), (8, " ".join(LONG.split()[50:65])), (9, "a a a")]
LEAKY = [(100, f"x {PASSAGE} {PASSAGE.upper()}! y"), (101, PASSAGE.replace("lazy", "very lazy")), (102, " ".join(PASSAGE.split()[2:12])), (103, "a a a a A b a a"), (104, PASSAGE), (104, PASSAGE), (None, "one,two. three four five")]


@pytest.mark.parametrize("block_windows", [1 << 18, 3])
def test_leaks_equal_brute_force(spark, docs, empty, block_windows):
    rows = [(r[0], r[1]) for r in ROWS] + LEAKY
    d, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = flat(decontaminate.contaminated(d, items, block_windows=block_windows))
    assert in_order(got) == in_order(brute_leaks(rows, ITEMS)) and any(r[2] > 20 for r in got)
    assert decontaminate.contaminated(empty, items, block_windows=block_windows).count() == 0
    assert all(r[2] == 0 for r in flat(decontaminate.contaminated(docs, items.limit(0), block_windows=block_windows)))
    clean = decontaminate.without_leaks(docs, items, block_windows=block_windows)
    assert clean.columns == docs.columns
    dirty = Counter(str((r[0], r[1])) for r, x in zip(ROWS, brute_leaks([(r[0], r[1]) for r in ROWS], ITEMS)) if not x[2])
    assert Counter(str((r["doc_id"], r["text"])) for r in clean.collect()) == dirty


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=40), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), min_size=1, max_size=5), st.integers(1, 5))
def test_search_equals_brute_force(texts, items, window):
    docs, items = [(k, " ".join(t)) for k, t in enumerate(texts)], [(k, " ".join(t)) for k, t in enumerate(items)]
    tests = {}
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - window + 1)):
            tests.setdefault((" ".join(w[k : k + window]), min(window, len(w))), set()).add(str(i))
    tables = decontaminate.Tables([(t, m, sorted(i)) for (t, m), i in tests.items()])
    spans = decontaminate.Spans([decontaminate.plain(t) for _, t in docs], Powers())
    hit, found = tables.find(spans)
    got = [(d, int(b - a), int(hit[a:b].sum()), ",".join(sorted(x))) for (d, _), a, b, x in zip(docs, spans.first, spans.first[1:], found)]
    assert got == brute_leaks(docs, items, window)


def test_shifts_skip_words():
    """A text without a block of the test strings is looked at once in as many words as the shift allows."""
    search = decontaminate.Search([b" ".join(b"w%d" % k for k in range(10))], 10)
    spans = decontaminate.Spans([" ".join(f"x{k}" for k in range(512)).encode()], Powers())
    seen, plain = [], decontaminate.combined
    decontaminate.combined = lambda h, at, n: seen.append(len(at)) or plain(h, at, n)
    try:
        assert len(search.hits(spans)[0]) == 0
    finally:
        decontaminate.combined = plain
    assert sum(seen) <= 60


# --- operator 13


def brute_resample(docs, target, least=20, percent=10):
    count = lambda texts: Counter(zlib.crc32(w.encode()) % 10000 for t in texts for w in words_of(t))
    s, t = count([x for _, x in docs]), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)}
    rows = []
    for d, x in docs:
        w = words_of(x)
        weight = sum(gain[zlib.crc32(v.encode()) % 10000] for v in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    due = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(due[: percent * len(due) // 100]):
        r[4] = k + 1
    return rows


def test_resampling_equals_brute_force(spark, docs, empty):
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "漢字"]
    rows = [(r[0], r[1]) for r in ROWS] + [(1000 + k, " ".join(vocabulary[(k * 31 + j * j * (k % 7 + 1)) % len(vocabulary)] for j in range(10 + k % 60))) for k in range(400)]
    target = [" ".join(vocabulary[:40]), None, "", "W1 w2"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = [tuple(r) for r in resample.resampled(spark.createDataFrame(rows, "doc_id long, text string"), t).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = [tuple(r) for r in brute_resample(rows, target)]
    assert in_order(got) == in_order(want) and sum(r[4] is not None for r in got) > 20
    assert resample.resampled(empty, t).count() == 0 and resample.resampled(docs, t.limit(0)).count() == len(ROWS)
    assert resample.draw(docs, t).columns == docs.columns


def test_draw_with_ties_and_any_bracket(spark):
    """Scores of few values, repeated rows and a bracket that has to be widened give the exact number of ranks."""
    rows = [(k % 150, 30, 30, 0, 5 - k % 3) for k in range(300)] + [(None, 30, 30, 0, 5)] * 3 + [(999, 3, 3, 0, 99)]
    scores = common.stored(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long"), "scores")
    for percent, error in ((10, 0.001), (50, 1e-6), (100, 0.1), (0, 0.1)):
        got = [r for r in resample.ranked_draw(scores, 20, percent, error).collect()]
        ranks = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["rank"])
        assert len(got) == len(rows) and [r[0] for r in ranks] == list(range(1, percent * 303 // 100 + 1))
        assert [r[1:] for r in ranks] == sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= 20)[: len(ranks)]


def test_longer_features():
    assert resample.features("A b, c", 2) == [b"a", b"b", b"c", b"a b", b"b c"]
    gain = resample.gains(np.array([3, 0]), np.array([0, 1]))
    assert list(gain) == [math.floor(1000 * math.log(5 / 12)), math.floor(1000 * math.log(10 / 3))]


def test_registered_queries_read_whole_tables(spark):
    from lanecast.llm import queries

    rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op11_merkle_manifest", "op12_decontaminate", "op13_resample"):
        assert queries.QUERIES[name](spark, SF).count() == rows and name in queries.SQL
    assert len(TEXTS) > 10
