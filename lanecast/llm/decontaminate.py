"""Operator 12: benchmark decontamination by Wu-Manber search over words.

Test strings are the benchmark's windows of `window` consecutive words (an item of fewer is one), after lower-casing A-Z. A document is a
sequence of word hashes; for each length m of test strings the search looks at the block of the last min(m, 2) words of the m words
before a position: the shift table says by how many words any test string is impossible from there (m - 1 where no
test string has the block); where the shift is 0, the block's bucket of test strings is entered by the hash of their first block, the
word hashes are compared, and what is left is compared directly, byte by byte. Positions of many texts move together, each in a lane of its
own (numpy inside an Arrow map), and every text is searched whole.

Test strings are dealt to blocks by their hash, of about `block_windows` each, so the tables that a pass broadcasts have a size bound
that doesn't grow with the benchmark; one pass over the documents a block. With more than one block what a pass finds (documents
with a hit only) is joined to the documents by id and text digest.

Words are runs of digits, letters and characters from U+0080. Null or empty text: no words, nothing hit; benchmark rows without words have no
window. Benchmark rows that share an id are one item; rows with a null id mark words but name no item. Equal windows of many items:
one test string with all their ids. Repeated documents: each has its row. Empty tables: no rows, or nothing hit. Other columns are
ignored. Very long texts are read whole, in chunks of words.hashes' size.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import UPPER, documents, stored, texts_of
from lanecast.llm.words import ODD, Powers, mixed, word_hashes

WINDOW = 10
BLOCK_WINDOWS = 1 << 18  # test strings a pass, about; some 50 MB of tables
LANE = 1 << 9  # words that a lane searches
CHUNK_BYTES = 1 << 22
PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PATTERN_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

_WORD_BYTES = bytes(b + 32 if chr(b) in UPPER else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """The words of a text, lower-cased, with white space between them."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)


def words_of(text: str | None) -> list[bytes]:
    return plain(text or "").split()


class Spans:
    """Words of one long buffer: starts, ends and hashes."""

    def __init__(self, texts: list[bytes], powers: Powers):
        self.data = b" " + b" ".join(texts) + b" "
        begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
        starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
        while at < len(self.data) - 1:
            end = self.data.find(b" ", min(at + CHUNK_BYTES, len(self.data) - 1))
            s, h = word_hashes(self.data[at : end + 1], powers)
            starts.append(s + at)
            hashes.append(h)
            at = end
        self.starts, self.hashes = np.concatenate(starts), np.concatenate(hashes)
        self.first = np.searchsorted(self.starts, begins)  # where each text's words begin, one more than texts

    def text(self, word: int, n: int) -> bytes:
        """n words from one on, with one space between them."""
        end = self.starts[word + n] if word + n < len(self.starts) else len(self.data)
        return b" ".join(self.data[self.starts[word] : end].split())


def combined(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    x = mixed(h[at] * ODD)
    for k in range(1, n):
        x = mixed(x * ODD + h[at + k])
    return x


class Search:
    """Wu-Manber tables for test strings of m words: strings (bytes, words joined by a space), rows of word hashes."""

    def __init__(self, strings: list[bytes], m: int):
        self.m, self.block = m, min(m, 2)
        spans = Spans(strings, Powers())
        words = spans.hashes.reshape(len(strings), m)
        flat, row = spans.hashes, np.arange(len(strings)) * m
        with np.errstate(over="ignore"):
            suffix, prefix = combined(flat, row + m - self.block, self.block), combined(flat, row, self.block)
            order = np.lexsort((prefix, suffix))
            self.suffix, self.prefix, self.words = suffix[order], prefix[order], words[order]
            self.strings, self.number = [strings[k] for k in order], order
            self.bits = np.uint64(64 - max(12, int(len(strings) * m).bit_length() + 2))
            self.shift = np.full(1 << (64 - int(self.bits)), m - self.block + 1, np.uint8)
            for end in range(self.block, m + 1):  # the block whose last word is the end-th
                np.minimum.at(self.shift, (combined(flat, row + end - self.block, self.block) >> self.bits).astype(np.int64), m - end)

    def hits(self, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of the test string) of every occurrence in the texts of spans."""
        h, m = spans.hashes, self.m
        begin, end = spans.first[:-1], spans.first[1:]
        long = end - begin >= m
        begin, end = begin[long] + m - 1, end[long]  # places of last words
        lanes = -(-(end - begin) // LANE)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(begin, lanes) + nth * LANE
        stop = np.minimum(at + LANE, np.repeat(end, lanes))
        found = []
        with np.errstate(over="ignore"):
            while len(at):
                block = combined(h, at - self.block + 1, self.block)
                step = self.shift[(block >> self.bits).astype(np.int64)]
                zero = step == 0
                if zero.any():
                    found.append(self._candidates(h, at[zero] - m + 1, block[zero]))
                at = at + np.maximum(step, 1)
                open_ = at < stop
                at, stop = at[open_], stop[open_]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, which = (np.concatenate(x) for x in zip(*found))
        same = np.fromiter((spans.text(p, m) == self.strings[w] for p, w in zip(place, which)), bool, len(place))
        return place[same], self.number[which[same]]

    def _candidates(self, h: np.ndarray, start: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of the suffix blocks' buckets whose first block and word hashes agree with the words from start on."""
        low, high = np.searchsorted(self.suffix, block), np.searchsorted(self.suffix, block, "right")
        full = high > low
        start, low, high = start[full], low[full], high[full]
        first = combined(h, start, self.block)
        # a bucket is sorted by its prefixes: two binary searches, all rows at a time
        low, high = self._bound(low, high, first, False), self._bound(low, high, first, True)
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(start, n)
        same = np.ones(len(which), bool)
        for k in range(self.m):
            same &= self.words[which, k] == h[place + k]
        return place[same], which[same]

    def _bound(self, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, 0)
            below = open_ & ((self.prefix[middle] <= value) if right else (self.prefix[middle] < value))
            low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return low


class Tables:
    """A block of test strings, by their length, with the items that each belongs to."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        """rows: test string, its words, the ids of its items."""
        by_length = defaultdict(list)
        for text, m, items in rows:
            by_length[m].append((text.encode("utf-8", "surrogatepass"), items))
        self.searches = [Search([t for t, _ in each], m) for m, each in sorted(by_length.items())]
        self.items = [[i for _, i in each] for _, each in sorted(by_length.items())]

    def find(self, spans: Spans) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items of each text."""
        edges, items = np.zeros(len(spans.hashes) + 1, np.int64), [set() for _ in spans.first[1:]]
        for search, named in zip(self.searches, self.items):
            place, which = search.hits(spans)
            np.add.at(edges, place, 1)
            np.add.at(edges, place + search.m, -1)
            for text, w in np.unique(np.stack([np.searchsorted(spans.first, place, "right") - 1, which]), axis=1).T.tolist():
                items[text].update(named[w])
        return np.cumsum(edges[:-1]) > 0, items


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """test (words joined by a space), m (its words), items (sorted ids) of the distinct windows of all items."""

    def cut(batches):
        for batch, texts in texts_of(batches):
            ids, each = batch.column("item").to_pylist(), [words_of(t) for t in texts]
            rows = [(i, b" ".join(w[k : k + window]).decode("utf-8", "surrogatepass"), min(window, len(w))) for i, w in zip(ids, each) if w for k in range(max(1, len(w) - window + 1))]
            yield pa.RecordBatch.from_pylist([{"item": i, "test": t, "m": m} for i, t, m in rows], pa.schema([("item", pa.string()), ("test", pa.string()), ("m", pa.int32())]))

    each = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, "item string, test string, m int")
    return each.groupBy("test", "m").agg(F.sort_array(F.collect_set("item")).alias("items"))


def occurrences(df: DataFrame, tables, columns: list[str], only_hits: bool = False) -> DataFrame:
    """The columns of df with n_words, starts, ends (of the words hit, as disjoint spans) and items of each row's text; tables: a broadcast Tables."""
    fields = [df.select(*columns).schema[c] for c in columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def read(batches):
        powers, found = Powers(), tables.value
        for batch, texts in texts_of(batches):
            spans = Spans([plain(t) for t in texts], powers)
            hit, items = found.find(spans)
            padded = np.concatenate([[False], hit, [False]])
            starts, ends, edges = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:]), spans.first
            # a run of hit words may go on from one text to the next: cut it there
            inner = edges[1:-1][(padded[edges[1:-1]] & padded[edges[1:-1] + 1])] if len(hit) else edges[:0]
            starts, ends = np.sort(np.concatenate([starts, np.unique(inner)])), np.sort(np.concatenate([ends, np.unique(inner)]))
            of = np.searchsorted(starts, edges)
            shift = edges[np.repeat(np.arange(len(texts)), np.diff(of))]
            lists = [pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(x - shift, pa.int64())) for x in (starts, ends)]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.diff(edges), pa.int64()), *lists, pa.array([sorted(i) for i in items], pa.list_(pa.string()))], [*columns, "n_words", "starts", "ends", "items"])
            yield out.filter(pa.array(np.diff(of) > 0)) if only_hits else out

    return df.select(*columns, "text").mapInArrow(read, f"{schema}, n_words long, starts array<long>, ends array<long>, items array<string>")


def blocks_of(df: DataFrame, benchmark: DataFrame, window: int, block_windows: int) -> list:
    """Broadcast Tables of all test strings, one a block."""
    context, tests = df.sparkSession.sparkContext, stored(windows(benchmark, window=window), "windows")
    blocks = -(-tests.count() // block_windows) or 1
    parts = [tests.where(F.pmod(F.xxhash64("test"), F.lit(blocks)) == k) for k in range(blocks)]
    return [context.broadcast(Tables([(r["test"], r["m"], r["items"]) for r in part.toLocalIterator()])) for part in parts]


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, starts, ends, items of each row: words from starts[k] up to ends[k] are hit."""
    tables = blocks_of(df, benchmark, window, block_windows)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if len(tables) == 1:
        return occurrences(docs, tables[0], ["doc_id"])
    docs = docs.withColumn("digest", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = None
    for block in tables:
        each = stored(occurrences(docs, block, ["doc_id", "digest"], only_hits=True).dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", "starts", "ends", "items"), "hits")
        found = each if found is None else found.unionByName(each)
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))  # an entry a block
    found = found.groupBy("doc_id", "digest").agg(F.sort_array(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    count = F.coalesce(F.regexp_count("text", F.lit(PATTERN_ANY_CASE)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id"), F.col("digest"), count.alias("n_words")).alias("d")
    rows = rows.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.digest") == F.col("f.digest")), "left")
    union = F.aggregate("spans", F.array().cast("array<struct<starts:bigint,ends:bigint>>"), _merge)
    none = F.array().cast("array<long>")
    rows = rows.select("d.doc_id", "n_words", union.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows.select("doc_id", "n_words", F.coalesce("spans.starts", none).alias("starts"), F.coalesce("spans.ends", none).alias("ends"), "items")


def _merge(acc, s):
    """Ordered spans, made disjoint."""
    last = F.element_at(acc, -1)
    grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], s["ends"]).alias("ends"))))
    return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["ends"] >= s["starts"]), grown).otherwise(F.concat(acc, F.array(s)))


def without_leaks(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of df that hold no window of the benchmark, with all their columns."""
    for tables in blocks_of(df, benchmark, window, block_windows):

        def clean(batches, tables=tables):
            powers, found = Powers(), tables.value
            for batch, texts in texts_of(batches):
                spans = Spans([plain(t) for t in texts], powers)
                hit = np.concatenate([[0], np.cumsum(found.find(spans)[0])])[spans.first]
                yield batch.filter(pa.array(np.diff(hit) == 0))

        df = df.mapInArrow(clean, df.schema)
    return df


def op12_decontaminate(spark, sf_dir):
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


QUERIES = {"op12_decontaminate": op12_decontaminate}
_LIST = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{PATTERN}')"
SQL = {
    "op12_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_LIST} AS w FROM documents),
b AS (SELECT item_id, {_LIST} AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS test FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS m, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT row, m, k, array_to_string(w[k:k + m - 1], ' ') AS test FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM t))),
o AS (SELECT row, x.m, k, item_id FROM x JOIN t ON x.m = t.m AND x.test = t.test),
h AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT row, m, k FROM o)) GROUP BY row),
i AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN i USING (row)"""
}
