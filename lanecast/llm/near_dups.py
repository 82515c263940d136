"""Operator 8: n-gram Jaccard join by rare-first prefix filtering; connected components of its links.

A document's set is its distinct `n`-word shingles (with fewer words, the whole sequence as one), as hashes.
Two sets with Jaccard similarity of at least `percent`/100 share a shingle among the first |set| - need + 1 of each,
whatever the common order; the order is rarest first, by a count sketch of fixed size (order only saves work, it
never decides). Steps, none of which gathers a group or emits all its pairs:

1. one pass: per document a digest of its words and its set's size; per task the sketch. Documents of equal words
   are one class from the start.
2. prefix postings (shingle, document, size, place), one document of a class per task; postings of a shingle that
   only one document has are dropped, the rest are stored.
3. pairs pass the length and positional filters, then the suffix filter (sizes of 64 hash classes of the sets bound
   the overlap), are made distinct, and verified once each on their texts. First each document is paired with one of
   those that lead its shingles' postings (where the shingle stands earliest), the one it meets most often; links are
   merged to components. Then likewise with the one before it in the postings, if they are still apart.
4. every other pair that could still join two components shares a stored shingle: such pairs are formed between
   different components only, with all three filters in the join, and verified. Links are merged again.

Postings of a hot shingle (its rarity stands in its token, so it is known without a count) are never one window's: its
leader and the components it has are sums before the shuffle, and its postings are dealt to parts, of which only the first
posting of each meets those of the other parts. They look their shingle up where they are, by broadcast, if the hot shingles
are few by count. A join by a leader with many partners comes last, without a shuffle behind it, so that the adaptive skew
join splits its large partitions.

Hashes have 64 bits (of a word: a polynomial over its bytes, mixed; of a shingle: its words' hashes, mixed in turn):
two given unlike shingles meet with a chance of about 2^-60, so sizes and links are exact but for that.

Null or empty text, or text without words: empty set, linked with nothing. Rows that share an id are one node: what
either links to is linked. Rows without an id have their size, no links and no component. Ties in size: by id.
Other columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lanecast.llm.common import discard, documents, fresh, looked_up, stored, texts_of
from lanecast.llm.words import ODD, Words, mixed

WORDS, PERCENT = 5, 80
SKETCH_BITS = 20  # counters of the sketch; 4 bytes each are broadcast
CHUNK = 1 << 14
RARITY_BITS = 11
HOT_SHARE = 1000  # a class with more than this share of all rows is looked up by broadcast: fewer than so many are
CLASSES = 64  # one byte each, in eight longs; a set with more than 255 in a class has none and passes the filter
SIGNATURE = [f"s{k}" for k in range(CLASSES // 8)]
HOT_HOLDERS = 256  # a shingle with at least so many documents by the sketch, and 16 times its mean, is hot
HOT_TOKENS = 1 << 17  # hot shingles that a join broadcasts at most; beyond, it is a merge join
PARTS = 64  # that a hot shingle's postings are dealt to
BUCKETS = 1 << 20  # hashed ids that a pre-filter of texts names at most


class Shingler(Words):
    """Word hashes and distinct shingle hashes of many texts at a time."""

    def __init__(self, n: int = WORDS):
        super().__init__()
        self.n = n

    def sets(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending in each text, and where each text's begin (one more than texts)."""
        counts, n = np.diff(first), self.n
        with np.errstate(over="ignore"):
            s = h.copy()
            for k in range(1, n):
                s = mixed(s[: len(s) - 1]) * ODD + h[k:]
            s = mixed(s)
            short = np.flatnonzero((counts > 0) & (counts < n))
            lengths = np.maximum(counts - n + 1, 0)
            lengths[short] = 1
            out = np.empty(lengths.sum(), np.uint64)
            begin = np.concatenate([[0], np.cumsum(lengths)])
            whole = np.repeat(first[:-1] - begin[:-1], lengths) + np.arange(len(out))
            alone = np.zeros(len(out), bool)
            alone[begin[short]] = True
            out[~alone] = s[whole[~alone]]
            for t in short:  # fewer words than a shingle has: the sequence as one, begun by its length
                x = mixed(np.full(1, counts[t], np.uint64) * ODD)
                for w in h[first[t] : first[t + 1]]:
                    x = mixed(x * ODD + w)
                out[begin[t]] = x[0]
        return distinct(out, begin)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        s, begin = self.sets(*self(texts))
        return [s[a:b] for a, b in zip(begin, begin[1:])]


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts and makes distinct each group of values, in place."""
    for a, b in zip(begin, begin[1:]):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[begin[:-1][np.diff(begin) > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[begin]


def digests(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each text's words."""
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first, first[1:])]


def prefix_lengths(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A partner shares at least ceil(t * size) shingles, so one of the first size - that + 1."""
    return np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def overlap_needed(a, b, percent: int):
    """Least overlap of sets of a and b elements: ceil(t / (1 + t) * (a + b)). Columns."""
    t = Fraction(percent, 100 + percent)
    return F.ceil((a + b) * t.numerator / F.lit(float(t.denominator)) - 1e-9)


def summarise(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, words digest, size, signature) of each row, stored; the sketch. docs: doc_id, text."""
    size, chunks = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // CHUNK

    def read(batches):
        shingle, counts = Shingler(n), np.zeros(size, np.int64)
        for batch, texts in texts_of(batches):
            h, first = shingle(texts)
            s, begin = shingle.sets(h, first)
            np.add.at(counts, (s & np.uint64(size - 1)).astype(np.int64), 1)
            sizes = np.diff(begin)
            of = np.repeat(np.arange(len(texts)), sizes) * CLASSES + (s >> np.uint64(58)).astype(np.int64)
            classes = np.bincount(of, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
            packed, none = np.minimum(classes, 255).astype(np.uint8).view("<i8"), classes.max(axis=1, initial=0) > 255
            yield rows(batch.column("doc_id"), pa.array(digests(h, first), pa.binary()), pa.array(sizes, pa.int32()), *[pa.array(packed[:, k], pa.int64(), mask=none) for k in range(len(SIGNATURE))], pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary()))
        parts = [(k, counts[k * CHUNK : (k + 1) * CHUNK]) for k in range(chunks)]
        parts = [(k, zlib.compress(c.astype("<i8").tobytes(), 1)) for k, c in parts if c.any()]
        m = len(parts)
        yield rows(pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64())] * len(SIGNATURE), pa.array([k for k, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary()))

    def rows(*columns):
        return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "key", "size", *SIGNATURE, "chunk", "counts"])

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in group["counts"])
        group = group.iloc[:1].assign(counts=[np.minimum(counts, 2**31 - 1).astype("<i4").tobytes()])
        return group[["chunk", "counts"]]

    both = stored(docs.mapInArrow(read, f"doc_id long, key binary, size int, {', '.join(f'{x} long' for x in SIGNATURE)}, chunk int, counts binary"), "shingle-sets")
    sketch = np.zeros(size, np.int32)
    sums = both.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInPandas(total, "chunk int, counts binary")
    for r in sums.toLocalIterator():
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<i4")
    return both.where("chunk IS NULL").select("doc_id", "key", "size", *SIGNATURE), sketch


def prefix_postings(docs: DataFrame, sketch: np.ndarray, n: int, percent: int) -> DataFrame:
    """token, size, doc, place: the prefix of each set in the sketch's order, once a task for equal words.

    A token is the shingle's rarity (64 times the logarithm of its count, 11 bits) before the first 53 bits of its hash,
    so ascending tokens are the order; two shingles with one token only make a pair that is verified in vain.
    """
    shared, mask = docs.sparkSession.sparkContext.broadcast(sketch), np.uint64(len(sketch) - 1)

    def read(batches):
        shingle, seen = Shingler(n), set()
        rarity = (64 * np.log2(np.maximum(shared.value, 1))).astype(np.uint64) << np.uint64(64 - RARITY_BITS)
        for batch, texts in texts_of(batches):
            h, first = shingle(texts)
            new = []
            for key, a, b in zip(digests(h, first), first, first[1:]):
                new.append(b > a and key not in seen)
                if new[-1]:
                    seen.add(key)
            s, begin = shingle.sets(h, first)
            sizes = np.diff(begin)
            tokens = rarity[(s & mask).astype(np.int64)] | (s >> np.uint64(RARITY_BITS))
            for a, b in zip(begin, begin[1:]):
                tokens[a:b].sort()
            k = np.where(new, prefix_lengths(sizes, percent), 0)
            place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            if len(place):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                columns = tokens[np.repeat(begin[:-1], k) + place].view(np.int64), np.repeat(sizes, k).astype(np.int32), np.repeat(ids, k), place.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "size", "doc", "place"])

    return docs.mapInArrow(read, "token long, size int, doc long, place int")


def passes(percent: int):
    """Length filter, and the positional filter at the first shared shingle: what may follow bounds the overlap."""
    low, high = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    rest = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    return (100 * low >= percent * high) & (rest >= overlap_needed(F.col("a_size"), F.col("b_size"), percent))


def may_overlap(percent: int):
    """Suffix filter: the classes' smaller sizes bound the overlap. Columns a_size, b_size, a_s0.., b_s0.."""
    byte = lambda c, k: F.shiftrightunsigned(F.col(c), 8 * k).bitwiseAND(255)
    both = reduce(lambda x, y: x + y, [F.least(byte(f"a_{c}", k), byte(f"b_{c}", k)) for c in SIGNATURE for k in range(8)])
    return F.coalesce(100 * both >= percent * (F.col("a_size") + F.col("b_size") - both), F.lit(True))


def filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    ends = sets.select("doc_id", "size", *SIGNATURE).dropDuplicates(["doc_id"])
    for x in "ab":
        pairs = pairs.join(ends.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("size", *SIGNATURE)]), x)
    return stored(pairs.where(may_overlap(percent)).select("a", "b"), "pairs")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The links among distinct pairs (a, b), by their texts. Texts are reduced to those of the pairs' hashed ids before they are shuffled."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    near = docs.withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")  # at most BUCKETS rows
    texts = near.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    # the leader (a) may have many partners: its join comes last, so that a large partition of it can be split
    full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def check(batches):
        shingle = Shingler(n)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                a, b = (shingle.of([t or "" for t in part.column(c).to_pylist()]) for c in ("ta", "tb"))
                keep = [linked(x, y, percent) for x, y in zip(a, b, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the edges (a, b), by alternating large-star and small-star steps.

    Each step replaces a node's edges by edges to its smallest neighbour; sums over groups only, no group is
    gathered. It ends when a step changes nothing; every step is stored.
    """
    def both_ways(e):
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e, large: bool):
        e = both_ways(e) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = e.join(least, "u")
        if large:
            moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))).select("col.*")
        return moved.where("a <> b").distinct()

    def marked(e):
        """Stored, with a mark of its rows that is taken while they are written."""
        seen = Observation()
        e = stored(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        return e, (seen.get["n"], seen.get["sum"])

    edges, now = marked(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while now != before:
        before, last = now, edges
        edges, now = marked(star(star(edges, True), False))
        discard(last)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of df."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets, sketch = summarise(docs, n)
    filled = sets.where("size > 0").select("key", "doc_id")
    by_words = stored(filled.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    copies = looked_up(filled, by_words, ["key"], F.col("n") * HOT_SHARE > sets.count(), "inner").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b")

    hot = is_hot(sketch)
    post = shared(prefix_postings(docs.where("doc_id IS NOT NULL"), sketch, n, percent), hot)
    copies = stored(copies.distinct(), "copies")
    discard(by_words)
    comp, tried, spent = copies.select(F.col("a").alias("node"), F.col("b").alias("component")), None, []
    near = with_components(post, comp)
    for nearest in (leading, preceding):
        pairs = nearest(near, percent, hot).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
        best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        best = filtered(best if tried is None else best.join(tried, ["a", "b"], "left_anti"), sets, percent)
        spent.append(best)
        tried = best if tried is None else tried.union(best)
        # what is known is a star a component, so that only new links need steps
        comp = stored(components(stars(comp).union(verified(best, docs, n, percent))), "components")
        spent.append(comp)
        last = near
        near = stored(open_shingles(with_components(post if nearest is leading else near.drop("component"), comp), hot), "open-postings")
        discard(*([post, copies] if nearest is leading else [last]))

    rest = stored(near.join(sets.select(F.col("doc_id").alias("doc"), *SIGNATURE).dropDuplicates(["doc"]), "doc"), "open-postings")
    a, b = (rest.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("doc", "size", "place", "component", *SIGNATURE)]) for x in "ab")
    later = (F.col("a_component") != F.col("b_component")) & ((F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_doc") < F.col("b_doc"))))
    more = a.join(b, (a["token"] == b["token"]) & later & passes(percent) & may_overlap(percent)).select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")).distinct()
    more = stored(more.join(tried, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        comp = stored(components(stars(comp).union(verified(more, docs, n, percent))), "components")
    discard(near, rest, more, *[x for x in spent if x is not comp])
    found = sets.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def stars(comp: DataFrame) -> DataFrame:
    return comp.select(F.col("node").alias("a"), F.col("component").alias("b"))


def with_components(postings: DataFrame, comp: DataFrame) -> DataFrame:
    return postings.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def is_hot(sketch: np.ndarray) -> Column:
    """Of a token: whether its shingle may have many documents."""
    least = int(64 * np.log2(max(HOT_HOLDERS, 16 * float(sketch.mean()))))
    return F.shiftrightunsigned("token", 64 - RARITY_BITS) >= least


def shared(postings: DataFrame, hot: Column) -> DataFrame:
    """Postings of shingles that more than one document has, stored; of hot ones all, in parts."""
    w = Window.partitionBy("token", "part").orderBy("size", "doc")
    d = postings.withColumn("part", F.when(hot, F.pmod(F.xxhash64("doc"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int"))
    d = d.withColumn("alone", F.lag("doc").over(w).isNull() & F.lead("doc").over(w).isNull())
    return stored(d.where(~F.col("alone") | hot).drop("alone", "part"), "postings")


def with_token(postings: DataFrame, tokens: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by token to what was stored of hot shingles."""
    return postings.join(F.broadcast(tokens) if tokens.count() <= HOT_TOKENS else tokens.hint("merge"), "token", how)


def open_shingles(postings: DataFrame, hot: Column) -> DataFrame:
    """Postings of shingles that more than one component has."""
    whole = Window.partitionBy("token")
    cold = postings.where(~hot).withColumn("lo", F.min("component").over(whole)).withColumn("hi", F.max("component").over(whole))
    several = postings.where(hot).groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return cold.where("lo <> hi").drop("lo", "hi").unionByName(with_token(postings.where(hot), stored(several, "hot-shingles"), "left_semi").select(*postings.columns))


ORDER = ["place", "size", "doc"]  # the earlier a shingle stands in its set, the fewer rarer ones the set has


def leading(postings: DataFrame, percent: int, hot: Column) -> DataFrame:
    """(a, b): a leads the postings of a shingle that b has, and they aren't yet together."""
    one = F.struct(*ORDER, "component")
    cold = postings.where(~hot).withColumn("other", F.first(one).over(Window.partitionBy("token").orderBy(*ORDER)))
    least = stored(postings.where(hot).groupBy("token").agg(F.min(one).alias("other")), "hot-leaders")
    return _apart(cold.unionByName(with_token(postings.where(hot), least).select(*cold.columns)), percent)


def preceding(postings: DataFrame, percent: int, hot: Column) -> DataFrame:
    """(a, b): a comes before b in the postings of a shingle, and they aren't yet together; the first of a part has the first of the part before."""
    one = F.struct(*ORDER, "component")
    before = lambda *keys: F.lag(one).over(Window.partitionBy(*keys).orderBy(*ORDER))
    d = postings.withColumn("part", F.when(hot, F.pmod(F.xxhash64("doc"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")).withColumn("other", before("token", "part"))
    firsts = d.where(hot & F.col("other").isNull()).withColumn("other", before("token"))  # at most PARTS a shingle
    return _apart(d.where("other IS NOT NULL").unionByName(firsts), percent)


def _apart(postings: DataFrame, percent: int) -> DataFrame:
    d = postings.where("other.component <> component")
    d = d.select(*[F.col(c).alias(f"b_{c}") for c in ("doc", "size", "place")], *[F.col(f"other.{c}").alias(f"a_{c}") for c in ("doc", "size", "place")])
    return d.where(passes(percent)).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of df that are their component's smallest id, with all their columns; and all rows whose id is null or
    stands more than once, so that no text is lost with an id that others share."""
    (node,) = fresh(df, "node")
    found = near_duplicates(df).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    keep = found.where("doc_id IS NULL OR doc_id = component_id OR n > 1").select(F.col("doc_id").alias(node))
    return df.join(keep, F.col("doc_id").eqNullSafe(F.col(node)), "left_semi")


def op8_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
SQL: dict[str, str] = {}


def brute_force(docs: list[tuple[int, str | None]], n: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), by comparing all pairs; for tests."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode("utf-8").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}
