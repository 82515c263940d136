"""Operator 13: importance resampling towards a target distribution, by array-scored weights and quantile bracketing.

1. Features are runs of 1 to `n` consecutive words; a feature's bucket is its crc32 modulo `buckets`. Each task adds up an
   array of bucket counts and hands on its non-zero entries, so what is shuffled has a bound by tasks, not by words.
2. The gains of all buckets are one array of fixed size, sent to the tasks; a document's weight is the mean of what its
   features pick from it. A seeded Gumbel term, from the id alone, makes the draw without replacement the highest scores.
3. The draw's cutoff: a quantile sketch gives a bracket; exact counts of the scores above and inside say whether the cutoff is in
   it, else it is widened, at last to all scores. Only the bracket is sorted to find the cutoff; what is above it is
   sorted apart, for its ranks alone. Both are sorted by ranges (common.numbered), in no single task.

Words are runs of digits, letters and characters from U+0080, after lower-casing A-Z. Null or empty text: no features, weight 0.
Null ids: the Gumbel term is that of an empty id, ties come last. Ties of score: smaller id; of repeated rows one by one.
Very long texts are read whole, one at a time. Empty table: no rows. Empty target: its counts are 0.
Documents below `least` words are never drawn. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import UPPER, documents, fresh, numbered, stored, texts_of
from lanecast.llm.decontaminate import PATTERN, plain
from lanecast.llm.manifest import CRC32_SQL

N_GRAM, BUCKETS, SEED = 1, 10_000, "2024"
LEAST_WORDS, PERCENT = 20, 10
MEMO = 1 << 19  # features a task remembers the buckets of
ERROR = 0.001  # of the sketch's ranks; the bracket is twice as wide on each side


class Buckets(dict):
    """feature -> bucket, remembered up to MEMO features."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def features(text: str, n: int = N_GRAM) -> list[bytes]:
    words = plain(text).split()
    return words + [b" ".join(words[k : k + m]) for m in range(2, n + 1) for k in range(len(words) - m + 1)]


def bucket_counts(texts: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket of all texts; at most `buckets` rows reach the driver."""

    def count(batches):
        memo, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for _, each in texts_of(batches):
            seen = Counter()
            for t in each:
                seen.update(features(t, n))
            if seen:
                at = np.fromiter(map(memo.__getitem__, seen), np.int64, len(seen))
                np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the add-one shares), by bucket."""
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    ratio = ((target + 1.0) * (s_all + buckets)) / ((source + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def gumbel(doc_id) -> F.Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row."""

    def read(batches):
        memo = Buckets(len(gain))
        for batch, texts in texts_of(batches):
            counts, words, weights = [], [], []
            for t in texts:
                f = features(t, n)
                total = int(gain[np.fromiter(map(memo.__getitem__, f), np.int64, len(f))].sum())
                counts.append(len(f))
                words.append(len(f) if n == 1 else len(plain(t).split()))
                weights.append(total // len(f) if f else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (words, counts, weights)]], ["doc_id", "n_words", "n_features", "weight"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.mapInArrow(read, "doc_id long, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id")))


def bracket(scores: DataFrame, wanted: int, rows: int, error: float = ERROR) -> tuple[int, int, int]:
    """(low, high, above): the wanted-th highest score is in [low, high], and so many scores are above high."""
    place = 1 - wanted / rows
    while True:
        width = 2 * error
        low, high = (math.floor(x) for x in scores.approxQuantile("score", [max(0.0, place - width), min(1.0, place + width)], min(error, 1.0)))
        if error >= 0.25:  # the ends themselves
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < wanted <= above + inside:
            return low, high, above
        error *= 4


def ranked_draw(scores: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, error: float = ERROR) -> DataFrame:
    """scores (stored) with `rank` from 1 of the drawn, else null."""
    due = scores.where(F.col("n_words") >= least_words)
    rows = due.count()
    wanted = percent * rows // 100
    none = F.lit(None).cast("long")
    if not wanted:
        return scores.withColumn("rank", none)
    low, high, above = bracket(due, wanted, rows, error)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]

    def ranks(part: DataFrame, before: int) -> DataFrame:
        return numbered(part.withColumn("all", F.lit("")), "all", order).select(*scores.columns, (F.col("rank") + before + 1).alias("rank"))

    inside = ranks(due.where(F.col("score").between(low, high)), above)
    inside = inside.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scores.where((F.col("n_words") < least_words) | (F.col("score") < low)).withColumn("rank", none)
    return ranks(due.where(F.col("score") > high), 0).unionByName(inside).unionByName(rest)


def resampled(df: DataFrame, target: DataFrame, n: int = N_GRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of df; target: text."""
    gain = gains(bucket_counts(df, n, buckets), bucket_counts(target, n, buckets))
    return ranked_draw(stored(scored(df, gain, n=n), "scores"), least_words, percent)


def draw(df: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of df that are drawn, with all their columns: those whose id is (of rows that share an id, all or none)."""
    (doc,) = fresh(df, "doc")
    drawn = resampled(df, target).where("rank IS NOT NULL").select(F.col("doc_id").alias(doc)).distinct()
    return df.join(drawn, F.col("doc_id").eqNullSafe(F.col(doc)), "left_semi")


def op13_resample(spark, sf_dir):
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


QUERIES = {"op13_resample": op13_resample}
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{PATTERN}')"
# crc32 of the UTF-8 bytes: hex digits of the blob, two a byte
_CRC = "xor(4294967295, list_reduce(flatten([[4294967295]] || list_transform(range(1, strlen(w) + 1), lambda k: [CAST('0x' || substr(hex(encode(w)), 2 * k - 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
SQL = {
    "op13_resample": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents),
f AS (SELECT row, unnest(ws) AS w FROM d),
g AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (SELECT w, {_CRC} % {BUCKETS} AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g)),
s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN v USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN v USING (w) JOIN gain USING (bucket) GROUP BY row),
e AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT *, n_features >= {LEAST_WORDS} AS due, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN due AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM r"""
}
