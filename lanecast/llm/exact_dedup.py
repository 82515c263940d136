"""Operator 7: exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to groups by digest and stored (partial sums before the
shuffle, so a group of copies of any size costs a row a task); only groups meet the index in the sort-merge anti-join,
new ones are appended, and every row then looks its digest up; the digests of large groups are looked up by broadcast, so that their
rows stay where they are. A batch has a name: run again under it, after a failure at any point, it finds its own digests
in the index and decides as before.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts of a batch, the row
with the largest id stays (null is the smallest; of repeated rows with that id, one); rows whose digest another
batch brought before are all dropped. Other columns are ignored; an empty batch appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanecast.llm.common import discard, documents, fresh, looked_up, lower_ascii, stored

BUCKET_ROWS = 1_000_000  # expected digests a bucket, where the caller names no number of buckets
HOT_SHARE = 1000  # groups with more than this share of all rows are looked up by broadcast: fewer than so many are
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def digest_of(text):
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def digests_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return stored(df.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest")), "digests")


class DigestIndex:
    """A bucketed, sorted table (digest, keep_id, group_size, batch) in the warehouse. Buckets: as given, or by the
    rows that are expected, or by the first batch's."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, expected_rows: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or (self._for(expected_rows) if expected_rows else None)

    @staticmethod
    def _for(rows: int) -> int:
        return max(8, -(-rows // BUCKET_ROWS))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table} PURGE")

    def append_new(self, digests: DataFrame, batch: str) -> None:
        """digests: stored doc_id, digest. Appends those that the index lacks, under the batch's name."""
        sums = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = found = stored(sums, "digest-groups")  # an anti-join on the sums themselves would be moved below them, to the raw rows
        if self.exists():
            known = self.rows().select("digest").hint("merge")
            groups = groups.join(known, "digest", "left_anti")
            described = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.table}").collect()}
            self.buckets = int(described["Num Buckets"])
        self.buckets = self.buckets or self._for(digests.count())
        rows = groups.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest")
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.table)
        discard(found)


def decided(digests: DataFrame, index: DataFrame, stays) -> DataFrame:
    """COLUMNS of each row; index: a row a digest. Of repeated rows that stay, one does."""
    found = looked_up(digests, index, ["digest"], F.col("group_size") * HOT_SHARE > digests.count(), "inner")
    found = found.withColumn("stays", stays & F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumnRenamed("digest", "text_sha256")
    once = F.row_number().over(Window.partitionBy("text_sha256").orderBy(F.lit(1))) == 1
    one = found.where("stays").withColumn("kept", once)
    return one.select(COLUMNS).unionByName(found.where("NOT stays").withColumn("kept", F.lit(False)).select(COLUMNS))


def dedup(df: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COLUMNS, one row per row of df, whose new digests the index now has under the batch's name."""
    digests = digests_of(df, id_col, text_col)
    index.append_new(digests, batch)
    return decided(digests, index.rows(), F.col("batch") == batch)


def keep_one(df: DataFrame, index: DigestIndex, batch: str = "first") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    found = stored(dedup(df, index, batch), "decided")
    doc, digest = fresh(df, "doc", "digest")
    kept = found.where("kept").select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(digest))
    match = F.col("doc_id").eqNullSafe(F.col(doc)) & (digest_of(F.col("text")) == F.col(digest))
    rows = df.join(kept, match, "left_semi")
    repeats = found.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id").distinct()
    if repeats.isEmpty():
        return rows
    again = repeats.select(F.col("doc_id").alias(doc))
    same_id = F.col("doc_id").eqNullSafe(F.col(doc))
    once = rows.join(again, same_id, "left_semi").withColumn(digest, digest_of(F.col("text"))).dropDuplicates(["doc_id", digest])
    return rows.join(again, same_id, "left_anti").unionByName(once.drop(digest))


def op7_exact_dedup(spark, sf_dir):
    """All rows by an index that starts empty, in two batches: the ids above the median first, so that of equal texts
    in both the larger id is known when the smaller comes. The sizes are those of whole groups."""
    digests = digests_of(documents(spark, sf_dir))
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", expected_rows=digests.count())
    middle = (digests.approxQuantile("doc_id", [0.5], 0.01) or [0])[0]
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    for batch, part in (("upper", upper), ("lower", ~upper)):
        index.append_new(digests.where(part), batch)
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stored(index.rows().select("digest", "keep_id").join(sizes, "digest"), "groups")
    found = stored(decided(digests, groups, F.lit(True)), "decided")
    index.drop()
    discard(digests, groups)
    return found


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
SQL = {
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""
}
