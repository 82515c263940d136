"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words of the contracts: runs of anything but ASCII white space. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


# Shuffle files of an execution go when it ends: what it made has been written by then.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared checkpoint folder; a local one only where none is set and Spark is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        set_by_context = spark.sparkContext.getCheckpointDir()
        if set_by_context is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = set_by_context or f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        if set_by_context is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*dfs: DataFrame) -> None:
    """Delete what `stored` wrote for these, once nothing will read it again."""
    for df in dfs:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], hot: Column, how: str = "left") -> DataFrame:
    """df with table's columns; table: a row a key. Its hot rows are broadcast, so that df's rows of these stay in place."""
    head = F.broadcast(table.where(hot))
    return df.join(head, keys).unionByName(df.join(head.select(*keys), keys, "left_anti").join(table.where(~hot), keys, how))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(batches: Iterator, text_col: str = "text", rows: int = 256) -> Iterator[tuple]:
    """(batch, list of texts) of Arrow batches, `rows` rows at a time, so that what is made of them stays small;
    null texts are empty."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part, [t or "" for t in part.column(text_col).to_pylist()]


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with `rank` (long, from 0, by the order within each value of group, which isn't null) and `size` (the group's rows).

    Rows are dealt to ranges of (group, order, place in df), so that neither a large group nor equal rows make a large
    task; what a range has of a group is added up, and a row's rank is its place in the range behind those before it.
    df is read twice (its ranges are sampled): give one that is stored. Its names may not be salt, at, part, first, n, rank, size.
    """
    whole = [F.col(group), *order, F.col("salt")]
    dealt = df.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*whole).sortWithinPartitions(*whole)
    dealt = stored(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()), "ranges")  # at: task, then place
    part = F.shiftright("at", 33)
    sums = dealt.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy(group)
    before = F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(group, "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(of_group).alias("size"))
    found = dealt.withColumn("part", part).join(sums, [group, "part"])
    return found.select(*df.columns, (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "size")
