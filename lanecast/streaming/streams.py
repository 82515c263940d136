"""Structured Streaming over observation files: ingest, idempotent append, rounds, latest quotes, freshness, emission."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanecast.functions import pricing
from lanecast.sources.ledgers import shared_folder

QUOTES = "race_id long, bet_type string, combination string, odds double, observed_at timestamp"


def observations(spark: SparkSession, folder: str, schema: str = QUOTES, delay: str = "10 minutes") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder).withWatermark("observed_at", delay)


def idempotent(stream: DataFrame, key: tuple[str, ...] = ("race_id", "bet_type", "combination", "observed_at")) -> DataFrame:
    """The key has the time of observation, so a repeated file adds nothing; state ends with the watermark."""
    return stream.where("odds IS NOT NULL").dropDuplicatesWithinWatermark(list(key))


def in_rounds(stream: DataFrame, schedule: DataFrame, rounds: DataFrame) -> DataFrame:
    """Stream-static join with the schedule; quotes after the deadline never get a round."""
    d = stream.join(schedule, "race_id").where("observed_at <= deadline")
    d = d.withColumn("lead", pricing.minutes_before(F.col("deadline"), F.col("observed_at")))
    return d.join(F.broadcast(rounds), pricing.in_round(F.col("lead")))


def latest(stream: DataFrame, span: str = "1 hour") -> DataFrame:
    """Latest quote per (race, candidate, round) and span of time, of several at that time the least; for update mode. The span is in the
    key, so its state goes when the watermark has passed it: what is held are the candidates quoted within a span and the delay, whatever
    the races so far. latest_of takes the last over the spans."""
    g = stream.groupBy(F.window("observed_at", span), "race_id", "bet_type", "combination", "round")
    return g.agg(F.max_by("odds", F.struct("observed_at", -F.col("odds"))).alias("odds"), F.max("observed_at").alias("observed_at")).drop("window")


def latest_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the updates that `latest` wrote (repeated or partial ones too) each key's quote."""
    return rows.groupBy(*key).agg(F.max_by("odds", F.struct("observed_at", -F.col("odds"))).alias("odds"))


def series_sessions(stream: DataFrame, gap: int = 3) -> DataFrame:
    """stream: venue, day, counter. venue, day, session, as windows.series_sessions gives them, for days that come in order (a batch's are put
    in order); a day that is not after its venue's last is dropped. State: a row a venue."""
    fields = "venue long, day date, session long"

    def add(key, frames, state: GroupState):
        last, session = state.get if state.exists else (None, 0)
        found = []
        for day, counter in sorted({(d, c) for f in frames for d, c in zip(f["day"], f["counter"]) if c == c and c is not None}):
            if last is not None and day <= last:
                continue
            session += int(last is None or counter == 1 or (day - last).days > gap)
            last = day
            found.append((key[0], day, session))
        state.update((last, session))
        yield pd.DataFrame(found, columns=["venue", "day", "session"])

    counted = stream.where("counter IS NOT NULL").select(F.col("venue").cast("long").alias("venue"), "day", F.col("counter").cast("double").alias("counter"))
    return counted.groupBy("venue").applyInPandasWithState(add, fields, "last date, session long", "append", GroupStateTimeout.NoTimeout)


def freshness(stream: DataFrame, width: str = "10 minutes", slide: str | None = None) -> DataFrame:
    w = F.window("observed_at", width, slide) if slide else F.window("observed_at", width)
    return stream.groupBy(w, "bet_type").agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("last")).select(F.col("window.start").alias("start"), "bet_type", "n", "last")


BUCKETS = 64  # of races, by hash: a batch reads those that it has


def bucket(race: Column) -> Column:
    return F.pmod(F.xxhash64(race), F.lit(BUCKETS)).cast("int")


def _of_batch(path: str, batch: DataFrame, columns: list[str]) -> DataFrame:
    """What stands at a path that is partitioned by bucket, of the batch's buckets (at most BUCKETS numbers are collected); nothing
    where nothing was written yet."""
    spark = batch.sparkSession
    wanted = [r[0] for r in batch.select(bucket(F.col("race_id"))).distinct().collect()]
    try:
        return spark.read.parquet(path).where(F.col("bucket").isin(wanted)).select(*columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return batch.where("false").select(*[F.lit(None).cast("long" if c == "race_id" else "string").alias(c) for c in columns])


def predicted(spark: SparkSession, path: str) -> DataFrame:
    """What emit_once wrote; no rows where it has found none yet."""
    return spark.read.schema("race_id long, model_version string, bucket int").parquet(path).select("race_id", "model_version")


def emit_once(predictions_path: str, version: str):
    """foreachBatch: races whose six lanes have all been seen, in this batch or before, and that this version hasn't
    predicted. The lanes of races that are still open go from batch to batch in a folder of their own, so a batch reads those and
    its own races' predictions; one that is run again starts from what the batch before it left."""
    left_open = f"{predictions_path.rstrip('/')}-open-{version}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _of_batch(predictions_path, batch, ["race_id", "model_version"]).where(F.col("model_version") == version).select("race_id")
        lanes = batch.select("race_id", "combination")
        try:
            lanes = lanes.unionByName(spark.read.parquet(f"{left_open}/{batch_id - 1}"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        path = f"{left_open}/{batch_id}"
        seen = lanes.distinct().join(done, "race_id", "left_anti").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("race_id")))
        seen.where("n < 6").drop("n").write.mode("overwrite").parquet(path)
        new = seen.where("n = 6").select("race_id").distinct().withColumn("model_version", F.lit(version)).withColumn("bucket", bucket(F.col("race_id")))
        new.write.mode("append").partitionBy("bucket").parquet(predictions_path)

    return write


def archive(results: DataFrame, path: str) -> None:
    """Writes the archive's race_id as `reconcile` reads it."""
    results.select("race_id", bucket(F.col("race_id")).alias("bucket")).distinct().write.mode("append").partitionBy("bucket").parquet(path)


def reconcile(archive_path: str, out_path: str):
    """foreachBatch: live results of races that the archive hasn't, per whole race; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        archived = _of_batch(archive_path, batch, ["race_id"])
        batch.join(archived, "race_id", "left_anti").write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    return write


def append_batches(path: str):
    """foreachBatch of update mode: changed rows are appended with their batch; a batch that is run again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return write


def last_updates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows appended by append_batches, each key's last."""
    rest = [c for c in rows.columns if c not in (*key, "batch_id")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("__last")).select(*key, "__last.*")


def drained(stream: DataFrame, sink, mode: str = "append") -> None:
    """Runs a stream to the end of what is there; its checkpoint, state included, is in the shared folder."""
    folder = shared_folder(stream.sparkSession, "stream")
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
