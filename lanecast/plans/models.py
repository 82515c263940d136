"""Logistic models fitted before every month, and what is done with their probabilities: losses, calibration, rules.

No SQL: a penalised optimum is found by iteration. Tests hold the fits against another solver and the steps after them against brute force.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import features, folds, metrics, monthly_models
from lanecast.plans import betting
from lanecast.plans.contest import candidates_of, full_fields
from lanecast.plans.registry import Registry
from lanecast.sources import ledgers

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL
MONTHS, LANES = 12, 6  # that the first model has seen
NAMES = ("quantity", "form", "odds")
PARTS = 96


def model_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dt.date]]:
    """race_id, race_class, month (number), label (the winner's lane less one), x, stored; the months' first days."""
    return model_rows_of(full_fields(spark, sf_dir))


def model_rows_of(fields: DataFrame) -> tuple[DataFrame, list[dt.date]]:
    spark = fields.sparkSession
    d = fields.withColumn("score", pricing.finish_score(F.col("finish"), F.lit(True)))
    d = features.lane_features(d)
    day = [F.max(c).alias(c) for c in ("race_date", "race_class")]
    w = features.wide(d, list(NAMES), LANES, F.max(F.when(F.col("won"), F.col("lane") - 1)).cast("int").alias("label"), *day)
    w = w.select("race_id", "race_class", F.trunc("race_date", "month").alias("m"), "label", F.array(*[F.col(f"lane{n}_{x}").cast("double") for n in range(1, LANES + 1) for x in NAMES]).alias("x"))
    # a month's rows count in all models after it, so months are dealt evenly; a row is few bytes and much work: a number given is kept
    w = ledgers.stored(w.repartition(PARTS, "race_id").sortWithinPartitions("m"), "model-rows")
    months = [r["m"] for r in w.select("m").distinct().orderBy("m").collect()]  # a row a month
    number = spark.createDataFrame(list(enumerate(months)), "month int, m date")
    return w.join(F.broadcast(number), "m").drop("m"), months  # a row a month


def by_lane(scored: DataFrame) -> DataFrame:
    """A row a lane: lane, p, won."""
    d = scored.select(*[c for c in scored.columns if c != "probs"], F.posexplode("probs").alias("lane", "p"))
    return d.withColumn("won", F.col("lane") == F.col("label")).withColumn("lane", F.col("lane") + 1).drop("label")


def fitted(rows: DataFrame, months: list[dt.date]) -> monthly_models.Models:
    return monthly_models.fitted(rows, len(months), LANES, LANES * len(NAMES), MONTHS)


def first_day(months: list[dt.date]) -> Column:
    """Of the month's number."""
    return F.element_at(F.array(*[F.lit(m) for m in months]), F.col("month") + 1) if months else F.lit(None).cast("date")


@R.query()
def logistic_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by test month of the model fitted before it."""
    rows, months = model_rows(spark, sf_dir)
    d = metrics.race_losses(by_lane(fitted(rows, months).score(rows)), ["race_id", "month"], "p", "won")
    return metrics.summary(d, ["month"]).withColumn("test_start", first_day(months)).drop("month")


@R.query()
def logistic_losses_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same races' losses pooled over all months, by class."""
    rows, months = model_rows(spark, sf_dir)
    return metrics.summary(metrics.race_losses(by_lane(fitted(rows, months).score(rows)), ["race_id", "race_class"], "p", "won"), ["race_class"])


def calibrated(models: monthly_models.Models, rows: DataFrame) -> DataFrame:
    """race_id, month, lane, won, p, p_calibrated: by the model that ends two months before, recalibrated on its favourites of the month between."""
    between = by_lane(models.score(rows)).groupBy((F.col("month") + 1).alias("month"), "race_id").agg(F.max("p").alias("c"), F.max_by("won", F.struct("p", -F.col("lane"))).alias("hit"))
    test = by_lane(models.score(rows, ahead=1))
    return metrics.recalibrate(test, ["month", "race_id"], "p", metrics.calibrator(between, "c", "hit", 10, ["month"]), 10, ["month"])


@R.query()
def logistic_calibration_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By test month: log loss and calibration error of the favourites, raw and recalibrated."""
    rows, months = model_rows(spark, sf_dir)
    d = ledgers.stored(calibrated(fitted(rows, months), rows), "calibrated")
    loss = lambda c: F.avg(F.when(F.col("won"), -F.log(F.greatest(F.col(c), F.lit(1e-12)))))
    out = d.groupBy("month").agg(F.count_if("won").alias("races"), loss("p").alias("raw_loss"), loss("p_calibrated").alias("calibrated_loss"))
    for name, p in (("raw_error", "p"), ("calibrated_error", "p_calibrated")):
        top = d.groupBy("month", "race_id").agg(F.max(p).alias("c"), F.max_by("won", F.struct(p, -F.col("lane"))).alias("hit"))
        out = out.join(metrics.expected_calibration_error(top, "c", "hit", 10, ["month"]).withColumnRenamed("ece", name), "month")
    return out.withColumn("month", first_day(months))


@R.query()
def logistic_rule_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published grid's rule of each month, chosen on the months before it, on probabilities that no model gave which had seen the
    race's month; whether the month returned more than was staked."""
    kept = ("race_id", "race_date", "race_class", "lane", "racer", "quantity", "rate", "odds", "p", "finish", "won")
    fields = ledgers.stored(full_fields(spark, sf_dir).select(*kept), "fields")  # for the models and the candidates
    rows, months = model_rows_of(fields)
    p = by_lane(fitted(rows, months).score(rows)).select("race_id", F.col("lane").cast("long").alias("lane"), "p")
    c = candidates_of(fields).select(*betting.CANDIDATE).drop("p").join(p, ["race_id", "lane"])
    return betting.grid_choices(ledgers.stored(c, "scored"), 1).withColumn("above", F.col("roi") > 1.0)
