"""Leakage-safe feature rows: one definition for training and prediction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lanecast.functions import pricing
from lanecast.operators import temporal, windows

LOOKBACK_DAYS = 10


def exclusion_reason(features: list[str], training: bool, block: list[str] | None = None, over: WindowSpec | None = None) -> Column:
    """The first reason that excludes a race, in this order: six_lanes, late_feature, one_winner (training), missing_feature,
    pre_race_block (a lane without one of `block`); null where none does.

    Of columns race_id, lane, late, won and those named: an aggregate of the race's rows, or over a window of them."""
    agg = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    lacks = lambda names: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names], F.lit(False))
    lanes = agg(F.bit_or(F.when(F.col("lane").between(1, 6), F.pow(F.lit(2), F.col("lane")).cast("int")).otherwise(F.lit(1))))
    reason = F.when((agg(F.count(F.lit(1))) != 6) | (lanes != 126), "six_lanes").when(agg(F.bool_or("late")), "late_feature")
    if training:
        reason = reason.when(agg(F.count_if("won")) != 1, "one_winner")
    reason = reason.when(agg(F.bool_or(lacks(features))), "missing_feature")
    return reason.when(agg(F.bool_or(lacks(block))), "pre_race_block") if block else reason


def exclusion(df: DataFrame, features: list[str], training: bool, block: list[str] | None = None) -> DataFrame:
    """df with the reason of its race."""
    return df.withColumn("reason", exclusion_reason(features, training, block, Window.partitionBy("race_id")))


def lane_features(entries: DataFrame, day: str = "race_date") -> DataFrame:
    """Adds per lane: prior starts and shrunk form of the racer over strictly earlier days, field statistics of the race
    (sample deviation of rates), z-score of the rate in the race (population deviation)."""
    d = windows.form_before(entries, ["racer"], day, "score")
    d = d.withColumn("form", pricing.shrunk_form(F.col("prior_avg"), F.col("prior_n"), F.col("rate")))
    w = Window.partitionBy("race_id")
    d = d.withColumn("field_sd", F.stddev_samp("rate").over(w)).withColumn("n_top", F.count_if(F.col("rate") >= 8).over(w))
    return windows.group_z(d, ["race_id"], "rate", "rate_z")


def series_form(entries: DataFrame, keys: list[str], series: str, day: str = "race_date") -> DataFrame:
    """Adds prior_n and form over strictly earlier days of the keys, which include the series; without a series, none."""
    d = windows.form_before(entries, keys, day, "score").withColumn("prior_n", F.when(F.col(series).isNull(), 0).otherwise(F.col("prior_n")))
    return d.withColumn("form", pricing.shrunk_form(F.col("prior_avg"), F.col("prior_n"), F.col("rate")))


def course_taken(entries: DataFrame, observations: DataFrame, at: str) -> DataFrame:
    """Adds course: the earliest one observed of those known at `at`, else the lane."""
    known = observations.join(entries.select("race_id", "lane", at), ["race_id", "lane"]).where(F.col("observed_at") <= F.col(at))
    seen = temporal.earliest(known, ["race_id", "lane"], "observed_at", "course")
    return entries.join(seen, ["race_id", "lane"], "left").withColumn("course", F.coalesce("course", "lane"))


def course_block(entries: DataFrame, stats: DataFrame, constants: DataFrame, at: str) -> DataFrame:
    """entries: course, racer; stats: racer, period, known, course, n, wins. Adds starts and course_rate, the shrunk win rate on
    the course in the racer's latest period known at `at`; no starts where that period lacks the course."""
    periods = stats.select("racer", "period", "known").distinct()
    d = temporal.asof_join(entries, periods, ["racer"], at, "known", ["period"]).drop("found")
    d = d.join(stats.select("racer", "period", "course", "n", "wins"), ["racer", "period", "course"], "left")
    d = d.join(F.broadcast(constants), "course", "left")  # a row a course
    starts, wins = F.coalesce("n", F.lit(0)), F.coalesce("wins", F.lit(0))
    d = d.withColumn("starts", starts).withColumn("course_rate", pricing.shrunk_rate(wins, starts, F.col("base"), F.col("k")))
    return d.drop("period", "n", "wins", "base", "k")


def wide(df: DataFrame, features: list[str], lanes: int = 6, *more: Column) -> DataFrame:
    """race_id and lane{n}_{feature} for every lane, by one aggregate (no distinct pass for the pivot's values); more: further aggregates."""
    cells = [F.max(F.when(F.col("lane") == n, F.col(f))).alias(f"lane{n}_{f}") for n in range(1, lanes + 1) for f in features]
    return df.groupBy("race_id").agg(*cells, *more)


def long(df: DataFrame, features: list[str], lanes: int = 6) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("lane"), *[F.col(f"lane{n}_{f}").alias(f) for f in features]) for n in range(1, lanes + 1)])
    return df.select("race_id", F.inline(rows))


def field_globals(rate: str, label: str) -> list[Column]:
    """Aggregates of a race: how many are of class A1, and the sample deviation of the rates (0 below two)."""
    return [F.count_if(F.trim(label) == "A1").alias("field_a1_count"), F.coalesce(F.when(F.count(rate) >= 2, F.stddev_samp(rate)), F.lit(0.0)).alias("field_win_rate_sd")]


BLOCK = ["exhibition_time", "tilt", "course"]  # a lane without one of these has no pre-race block; a missing start is allowed


def pre_race_block(entries: DataFrame, observations: DataFrame) -> DataFrame:
    """Earliest observation per (race, lane), with its observed_at: z-scores of time and start in the race, tilt as it is, whether
    the course changed; complete only if all six lanes have BLOCK."""
    first = observations.groupBy("race_id", "lane").agg(F.min_by(F.struct(*[c for c in observations.columns if c not in ("race_id", "lane")]), "observed_at").alias("o"))
    return observed_block(entries.join(first.select("race_id", "lane", "o.*"), ["race_id", "lane"], "left"))


def observed_block(d: DataFrame) -> DataFrame:
    """The block of entries that have their earliest observation beside them; within a race only."""
    d = windows.group_z(windows.group_z(d, ["race_id"], "exhibition_time", "time_z"), ["race_id"], "start_timing", "start_z")
    has = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in BLOCK])
    return d.withColumn("course_changed", (F.col("course") != F.col("lane")).cast("int")).withColumn("block_complete", F.count_if(has).over(Window.partitionBy("race_id")) == 6)


def first_capture(captures: Column) -> Column:
    """Of an entry's own captures (array of structs that begin with observed_at) the earliest."""
    return F.array_min(F.filter(captures, lambda c: c["observed_at"].isNotNull()))


def course_seen(captures: Column, at: Column) -> Column:
    """The earliest course captured of those known at `at`, as course_taken has it."""
    known = F.filter(captures, lambda c: c["course"].isNotNull() & (c["observed_at"] <= at))
    return F.array_min(F.transform(known, lambda c: F.struct(c["observed_at"], c["course"].alias("course"))))["course"]


def history(df: DataFrame, key: list[str], day: str, value: str) -> DataFrame:
    """Design-document features: last 5 and 10 racing days, 30 and 90 days, deviation of the last 10, all strictly before the day."""
    daily = df.groupBy(*key, day).agg(F.avg(value).alias("__m"))
    w = Window.partitionBy(*key).orderBy(F.unix_date(day))
    d = daily.withColumn("last5", F.avg("__m").over(w.rowsBetween(-5, -1))).withColumn("last10", F.avg("__m").over(w.rowsBetween(-10, -1))).withColumn("sd10", F.stddev_samp("__m").over(w.rowsBetween(-10, -1)))
    d = d.withColumn("days30", F.avg("__m").over(w.rangeBetween(-30, -1))).withColumn("days90", F.avg("__m").over(w.rangeBetween(-90, -1)))
    return d.drop("__m")
