"""Point in time: what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecast.functions import pricing

TIMES = ("event_time", "published_at", "collected_at", "available_at")


def known_at(df: DataFrame, at: Column, available: str = "available_at") -> DataFrame:
    return df.where(F.col(available) <= at)


def valid_at(df: DataFrame, at: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return df.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))


def temporal_violations(df: DataFrame) -> DataFrame:
    """Rows whose times aren't in order, with the first pair that isn't."""
    checks = [*zip(TIMES, TIMES[1:], strict=False), ("valid_from", "valid_to")]
    wrong = F.coalesce(*[F.when(F.col(a) > F.col(b), F.lit(f"{a} > {b}")) for a, b in checks])
    return df.withColumn("violation", wrong).where("violation IS NOT NULL")


def versions(df: DataFrame, keys: list[str], available: str = "available_at") -> DataFrame:
    """Adds valid_from, valid_to: each version holds until the next becomes available."""
    w = Window.partitionBy(*keys).orderBy(available)
    return df.withColumn("valid_from", F.col(available)).withColumn("valid_to", F.lead(available).over(w))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str = "valid_to", how: str = "left") -> DataFrame:
    """Point-in-time join: equal keys, start <= at < end. The equi part is a hash or merge join, the range its residual."""
    r = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    for k in keys:
        on = on & (left[k] == F.col(f"__{k}"))
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], order: str | None = None) -> DataFrame:
    """For each left row the latest right row of its keys with right_time <= left_time, and `found`.

    One sort by (keys, time) of both sides together and a last-value window, so a key with many versions isn't
    multiplied by its queries. Ties of right_time: the smallest `order`.
    """
    names = [*left.columns]
    tie = F.col(order) if order else F.lit(0)
    latest = Window.partitionBy(*keys, right_time).orderBy(tie)
    r = right.withColumn("__nth", F.row_number().over(latest)).where("__nth = 1")
    r = r.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__value"))
    l = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__value", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select(*[F.col(f"__row.{c}").alias(c) for c in names], *[F.col(f"__value.{c}").alias(c) for c in values], F.col("__value").isNotNull().alias("found"))


def latest_version(df: DataFrame, keys: list[str], at: Column, order: str, available: str = "available_at") -> DataFrame:
    """Of each key the version of greatest availability among those known and valid at `at`; ties: the smallest order."""
    w = Window.partitionBy(*keys).orderBy(F.col(available).desc(), F.col(order))
    return valid_at(known_at(df, at, available), at).withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def exactly_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the value, or the reason why there is none."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias(value))
    return g.select(*keys, F.when(F.col("n") == 1, F.col(value)).alias(value), F.when(F.col("n") > 1, "ambiguous").alias("reason"))


def earliest(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Per key the value of the earliest row that has one."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, time).alias(value))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def merge_by_priority(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of `first`, and of `second` those whose whole key `first` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def availability_violations(df: DataFrame, prediction: str, features: dict[str, str], finalised: dict[str, str] | None = None) -> DataFrame:
    """First feature, in the given order, that wasn't available by the prediction; result-derived ones also by their finalised time."""
    each = [F.when(F.col(a).isNull() | (F.col(a) > F.col(prediction)), F.lit(f"{n}: not available")) for n, a in features.items()]
    each += [F.when(F.col(a).isNull() | (F.col(a) > F.col(prediction)), F.lit(f"{n}: not final")) for n, a in (finalised or {}).items()]
    return df.withColumn("violation", F.coalesce(*each)).where("violation IS NOT NULL")


def due(schedule: DataFrame, leads: DataFrame, done: DataFrame, now: Column, tolerance_minutes: float) -> DataFrame:
    """race_id, lead: races within a lead's window of their deadline and without an observation since it opened; the greatest lead."""
    s = schedule.crossJoin(F.broadcast(leads)).withColumn("ahead", pricing.minutes_before(F.col("deadline"), now))
    s = s.where(F.abs(F.col("ahead") - F.col("lead")) <= tolerance_minutes)
    opens = F.col("deadline") - F.make_interval(mins=(F.col("lead") + tolerance_minutes).cast("int"))
    last = done.groupBy("race_id").agg(F.max("observed_at").alias("last"))
    s = s.join(last, "race_id", "left").where(F.col("last").isNull() | (F.col("last") < opens))
    return s.groupBy("race_id").agg(F.max("lead").alias("lead"))
