"""Ordered analytics: form, z-scores, sessions, drawdown, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def form_before(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Adds prior_n, prior_avg over strictly earlier days of the key: a range frame, so rows of the same day never see each other."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("prior_n", F.count(value).over(w)).withColumn("prior_avg", F.avg(value).over(w))


def group_z(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Population z-score in the group; 0 where missing, where fewer than two are present, or without spread."""
    w = Window.partitionBy(*group)
    x, sd = F.col(value), F.stddev_pop(value).over(w)
    ok = x.isNotNull() & (F.count(value).over(w) >= 2) & (sd > 0)
    return df.withColumn(out, F.when(ok, (x - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))


def series_sessions(days: DataFrame, venue: str, day: str, counter: str, gap: int = 3) -> DataFrame:
    """Adds session: a day continues its venue's series unless its counter is 1 or more than `gap` days have passed
    since the last day that has a counter; days without one are left out and don't break the chain."""
    w = Window.partitionBy(venue).orderBy(day)
    d = days.where(F.col(counter).isNotNull()).withColumn("__last", F.lag(day).over(w))
    new = (F.col(counter) == 1) | F.col("__last").isNull() | ~F.datediff(F.col(day), F.col("__last")).between(1, gap)
    return d.withColumn("session", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__last")


def series_plan(sessions: DataFrame, venue: str, day: str, old_id: str) -> DataFrame:
    """Per session: first and last day, the series id that survives (the smallest of the earliest day that has one), ids merged."""
    has = sessions.where(F.col(old_id).isNotNull()).groupBy(venue, "session").agg(F.min(F.struct(day, old_id)).alias("s"), F.count_distinct(old_id).alias("merged"))
    span = sessions.groupBy(venue, "session").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("days"))
    return span.join(has, [venue, "session"], "left").select(venue, "session", "start", "end", "days", F.col(f"s.{old_id}").alias("survivor"), F.coalesce("merged", F.lit(0)).alias("merged"))


def series_rebuild(races: DataFrame, titles: DataFrame) -> DataFrame:
    """What putting every race on the series of its session would change. races: venue, session, day, race_id, old_id (null: none);
    titles: old_id, title. Per session: survivor (the smallest id of the earliest day that has one), title (its own, else that of the smallest
    merged id that has one), merged (ids before), split_before (several), repointed (races of days with another id). Rows are summed up
    by day and id first."""
    of = ["venue", "session"]
    days = races.groupBy(*of, "day", "old_id").agg(F.count(F.lit(1)).alias("n"))
    has = days.where("old_id IS NOT NULL").join(titles, "old_id", "left")
    plan = has.groupBy(*of).agg(F.min_by("old_id", F.struct("day", "old_id")).alias("survivor"), F.count_distinct("old_id").alias("merged"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("old_id"))).alias("__other"))
    d = days.join(plan.select(*of, "survivor"), of).groupBy(*of, "day", "survivor").agg(F.sum("n").alias("n"), F.coalesce(F.bool_or(F.col("old_id") != F.col("survivor")), F.lit(False)).alias("moved"))
    moved = d.groupBy(*of).agg(F.sum(F.when(F.col("moved"), F.col("n")).otherwise(0)).alias("repointed"))
    own = titles.select(F.col("old_id").alias("survivor"), "title")
    d = plan.join(moved, of).join(own, "survivor", "left")
    return d.select(*of, "survivor", F.coalesce("title", "__other").alias("title"), "merged", (F.col("merged") > 1).alias("split_before"), "repointed")


def free_starts(starts: DataFrame, venue: str, start: str, tie: str) -> DataFrame:
    """Moves each estimated start, in order, to the first day its venue hasn't given away.

    In order, the day given is the greatest of estimate + 0 and the last given + 1, which is a running maximum of
    estimate - rank: no per-venue loop is needed.
    """
    w = Window.partitionBy(venue).orderBy(start, tie)
    nth = F.row_number().over(w)
    d = starts.withColumn("__r", nth).withColumn("__m", F.unix_date(start) - F.col("__r"))
    running = F.max("__m").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("start_free", F.date_from_unix_date((running + F.col("__r")).cast("int"))).drop("__r", "__m")


def drawdown(df: DataFrame, keys: list[str], order: list[Column], net: str) -> DataFrame:
    """Adds cumulative, peak (0 at least) and drawdown."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("cumulative", F.sum(net).over(w))
    return d.withColumn("peak", F.greatest(F.lit(0.0), F.max("cumulative").over(w))).withColumn("drawdown", F.col("peak") - F.col("cumulative"))


def streaks(df: DataFrame, keys: list[str], order: list[Column], won: str) -> DataFrame:
    """Per key the longest runs of wins and of losses; remove void rows first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    by_outcome = Window.partitionBy(*keys, won).orderBy(*order)
    runs = df.withColumn("island", F.row_number().over(w) - F.row_number().over(by_outcome)).groupBy(*keys, won, "island").agg(F.count(F.lit(1)).alias("run"))
    longest = lambda flag: F.coalesce(F.max(F.when(F.col(won) == flag, F.col("run"))), F.lit(0))
    return runs.groupBy(*keys).agg(longest(True).alias("longest_win"), longest(False).alias("longest_loss"))


def last_readings(df: DataFrame, keys: list[str], time: str, value: str, n: int = 5) -> DataFrame:
    """Per key the last n readings in order of time, with first, last and their ratio."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(value))
    last = df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n)
    g = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(time, value))).alias("h"))
    v = F.transform("h", lambda s: s[value])
    return g.select(*keys, v.alias("readings"), F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"), (F.element_at(v, -1) / F.element_at(v, 1)).alias("drift"))


def recent_average(df: DataFrame, keys: list[str], day: str, value: str, days: int = 10) -> DataFrame:
    """Average of the key's daily means over its last `days` racing days before the row's."""
    daily = df.groupBy(*keys, day).agg(F.avg(value).alias("__mean"))
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-days, -1)
    return df.join(daily.withColumn("recent", F.avg("__mean").over(w)).drop("__mean"), [*keys, day])


def lag_persistence(df: DataFrame, keys: list[str], day: str, value: str, lags: tuple[int, ...] = (1, 2, 3), adjust: str | None = None) -> DataFrame:
    """Correlation of a day's mean with that of the key's 1st, 2nd, 3rd day before; values less the mean of their `adjust`, a column of few
    values such as the lane."""
    if adjust:
        means = df.groupBy(adjust).agg(F.avg(value).alias("__mean"))
        df = df.join(F.broadcast(means), adjust).withColumn(value, F.col(value) - F.col("__mean"))
    w = Window.partitionBy(*keys).orderBy(day)
    daily = df.groupBy(*keys, day).agg(F.avg(value).alias("x"))
    for k in lags:
        daily = daily.withColumn(f"x{k}", F.lag("x", k).over(w))
    return daily.agg(*[F.corr("x", f"x{k}").alias(f"lag{k}") for k in lags])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; the order must end in a unique tiebreaker."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
