"""Effects and persistence: differences in differences, same-day comparisons, two-way residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_corr(x: str, y: str, w: str) -> Column:
    """Aggregate: correlation of x and y with weights w; null without spread."""
    total = F.sum(w)
    mean = lambda c: F.sum(F.col(w) * c) / total
    cov = lambda a, b: mean(F.col(a) * F.col(b)) - mean(F.col(a)) * mean(F.col(b))
    spread = F.sqrt(cov(x, x) * cov(y, y))
    return F.when((cov(x, x) > 1e-15) & (cov(y, y) > 1e-15), cov(x, y) / F.nullif(spread, F.lit(0.0)))


def difference_in_differences(panel: DataFrame, treated: DataFrame, subject: str, day: str, value: str, window: int) -> DataFrame:
    """One row: subjects, controls, effect, control, difference, se.

    panel: subject, day, value; treated: a row a treated subject, with its day as `since`. A cohort are the subjects of one such day; each is
    compared with itself, the `window` days from that day on against those before, and beside it stand the subjects that aren't yet
    treated when the cohort's window ends, split at the same day, so a common trend cancels. difference: treated less controls,
    cohorts weighted by their treated subjects that have both sides. se: clustered by subject, which may be a control of several cohorts.

    The panel is summed by subject and day first; a day meets the cohorts within its window only (2 * window of them), whose days are
    a calendar's, so they are broadcast."""
    daily = panel.groupBy(subject, day).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    cohorts = treated.select(F.col("since").alias("cohort")).distinct()
    lag = F.datediff(F.col(day), F.col("cohort"))
    near = daily.join(F.broadcast(cohorts), lag.between(-window, window - 1)).join(treated.select(subject, "since"), subject, "left")  # a row a calendar day
    own, later = F.col("since") == F.col("cohort"), F.col("since").isNull() | (F.datediff("since", "cohort") >= window)
    near = near.where(own | later).withColumn("own", F.coalesce(own, F.lit(False)))
    mean = lambda side: F.sum(F.when(side, F.col("s"))) / F.nullif(F.sum(F.when(side, F.col("n"))), F.lit(0))
    d = near.groupBy("cohort", subject, "own").agg(mean(lag >= 0).alias("after"), mean(lag < 0).alias("before")).where("after IS NOT NULL AND before IS NOT NULL").withColumn("d", F.col("after") - F.col("before"))
    of = lambda flag: F.when(F.col("own") == flag, F.col("d"))
    c = d.groupBy("cohort").agg(F.count(of(True)).alias("n"), F.avg(of(True)).alias("effect"), F.count(of(False)).alias("m"), F.avg(of(False)).alias("control")).where("n > 0 AND m > 0")
    total = c.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("effect")) / F.sum("n")).alias("all_effect"), (F.sum(F.col("n") * F.col("control")) / F.sum("n")).alias("all_control"))
    part = d.join(c, "cohort").crossJoin(F.broadcast(total))  # one row
    score = F.when(F.col("own"), (F.col("d") - F.col("effect")) / F.col("total")).otherwise(-(F.col("d") - F.col("control")) * F.col("n") / (F.col("m") * F.col("total")))
    by_subject = part.withColumn("score", score).groupBy(subject).agg(F.sum("score").alias("score"), F.max(F.col("own").cast("int")).alias("own"), F.max((~F.col("own")).cast("int")).alias("other"))
    sums = by_subject.agg(F.sum("own").alias("subjects"), F.sum("other").alias("controls"), F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("se"))
    return sums.crossJoin(F.broadcast(total)).select("subjects", "controls", F.col("all_effect").alias("effect"), F.col("all_control").alias("control"), (F.col("all_effect") - F.col("all_control")).alias("difference"), "se")


def same_day_comparison(df: DataFrame, by: list[str], day: str, flag: str, value: str) -> DataFrame:
    """Per `by`: what flagged rows get, what the others get on the same days (each day weighted by its flagged rows), and the difference;
    days without both are left out, and counted out of n."""
    d = df.groupBy(*by, day).agg(*[f(F.when(F.col(flag) == v, F.col(value))).alias(n) for v, k in ((True, "on"), (False, "off")) for f, n in ((F.count, f"n_{k}"), (F.avg, f"m_{k}"))])
    d = d.where("n_on > 0 AND n_off > 0").groupBy(*by)
    mean = lambda c: F.sum(F.col("n_on") * F.col(c)) / F.sum("n_on")
    return d.agg(F.count(F.lit(1)).alias("days"), F.sum("n_on").alias("flagged"), F.sum("n_off").alias("others"), mean("m_on").alias("flagged_mean"), mean("m_off").alias("others_mean")).withColumn("difference", F.col("flagged_mean") - F.col("others_mean"))


def two_way(df: DataFrame, by: list[str], subject: list[str], control: list[str], value: str, sweeps: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Sums of the additive fit value ~ control + subject in each group of `by`, by `sweeps` rounds of alternating means, which
    begin with the control: by, subject, control, keep, n, total, a (control's effect), b (subject's).

    Rows are summed up by (by, subject, control, keep) first; each round then moves only those sums."""
    keys = [*dict.fromkeys([*by, *subject, *control, *(keep or [])])]
    d = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).withColumn("b", F.lit(0.0))
    for _ in range(sweeps):
        for side, effect, other in ((control, "a", "b"), (subject, "b", "a")):
            group = [*dict.fromkeys([*by, *side])]
            mean = d.groupBy(*group).agg((F.sum(F.col("total") - F.col("n") * F.col(other)) / F.sum("n")).alias(effect))
            d = d.drop(effect).join(mean, group)
    return d


def persistence(fit: DataFrame, half: str, keys: list[str], value: Column, by: list[str] | None = None) -> DataFrame:
    """Weighted correlation of the keys' early and late values, the weight n1 n2 / (n1 + n2); fit: half (0, 1) and two_way's columns.
    value: an aggregate of its rows."""
    by = by or []
    g = fit.groupBy(*dict.fromkeys([half, *by, *keys])).agg(F.sum("n").cast("double").alias("n"), value.alias("v"))
    side = lambda k: g.where(F.col(half) == k).select(*dict.fromkeys([*by, *keys]), F.col("n").alias(f"n{k}"), F.col("v").alias(f"v{k}"))
    both = side(0).join(side(1), [*dict.fromkeys([*by, *keys])]).withColumn("w", F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), weighted_corr("v0", "v1", "w").alias("persistence"))


def interaction() -> Column:
    """Mean of what two_way leaves."""
    return F.sum(F.col("total") - F.col("n") * (F.col("a") + F.col("b"))) / F.sum("n")
