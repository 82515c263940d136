"""Prices, probabilities, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
PRICE_EDGES = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 10.0, 20.0, 50.0)
ROUNDS = (("t-2", 0.0, 5.0), ("t-10", 5.0, 20.0), ("t-60", 20.0, 90.0))
COURSE_BASE = {1: 0.5343, 2: 0.1482, 3: 0.1277, 4: 0.1127, 5: 0.0605, 6: 0.0203}
COURSE_SHRINKAGE = {1: 7.7, 2: 27.0, 3: 28.0, 4: 31.0, 5: 45.6, 6: 48.0}
FORM_SHRINKAGE = 3.0


def implied(odds: Column) -> Column:
    return F.when(odds > 0, 1.0 / odds)


def price_band(odds: Column, edges: tuple[float, ...] = PRICE_EDGES) -> Column:
    """[low, high) by label; "[low, )" from the last edge on; null below the first."""
    out = F.when(odds >= edges[-1], f"[{edges[-1]:g}, )")
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        out = out.when((odds >= low) & (odds < high), f"[{low:g}, {high:g})")
    return out


def rounds(spark: SparkSession) -> DataFrame:
    """Both ends belong to a round, so leads of 5 and 20 minutes are in two."""
    return spark.createDataFrame(list(ROUNDS), "round string, least double, most double")


def minutes_before(deadline: Column, at: Column) -> Column:
    """With fractions of a second: a lead of 4:59.9 is not one of five minutes."""
    return (F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60e6


def in_round(lead: Column) -> Column:
    return lead.between(F.col("least"), F.col("most"))


def margin(calibration_error: Column, n: Column, spread: Column, w1: float, w2: float) -> Column:
    """Calibration error + w1 / sqrt(n) + w2 * spread."""
    return calibration_error + w1 / F.sqrt(n) + w2 * spread


def conservative_value(p: Column, margin_: Column, odds: Column) -> Column:
    return F.greatest(F.lit(0.0), p - margin_) * odds


FORMULA_VERSION = "margin-1"


def value_report(p: Column, odds: Column, calibration_error: Column, n: Column, spread: Column, w1: float = 1.0, w2: float = 1.0) -> Column:
    """struct<raw, conservative, margin, version>: both expected values, the margin between their probabilities, and the formula's
    version; null unless 0 <= p <= 1 and odds > 0."""
    m = margin(calibration_error, n, spread, w1, w2)
    return F.when(p.between(0, 1) & (odds > 0), F.struct((p * odds).alias("raw"), conservative_value(p, m, odds).alias("conservative"), m.alias("margin"), F.lit(FORMULA_VERSION).alias("version")))


def log_deviation(actual: Column, predicted: Column) -> Column:
    return F.when(actual.isNotNull() & predicted.isNotNull(), F.log(actual / predicted))


def finish_score(position: Column, has_result: Column) -> Column:
    """(7 - position) / 6; a result without a position is 0, no result is null."""
    return F.when(position.isNotNull(), (7 - position) / 6.0).when(has_result, 0.0)


def shrunk_form(average: Column, n: Column, win_rate: Column, k: float = FORM_SHRINKAGE) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, win_rate / 10).otherwise((average * n + win_rate / 10 * k) / (n + k))


def course_constants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, COURSE_BASE[c], COURSE_SHRINKAGE[c]) for c in COURSE_BASE], "course int, base double, k double")


def shrunk_rate(wins: Column, starts: Column, base: Column, k: Column) -> Column:
    """Empirical Bayes; (0) for a course that has no constants."""
    return F.when(base.isNull(), 0.0).otherwise((wins + k * base) / (starts + k))


def confidence_bin(p: Column, n: int) -> Column:
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")


def expected_return(p: Column, odds: Column) -> Column:
    """Of 100 staked, rounded half to even."""
    return F.bround(p * odds * 100, 0)


def win_payout(stake: Column, odds: Column) -> Column:
    return F.bround(stake * odds, 0)


def race_state(cancelled: Column, has_result: Column, has_first: Column, past_deadline: Column) -> Column:
    return F.when(cancelled, "cancelled").when(~has_result, F.when(past_deadline, "pending").otherwise("upcoming")).when(has_first, "finished").otherwise("void")


def decision(critical_missing: Column, expected: Column) -> Column:
    """expected: return per 100 staked."""
    return F.when(critical_missing, "waiting").when(expected >= 100, "candidate").otherwise("skip")


def uniform(*parts: Column) -> Column:
    """[0, 1) from md5 of the parts, so that it doesn't depend on partitioning and any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts: Column) -> Column:
    """Box-Muller on two such draws."""
    u1, u2 = uniform(*parts, F.lit("u")), uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * F.lit(3.141592653589793) * u2)
