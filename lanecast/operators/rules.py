"""Selection rules, settlement, ledgers, attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import metrics

# fixed values: the published reason codes
REASON_CODES = (
    "DQ_LOW_DATA_QUALITY", "DQ_MISSING_REQUIRED_DATA", "DQ_POINT_IN_TIME_VIOLATION", "MD_MODEL_DISAGREEMENT", "MD_LOW_CALIBRATION_CONFIDENCE", "MD_OUT_OF_DISTRIBUTION",
    "OD_ODDS_MISSING", "OD_ODDS_STALE", "OD_ODDS_SHARP_CHANGE", "RC_ENTRY_CHANGE", "RC_EXHIBITION_UNSTABLE", "RC_WEATHER_EXTREME",
    "RM_DAILY_LIMIT_REACHED", "RM_MONTHLY_LIMIT_REACHED", "EV_CONSERVATIVE_BELOW_THRESHOLD", "OD_ODDS_UNEXPECTED_VS_MODEL",
)
MISSING = "DQ_MISSING_REQUIRED_DATA"
RANK_PARTS = 1 << 12


def complete_grids(df: DataFrame, group: list[str], priced: Column, size: int | Column) -> DataFrame:
    """Adds complete: at least `size` candidates of the group have a price."""
    return df.withColumn("complete", F.count_if(priced).over(Window.partitionBy(*group)) >= size)


def select_bets(c: DataFrame, thresholds: dict[str, tuple[float, ...]], group: list[str], order: str) -> DataFrame:
    """c: group, p, odds, complete. Bets of confidence (arg-max p, p >= threshold), ev_best (one a race) and ev_all;
    the last two on complete grids only. The grid of thresholds is a broadcast parameter table."""
    spark = c.sparkSession
    grid = F.broadcast(spark.createDataFrame([(r, t) for r, ts in thresholds.items() for t in ts], "rule string, threshold double"))
    w = Window.partitionBy(*group)
    d = c.withColumn("ev", F.col("p") * F.col("odds"))
    d = d.withColumn("by_p", F.row_number().over(w.orderBy(F.col("p").desc(), order))).withColumn("by_ev", F.row_number().over(w.orderBy(F.col("ev").desc_nulls_last(), order)))
    least = {r: min(ts) for r, ts in thresholds.items()}
    no = F.lit(False)
    possible = {"confidence": (F.col("by_p") == 1) & (F.col("p") >= least.get("confidence", 0)), "ev_best": F.col("complete") & (F.col("by_ev") == 1) & (F.col("ev") >= least.get("ev_best", 0)), "ev_all": F.col("complete") & (F.col("ev") >= least.get("ev_all", 0))}
    d = d.where(reduce(lambda a, b: a | b, [possible[r] for r in thresholds], no)).crossJoin(grid)  # what no threshold takes goes first
    on = ((F.col("rule") == "confidence") & (F.col("by_p") == 1) & (F.col("p") >= F.col("threshold"))) | (F.col("complete") & (F.col("ev") >= F.col("threshold")) & ((F.col("rule") == "ev_all") | ((F.col("rule") == "ev_best") & (F.col("by_ev") == 1))))
    return d.where(on)


def settle(bets: DataFrame, payouts: DataFrame, keys: list[str], combination: str = "combination", refund: str = "特払い") -> DataFrame:
    """payouts: keys, combination, payout (per 100). A paid combination hits; else the refund row of its keys returns part of the
    stake without a hit; else nothing. Races without any payout row are left out."""
    rows = F.collect_list(F.struct(F.col(combination).alias("c"), F.col("payout").alias("amount")))  # a race's few paid combinations
    p = payouts.groupBy(*keys).agg(rows.alias("__paid"))
    of = lambda c: F.array_max(F.transform(F.filter("__paid", lambda x: x["c"] == c), lambda x: x["amount"]))
    d = bets.join(p, keys).withColumn("__hit", F.when(F.col(combination) != refund, of(F.col(combination))))
    return d.withColumn("ret", F.coalesce("__hit", of(F.lit(refund)), F.lit(0)) / 100.0).withColumn("hit", F.col("__hit").isNotNull()).drop("__paid", "__hit")


def market_by_round(quotes: DataFrame, schedule: DataFrame, keys: list[str], rounds: DataFrame, seen: str | None = None) -> DataFrame:
    """Latest quote of each candidate in each round before the deadline; ties: the first seen where `seen` names its order,
    else the lower quote."""
    q = quotes.join(schedule, "race_id").withColumn("lead", pricing.minutes_before(F.col("deadline"), F.col("available_at")))
    q = q.join(F.broadcast(rounds), pricing.in_round(F.col("lead")))
    return q.groupBy(*keys, "round").agg(F.max_by("odds", F.struct("available_at", -F.col(seen or "odds"))).alias("odds"))


def market(quotes: DataFrame, schedule: DataFrame, keys: list[str], rounds: DataFrame, name: str) -> DataFrame:
    """keys, round, odds of one market. quotes: closing, odds, available_at, race_id. "closing" is the last of the quotes marked so, on ties the
    lower; any other name a round of the live ones. An unknown name is an error."""
    if name == "closing":
        d = quotes.where("closing AND odds > 0").groupBy(*keys).agg(F.max_by("odds", F.struct("available_at", -F.col("odds"))).alias("odds"))
        return d.withColumn("round", F.lit("closing"))
    if name not in {r for r, *_ in pricing.ROUNDS}:
        raise ValueError(f"unknown market: {name}")
    return market_by_round(quotes.where("NOT closing AND odds > 0"), schedule, keys, rounds.where(F.col("round") == name))


def band_reference(c: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell of complete, priced candidates: n, hit rate, mean return of betting all of it."""
    return c.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("ret").alias("blind_roi"))


def priced_cells(c: DataFrame, cell: list[str], threshold: float) -> DataFrame:
    """band_reference with the implied rate, and beside it what ev_all at the threshold takes of the cell; one aggregate. c: complete candidates."""
    taken = F.col("p") * F.col("odds") >= threshold
    sums = [F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("ret").alias("blind_roi"), F.avg(pricing.implied(F.col("odds"))).alias("implied")]
    return c.groupBy(*cell).agg(*sums, F.count_if(taken).alias("ev_bets"), F.avg(F.when(taken, F.col("ret"))).alias("ev_roi"))


def counterfactual(bets: DataFrame, cells: DataFrame, cell: list[str], by: list[str]) -> DataFrame:
    """What the same cells return blindly: mean of the bets' cell returns, coverage, and the rule's lift over it. Bets are summed up by cell
    before they meet it."""
    d = bets.groupBy(*by, *cell).agg(F.count(F.lit(1)).alias("bets"), F.sum("ret").alias("returned")).join(cells.select(*cell, "blind_roi"), cell, "left")
    inside = F.col("blind_roi").isNotNull()
    covered = F.sum(F.when(inside, F.col("bets")))
    g = d.groupBy(*by).agg((F.sum(F.col("bets") * F.col("blind_roi")) / covered).alias("blind"), (F.coalesce(covered, F.lit(0)) / F.sum("bets")).alias("covered"), (F.sum(F.when(inside, F.col("returned"))) / covered).alias("rule_return"))
    return g.withColumn("lift", F.col("rule_return") / F.nullif(F.col("blind"), F.lit(0.0)))


def ranked(df: DataFrame, by: list[str], u: str, tie: str, name: str) -> DataFrame:
    """Adds name: the row number in each group in order of u, a uniform of [0, 1), and tie. Rows are counted in RANK_PARTS
    ranges of u and numbered within them, so that no window holds a group."""
    d = df.withColumn("__part", F.floor(F.col(u) * RANK_PARTS))
    n = d.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    n = n.select(*by, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(u, tie))
    return d.withColumn("__nth", nth).join(n, [*by, "__part"]).withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def permuted(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """race_id, draw, __from: per draw every race is given another's id: ranks by the draw's hash paired with ranks by a fixed one."""
    to = ranked(ids.withColumn("__u", pricing.uniform(F.lit(seed), F.lit("to"), F.col("race_id"))), [], "__u", "race_id", "__rank").select("__rank", "race_id")
    source = metrics.draws(ids, n).withColumn("__u", pricing.uniform(F.lit(seed), F.col("draw"), F.col("race_id")))
    source = ranked(source, ["draw"], "__u", "race_id", "__rank").select("draw", "__rank", F.col("race_id").alias("__from"))
    return to.join(source, "__rank").drop("__rank")


def permutation_null(races: DataFrame, candidates: DataFrame, threshold: float, n: int, seed: int = 0) -> DataFrame:
    """Per draw every race takes another's probability vector, prices and payouts stay; the return of ev_best at the threshold per draw.

    races: race_id, probs array; candidates: race_id, lane, odds, ret. Only ids are permuted; vectors are joined after.
    """
    field = candidates.groupBy("race_id").agg(F.collect_list(F.struct("lane", "odds", "ret")).alias("__field"))  # a row a lane
    d = permuted(races.select("race_id"), n, seed).join(races.select(F.col("race_id").alias("__from"), "probs"), "__from").join(field, "race_id")
    best = F.array_max(F.transform("__field", lambda c: F.struct((F.element_at("probs", c["lane"]) * c["odds"]).alias("ev"), (-c["lane"]).alias("order"), c["ret"].alias("ret"))))
    return d.select("draw", best.alias("b")).where(F.col("b.ev") >= threshold).groupBy("draw").agg(F.count(F.lit(1)).alias("bets"), F.avg("b.ret").alias("roi"))


def noise_sensitivity(c: DataFrame, threshold: float, sigma: float, n: int, seed: int = 0, by: tuple[str, ...] = (), item: str = "lane") -> DataFrame:
    """Per draw ev_best selects on odds * exp(N(0, sigma)) and settles on the true return; a row a draw, of each pool where `by` names it."""
    draw = pricing.normal(F.lit(seed), F.col("draw"), F.col("race_id"), *map(F.col, by), F.col(item))
    d = metrics.draws(c, n).withColumn("ev", F.col("p") * F.col("odds") * F.exp(sigma * draw))
    return _best_by_draw(d, [*by], item, threshold)


def _best_by_draw(d: DataFrame, by: list[str], item: str, threshold: float) -> DataFrame:
    """Of each draw's races the candidate of greatest ev, the first item on ties; those that reach the threshold."""
    best = d.groupBy("draw", *by, "race_id").agg(F.min_by(F.struct("ev", "ret"), F.struct(-F.col("ev"), F.col(item))).alias("b"))
    return best.where(F.col("b.ev") >= threshold).groupBy("draw", *by).agg(F.count(F.lit(1)).alias("bets"), F.avg("b.ret").alias("roi"))


def pools_against_null(null: DataFrame, real: DataFrame) -> DataFrame:
    """Per pool the null's mean, greatest and population sd beside the real return and its z; null: pool, roi; real: pool, roi."""
    g = null.groupBy("pool").agg(F.avg("roi").alias("null_mean"), F.max("roi").alias("null_max"), F.stddev_pop("roi").alias("null_sd"))
    g = g.join(real.select("pool", F.col("roi").alias("real")), "pool", "left")
    return g.withColumn("z", (F.col("real") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0)))


def against_null(null: DataFrame, real: Column) -> DataFrame:
    """Mean, greatest, population sd of the null and the real return's z."""
    g = null.agg(F.avg("roi").alias("null_mean"), F.max("roi").alias("null_max"), F.stddev_pop("roi").alias("null_sd"))
    return g.withColumn("z", (real - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0)))


def abstention(quality: Column, odds: Column, disagreement: Column, value: Column, least_quality: float, most_disagreement: float, least_value: float, extras: Column | None = None) -> Column:
    """array<string> of published codes in order, without repeats; a missing input is a reason of its own. extras: an array
    of further codes; one that isn't published is an error."""
    own = F.array_compact(F.array(
        F.when(quality.isNull(), MISSING).when(quality < least_quality, "DQ_LOW_DATA_QUALITY"), F.when(odds.isNull(), "OD_ODDS_MISSING"),
        F.when(disagreement.isNull(), MISSING).when(disagreement > most_disagreement, "MD_MODEL_DISAGREEMENT"), F.when(value.isNull(), MISSING).when(value < least_value, "EV_CONSERVATIVE_BELOW_THRESHOLD"),
    ))
    if extras is None:
        return F.array_distinct(own)
    known = F.when(F.forall(extras, lambda c: c.isin(*REASON_CODES)), extras).otherwise(F.raise_error("unknown reason code").cast("array<string>"))
    return F.array_distinct(F.concat(own, known))


def deviation_reason(ratio: Column, most: float) -> Column:
    """Reason of an absolute log ratio of prices, of one lane or the greatest of a field; null where none."""
    return F.when(ratio.isNull(), MISSING).when(ratio > most, "OD_ODDS_UNEXPECTED_VS_MODEL")


def skip_reason(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, F.array_join(reasons, ","))


def ledger_flags(bets: DataFrame, stake: float, daily_cap: float) -> DataFrame:
    """Adds violation: a second bet of a race, or one beyond the day's cap at a fixed stake."""
    nth = F.row_number().over(Window.partitionBy("race_id").orderBy("bet_id"))
    of_day = F.row_number().over(Window.partitionBy("race_date").orderBy("race_id", "bet_id"))
    return bets.withColumn("violation", F.when(nth > 1, "one_bet_per_race").when(of_day * stake > daily_cap, "daily_cap"))


def best_rule(grid_returns: DataFrame, by: list[str], least_bets: int) -> DataFrame:
    """Of each fold's rules with enough bets the one of greatest trimmed return, first in grid order on ties."""
    w = Window.partitionBy(*by).orderBy(F.col("trimmed_roi").desc(), "grid")
    return grid_returns.where(F.col("bets") >= least_bets).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
