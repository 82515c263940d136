"""Losses, calibration, subgroup stability, returns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lanecast.functions import pricing
from lanecast.functions.draws import uniforms
from lanecast.operators import ranks

# fixed values
Z = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.96, 0.99: 2.5758}
EPS = 1e-12

BOOK_PARTS = 64
RESAMPLE_PARTS = 256


def race_losses(df: DataFrame, group: list[str], p: str, won: str) -> DataFrame:
    """Per race: log-loss and Brier of its distribution, and whether the favourite (lowest lane on ties) won."""
    w = F.col(won).cast("int")
    g = df.groupBy(*group).agg(
        F.sum(F.when(F.col(won), -F.log(F.greatest(F.col(p), F.lit(EPS))))).alias("log_loss"),
        F.sum((F.col(p) - w) * (F.col(p) - w)).alias("brier"),
        F.max_by(F.col(won), F.struct(F.col(p), -F.col("lane"))).alias("top1"),
        F.max(p).alias("confidence"),
    )
    return g


def summary(losses: DataFrame, by: list[str]) -> DataFrame:
    return losses.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg(F.col("top1").cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, p: str, hit: str, bins: int, by: list[str] | None = None) -> DataFrame:
    by = by or []
    b = df.withColumn("bin", pricing.confidence_bin(F.col(p), bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(hit).cast("double")).alias("accuracy"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return b.withColumn("part", F.col("n") / total * F.abs(F.col("mean_p") - F.col("accuracy"))).groupBy(*by).agg(F.sum("part").alias("ece"))


def lane_prior(df: DataFrame, by: list[str], lane: str, won: str, smoothing: float, lanes: int = 6) -> DataFrame:
    """(wins + s) / (N + lanes s) for each of the lanes, present or not."""
    wins = df.where(won).groupBy(*by, F.col(lane).cast("int").alias("lane")).agg(F.count(F.lit(1)).alias("wins"))
    return lane_prior_of(wins, by, smoothing, lanes)


def lane_prior_of(wins: DataFrame, by: list[str], smoothing: float, lanes: int = 6) -> DataFrame:
    """As lane_prior, of counts: by, lane, wins."""
    every = wins.sparkSession.range(1, lanes + 1).select(F.col("id").cast("int").alias("lane"))
    total = wins.groupBy(*by).agg(F.sum("wins").alias("n"))
    d = total.crossJoin(F.broadcast(every)).join(wins, [*by, "lane"], "left")
    return d.select(*by, "lane", ((F.coalesce("wins", F.lit(0)) + smoothing) / (F.col("n") + lanes * smoothing)).alias("p"))


def second_given_first(df: DataFrame, by: list[str], first: str, second: str, smoothing: float, lanes: int = 6) -> DataFrame:
    """(n_ij + s) / (n_i + (lanes - 1) s) over all pairs; the diagonal is exactly 0."""
    spark = df.sparkSession
    every = spark.range(1, lanes + 1).select(F.col("id").cast("int").alias("i"))
    pairs = F.broadcast(every.crossJoin(every.withColumnRenamed("i", "j")))
    n = df.groupBy(*by, F.col(first).cast("int").alias("i"), F.col(second).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    scopes = n.select(*by).distinct() if by else spark.range(1).select()
    d = scopes.crossJoin(pairs).join(n, [*by, "i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy(*by, "i"))
    return d.select(*by, "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise((F.col("n") + smoothing) / (row + (lanes - 1) * smoothing)).alias("p"))


def stability(df: DataFrame, group: str, value: str, confidence: float = 0.95, concentration: float = 0.5) -> DataFrame:
    """Per subgroup: n, mean, normal interval (sample variance; one row has none), share, whether it concentrates."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("v"))
    half = F.when(F.col("n") > 1, Z[confidence] * F.sqrt(F.col("v") / F.col("n"))).otherwise(0.0)
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return g.select(group, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"), share.alias("share"), (share > concentration).alias("concentrated"))


def partial_book(bets: DataFrame, by: list[str], drop: int = 10) -> DataFrame:
    """bets: race_id, ret (return per unit staked), hit. Per group counts, sums and the returns of its `drop` best hits.

    Groups are few and may be large, so races are dealt to BOOK_PARTS parts of each first; a part passes on `drop` returns."""
    d = bets.withColumn("__part", F.pmod(F.xxhash64("race_id"), F.lit(BOOK_PARTS)))
    w = Window.partitionBy(*by, "__part").orderBy(F.col("hit").desc(), F.col("ret").desc())
    d = d.withColumn("__nth", F.row_number().over(w))
    g = d.groupBy(*by, "__part").agg(
        F.count(F.lit(1)).alias("bets"), F.count_distinct("race_id").alias("races"), F.count_if("hit").alias("hits"), F.sum("ret").alias("returned"),
        F.count_if(~F.col("hit") & (F.col("ret") > 0)).alias("refunds"), F.collect_list(F.when(F.col("hit") & (F.col("__nth") <= drop), F.col("ret"))).alias("best"),
    )
    return combined_book(g, by, drop)


def combined_book(parts: DataFrame, by: list[str], drop: int = 10) -> DataFrame:
    """Sums of partial books by a coarser key."""
    sums = [F.sum(c).alias(c) for c in ("bets", "races", "hits", "returned", "refunds")]
    best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, drop)
    return parts.groupBy(*by).agg(*sums, best.alias("best"))


def trimmed(drop: int = 10) -> Column:
    """Of a partial book: the return without the best hits and their stakes; null where there are no more bets than `drop`."""
    rest = F.col("returned") - F.aggregate("best", F.lit(0.0), lambda x, y: x + y)
    return F.when(F.col("bets") > drop, rest / (F.col("bets") - F.size("best")))


def rule_book(bets: DataFrame, by: list[str], drop: int = 10) -> DataFrame:
    """Counts, returns, and the return without the `drop` best hits and their stakes, of bets as partial_book takes them."""
    g = partial_book(bets, by, drop)
    return g.select(*by, "bets", "races", "hits", "refunds", "returned", (F.col("returned") / F.col("bets")).alias("roi"), (F.col("hits") / F.col("bets")).alias("hit_rate"), trimmed(drop).alias("trimmed_roi"))


def tail_concentration(bets: DataFrame, by: list[str]) -> DataFrame:
    """Share of all return in the best 1 % of bets (one at least) and in the best ten; zeros below two bets or without return.

    The sums need no order but the two values where the best end: above such a value all counts, at it as many as are left."""
    n = F.col("n")
    best = {"percent": F.greatest(F.lit(1), F.floor(n / 100)), "ten": F.least(F.lit(10), n)}
    cut = ranks.values_at(bets, by, "ret", {k: n - most + 1 for k, most in best.items()})
    sums = [F.sum("ret").alias("total")] + [c for k in best for c in (F.sum(F.when(F.col("ret") > F.col(k), F.col("ret")).otherwise(0.0)).alias(f"{k}_sum"), F.count_if(F.col("ret") > F.col(k)).alias(f"{k}_n"))]
    d = bets.select(*by, "ret").join(cut, by).groupBy(*by, "n", *best).agg(*sums)
    ok = (n >= 2) & (F.col("total") > 0)
    share = lambda k: F.when(ok, (F.col(f"{k}_sum") + (best[k] - F.col(f"{k}_n")) * F.col(k)) / F.nullif(F.col("total"), F.lit(0.0))).otherwise(0.0)
    return d.select(*by, "n", share("percent").alias("top_percent_share"), share("ten").alias("top_ten_share"))


def quote_realisation(hits: DataFrame, by: list[str]) -> DataFrame:
    """hits: odds, ret. Mean and median of return over quote, and the median quote."""
    d = hits.withColumn("x", F.col("ret") / F.col("odds"))
    middle = lambda c: ranks.values_at(d, by, c, ranks.quantile("m", 0.5)).select(*by, ranks.interpolated("m", 0.5).alias(f"median_{c}"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("hits"), F.avg("x").alias("mean_x")).join(middle("x"), by).join(middle("odds"), by)


def floor_effect(candidates: DataFrame, floor: float, wide: float) -> DataFrame:
    """candidates: race_id, odds, ret, hit. Races by whether their overround is below `wide` and whether a boat stands at the floor: how many,
    implied takeout, shortest and longest quote; what backing the boats at the floor, and all others of these races, returns."""
    at = F.col("odds") <= floor
    r = candidates.groupBy("race_id").agg(
        F.sum(pricing.implied(F.col("odds"))).alias("overround"), F.min("odds").alias("shortest"), F.max("odds").alias("longest"), F.count_if(at).alias("n_floor"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(at, F.col("ret")).otherwise(0.0)).alias("floor_sum"), F.sum("ret").alias("all_sum"), F.count_if(at & F.col("hit")).alias("floor_hits"), F.count_if(F.col("hit")).alias("all_hits"),
    )
    g = r.groupBy((F.col("overround") < wide).alias("low"), (F.col("n_floor") > 0).alias("at_floor"))
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    rest = F.sum("n") - F.sum("n_floor")
    return g.agg(
        F.count(F.lit(1)).alias("races"), F.avg(1 - 1 / F.col("overround")).alias("takeout"), F.avg("shortest").alias("shortest"), F.avg("longest").alias("longest"), F.sum("n_floor").alias("floor_bets"), over(F.sum("floor_hits"), F.sum("n_floor")).alias("floor_hit_rate"),
        over(F.sum("floor_sum"), F.sum("n_floor")).alias("floor_return"), rest.alias("other_bets"), over(F.sum("all_hits") - F.sum("floor_hits"), rest).alias("other_hit_rate"), over(F.sum("all_sum") - F.sum("floor_sum"), rest).alias("other_return"),
    )


def draws(df: DataFrame, n: int) -> DataFrame:
    """Every row once per draw 0..n-1; the draws are a parameter table."""
    return df.crossJoin(F.broadcast(df.sparkSession.range(n).select(F.col("id").cast("int").alias("draw"))))


def poisson_weight(u: Column, most: int = 8) -> Column:
    """Poisson(1) by inversion of a uniform."""
    p = total = 0.36787944117144233
    out = F.when(u < total, 0)
    for k in range(1, most):
        p /= k
        total += p
        out = out.when(u < total, k)
    return out.otherwise(most)


def poisson_steps(most: int = 8) -> list[float]:
    """Where poisson_weight goes up by one."""
    p = total = 0.36787944117144233
    out = [total]
    for k in range(1, most):
        p /= k
        total += p
        out.append(total)
    return out


def resampled(bets: DataFrame, by: list[str], key: list[str], n: int, seed: int = 0) -> DataFrame:
    """by, w, wr (arrays by draw): sums of the Poisson weights of pricing.uniform(seed, draw, *key), alone and times ret, of a part of
    the bets. A part goes through its bets once, n draws of a key at a time, whatever groups the key is in. Groups are few."""
    spark, kinds = bets.sparkSession, dict(bets.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["w array<double>", "wr array<double>"])
    tail = F.concat(*[F.coalesce(F.concat(F.lit("|"), F.col(k).cast("string")), F.lit("")) for k in key])  # as concat_ws: a null is left out
    d = bets.select(*by, F.col("ret").cast("double").alias("__ret"), tail.alias("__key"))

    def sums(batches):
        steps, found = np.array(poisson_steps()), {}
        for batch in batches:
            groups, ret = list(zip(*[batch.column(c).to_pylist() for c in by])), batch.column("__ret").to_numpy(zero_copy_only=False)
            keys, at = np.unique(np.array(batch.column("__key").to_pylist(), dtype=object), return_inverse=True)
            names = sorted(set(groups), key=repr)
            n_of, r_of = np.zeros((len(names), len(keys))), np.zeros((len(names), len(keys)))
            row = np.array([{g: k for k, g in enumerate(names)}[g] for g in groups]) if len(names) > 1 else np.zeros(len(groups), int)
            np.add.at(n_of, (row, at), 1.0), np.add.at(r_of, (row, at), np.nan_to_num(ret))
            for g in names:
                found.setdefault(g, np.zeros((2, n)))
            for across, down, u in uniforms(seed, n, list(keys)):
                w = np.searchsorted(steps, u, side="right").astype(float)
                one, many = n_of[:, down] @ w, r_of[:, down] @ w
                for k, g in enumerate(names):
                    found[g][0, across] += one[k]
                    found[g][1, across] += many[k]
        columns = [[g[k] for g in found] for k in range(len(by))] + [[x[k].tolist() for x in found.values()] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, to_arrow_schema(wanted))], names=[*by, "w", "wr"])

    wanted = spark.createDataFrame([], schema).schema
    return d.repartition(RESAMPLE_PARTS).mapInArrow(sums, wanted)  # a number given is kept: the bets are few bytes and much work


def bootstrap(bets: DataFrame, by: list[str], key: list[str], n: int = 2000, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 percentiles of the return over resamples with Poisson weights, and the share above 1."""
    of = lambda c: F.sum(F.get(c, F.col("draw")))
    d = draws(resampled(bets, by, key, n, seed), n).groupBy(*by, "draw").agg((of("wr") / F.nullif(of("w"), F.lit(0.0))).alias("roi"))
    return d.groupBy(*by).agg(F.percentile("roi", F.lit(0.025)).alias("low"), F.percentile("roi", F.lit(0.975)).alias("high"), F.avg((F.col("roi") > 1).cast("double")).alias("p_above_one"))


def race_deviations(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """race_id, lane and predicted or actual, a row a lane. Per race: lanes that either side has, the greatest and mean absolute
    log ratio of those that both price (null without any), and the lanes that one lacks."""
    d = predicted.join(actual, ["race_id", "lane"], "full_outer").withColumn("ratio", F.abs(pricing.log_deviation(F.col("actual"), F.col("predicted"))))
    missing = F.array_sort(F.collect_list(F.when(F.col("ratio").isNull(), F.col("lane"))))  # six at most
    return d.groupBy("race_id").agg(F.count(F.lit(1)).alias("lanes"), F.max("ratio").alias("max_log"), F.avg("ratio").alias("mean_log"), F.array_join(missing.cast("array<string>"), ",").alias("missing_lanes"))


def entropy_bits(df: DataFrame, by: list[str], p: str) -> DataFrame:
    return df.where(F.col(p) > 0).groupBy(*by).agg((-F.sum(F.col(p) * F.log2(p))).alias("entropy"))


def calibrator(df: DataFrame, p: str, hit: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Bin -> accuracy, in each group of by; an empty bin has its midpoint."""
    spark, by = df.sparkSession, by or []
    every = F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    every = df.select(*by).distinct().crossJoin(every) if by else every
    g = df.groupBy(*by, pricing.confidence_bin(F.col(p), bins).alias("bin")).agg(F.avg(F.col(hit).cast("double")).alias("a"), F.count(F.lit(1)).alias("n"))
    return every.join(g, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("a", (F.col("bin") + 0.5) / bins).alias("value"))


def recalibrate(df: DataFrame, group: list[str], p: str, table: DataFrame, bins: int, by: list[str] | None = None) -> DataFrame:
    """The favourite gets its bin's value, the rest share what remains in proportion; without any rest, evenly. A race whose
    group of by the table lacks has its bin's midpoint."""
    w = Window.partitionBy(*group)
    order = w.orderBy(F.col(p).desc(), "lane")
    d = df.withColumn("__nth", F.row_number().over(order)).withColumn("__top", F.max(p).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    d = d.withColumn("__rest", F.sum(F.when(F.col("__nth") > 1, F.col(p)).otherwise(0.0)).over(w)).withColumn("bin", pricing.confidence_bin(F.col("__top"), bins))
    by = by or []
    d = d.join(table.select(*by, "bin", "value") if by else F.broadcast(table.select("bin", "value")), [*by, "bin"], "left")  # broadcast: as many rows as bins
    d = d.withColumn("value", F.coalesce("value", (F.col("bin") + 0.5) / bins))
    left = 1 - F.col("value")
    new = F.when(F.col("__nth") == 1, F.col("value")).when(F.col("__rest") > 0, F.col(p) / F.nullif(F.col("__rest"), F.lit(0.0)) * left).otherwise(left / F.nullif(F.col("__n") - 1, F.lit(0)))
    return d.withColumn("p_calibrated", new).drop("__nth", "__top", "__n", "__rest", "bin", "value")
