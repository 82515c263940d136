"""Draws in numpy are those of Spark's and DuckDB's md5."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lanecast.functions import draws, pricing
from lanecast.operators import metrics


def test_uniforms_are_those_of_md5():
    keys = ["|1|1", "|123456789012|6", "", "|" + "9" * 40, "|" + "x" * 60, "|é|3"]
    got = np.full((len(keys), 1203), np.nan)
    for across, down, u in draws.uniforms(7, 1203, keys):
        got[down, across] = u
    want = [[int(hashlib.md5(f"7|{d}{k}".encode()).hexdigest()[:8], 16) / 4294967296.0 for d in range(1203)] for k in keys]
    assert (got == np.array(want)).all()


def test_bootstrap_is_that_of_a_row_a_draw(spark):
    bets = [(rule, r, r % 6 + 1, (r * 37 % 11) / 4) for r in range(300) for rule in ("a", "b", None) if rule != "a" or r % 3 == 0]
    d = spark.createDataFrame(bets, "rule string, race_id long, lane long, ret double")
    w = metrics.poisson_weight(F.col("u"))
    x = metrics.draws(d, 120).withColumn("u", pricing.uniform(F.lit(0), F.col("draw"), F.col("race_id"), F.col("lane"))).withColumn("w", w)
    x = x.groupBy("rule", "draw").agg((F.sum(F.col("w") * F.col("ret")) / F.sum("w")).alias("roi")).groupBy("rule")
    want = x.agg(F.percentile("roi", F.lit(0.025)).alias("low"), F.percentile("roi", F.lit(0.975)).alias("high"), F.avg((F.col("roi") > 1).cast("double")).alias("p")).collect()
    got = {r["rule"]: r for r in metrics.bootstrap(d, ["rule"], ["race_id", "lane"], 120).collect()}
    assert len(got) == len(want) == 3
    for r in want:
        assert abs(got[r["rule"]]["low"] - r["low"]) < 1e-9 and abs(got[r["rule"]]["high"] - r["high"]) < 1e-9 and got[r["rule"]]["p_above_one"] == r["p"]


def test_bootstrap_hands_on_sums_not_rows(spark):
    d = spark.range(500).select(F.col("id").alias("race_id"), F.lit(1).alias("lane"), F.lit("a").alias("rule"), F.lit(1.0).alias("ret"))
    sums = metrics.resampled(d, ["rule"], ["race_id", "lane"], 40)
    assert sums.count() <= metrics.RESAMPLE_PARTS and all(len(r["w"]) == 40 for r in sums.collect())
