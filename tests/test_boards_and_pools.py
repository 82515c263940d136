"""Published codes, ranks, stakes, pools with an absent lane, form within a series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanecast.operators import boards, features, joint, quality, rules


def test_reason_codes_are_the_published_ones_without_repeats(spark):
    d = spark.createDataFrame([(None, 2.0, None, None), (40.0, None, 0.5, 0.0), (90.0, 2.0, 0.1, 1.0)], "q double, o double, m double, v double")
    got = [r[0] for r in d.select(rules.abstention(F.col("q"), F.col("o"), F.col("m"), F.col("v"), 50, 0.3, 0.05)).collect()]
    assert got == [["DQ_MISSING_REQUIRED_DATA"], ["DQ_LOW_DATA_QUALITY", "OD_ODDS_MISSING", "MD_MODEL_DISAGREEMENT", "EV_CONSERVATIVE_BELOW_THRESHOLD"], []]


def test_extra_codes_follow_and_unknown_ones_are_errors(spark):
    d = spark.createDataFrame([(90.0,)], "q double")
    one = lambda *codes: d.select(rules.abstention(F.col("q"), F.lit(2.0), F.lit(0.1), F.lit(1.0), 50, 0.3, 0.05, F.array(*map(F.lit, codes)))).first()[0]
    assert one("RC_ENTRY_CHANGE", "RC_ENTRY_CHANGE") == ["RC_ENTRY_CHANGE"]
    with pytest.raises(Exception, match="unknown reason code"):
        one("NO_SUCH_CODE")


def test_ranks_are_those_of_one_sort(spark):
    d = spark.range(500).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 97).alias("u"), (F.col("id") % 2).alias("g"))
    got = {(r["g"], r["k"]): r["n"] for r in rules.ranked(d, ["g"], "u", "k", "n").collect()}
    rows = sorted((r["g"], r["u"], r["k"]) for r in d.collect())
    for g in (0, 1):
        for n, (_, _, k) in enumerate([r for r in rows if r[0] == g], 1):
            assert got[g, k] == n


def test_stakes(spark):
    day = dt.date(2026, 1, 1)
    d = spark.createDataFrame([(1, 1, day, 100, True), (2, 1, day, 150, True), (3, 1, day, 800, True), (4, 1, day, 300, True), (5, 1, day, 100, False)], "race_id long, lane long, race_date date, stake long, offered boolean")
    got = {r["race_id"]: r["violation"] for r in boards.stake_violations(d, 100, 700, 1300).collect()}
    assert got == {1: None, 2: "unit", 3: "race_limit", 4: "day_limit", 5: "day_limit"}


def test_pools_of_six_and_of_five_lanes(spark):
    six = [(1, n, p) for n, p in enumerate((0.4, 0.2, 0.15, 0.1, 0.1, 0.05), 1)]
    five = [(2, n, 0.2) for n in (1, 2, 3, 5, 6)]
    rows = joint.pools(spark.createDataFrame(six + five, "race_id int, lane int, p double")).collect()
    count, total = {}, {}
    for r in rows:
        key = r["race_id"], r["pool"]
        count[key], total[key] = count.get(key, 0) + 1, total.get(key, 0.0) + r["p"]
    assert [count[1, p] for p in joint.POOLS] == [6, 6, 30, 15, 120, 20, 15]
    assert [count[2, p] for p in joint.POOLS] == [5, 5, 20, 10, 60, 10, 10]
    for (_, pool), t in total.items():
        assert abs(t - {"place": 2, "wide": 3}.get(pool, 1)) < 1e-9
    p = {(r["pool"], r["combination"]): r["p"] for r in rows if r["race_id"] == 1}
    assert abs(p["exacta", "1-2"] - 0.4 * 0.2 / 0.6) < 1e-12
    assert abs(p["trifecta", "2-1-3"] - 0.2 * 0.4 / 0.8 * 0.15 / 0.4) < 1e-12


def test_form_stays_within_its_series_and_before_its_day(spark):
    d = [dt.date(2026, 1, n) for n in (1, 2, 2, 9)]
    rows = [(1, 7, 1, d[0], 1.0), (2, 7, 1, d[1], 0.0), (3, 7, 1, d[2], 0.5), (4, 7, 2, d[3], 1.0), (5, 7, None, d[3], 1.0)]
    e = spark.createDataFrame(rows, "race_id int, racer int, session int, race_date date, score double").withColumn("rate", F.lit(5.0))
    got = {r["race_id"]: (r["prior_n"], round(r["form"], 6)) for r in features.series_form(e, ["session", "racer"], "session").collect()}
    assert got == {1: (0, 0.5), 2: (1, 0.625), 3: (1, 0.625), 4: (0, 0.5), 5: (0, 0.5)}


def test_exact_duplicates_are_compared_by_their_columns(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3)], "k int, v string, o int")
    got = {r["o"]: r["duplicate"] for r in quality.split_duplicates(d, ["k"], ["o"], ["v"]).collect()}
    assert got == {1: None, 2: "exact", 3: "key"}
