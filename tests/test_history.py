"""Markets by name, rebuilt series, weather rows, derived tables, forced zeros, value reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import quality, rules, windows
from lanecast.sources import dimensions, ledgers, pages


def test_markets(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 12) - dt.timedelta(minutes=m)
    q = spark.createDataFrame([(1, "1", at(1), 2.0, False), (1, "1", at(0), 3.0, True), (1, "1", at(0), 2.5, True), (1, "1", at(9), 0.0, False), (1, "2", at(30), 9.0, False)], "race_id long, combination string, available_at timestamp, odds double, closing boolean")
    s = spark.createDataFrame([(1, at(0))], "race_id long, deadline timestamp")
    get = lambda name: {(r["combination"], r["odds"]) for r in rules.market(q, s, ["race_id", "combination"], pricing.rounds(spark), name).collect()}
    assert get("closing") == {("1", 2.5)}  # the lower of equal times
    assert get("t-2") == {("1", 2.0)} and get("t-10") == set() and get("t-60") == {("2", 9.0)}
    with pytest.raises(ValueError, match="unknown market"):
        get("t-5")


def test_series_rebuild(spark):
    rows = [(1, 1, 1, 10, None), (1, 1, 2, 11, "b"), (1, 1, 2, 12, "c"), (1, 1, 3, 13, "a"), (1, 1, 3, 14, None), (1, 1, 4, 15, "b"), (1, 2, 9, 16, None), (2, 1, 1, 17, "d")]
    d = spark.createDataFrame(rows, "venue long, session long, day int, race_id long, old_id string")
    titles = spark.createDataFrame([("a", "A"), ("b", None), ("c", "C"), ("d", None)], "old_id string, title string")
    got = {(r["venue"], r["session"]): (r["survivor"], r["title"], r["merged"], r["split_before"], r["repointed"]) for r in windows.series_rebuild(d, titles).collect()}
    assert got == {(1, 1): ("b", "A", 3, True, 4), (2, 1): ("d", None, 1, False, 0)}  # day 2 has c, day 3 has a; day 1 has none


def test_daily_weather_layouts(spark):
    short = ["1", *map(str, range(17))]
    short[1], short[5], short[11] = "0.5 )", "///", "北"
    long = ["2", *map(str, range(20))]
    rows = [(n, c, v) for n, row in enumerate([["day", "x"], short, long, ["3", *"abc"]]) for c, v in enumerate(row)]
    d = spark.createDataFrame([(1, *r) for r in rows], "page long, row_no int, col_no int, cell string")
    got = {r["day"]: r.asDict() for r in pages.daily_weather(d).collect()}
    assert sorted(got) == [1, 2, 3] and [got[k]["rejected"] for k in (1, 2, 3)] == [False, False, True]
    assert got[1]["precipitation_total_mm"] == 0.5 and got[1]["temperature_max_c"] is None and got[1]["wind_max_direction"] == "北"
    assert got[2]["precipitation_total_mm"] == 2.0 and got[2]["wind_prevailing_direction"] is None and got[2]["sunshine_hours"] == 15.0
    assert got[3]["sunshine_hours"] is None


def test_regimes(spark):
    d = spark.createDataFrame([(2, dt.date(2026, 8, 4)), (2, dt.date(2026, 8, 5)), (7, dt.date(2026, 8, 5))], "venue long, day date")
    got = {(r["venue"], r["day"].day, r["regime_type"]): r["value"] for r in dimensions.regimes_at(d, "day").collect()}
    assert len(got) == 6 and got[2, 4, "fuel"] is None and got[2, 5, "fuel"] == "E30" and got[2, 5, "motor_generation"] == "2026" and got[7, 5, "fuel"] is None


def test_materialised(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    source = spark.createDataFrame([(1, 5)], "id long, updated long")
    key = ledgers.fingerprint(spark, {"v": 1}, {"t": source}, "updated")
    assert key == ledgers.fingerprint(spark, {"v": 1}, {"t": source}, "updated") != ledgers.fingerprint(spark, {"v": 1}, {"t": source.union(source)}, "updated")
    for _ in range(2):
        assert ledgers.materialised(spark, f"file://{tmp_path}", key, build).count() == 3
    assert built == [1]
    for _ in range(2):
        ledgers.write_report(spark.range(2), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").count() == 2


def test_forced_zero_and_values(spark):
    d = spark.createDataFrame([(g, k, p) for g, ps in ((1, (0.5, 0.5)), (2, (1.0, 0.0)), (3, (0.7, 0.2))) for k, p in enumerate(ps)], "g long, k long, p double")
    got = {r["g"]: r["violation"] for r in quality.distribution_violations(d, ["g"], "p", 2, zero_at=F.col("k") == 1).collect()}
    assert got == {1: "zero", 3: "zero"}
    v = spark.createDataFrame([(0.5, 3.0), (1.5, 3.0), (0.5, 0.0)], "p double, o double").select(pricing.value_report(F.col("p"), F.col("o"), F.lit(0.1), F.lit(100), F.lit(0.0)).alias("v"), pricing.win_payout(F.lit(100), F.col("o")).alias("w")).collect()
    assert v[0]["v"]["raw"] == 1.5 and abs(v[0]["v"]["conservative"] - 0.9) < 1e-12 and v[1]["v"] is None and v[2]["v"] is None and v[0]["w"] == 300.0
