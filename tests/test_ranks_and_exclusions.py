"""Exact order statistics, the order of exclusions, planted late rows, checks over small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanecast.operators import effects, features, metrics, quality, ranks
from lanecast.sources import ledgers


def test_values_at_every_rank(spark):
    rows = [("a", float((k * 37) % 101)) for k in range(3000)] + [("b", 5.0)] * 2000 + [("c", 1.5)] + [("c", None)] + [("d", float(k)) for k in range(5000)]
    d = ledgers.stored(spark.createDataFrame(rows, "g string, v double").repartition(3), "values")
    n = F.col("n")
    got = {r["g"]: r for r in ranks.values_at(d, ["g"], "v", {"first": F.lit(1), "last": n, "third": F.ceil(n / 3), "near_end": F.greatest(F.lit(1), n - 9)}).collect()}
    for g in "abcd":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert (got[g]["n"], got[g]["first"], got[g]["last"], got[g]["third"], got[g]["near_end"]) == (len(v), v[0], v[-1], v[-(-len(v) // 3) - 1], v[max(1, len(v) - 9) - 1])
    whole = ranks.values_at(d, [], "v", {"m": F.ceil(n / 2)}).first()
    v = sorted(x for _, x in rows if x is not None)
    assert whole["m"] == v[(len(v) + 1) // 2 - 1]


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLACK", -2)  # brackets that hold nothing
    d = ledgers.stored(spark.createDataFrame([(float(k % 40),) for k in range(400)], "v double"), "values")
    assert ranks.values_at(d, [], "v", {"m": F.ceil(F.col("n") / 2)}).first()["m"] == 19.0


def test_tail_shares(spark):
    rows = [("r", 0.5, float(k), k) for k in range(250)] + [("one", 1.0, 3.0, 1)] + [("zero", 1.0, 0.0, k) for k in range(5)]
    d = ledgers.stored(spark.createDataFrame(rows, "rule string, threshold double, ret double, race_id int"), "bets")
    got = {r["rule"]: r for r in metrics.tail_concentration(d, ["rule", "threshold"]).collect()}
    assert abs(got["r"]["top_percent_share"] - (249 + 248) / sum(range(250))) < 1e-12 and abs(got["r"]["top_ten_share"] - sum(range(240, 250)) / sum(range(250))) < 1e-12
    assert all(got[x]["top_percent_share"] == got[x]["top_ten_share"] == 0 for x in ("one", "zero"))


def lanes(race, **change):
    rows = [dict(race_id=race, lane=n, late=False, won=n == 2, x=1.0, tilt=0.5) for n in range(1, 7)]
    for key, (lane, value) in change.items():
        rows[lane - 1][key] = value
    return rows


def test_exclusions_in_their_order(spark):
    cases = {
        "used": lanes(1), "six_lanes": lanes(2)[:5], "late_feature": lanes(3, late=(4, True), won=(1, True), x=(1, None)), "one_winner": lanes(4, won=(1, True), x=(3, None)),
        "missing_feature": lanes(5, x=(6, None), tilt=(1, None)), "pre_race_block": lanes(6, tilt=(6, None)),
    }
    twice = [dict(r, race_id=7, lane=max(2, r["lane"])) for r in lanes(7)]
    d = spark.createDataFrame([r for rows in cases.values() for r in rows] + twice, "race_id int, lane int, late boolean, won boolean, x double, tilt double")
    names = {1: None, 2: "six_lanes", 3: "late_feature", 4: "one_winner", 5: "missing_feature", 6: "pre_race_block", 7: "six_lanes"}
    got = {r["race_id"]: r["reason"] for r in d.groupBy("race_id").agg(features.exclusion_reason(["x"], True, ["tilt"]).alias("reason")).collect()}
    assert got == names
    assert {r["race_id"]: r["reason"] for r in features.exclusion(d, ["x"], True, ["tilt"]).select("race_id", "reason").distinct().collect()} == names
    prediction = {r["race_id"]: r["reason"] for r in d.groupBy("race_id").agg(features.exclusion_reason(["x"], False, ["tilt"]).alias("reason")).collect()}
    assert prediction[4] == "missing_feature"


def test_a_planted_late_observation_excludes_its_race(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 12, m)
    entries = spark.createDataFrame([(r, n, t(30)) for r in (1, 2) for n in range(1, 7)], "race_id int, lane int, deadline timestamp")
    seen = [(r, n, t(31 if (r, n) == (2, 3) else 10), 6.7 + n / 100, 0.1, 0.5, n) for r in (1, 2) for n in range(1, 7)] + [(1, 1, t(40), 9.9, 0.9, 9.0, 6)]
    o = spark.createDataFrame(seen, "race_id int, lane int, observed_at timestamp, exhibition_time double, start_timing double, tilt double, course int")
    d = features.pre_race_block(entries, o).withColumn("late", F.col("observed_at") > F.col("deadline")).withColumn("won", F.col("lane") == 1)
    got = {r["race_id"]: r["reason"] for r in d.groupBy("race_id").agg(features.exclusion_reason([], True, features.BLOCK).alias("reason")).collect()}
    assert got == {1: None, 2: "late_feature"}
    assert d.where("race_id = 1 AND lane = 1").first()["tilt"] == 0.5  # the later observation of lane 1 isn't used
    taken = {(r["race_id"], r["lane"]): r["course"] for r in features.course_taken(entries.withColumn("racer", F.lit(1)), o.withColumn("course", F.when(F.col("lane") != 2, 7 - F.col("lane"))), "deadline").collect()}
    assert taken[1, 1] == 6 and taken[1, 2] == 2 and taken[2, 3] == 3  # not seen by the deadline: the lane


def test_checks_of_empty_tables_are_skipped(spark):
    schemas = {
        "races": "race_id long, race_date date, venue long, status string, deadline timestamp, meeting_id long", "entries": "race_id long, lane int, win_rate double, available_at timestamp", "results": "result_id long, race_id long, available_at timestamp",
        "placings": "result_id long, lane int, finish int, state string", "meetings": "meeting_id long, venue long", "odds": "odds double, observed_at timestamp, available_at timestamp", "weather": "weather_date timestamp, available_at timestamp",
    }
    got = quality.audit(**{n: spark.createDataFrame([], s) for n, s in schemas.items()}).collect()
    assert len(got) == 19 and all((r["examined"], r["defects"]) == (0, 0) for r in got)
    assert sum(r["score"] for r in quality.axis_scores(spark.createDataFrame(got)).collect()) == 100


def test_differences_against_controls(spark):
    """A common trend of 2 a day cancels; treated subjects gain 10."""
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    panel = [(s, day(k), 2.0 * k + (10.0 if s < 3 and k >= 6 else 0.0)) for s in range(8) for k in range(12)]
    treated = spark.createDataFrame([(s, day(6)) for s in range(3)] + [(7, day(30))], "subject int, since date")
    r = effects.difference_in_differences(spark.createDataFrame(panel, "subject int, day date, value double"), treated, "subject", "day", "value", 4).first()
    assert (r["subjects"], r["controls"]) == (3, 5) and abs(r["difference"] - 10) < 1e-9 and abs(r["control"] - 8) < 1e-9 and r["se"] < 1e-9


def test_two_way_residuals_of_additive_rows_are_nothing(spark):
    rows = [(s, c, 3.0 * s + 5.0 * c) for s in range(6) for c in range(4)]
    d = effects.two_way(spark.createDataFrame(rows, "s int, c int, y double"), [], ["s"], ["c"], "y", 4)
    assert d.select(F.max(F.abs(F.col("total") - F.col("n") * (F.col("a") + F.col("b"))))).first()[0] < 1e-9


def test_weighted_correlation(spark):
    d = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 3.0), (3.0, 6.0, 0.5), (9.0, -9.0, 0.0)], "x double, y double, w double")
    assert abs(d.agg(effects.weighted_corr("x", "y", "w")).first()[0] - 1) < 1e-12
    assert d.limit(1).agg(effects.weighted_corr("x", "y", "w")).first()[0] is None


@pytest.mark.parametrize("kept", ["odds", "ret"])
def test_realised_quotes(spark, kept):
    d = ledgers.stored(spark.createDataFrame([("r", 2.0, 1.0), ("r", 4.0, 4.0), ("r", 8.0, 2.0), ("r", 10.0, 20.0)], "rule string, odds double, ret double"), "hits")
    r = metrics.quote_realisation(d, ["rule"]).first()
    assert (r["hits"], r["median_x"], r["median_odds"]) == (4, 0.75, 6.0) and kept in d.columns
