"""Operators on literal rows: the cases that decide semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanecast.functions import keys, pricing, text
from lanecast.operators import features, folds, joint, metrics, quality, rules, temporal, windows
from lanecast.sources import ledgers, lines, pages
from lanecast.streaming import streams

D = dt.date


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    lit = F.lit
    r = one(
        spark, keys.race_key(lit(D(2026, 3, 1)), lit(4), lit(9)).alias("key"), keys.valid_key(lit(25), lit(1)).alias("bad"), keys.code(lit(3), lit(1), lit(2)).alias("code"), keys.valid_code(lit(313), 3).alias("twice"),
        text.race_phase(lit("準優　勝戦")).alias("semi"), text.race_phase(lit("準々優勝")).alias("qual"), text.race_phase(lit("順位決定戦")).alias("rank"), text.class_rank(lit(" A1 ")).alias("a1"), text.class_rank(lit("C")).alias("none"),
        text.odds_cell(lit("2.0-2.8")).alias("pair"), text.odds_cell(lit("0.5")).alias("low"), text.start_timing(lit("F.01")).alias("f"), text.with_unit(lit("5 cm")).alias("cm"), text.reading_is_safe(lit("３R時点"), lit(4)).alias("safe"),
        pricing.price_band(lit(3.0)).alias("band"), pricing.expected_return(lit(0.5), lit(1.25)).alias("even"), pricing.shrunk_rate(lit(0), lit(5), lit(None).cast("double"), lit(1.0)).alias("unknown"), keys.deadline(lit(D(2026, 3, 1)), lit("17:41")).alias("utc"),
        keys.filename_date(lit("k260301")).alias("file"), lines.era_date(lit("H010203")).alias("era"),
    )
    assert r["key"] == "2026-03-01-04-09" and not r["bad"] and r["code"] == 312 and not r["twice"]
    assert (r["semi"], r["qual"], r["rank"], r["a1"], r["none"]) == ("semifinal", "qualifier", "unknown", 4.0, None)
    assert r["pair"] == (2.0, 2.8) and r["low"] == (None, None) and r["f"] == (0.01, True) and r["cm"] == 5.0 and r["safe"]
    assert r["band"] == "[3, 4)" and r["even"] == 62.0 and r["unknown"] == 0.0 and r["utc"] == dt.datetime(2026, 3, 1, 8, 41)
    assert r["file"] == D(2026, 3, 1) and r["era"] == D(1989, 2, 3)


def test_form_never_sees_its_own_day(spark):
    rows = [(1, D(2026, 1, 1), 1.0), (1, D(2026, 1, 1), 0.0), (1, D(2026, 1, 2), 0.5)]
    d = windows.form_before(spark.createDataFrame(rows, "racer int, day date, score double"), ["racer"], "day", "score")
    assert sorted((r["prior_n"], r["prior_avg"]) for r in d.collect() if r["day"].day == 2) == [(2, 0.5)]
    assert {r["prior_n"] for r in d.collect() if r["day"].day == 1} == {0}


def test_future_rows_change_nothing(spark):
    q = spark.createDataFrame([(1, 10)], "k int, t int")
    v = [(1, 5, "a"), (1, 5, "b"), (1, 9, "c")]
    for extra in ([], [(1, 11, "z")]):
        r = temporal.asof_join(q, spark.createDataFrame(v + extra, "k int, s int, x string"), ["k"], "t", "s", ["x"], "x").first()
        assert (r["x"], r["found"]) == ("c", True)


def test_sessions_and_free_starts(spark):
    days = [(1, D(2026, 1, 1), 1), (1, D(2026, 1, 2), None), (1, D(2026, 1, 4), 3), (1, D(2026, 1, 8), 2), (1, D(2026, 1, 9), 1)]
    s = windows.series_sessions(spark.createDataFrame(days, "v int, d date, c int"), "v", "d", "c")
    assert [r["session"] for r in s.orderBy("d").collect()] == [1, 1, 2, 3]
    e = spark.createDataFrame([(1, D(2026, 1, 1), 1), (1, D(2026, 1, 1), 2), (1, D(2026, 1, 2), 3), (1, D(2026, 1, 9), 4)], "v int, s date, n int")
    assert [r["start_free"].day for r in windows.free_starts(e, "v", "s", "n").orderBy("n").collect()] == [1, 2, 3, 9]


def test_joint_is_coherent(spark):
    p = spark.createDataFrame([(1, k, x) for k, x in enumerate((0.4, 0.2, 0.15, 0.1, 0.1, 0.05), 1)] + [(2, 1, 1.0)] + [(2, k, 0.0) for k in range(2, 7)], "race_id int, lane int, p double")
    ex = joint.exacta(p)
    assert joint.incoherent(p, ex).count() == 0
    totals = {(r["race_id"], r["pool"]): (r["n"], round(r["t"], 9)) for r in joint.pools(p).groupBy("race_id", "pool").agg(F.count("*").alias("n"), F.sum("p").alias("t")).collect()}
    for race in (1, 2):
        assert {k: totals[race, k] for k in keys.POOL_SIZES} == {k: (n, {"place": 2.0, "wide": 3.0}.get(k, 1.0)) for k, n in keys.POOL_SIZES.items()}


def test_rules_settlement_and_trim(spark):
    c = spark.createDataFrame([(1, k, 1 / 6, 5.0 + k) for k in range(1, 7)], "race_id int, lane int, p double, odds double").withColumn("combination", F.col("lane").cast("string"))
    c = rules.complete_grids(c, ["race_id"], F.col("odds").isNotNull(), 6)
    bets = rules.select_bets(c, {"confidence": (0.1,), "ev_best": (1.0,), "ev_all": (1.5,)}, ["race_id"], "lane")
    assert sorted((r["rule"], r["lane"]) for r in bets.collect()) == [("confidence", 1), ("ev_all", 4), ("ev_all", 5), ("ev_all", 6), ("ev_best", 6)]
    pay = spark.createDataFrame([(1, "特払い", 70.0)], "race_id int, combination string, payout double")
    assert {(r["ret"], r["hit"]) for r in rules.settle(bets, pay, ["race_id"]).collect()} == {(0.7, False)}
    many = spark.createDataFrame([("r", k, float(k), True) for k in range(1, 13)], "rule string, race_id int, ret double, hit boolean")
    assert metrics.rule_book(many, ["rule"]).first()["trimmed_roi"] == 1.5
    assert metrics.rule_book(many.where("race_id <= 10"), ["rule"]).first()["trimmed_roi"] is None


def test_identical_vectors_make_the_null_the_real_return(spark):
    races = spark.createDataFrame([(r, [0.5, 0.5]) for r in range(9)], "race_id int, probs array<double>")
    c = spark.createDataFrame([(r, k, 3.0, float(k)) for r in range(9) for k in (1, 2)], "race_id int, lane int, odds double, ret double")
    assert {r["roi"] for r in rules.permutation_null(races, c, 1.0, 3).collect()} == {1.0}
    p = c.withColumn("p", F.lit(0.5))
    assert {r["roi"] for r in rules.noise_sensitivity(p, 1.0, 0.0, 3).collect()} == {1.0}


def test_exclusion_order(spark):
    rows = [(1, k, k == 1, True, 1.0) for k in range(1, 6)] + [(2, k, k == 1, k == 2, None) for k in range(1, 7)] + [(3, k, k < 3, False, 1.0) for k in range(1, 7)] + [(4, k, k == 1, False, None if k == 6 else 1.0) for k in range(1, 7)] + [(5, k, k == 1, False, 1.0) for k in range(1, 7)]
    d = features.exclusion(spark.createDataFrame(rows, "race_id int, lane int, won boolean, late boolean, x double"), ["x"], True)
    assert dict(d.select("race_id", "reason").distinct().collect()) == {1: "six_lanes", 2: "late_feature", 3: "one_winner", 4: "missing_feature", 5: None}


def test_validation_duplicates_quarantine(spark):
    d = spark.createDataFrame([("1", "4001"), (None, "x"), ("7", None)], "lane_number string, registration_number string")
    got = [[(f["field"], f["code"], f["message"]) for f in r["failures"]] for r in quality.validate(d, quality.LANE_FIELDS).collect()]
    assert got == [[], [("lane_number", "E003", "required"), ("registration_number", "E006", "type")], [("lane_number", "E005", "max"), ("registration_number", "E003", "required")]]
    rows = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2)], "k int, x string, n int")
    assert [r["duplicate"] for r in quality.split_duplicates(rows, ["k"], ["n"]).orderBy("n").collect()] == [None, "exact", "key"]
    bad = d.where("lane_number = '7'").withColumn("code", F.lit("E005"))
    record = ["lane_number", "registration_number"]
    store = quality.quarantine(None, bad, record)
    assert quality.quarantine(store, bad, record).count() == 1
    fix = store.select("quarantine_id", F.lit("6").alias("lane_number"), F.lit("4001").alias("registration_number"))
    done = quality.replay(store, fix, quality.LANE_FIELDS).first()
    assert done["state"] == "replayed" and done["lane_number"] == "7"
    once = quality.replay(store, fix.union(fix), quality.LANE_FIELDS)
    other = fix.withColumn("lane_number", F.lit("2"))
    again = quality.replay(once, other, quality.LANE_FIELDS)
    assert once.count() == 1 and again.collect() == once.collect()


def test_a_race_is_emitted_once_and_a_batch_may_run_again(spark, tmp_path):
    lanes = spark.createDataFrame([(r, str(k)) for r in (1, 2) for k in range(1, 7 if r == 1 else 6)], "race_id long, combination string")
    write = streams.emit_once(str(tmp_path / "emitted"), "v1")
    write(lanes, 0)
    write(lanes, 0)
    assert [r["race_id"] for r in spark.read.parquet(str(tmp_path / "emitted")).collect()] == [1]
    put = streams.append_batches(str(tmp_path / "updates"))
    for k, n in ((0, 1), (1, 2), (1, 2)):
        put(spark.createDataFrame([("a", n)], "k string, n int"), k)
    assert streams.last_updates(spark.read.parquet(str(tmp_path / "updates")), ["k"]).collect() == [("a", 2)]


def test_folds_refuse_overlap():
    with pytest.raises(ValueError):
        folds.check_no_overlap(D(2026, 2, 1), D(2026, 2, 1))


def test_grids_and_feeds(spark):
    html = "<h2>t</h2><table><tr><th>1</th><th>2</th></tr><tr><td>2</td><td>5.6</td><td>1</td><td>7.0</td></tr><tr><td>3</td><td>欠場</td><td>3</td><td><b>9.1</b></td></tr></table>"
    cells = pages.table_cells(spark.createDataFrame([("p", html)], "page string, html string"), "page", "html", "<h2>t</h2>")
    assert {(r["combination"], r["odds"]) for r in pages.pair_grid(cells, True).collect()} == {("1-2", 5.6), ("2-1", 7.0), ("2-3", 9.1)}
    feed = ['{"previews":[{"date":"d","stadium_number":1,"number":2,"boats":[{"racer_boat_number":1,"racer_start_timing":-0.02}]}]}', '{"previews":[{"date":"d","stadium_number":1,"number":3,"boats":{"1":{"racer_boat_number":4,"racer_course_number":5,"racer_start_timing":0.1}}}]}']
    got = {(r["number"], r["lane"], r["course"], r["start_timing"], r["flying"]) for r in pages.previews(spark.createDataFrame([(x,) for x in feed], "value string")).collect()}
    assert got == {(2, 1, 1, 0.02, True), (3, 4, 5, 0.1, False)}


def test_ledgers(spark):
    files = spark.createDataFrame([("a", "h1", 3), ("b", "h2", 0), ("c", "h1", 3)], "path string, sha256 string, size int")
    first = ledgers.ingest(files, None, "v1")
    assert sorted((r["sha256"], r["state"]) for r in first.collect()) == [("h1", "ok"), ("h2", "failed")]
    assert ledgers.ingest(files, first, "v1").count() == 0 and ledgers.ingest(files, first, "v2").count() == 2
    t = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, m string")
    filled, counts = ledgers.back_fill(t, spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (9, "z")], "k int, m string"), ["k"], "m")
    assert {r["k"]: r["m"] for r in filled.collect()} == {1: "a", 2: "x", 3: None}
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"matched": 1, "already_set": 1, "no_value": 1, "not_found": 1}


def test_result_stays_when_partitions_change(spark):
    rows = spark.createDataFrame([(k % 7, k, float(k % 5)) for k in range(200)], "g int, lane int, p double")
    runs = {tuple(map(tuple, windows.top_n(rows.repartition(n), ["g"], [F.col("p").desc(), F.col("lane")], 2).orderBy("g", "rank").collect())) for n in (1, 3, 7)}
    assert len(runs) == 1
