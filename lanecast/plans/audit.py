"""Quality checks across the tables of cards, results, meetings, odds and weather.

What is wrong is planted by the supplied rows themselves: a card's lane is 1 or 0 for some parts, a place is 9 or missing for
some quantities, a result is missing, doubled or early for some races.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.operators import quality, windows
from lanecast.plans.contest import races, runners, table
from lanecast.plans.registry import Registry
from lanecast.plans.timeline import _DAYS, _days

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_TABLES = _DAYS + """,
rc AS (SELECT r.race_id, r.race_date, r.venue, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'cancelled' ELSE 'scheduled' END AS status, CASE WHEN r.race_id % 97 <> 0 THEN r.deadline END AS deadline,
  (r.venue + (r.race_id % 61 = 0)::INT) * 100000 + s.session AS meeting_id FROM races r JOIN orders ON o_orderkey = r.race_id LEFT JOIN s ON s.venue = r.venue AND s.day = r.race_date),
en AS (SELECT race_id, CASE WHEN part % 89 = 0 THEN 1 WHEN part % 83 = 0 THEN 0 ELSE lane END AS lane, CASE WHEN quantity = 48 THEN 10.4 WHEN quantity < 50 THEN rate END AS win_rate, available_at FROM entries),
rs AS (SELECT race_id * 2 + k AS result_id, race_id, race_date + to_days(CASE WHEN race_id % 59 = 0 THEN 30 ELSE 31 END) AS available_at FROM rc, (VALUES (0), (1)) v(k) WHERE status = 'finished' AND race_id % 41 <> 0 AND (k = 0 OR race_id % 53 = 0)),
pl AS (SELECT result_id, CASE WHEN part % 101 = 0 THEN lane + 1 ELSE lane END AS lane, CASE WHEN quantity = 49 THEN 9 WHEN quantity % 23 <> 0 THEN finish END AS finish, CASE WHEN quantity = 46 THEN 'F' END AS state FROM rs JOIN runners USING (race_id)),
mt AS (SELECT DISTINCT venue * 100000 + session AS meeting_id, venue FROM s),
od AS (SELECT value / 10 AS odds, ts AS observed_at, CASE WHEN user_id % 13 = 0 THEN ts + INTERVAL 1 MINUTE ELSE ts END AS available_at FROM events),
we AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS weather_date, date_trunc('day', ts) + to_hours(CASE WHEN user_id % 17 = 0 THEN -1 ELSE 24 END) AS available_at FROM events)"""

_AUDIT = _TABLES + """, c AS (
SELECT 'completeness' AS axis, 'races_have_six_entries' AS name, count(*) AS examined, count(*) FILTER (n <> 6) AS defects FROM (SELECT rc.race_id, count(en.race_id) AS n FROM rc LEFT JOIN en USING (race_id) WHERE status <> 'cancelled' GROUP BY rc.race_id)
UNION ALL SELECT 'completeness', 'finished_races_have_a_result', count(*), count(*) FILTER (race_id NOT IN (SELECT race_id FROM rs)) FROM rc WHERE status = 'finished'
UNION ALL SELECT 'completeness', 'entries_have_a_national_win_rate', count(*), count(*) - count(win_rate) FROM en
UNION ALL SELECT 'completeness', 'races_have_a_deadline', count(*), count(*) - count(deadline) FROM rc WHERE status <> 'cancelled'
UNION ALL SELECT 'uniqueness', 'one_entry_per_lane', count(*), count(*) - count(DISTINCT (race_id, lane)) FROM en
UNION ALL SELECT 'uniqueness', 'one_result_per_race', count(*), count(*) - count(DISTINCT race_id) FROM rs
UNION ALL SELECT 'uniqueness', 'one_result_entry_per_lane', count(*), count(*) - count(DISTINCT (result_id, lane)) FROM pl
UNION ALL SELECT 'validity', 'lane_numbers_in_range', count(*), count(*) FILTER (lane < 1 OR lane > 6) FROM en
UNION ALL SELECT 'validity', 'finish_positions_in_range', count(*), count(*) FILTER (finish < 1 OR finish > 6 OR (finish IS NULL AND state IS NULL)) FROM pl
UNION ALL SELECT 'validity', 'win_rates_in_range', count(win_rate), count(*) FILTER (win_rate < 0 OR win_rate > 10) FROM en
UNION ALL SELECT 'validity', 'odds_are_quotable', count(*), count(*) FILTER (odds < 1) FROM od
UNION ALL SELECT 'consistency', 'a_race_that_produced_placings_has_a_first', count(*), count(*) FILTER (best IS DISTINCT FROM 1) FROM (SELECT result_id, min(finish) AS best FROM pl WHERE finish IS NOT NULL GROUP BY result_id)
UNION ALL SELECT 'consistency', 'result_lanes_match_the_card', count(*), count(*) FILTER ((rs.race_id, pl.lane) NOT IN (SELECT (race_id, lane) FROM en)) FROM pl JOIN rs USING (result_id) WHERE rs.race_id IN (SELECT race_id FROM en)
UNION ALL SELECT 'consistency', 'races_belong_to_their_venue_meeting', count(*), count(*) FILTER (mt.venue <> rc.venue) FROM rc LEFT JOIN mt USING (meeting_id) WHERE meeting_id IS NOT NULL
UNION ALL SELECT 'consistency', 'meetings_span_a_plausible_series', count(*), count(*) FILTER (days > 9) FROM (SELECT meeting_id, count(DISTINCT race_date) AS days FROM mt LEFT JOIN rc USING (meeting_id) GROUP BY meeting_id)
UNION ALL SELECT 'point_in_time', 'card_features_precede_the_deadline', count(*), count(*) FILTER (available_at > deadline) FROM en JOIN rc USING (race_id) WHERE deadline IS NOT NULL
UNION ALL SELECT 'point_in_time', 'results_do_not_precede_their_race', count(*), count(*) FILTER (available_at <= deadline) FROM rs JOIN rc USING (race_id)
UNION ALL SELECT 'point_in_time', 'odds_available_at_matches_observed_at', count(*), count(*) FILTER (available_at <> observed_at) FROM od
UNION ALL SELECT 'point_in_time', 'weather_is_not_available_before_its_day', count(*), count(*) FILTER (available_at < weather_date) FROM we)"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Of quality.audit."""
    s = windows.series_sessions(_days(spark, sf_dir), "venue", "day", "counter").select("venue", F.col("day").alias("race_date"), "session")
    states = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("race_id"), F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("scheduled").alias("status"))
    rid, q, part = F.col("race_id"), F.col("quantity"), F.col("part")
    meeting = (F.col("venue") + (rid % 61 == 0).cast("int")) * 100000 + F.col("session")
    r = races(spark, sf_dir).join(states, "race_id").join(s, ["venue", "race_date"], "left").select("race_id", "race_date", "venue", "status", F.when(rid % 97 != 0, F.col("deadline")).alias("deadline"), meeting.alias("meeting_id"))
    d = runners(spark, sf_dir)
    e = d.select("race_id", F.when(part % 89 == 0, 1).when(part % 83 == 0, 0).otherwise(F.col("lane")).alias("lane"), F.when(q == 48, 10.4).when(q < 50, F.col("rate")).alias("win_rate"), "available_at")
    known = r.where("status = 'finished' AND race_id % 41 <> 0").withColumn("k", F.explode(F.when(rid % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    res = known.select((rid * 2 + F.col("k")).alias("result_id"), "race_id", F.date_add("race_date", F.when(rid % 59 == 0, 30).otherwise(31)).cast("timestamp_ntz").alias("available_at"))
    p = res.select("result_id", "race_id").join(d, "race_id").select("result_id", F.when(part % 101 == 0, F.col("lane") + 1).otherwise(F.col("lane")).alias("lane"), F.when(q == 49, 9).when(q % 23 != 0, F.col("finish")).alias("finish"), F.when(q == 46, "F").alias("state"))
    m = s.select((F.col("venue") * 100000 + F.col("session")).alias("meeting_id"), "venue").where("meeting_id IS NOT NULL").distinct()
    ev, day = table(spark, sf_dir, "events"), F.date_trunc("day", "ts")
    o = ev.select((F.col("value") / 10).alias("odds"), F.col("ts").alias("observed_at"), F.when(F.col("user_id") % 13 == 0, F.col("ts") + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("ts")).alias("available_at"))
    w = ev.select("user_id", day.alias("weather_date")).distinct().select("weather_date", F.when(F.col("user_id") % 17 == 0, F.col("weather_date") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("weather_date") + F.expr("INTERVAL 24 HOURS")).alias("available_at"))
    return {"races": r, "entries": e, "results": res, "placings": p, "meetings": m, "odds": o, "weather": w}


@R.query(_AUDIT + " SELECT * FROM c")
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """19 checks, each with what it examined and how many were defective."""
    return quality.audit(**tables(spark, sf_dir))


@R.query(_AUDIT + """, w(axis, weight) AS (VALUES ('completeness', 25), ('uniqueness', 15), ('validity', 20), ('consistency', 15), ('point_in_time', 25)), scores AS (SELECT axis, weight * coalesce(avg(1 - defects / examined), 1) AS score FROM w LEFT JOIN c USING (axis) WHERE examined IS NULL OR examined > 0 GROUP BY axis, weight)
SELECT round(sum(score), 9) AS score, CASE WHEN sum(score) >= 95 THEN 'train_or_predict' WHEN sum(score) >= 90 THEN 'predict_with_warning' WHEN sum(score) >= 80 THEN 'research_only' ELSE 'blocked' END AS verdict FROM scores""")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.axis_scores(quality_audit(spark, sf_dir)).agg(F.sum("score").alias("score"))
    return d.select(F.round("score", 9).alias("score"), quality.verdict(F.col("score")).alias("verdict"))
