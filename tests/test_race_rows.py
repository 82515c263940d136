"""The race board from a row a race."""

import datetime as dt

import __spark_entry__ as entry
import pytest

from lanecast.operators import boards

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["open_race_board", "open_races_by_venue"])
def test_lineitem_is_read_once_and_quotes_are_not_grouped(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1  # before: 2, once for lanes and once for quotes
    assert "collect_list" in plan and "Aggregate [race_id" not in plan  # before: grouped by race and lane, and by race again


def test_readings_by_brute_force(spark):
    """Readings are the race's, not the lane's: a lane that isn't entered counts for them, and a lane without a late quote has no quote."""
    now = dt.datetime(2026, 1, 1, 12)
    schedule = spark.createDataFrame([(r, 1, r, now + dt.timedelta(hours=1), now, False, True) for r in (1, 2, 3)], "race_id long, venue long, race_number int, deadline timestamp, now timestamp, cancelled boolean, surface boolean")
    lanes = spark.createDataFrame([(r, n, True, True, 1.0, 1.0, 6.7, 0.0, n if r == 1 else 7 - n, False, 0.1 * n, None) for r in (1, 2) for n in range(1, 7)], "race_id long, lane long, has_period boolean, has_course boolean, motor_rate double, boat_rate double, exhibition_time double, tilt double, course long, parts_seen boolean, p_card double, p_preview double")
    said = [(1, n, 10.0 * t + n, t) for t in range(1, 8) for n in range(1, 7) if (t + n) % 3] + [(1, 1, 0.5, 7), (1, 9, 3.0, 8), (2, 2, 4.0, 1), (2, 2, 5.0, 1)]
    quotes = spark.createDataFrame(said, "race_id long, lane long, odds double, observed_at int")
    got = {r["race_id"]: r for r in boards.race_board(schedule, lanes, quotes, 360).collect()}
    for race in (1, 2):
        last = sorted({t for r, _, _, t in said if r == race})[-boards.READINGS :]
        for lane in got[race]["lanes"]:
            assert (lane["history"] or []) == [o for _, o in sorted((t, o) for r, n, o, t in said if r == race and n == lane["lane"] and t in last)]
    assert got[1]["odds_history"] == [41.0, 61.0, 0.5, 71.0]  # of readings 4 to 8; of equal readings the lower odds come first
    assert not got[1]["availability"]["current_odds"]  # the latest reading is of a lane that isn't entered
    assert (got[2]["best_lane"], got[2]["odds"]) == (6, None) and got[2]["availability"]["current_odds"] and "course_change_of_pick" in got[2]["reasons"]
    assert got[3]["decision"] == "waiting" and got[3]["odds_history"] == [] and got[3]["best_lane"] is None
