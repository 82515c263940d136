"""Leads with fractions of a second."""

import datetime as dt

from lanecast.functions import pricing
from lanecast.operators import rules


def test_a_lead_just_under_five_minutes_is_in_one_round(spark):
    end = dt.datetime(2024, 1, 1, 12)
    leads = {1: 300.0, 2: 299.5, 3: 1200.5, 4: 1199.5}  # seconds
    quotes = spark.createDataFrame([(r, 2.0, end - dt.timedelta(seconds=s)) for r, s in leads.items()], "race_id long, odds double, available_at timestamp")
    schedule = spark.createDataFrame([(r, end) for r in leads], "race_id long, deadline timestamp")
    rows = rules.market_by_round(quotes, schedule, ["race_id"], pricing.rounds(spark)).collect()
    assert sorted((r["race_id"], r["round"]) for r in rows) == [(1, "t-10"), (1, "t-2"), (2, "t-2"), (3, "t-60"), (4, "t-10")]


def test_streamed_quotes_have_the_same_rounds(spark):
    from lanecast.streaming import streams

    end = dt.datetime(2024, 1, 1, 12)
    quotes = spark.createDataFrame([(1, end - dt.timedelta(seconds=299.5)), (2, end - dt.timedelta(seconds=1199.5))], "race_id long, observed_at timestamp")
    schedule = spark.createDataFrame([(1, end), (2, end)], "race_id long, deadline timestamp")
    assert sorted((r["race_id"], r["round"]) for r in streams.in_rounds(quotes, schedule, pricing.rounds(spark)).collect()) == [(1, "t-2"), (2, "t-10")]
