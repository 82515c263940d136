"""Static tables: venues' regimes and water, published returns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.operators import temporal

# fixed values: venue, first day, certainty of the fuel E30, by day
FUEL = (
    (11, "2025-05-01", "approximate"), (24, "2025-05-01", "approximate"), (6, "2026-04-09", "announced"), (21, "2026-04-16", "announced"), (13, "2026-04-17", "announced"),
    (5, "2026-04-18", "announced"), (18, "2026-04-20", "announced"), (19, "2026-04-29", "announced"), (2, "2026-08-05", "reported"),
)
# fixed values: venue, first day, generation, certainty
MOTORS = ((2, "2026-08-05", "2026", "reported"),)
# fixed values: the water of venues 1 to 24; all others are on sea water
FRESH, BRACKISH = (1, 2, 5, 10, 11, 12, 13), (3, 6)
# fixed values: published return of betting lane 1 always, and its races
LANE_ONE = (0.9032, 634921)


def regimes(spark: SparkSession) -> DataFrame:
    """venue, regime_type, value, certainty, available_at, valid_from, valid_to: each holds until the venue's next of its type."""
    rows = [(v, "fuel", "E30", c, dt.date.fromisoformat(d)) for v, d, c in FUEL] + [(v, "motor_generation", g, c, dt.date.fromisoformat(d)) for v, d, g, c in MOTORS]
    return temporal.versions(spark.createDataFrame(rows, "venue long, regime_type string, value string, certainty string, available_at date"), ["venue", "regime_type"])


def waters(spark: SparkSession) -> DataFrame:
    kind = lambda v: "fresh" if v in FRESH else "brackish" if v in BRACKISH else "sea"
    return spark.createDataFrame([(v, kind(v)) for v in range(1, 25)], "venue long, water string")


def regimes_at(races: DataFrame, day: str) -> DataFrame:
    """Races once a regime type, with the value in force on their day (null before the first); the tables are broadcast, they have a row
    a change of a venue."""
    spark = races.sparkSession
    types = F.explode(F.array(F.lit("fuel"), F.lit("motor_generation")))
    return temporal.range_join(races.withColumn("regime_type", types), F.broadcast(regimes(spark).drop("available_at")), ["venue", "regime_type"], day)
