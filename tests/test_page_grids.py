"""Odds grids stay in their page's row: read once, without a shuffle of cells."""

from __future__ import annotations

import __spark_entry__ as entry
from lanecast.sources import pages


def test_odds_grids_read_the_races_once(spark):
    d = entry.queries()["odds_grids"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") > 0 and plan.count("Relation [l_orderkey") == 1  # before: once for every pool and header


def test_grids_with_gaps_repeats_and_rows_that_dont_divide(spark):
    rows = [(0, 0, "1"), (0, 1, "2"), (1, 0, "2"), (1, 1, "3"), (1, 2, "5.6"), (1, 3, "1"), (1, 4, "3"), (1, 5, "x"), (2, 0, "4"), (2, 1, "7.0"), (2, 2, "4"), (2, 3, "8.1"), (3, 0, "9"), (4, 0, "3"), (4, 1, "2"), (4, 2, "5.7"), (4, 3, "3"), (4, 4, "4"), (4, 5, "6.0")]
    cells = spark.createDataFrame([(1, *r) for r in rows], "page int, row_no int, col_no int, cell string")
    found = lambda ordered: {(r["combination"], r["odds"]) for r in pages.triple_grid(cells, ordered).collect()}
    assert found(True) == {("1-2-3", 5.6), ("1-2-4", 7.0), ("2-1-4", 8.1), ("1-3-2", 5.7), ("2-3-4", 6.0)}
    assert found(False) == {("1-2-3", 5.6), ("1-2-4", 7.0), ("2-3-4", 6.0)}
    pairs = spark.createDataFrame([(1, 0, 0, "1"), (1, 0, 1, "2"), (1, 1, 2, "1"), (1, 1, 3, "2.5"), (1, 2, 0, "1"), (1, 2, 1, "3.0")], "page int, row_no int, col_no int, cell string")
    assert [tuple(r) for r in pages.pair_grid(pairs, True).collect()] == [(1, "2-1", 2.5)]
