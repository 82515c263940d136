"""Odds grids of many pages at once: no page is parsed by itself, and the races are counted without ordering their lines."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lanecast.functions import text
from lanecast.plans import captures, contest
from lanecast.sources import grids


def _entries(found):
    page, lanes, odds = found
    return list(zip(page.tolist(), grids.combinations(lanes).to_pylist(), odds.tolist()))


def _grid(*pages):
    return pa.array([[{"row_no": n, "v": v} for n, v in rows] for rows in pages], pa.list_(pa.struct([("row_no", pa.int32()), ("v", pa.list_(pa.string()))])))


def test_a_page_takes_a_fraction_of_a_millisecond():
    pages = pa.record_batch([pa.array(np.arange(20_480))], names=["race_id"])
    start = time.process_time()
    out = pa.Table.from_batches(captures._pages_read([pages]))
    assert time.process_time() - start < 20  # before: some 4 ms a page, 80 s
    assert out.num_rows == 6 * 20_480
    assert out.slice(6 * 20_000, 6).to_pylist() == [{"race_id": 20_000, "pool": p, "n": n, "tenths": t + n * (20_000 % 7)} for p, n, t in (("win", 6, 2100), ("place", 6, 2100), ("exacta", 30, 11550), ("quinella", 15, 4200), ("trifecta", 120, 46620), ("trio", 20, 4305))]


def test_races_are_counted_in_one_shuffle_without_order(spark):
    plan = entry.queries()["odds_grids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange hashpartitioning(race_id") == 1 and "transform(" not in plan


def test_counted_races_are_those_of_full_fields(spark, tmp_path):
    lines = {1: 6, 2: 7, 3: 5, 4: 3, 5: 6, 6: 6, 7: 2, 8: 6, None: 6, -11: 6}  # 4, 7 twice or three times in orders, 5 twice, 6 without an order, 8 without a customer
    rows = [(k, n, 1, 1, 1.0, 10.0 * n, 0.1, 0.0) for k, many in lines.items() for n in range(1, many + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").selectExpr("*", "TIMESTAMP '2026-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 9 if k == 8 else 1) for k in (1, 2, 3, 4, 4, 5, 5, 7, 7, 7, 8, 12, None, -11)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").selectExpr("*", "'F' AS o_orderstatus", "TIMESTAMP '2026-01-01' AS o_orderdate", "'1' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    found = sorted(r[0] for r in contest.full_races(spark, str(tmp_path), 3).collect())
    assert found == sorted(r[0] for r in contest.full_fields(spark, str(tmp_path)).select("race_id").distinct().collect()) == [-11, 1, 2, 4, 7]


def test_cells_are_read_as_by_the_expression(spark):
    cells = ["5.6", " 2.0-2.8 ", "0.5", "欠場", "", "-3", "1e2", "1.5d", "inf", "1_0", ".9-1.", "2.0 - 3", None]
    want = [tuple(r[0]) for r in spark.createDataFrame([(c,) for c in cells], "c string").select(text.odds_cell(F.col("c"))).collect()]
    got = [tuple(None if np.isnan(x) else x for x in grids.odds_cell(c)) if c is not None else (None, None) for c in cells]
    assert got == want


def test_sliced_pages_gaps_and_lanes_not_known():
    pair = [(0, ["1", "x", "11"]), (1, ["2", "2.5", "3", "9.0", "1", "4.5"]), (2, [None, "3.0", "1"]), (3, ["1", "7.0"])]
    none, no_head = [], [(1, ["2", "2.5"])]
    pages = _grid(no_head, pair, none, pair)
    want = [("1-2", 2.5), ("11-1", 4.5)]  # not under a header that is no lane, not of a lane with itself
    assert _entries(grids.pair_odds(pages, True)) == [(n, *x) for n in (1, 3) for x in want]
    assert _entries(grids.pair_odds(pages.slice(2, 2), False)) == [(1, "1-2", 2.5), (1, "1-11", 4.5)]
    triple = [(0, ["1", "4"]), (1, ["2", "2.0", "3", "3.0"]), (2, ["2", "3", "5.0", "", "", ""]), (3, ["4", "6.0", "2", "8.0"]), (4, ["3", "2", "4.0", "1", "2", "9.0"]), (5, ["4", "1.5", "3", "0.0"])]
    full = [(0, "1-2-3", 5.0), (0, "1-2-4", 6.0), (0, "1-3-2", 4.0), (0, "4-1-2", 9.0), (0, "1-3-4", 1.5)]  # no second lane yet in row 1, and under 4 in row 3
    assert sorted(_entries(grids.triple_odds(_grid(triple), True))) == sorted(full)
    assert sorted(_entries(grids.triple_odds(_grid(none, triple).slice(1, 1), False))) == [(0, "1-2-3", 4.0), (0, "1-2-4", 6.0), (0, "1-3-4", 1.5)]
    assert [len(x) for x in grids.triple_odds(_grid(none, no_head), True)[::2]] == [0, 0]


def test_win_and_place_of_uneven_lists():
    lists = lambda *x: pa.array(x, pa.list_(pa.string()))
    d = grids.win_place_odds(lists(["9.9"], ["5.6", None, "0.0"], []), lists(["1.0"], ["2.0-2.8"], ["1.1"]))
    got = [tuple(None if np.isnan(x) else x for x in r) for r in zip(*[d[k].tolist() for k in ("page", "lane", "win", "place_low", "place_high")])]
    assert got == [(0, 1, 9.9, 1.0, None), (1, 1, 5.6, 2.0, 2.8), (1, 2, None, None, None), (1, 3, None, None, None), (2, 1, None, 1.1, None)]
