"""Thirds of equal size, ties told apart by a second column."""

import os

import pytest
from pyspark.sql import functions as F

from lanecast import catalog
from lanecast.operators import ranks

SF = "/root/testdata/sf0.001"


def test_thirds_are_those_of_ntile(spark):
    rows = [(n, g, float(v % m)) for g, size, m in ((1, 100, 5), (2, 1, 1), (3, 2, 1), (4, 50, 1), (5, 31, 40)) for n, v in enumerate(range(3, 3 + size))]
    d = spark.createDataFrame(rows, "k long, g int, v double")
    want = {}
    for g in range(1, 6):
        of = sorted((v, k) for k, h, v in rows if h == g)
        q, rest = divmod(len(of), 3)
        ends = (q + (rest > 0), 2 * q + rest)
        want |= {(g, k): 1 + sum(n >= e for e in ends) for n, (_, k) in enumerate(of)}
    assert {(r["g"], r["k"]): r["third"] for r in ranks.in_thirds(d, ["g"], "v", "k").collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_factor_thirds_are_equal_in_size(spark):
    for n in (r["n"] for r in catalog.queries()["factor_thirds"](spark, SF).groupBy("lane").agg(F.collect_list("n").alias("n")).collect()):
        assert len(n) == 3 and max(n) - min(n) <= 1
