"""Walk-forward over all months; deviations over all lanes."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lanecast import catalog
from lanecast.operators import folds, metrics
from lanecast.plans import contest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_month_after_the_first_twelve_is_scored(spark):
    got = {r["test_start"]: r for r in catalog.queries()["logistic_walk_forward"](spark, SF).collect()}
    d = contest.full_fields(spark, SF)
    won = {r["m"]: r["n"] for r in d.where("won").groupBy(F.trunc("race_date", "month").alias("m")).agg(F.count("*").alias("n")).collect()}
    months = [r["test_start"] for r in folds.monthly_folds(d, "race_date", 12).collect()]
    assert len(months) > 2 and {m: r["n"] for m, r in got.items()} == {m: won[m] for m in months if m in won}
    assert all(math.isfinite(r["log_loss"]) and 0 <= r["accuracy"] <= 1 for r in got.values())


def test_deviations_cover_all_lanes(spark):
    p = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, None), (1, 4, 3.0), (2, 1, 2.0)], "race_id int, lane int, predicted double")
    a = spark.createDataFrame([(1, 1, 4.0), (1, 2, 1.0), (1, 3, 2.0), (1, 6, 9.0), (2, 2, 5.0)], "race_id int, lane int, actual double")
    got = {r["race_id"]: r for r in metrics.race_deviations(p, a).collect()}
    assert (got[1]["lanes"], got[1]["missing_lanes"]) == (5, "3,4,6") and abs(got[1]["max_log"] - math.log(4)) < 1e-12 and abs(got[1]["mean_log"] - 1.5 * math.log(2)) < 1e-12
    assert (got[2]["lanes"], got[2]["max_log"], got[2]["missing_lanes"]) == (2, None, "1,2")
