"""Draws as many as the reference's, and their summaries."""

import os
import statistics

import pytest

from lanecast import catalog
from lanecast.operators import metrics
from lanecast.plans import betting

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_summaries_are_over_all_draws(spark, monkeypatch):
    assert (betting.RESAMPLES, betting.PERMUTATIONS, betting.NOISES, betting.SIGMA) == (2000, 40, 20, 0.6)
    monkeypatch.setattr(betting, "PERMUTATIONS", 10)  # the draws that permutation_null lists
    rois = [r["roi"] for r in catalog.queries()["permutation_null"](spark, SF).collect()]
    got = catalog.queries()["permutation_against_null"](spark, SF).first()
    mean, sd = statistics.fmean(rois), statistics.pstdev(rois)
    assert abs(got["null_mean"] - mean) < 2e-6 and abs(got["null_max"] - max(rois)) < 2e-6 and abs(got["null_sd"] - sd) < 2e-6
    assert abs(got["z"] - (got["real"] - mean) / sd) < 1e-3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_bootstrap_has_2000_resamples(spark, monkeypatch):
    seen, draws = [], metrics.draws
    monkeypatch.setattr(metrics, "draws", lambda df, n: seen.append(n) or draws(df, n))
    got = catalog.queries()["bootstrap_returns_full"](spark, SF).collect()
    assert seen == [2000] and len(got) == 3 and all(r["low"] <= r["high"] for r in got)
    assert all(abs(r["p_above_one"] * 2000 - round(r["p_above_one"] * 2000)) < 1e-4 for r in got)
