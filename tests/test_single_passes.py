"""What several passes read is made once."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["permutation_null", "pre_race_page_rows"])
def test_lineitem_is_not_read_again(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan  # before: the lineitems' window stood in the plan several times


def test_the_real_return_is_taken_from_stored_candidates(spark, monkeypatch):
    from lanecast.plans import betting

    calls, made = [], betting.candidates
    monkeypatch.setattr(betting, "candidates", lambda *a: calls.append(1) or made(*a))
    d = betting.permutation_against_null(spark, SF)
    assert len(calls) == 1 and "l_linenumber" not in d._jdf.queryExecution().optimizedPlan().toString()
