"""The attribution report derives the races' full fields once, for win candidates and pools alike."""

from lanecast.plans import attribution, contest


def test_full_fields_are_derived_once(spark, monkeypatch):
    calls, runners = [], contest.runners
    monkeypatch.setattr(contest, "runners", lambda *a: calls.append(1) or runners(*a))
    d = attribution.attribution_report(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and "l_linenumber" not in d._jdf.queryExecution().optimizedPlan().toString()  # before: 3, the pools' among them
