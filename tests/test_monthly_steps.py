"""Beyond EXACT_ROWS a model's steps take gradients only, to the same optimum; months are dealt evenly over the parts."""

import numpy as np

from lanecast.operators import monthly_models
from lanecast.plans import contest, models

SF = "/root/testdata/sf0.001"


def planted(rows=9000, months=15):
    rng = np.random.default_rng(3)
    x, month = rng.normal(size=(rows, 3)) * [1, 4, 0.5] + [0, 9, 1], rng.integers(0, months, rows)
    z = np.c_[np.zeros(rows), x[:, 0], 0.3 * x[:, 1] - 2 * x[:, 2]] + rng.gumbel(size=(rows, 3))
    return [(int(m), int(k), [float(f) for f in v]) for m, k, v in zip(month, z.argmax(axis=1), x, strict=True)]


def test_many_rows_take_curvatures_once(spark, monkeypatch):
    shapes, summed = [], monthly_models._summed
    monkeypatch.setattr(monthly_models, "_summed", lambda rows, shape, add: shapes.append(shape) or summed(rows, shape, add))
    d = spark.createDataFrame(planted(), "month int, label int, x array<double>").repartition(4)
    exact = monthly_models.fitted(d, 15, 3, 3, 12)
    shapes.clear()
    monkeypatch.setattr(monthly_models, "EXACT_ROWS", 0)
    fixed = monthly_models.fitted(d, 15, 3, 3, 12)
    size = 3 * 4
    centred = lambda w: w - w.mean(axis=1, keepdims=True)  # noqa: E731  a shift common to all classes is in no probability
    assert np.abs(centred(exact.weights) - centred(fixed.weights)).max() < 1e-6
    assert (3, 1 + size + size * size) not in shapes and sum(s[:1] == (15,) and len(s) == 3 for s in shapes) == 1  # before: all models' curvatures at every step


def test_sums_of_runs_are_those_of_months(spark, monkeypatch):
    month = np.array([2, 2, 2, 2, 2, 5, 7, 7])
    monkeypatch.setattr(monthly_models, "CHUNK", 2)
    assert [(m, at.start, at.stop) for m, at in monthly_models._runs(month)] == [(2, 0, 2), (2, 2, 4), (2, 4, 5), (5, 5, 6), (7, 6, 8)]
    assert list(monthly_models._runs(month[:0])) == []


def test_every_part_has_rows_of_many_months(spark, monkeypatch):
    monkeypatch.setattr(models, "PARTS", 4)
    rows, months = models.model_rows(spark, SF)
    seen = [len({r["month"] for r in part}) for part in rows.rdd.glom().collect() if part]
    assert min(seen) > len(months) // 4  # before: a part had some months' rows only, the first ones those of most work


def test_the_rule_derives_the_fields_once(spark, monkeypatch):
    calls, runners = [], contest.runners
    monkeypatch.setattr(contest, "runners", lambda *a: calls.append(1) or runners(*a))
    models.logistic_rule_walk_forward(spark, SF)
    assert len(calls) == 1  # before: 3
