"""Monthly models against other solvers, and what follows them against brute force."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecast.operators import folds, monthly_models
from lanecast.plans import models

SF = "/root/testdata/sf0.001"
MONTHS, CLASSES, FEATURES = 16, 3, 4


def planted():
    rng = np.random.default_rng(7)
    true = rng.normal(size=(CLASSES, FEATURES + 1))
    rows = []
    for month in range(MONTHS):
        for _ in range(0 if month == 13 else 40):  # a month without rows
            x = rng.normal(size=FEATURES) * [1, 5, 0.2, 10] + [0, 20, 1, -5]
            z = true @ np.r_[1, (x - [0, 20, 1, -5]) / [1, 5, 0.2, 10]]
            p = np.exp(z - z.max())
            rows.append((month, int(rng.choice(CLASSES, p=p / p.sum())), [float(v) for v in x]))
    return rows


def newton(rows):
    """Probabilities function of the penalised optimum, by Newton steps on the standardised rows."""
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    design = lambda v: np.c_[np.ones(len(v)), (v - mean) / sd]
    z, d = design(x), FEATURES + 1
    w, ridge = np.zeros((CLASSES, d)), np.r_[1e-9, np.ones(FEATURES)]
    soft = lambda t: np.exp(t - t.max(axis=1, keepdims=True)) / np.exp(t - t.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    for _ in range(60):
        p = soft(z @ w.T)
        h = np.block([[z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]) for b in range(CLASSES)] for a in range(CLASSES)])
        w -= np.linalg.solve(h + np.diag(np.tile(ridge, CLASSES)), ((p - np.eye(CLASSES)[y]).T @ z + w * ridge).ravel()).reshape(w.shape)
    return lambda v: soft(design(v) @ w.T)


@pytest.mark.parametrize("limit", [1 << 31, 0])
def test_every_model_is_the_optimum_of_the_months_before_it(spark, monkeypatch, limit):
    monkeypatch.setattr(monthly_models, "EXACT_BYTES", limit)
    rows = planted()
    d = spark.createDataFrame(rows, "month int, label int, x array<double>").repartition(5)
    got = monthly_models.fitted(d, MONTHS, CLASSES, FEATURES, 12)
    assert len(got.weights) == MONTHS - 12 and list(got.trained) == [480, 520, 520, 560]
    scored = got.score(d).collect()
    assert {r["month"] for r in scored} == {12, 14, 15}
    for month in (12, 15):
        exact = newton([r for r in rows if r[0] < month])
        want = exact(np.array([r[2] for r in rows if r[0] == month]))
        assert np.abs(np.sort([r["probs"] for r in scored if r["month"] == month], axis=0) - np.sort(want, axis=0)).max() < 1e-6
    ahead = {r["month"] for r in got.score(d, ahead=1).collect()}
    assert ahead == {14, 15}  # month 13 has no rows, month 12 no model that ends a month earlier


def test_too_few_months_give_no_model(spark):
    d = spark.createDataFrame([(0, 1, [1.0])], "month int, label int, x array<double>")
    models_ = monthly_models.fitted(d, 1, 2, 1, 12)
    assert len(models_.weights) == 0 and models_.score(d).count() == 0


def test_agrees_with_the_library_fit(spark):
    """Spark ML scales by the sample deviation, so losses are compared, not weights."""
    rows = [(m, float(y), *x) for m, y, x in planted() if m < 13]
    names = [f"f{k}" for k in range(FEATURES)]
    d = spark.createDataFrame(rows, f"month int, label double, {', '.join(n + ' double' for n in names)}")
    model = folds.fit_logistic(d.where("month < 12"), names, "label")
    p = folds.aligned(model.transform(d.where("month = 12")).withColumn("row", F.monotonically_increasing_id()), ["row", "label"], CLASSES).where("lane - 1 = label")
    theirs = p.agg(F.avg(-F.log("p"))).first()[0]
    x = d.select("month", F.col("label").cast("int").alias("label"), F.array(*names).alias("x"))
    ours = monthly_models.fitted(x, 13, CLASSES, FEATURES, 12).score(x).select((-F.log(F.element_at("probs", F.col("label") + 1))).alias("l")).agg(F.avg("l")).first()[0]
    assert abs(theirs - ours) < 2e-3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_calibration_by_brute_force(spark):
    rows, months = models.model_rows(spark, SF)
    fit = models.fitted(rows, months)
    got = {(r["race_id"], r["lane"]): r["p_calibrated"] for r in models.calibrated(fit, rows).collect()}
    plain = {}
    for r in rows.collect():
        for k, name in ((0, "between"), (1, "test")):
            at = r["month"] - fit.first - k
            if 0 <= at < len(fit.weights):
                z = fit.weights[at] @ np.r_[1, r["x"]]
                p = np.exp(z - z.max())
                plain.setdefault(name, []).append((r["month"], r["race_id"], r["label"], p / p.sum()))
    bins = {}
    for month, _, label, p in plain["between"]:
        bins.setdefault((month + 1, min(int(p.max() * 10), 9)), []).append(int(p.argmax()) == label)
    assert len(got) == 6 * len(plain["test"]) > 0
    for month, race, _, p in plain["test"]:
        b = min(int(p.max() * 10), 9)
        hits = bins.get((month, b))
        value = sum(hits) / len(hits) if hits else (b + 0.5) / 10
        rest = np.delete(p, p.argmax()).sum()
        others = p / rest if rest > 0 else np.full(6, 0.2)
        want = np.where(np.arange(6) == p.argmax(), value, others * (1 - value))
        assert np.allclose([got[race, n] for n in range(1, 7)], want, atol=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_of_models(spark):
    q = models.QUERIES
    losses = q["logistic_losses_by_class"](spark, SF).collect()
    assert losses and all(math.isfinite(r["log_loss"]) for r in losses)
    walk = q["logistic_calibration_walk_forward"](spark, SF).collect()
    assert walk and all(0 <= r["calibrated_error"] <= 1 and r["races"] > 0 for r in walk)
    assert set(q["logistic_rule_walk_forward"](spark, SF).columns) >= {"month", "train_bets", "roi", "above"}
