"""Documented values, refusals and a sequential twin of the ordered operators."""

import math

import numpy as np
import pytest

from assayer.operators import metrics as m
from assayer.operators import ordered, tables
from pyspark.sql import functions as F


def one(df):
    return df.first()[0]


def frame(spark, **cols):
    return spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*cols.values(), strict=True)], ", ".join(f"{c} double" for c in cols))


def test_deviances(spark):
    p = frame(spark, y=[0, 1, 2], mu=[0.5, 1, 2.5], w=[0.5, 1, 0.5])
    assert one(m.poisson_deviance(p, "y", "mu")) == pytest.approx(0.3691, abs=1e-4)
    assert one(m.deviance_per_row(p, "y", "mu", "poisson", "w")) == pytest.approx(0.1846, abs=1e-4)
    t = frame(spark, y=[10, 20], mu=[12, 18])
    assert one(m.tweedie_deviance(t, "y", "mu", 1.5)) == pytest.approx(0.0774, abs=1e-4)
    d = frame(spark, y=[1, 2, 3, 6], mu=[1, 2, 3, 6], flat=[3, 3, 3, 3])
    assert one(m.d2(d, "y", "mu", "poisson")) == 1 and one(m.d2(d, "y", "flat", "poisson")) == pytest.approx(0)


@pytest.mark.parametrize("power,family", [(0.0, "gaussian"), (1.0, "poisson"), (2.0, "gamma")])
def test_tweedie_meets_its_special_cases(spark, power, family):
    d = frame(spark, y=[1, 2, 5], mu=[1.5, 2, 4])
    assert one(m.tweedie_deviance(d, "y", "mu", power)) == pytest.approx(one(m.deviance(d, "y", "mu", family)))


def test_ranking(spark):
    g = frame(spark, y=[0, 0, 1, 1], s=[0.1, 0.2, 0.8, 0.9], r=[0.9, 0.8, 0.2, 0.1])
    assert one(m.gini(g, "y", "s")) == pytest.approx(0.5) and one(m.gini(g, "y", "r")) == pytest.approx(-0.5)
    assert one(m.normalized_gini(g, "y", "s")) == pytest.approx(1)
    assert sorted(map(tuple, m.lorenz_curve(g, "y", "s").collect())) == [(0, 0), (0.25, 0), (0.5, 0), (0.75, 0.5), (1, 1)]
    a = frame(spark, y=[0, 0, 1, 1], s=[0.1, 0.4, 0.35, 0.8])
    assert one(m.roc_auc(a, "y", "s")) == pytest.approx(0.75)
    assert one(m.average_precision(a, "y", "s")) == pytest.approx(0.8333, abs=1e-4)
    assert one(m.ks(a, "y", "s")) == pytest.approx(0.5)
    roc = sorted(map(tuple, m.roc_curve(a, "y", "s").select("fpr", "tpr").collect()))
    assert roc == [(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)]


def test_regression_and_losses(spark):
    d = frame(spark, y=[1, 2, 4], mu=[1, 3, 2])
    want = {"rmse": 1.291, "mae": 1.0, "mape": 0.3333, "smape": 0.3556, "msle": 0.1146, "r2": -0.0714}
    for name, v in want.items():
        assert one(getattr(m, name)(d, "y", "mu")) == pytest.approx(v, abs=1e-4)
    b = frame(spark, y=[0, 1], p=[0.2, 0.8])
    assert one(m.log_loss(b, "y", "p")) == pytest.approx(0.2231, abs=1e-4) and one(m.brier(b, "y", "p")) == pytest.approx(0.04)


def test_threshold(spark):
    d = frame(spark, y=[1, 1, 0, 1, 0, 0], s=[0.9, 0.8, 0.7, 0.4, 0.3, 0.1])
    r = m.threshold_metrics(d, "y", "s", 0.5).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 2) and r["mcc"] == pytest.approx(1 / 3)
    grid = m.threshold_grid(d, "y", "s")
    assert grid.count() == 101 and grid.filter("threshold = 1").first()["alerts_per_tp"] is None


def test_tables(spark):
    c = frame(spark, y=[0, 1, 1, 2, 2, 4], mu=[0.5, 0.5, 1.5, 1.5, 3, 3])
    assert [r["actual_over_expected"] for r in tables.calibration_table(c, "y", "mu", bins=3).orderBy("bin").collect()] == [1, 1, 1]
    d = frame(spark, y=[1, 2, 3, 4], a=[1, 2, 3, 4], b=[2, 2, 2, 2])
    assert [tuple(r) for r in tables.double_lift(d, "y", "a", "b", bins=2).orderBy("bin").select("actual", "predicted_a", "predicted_b").collect()] == [(1.5, 1.5, 2), (3.5, 3.5, 2)]
    t = tables.win_sets(frame(spark, y=[1, 2, 3, 4], a=[0.5, 3, 2, 4], b=[1, 2, 2, 5]), "y", ["a", "b"]).orderBy("model").collect()
    assert [r["share"] for r in t] == [0.625, 0.375] and t[0]["actual_over_expected"] == pytest.approx(1.182, abs=1e-3)
    r = tables.residuals(frame(spark, y=[0, 2], mu=[1, 1]), "y", "mu", "poisson").orderBy("y").collect()
    assert [x["residual"] for x in r] == pytest.approx([-1.4142, 0.879], abs=1e-3)


def test_binning_rules_differ(spark):
    d = frame(spark, k=[1, 2, 3, 4, 5], w=[1, 1, 6, 1, 1])
    bins = lambda f: [r["bin"] for r in f(d, F.col("k"), F.col("w"), 5).orderBy("key").collect()]
    assert bins(ordered.equal_weight_bins) == [0, 0, 1, 2, 2]
    assert bins(ordered.stepped_bins) == [0, 0, 1, 2, 3]


def sequential(weights, bins, stepped):
    """The rules as walks over tie groups."""
    width = sum(weights) / bins
    edges = np.cumsum([width] * (bins - 1)) if bins > 1 else []
    seen, out, last, k = 0.0, [], -1, -1
    for w in weights:
        cell = sum(seen + w / 2 >= e for e in edges)
        seen += w
        if stepped:
            k = 0 if k < 0 else min(k + 1, max(cell, k))
        elif cell != last:
            k, last = k + 1, cell
        out.append(min(k, bins - 1))
    return out


def test_bins_match_the_walk(spark):
    rng = np.random.default_rng(4)
    for trial in range(6):
        n = int(rng.integers(1, 40))
        w = (rng.integers(1, 6, n) if trial % 2 else rng.pareto(1, n) + 0.01).astype(float)
        d = frame(spark, k=range(n), w=w)
        for rule, stepped in ((ordered.equal_weight_bins, False), (ordered.stepped_bins, True)):
            bounds = sorted(rng.choice(n, min(n, 3), replace=False).astype(float).tolist())
            got = [r["bin"] for r in rule(d, F.col("k"), F.col("w"), 7, bounds).orderBy("key").collect()]
            assert got == sequential(w, 7, stepped)


def test_interaction_strength(spark):
    rows = lambda v: spark.createDataFrame([(i, j, 1.0, float(a), 1.0) for (i, j), a in v.items()], "position_a int, position_b int, weight double, actual double, predicted double")
    assert tables.interaction_strength(rows({(0, 0): 1, (0, 1): 2, (1, 0): 2, (1, 1): 4})) == pytest.approx(0, abs=1e-9)
    assert tables.interaction_strength(rows({(0, 0): 1, (0, 1): 3, (1, 0): 3, (1, 1): 1})) > 0.2


def test_profiles(spark):
    h = tables.histogram(frame(spark, v=[0, 0, 1, 3]), "v", bins=3).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["n_rows"]) for r in h] == [(0, 1, 2), (1, 2, 1), (2, 3, 1)]
    h = tables.histogram(frame(spark, v=[*range(100), 1000]), "v", bins=3).orderBy("bin").collect()
    assert [r["n_rows"] for r in h] == [33, 33, 33, 2]
    c = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", 4.0), ("d", 5.0)], "k string, y double")
    t = tables.categorical_profile(c, "k", "y", max_levels=2).orderBy("position").collect()
    assert [(r["level"], r["n_rows"]) for r in t] == [("b", 2), ("a", 1), ("(other: 2 levels)", 2)] and t[2]["actual"] == 4.5


@pytest.mark.parametrize(
    "call,words",
    [
        (lambda d: m.poisson_deviance(d, "y", "bad"), ["2 of 3 rows", "above 0"]),
        (lambda d: m.gini(d, "y", "mu", F.lit(0.0)), ["3 of 3 rows", "weight"]),
        (lambda d: m.mape(d, "y", "mu"), ["1 of 3 rows", "MAPE"]),
        (lambda d: m.roc_auc(d, "one", "mu"), ["one class"]),
        (lambda d: m.d2(d, "one", "mu", "poisson"), ["two values"]),
        (lambda d: m.rmse(d, "y", "hole"), ["missing", "1 of 3 rows"]),
        (lambda d: m.confusion(d, "mu", "mu"), ["0 nor 1"]),
    ],
)
def test_refusals_name_count_and_fix(spark, call, words):
    d = spark.createDataFrame([(0.0, 0.5, 0.0, 1.0, 1.0), (1.0, 1.0, -1.0, 1.0, None), (2.0, 2.0, 1.0, 1.0, 1.0)], "y double, mu double, bad double, one double, hole double")
    with pytest.raises(ValueError) as e:
        call(d)
    assert all(w in str(e.value) for w in words)


def test_undefined_ratios_are_nan(spark):
    d = frame(spark, y=[1, 2], mu=[0, 0])
    assert math.isnan(one(m.balance(d, "y", "mu")))
