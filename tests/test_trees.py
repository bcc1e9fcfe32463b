"""Boosted trees: splits, offsets, early stopping, depth, missing and unseen values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators.glm import GLM
from assayer.operators.trees import BoostedTrees, best_split


@pytest.fixture(scope="module")
def curve(spark):
    """Counts around a U shape in x, and a level that doubles them."""
    r = np.random.default_rng(3)
    n = 4000
    x, level, e = r.uniform(-2, 2, n), r.choice(["a", "b", "c"], n), r.uniform(0.5, 2, n)
    y = r.poisson(e * np.exp(0.5 * x * x - 0.5) * np.where(level == "b", 2.0, 1.0))
    f = pd.DataFrame({"id": np.arange(n), "x": x, "z": r.uniform(size=n), "level": level, "e": e, "y": y.astype(float), "o": np.log(e)})
    return spark.createDataFrame(f).repartition(4).persist()


def deviance(model, df):
    p = model.predict(df, offset="o").select("y", "prediction").toPandas()
    y, m = p["y"].to_numpy(), p["prediction"].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        return float((2 * (np.where(y > 0, y * np.log(y / m), 0) - (y - m))).mean())


def brute(codes, g, h, size, ridge):
    """Best cut of one numeric feature without missing values, by trying all of them."""
    gain = [sum(g[m].sum() ** 2 / (h[m].sum() + ridge) for m in (codes <= k, codes > k)) - g.sum() ** 2 / (h.sum() + ridge) for k in range(size - 2)]
    return int(np.argmax(gain)), max(gain)


def test_split_is_the_best_cut():
    r = np.random.default_rng(0)
    codes, g, h = r.integers(0, 8, 500), r.normal(size=500), r.uniform(1, 2, 500)
    hist = np.array([np.bincount(codes, v, 9) for v in (g, h, np.ones(500))])
    s = best_split(hist, [9], [True], 0.1, 1)
    k, gain = brute(codes, g, h, 9, 0.1)
    assert s.left[:8].sum() == k + 1 and s.gain == pytest.approx(gain)


def test_subset_of_levels_and_missing_side():
    hist = np.array([[-9.0, 8.0, -7.0, 9.0], [10.0, 10.0, 10.0, 10.0], [30.0, 30.0, 30.0, 30.0]])
    s = best_split(hist, [4], [False], 0.0, 1)
    assert s.left.tolist() in ([True, False, True, False], [False, True, False, True])
    assert best_split(hist[:, :1].repeat(2, 1), [2], [True], 0.0, 1000) is None


def test_beats_a_linear_model_on_a_u_shape(curve):
    trees = BoostedTrees("poisson", ["x"], ["level"], n_trees=60, id_col="id").fit(curve, "y", offset="o")
    linear = GLM("poisson", {"x": "raw", "level": "onehot"}).fit(curve, "y", offset="o")
    assert deviance(trees, curve) < 0.85 * deviance(linear, curve)
    assert trees.importance["x"] > trees.importance["level"] > 0


def test_offset_is_multiplicative_and_predict_keeps_columns(curve):
    t = BoostedTrees("poisson", ["x"], n_trees=5, id_col="id").fit(curve, "y", offset="o")
    p = t.predict(t.predict(curve, out="rate"), offset="o", out="count")
    assert p.columns == [*curve.columns, "rate", "count"]
    assert p.filter(F.abs(F.col("count") / F.col("rate") / F.col("e") - 1) > 1e-9).count() == 0


def test_stops_early_on_noise_and_folds_scores_in(curve):
    noise = BoostedTrees("poisson", ["z"], n_trees=100, learning_rate=0.5, early_stopping=4, id_col="id").fit(curve, "y", offset="o")
    assert len(noise.trees) < 40 and len(noise.trace) <= len(noise.trees) + 5
    whole = BoostedTrees("poisson", ["x"], n_trees=23, max_depth=2, valid_fraction=0.0).fit(curve, "y", offset="o")
    d = [r["deviance"] for r in whole.trace]
    assert len(whole.trees) == 23 and d == sorted(d, reverse=True) and d[-1] == pytest.approx(deviance(whole, curve), rel=1e-9)


def test_depth_one_is_additive_on_the_link(curve, spark):
    t = BoostedTrees("poisson", ["x", "z"], ["level"], n_trees=20, max_depth=1, id_col="id").fit(curve, "y", offset="o")
    grid = spark.createDataFrame([(x, z, v) for x in (-1.5, 0.0) for z in (0.1, 0.9) for v in ("a", "b")], "x double, z double, level string")
    p = np.log(t.predict(grid).orderBy("x", "z", "level").toPandas()["prediction"].to_numpy()).reshape(2, 2, 2)
    assert np.allclose(p[0] - p[1], (p[0] - p[1])[0, 0])
    assert all(x.depth == 1 for x in t.trees)


def test_missing_and_unseen_values(curve, spark):
    holes = curve.withColumn("x", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("x")))
    t = BoostedTrees("poisson", ["x"], ["level"], n_trees=5).fit(holes, "y", offset="o")
    odd = spark.createDataFrame([(None, "a"), (float("nan"), "new"), (float("inf"), None)], "x double, level string")
    assert all(v > 0 and np.isfinite(v) for v in t.predict(odd).toPandas()["prediction"])
    assert t.predict(odd.limit(0)).count() == 0


@pytest.mark.parametrize("family", ["gaussian", "gamma", "binomial", "tweedie"])
def test_every_family(curve, family):
    df = curve.withColumn("y", F.col("y") + 0.5) if family in ("gamma", "gaussian") else curve.withColumn("y", (F.col("y") > 1).cast("double")) if family == "binomial" else curve
    t = BoostedTrees(family, ["x"], ["level"], power=1.5 if family == "tweedie" else None, n_trees=10, id_col="id").fit(df, "y", "e")
    assert t.trace[-1]["deviance"] < 0.97 * t.trace[0]["deviance"]


def test_refusals(curve):
    with pytest.raises(ValueError, match="lacks nothere"):
        BoostedTrees("poisson", ["nothere"]).fit(curve, "y")
    with pytest.raises(ValueError, match="y is outside the support"):
        BoostedTrees("gamma", ["x"]).fit(curve, "y")
    with pytest.raises(ValueError, match="start from"):
        BoostedTrees("poisson", ["x"]).fit(curve.withColumn("y", F.lit(0.0)), "y")
    with pytest.raises(ValueError, match="more than 2000 levels"):
        BoostedTrees("poisson", [], ["id"]).fit(curve, "y")
