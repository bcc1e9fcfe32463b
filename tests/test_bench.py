"""The bench's report: thinned curves, bands over folds, the ladder, the schema."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import explain, scorecard
from assayer.operators.glm import GLM
from assayer.plans import bench, views


def test_thinned_curve_keeps_ends_and_exact_points(spark):
    d = spark.range(5000).select((F.col("id") / 4999).alias("x"), (F.col("id") / 4999 * F.col("id") / 4999).alias("y"))
    whole = {(r["x"], r["y"]) for r in d.collect()}
    rows = [(r["x"], r["y"]) for r in bench.curve_points(d, F.col("x"), ["x", "y"], 50).collect()]
    assert rows == sorted(rows) and set(rows) <= whole and 50 <= len(rows) <= 102
    assert rows[0] == (0, 0) and rows[-1] == (1, 1)


def test_short_curve_stays_whole(spark):
    d = spark.createDataFrame([(0.0, 0.0), (0.3, 0.1), (0.3, 0.2), (1.0, 1.0)], "x double, y double")
    assert [tuple(r) for r in bench.curve_points(d, F.col("x"), ["x", "y"]).collect()] == [(0, 0), (0.3, 0.1), (0.3, 0.2), (1, 1)]


def test_bands_over_folds():
    fold = lambda i, c, p: {"importance": {"a": i}, "dependence": {"a": {1.0: p, 0.0: 2 * p}}, "coefficients": c, "link": "log", "path": None, "gcv": {"a": [(1.0, 5.0), (0.0, 4.0)]}, "attributions": [{"id": 1, "prediction": p, "kind": "highest"}, {"id": 2, "prediction": p, "kind": "sample"}]}
    got = views.merged([fold(1.0, {"(intercept)": 0.0, "a=x": 2.0}, 1.0), fold(3.0, {"(intercept)": 1.0}, 3.0)])
    assert got["importance"]["a"] == {"mean": 2, "std": 1, "low": 1, "high": 3, "folds": 2}
    assert [(r["value"], r["mean"], r["low"], r["high"]) for r in got["partial_dependence"]["a"]] == [(0, 4, 2, 6), (1, 2, 1, 3)]
    assert got["coefficients"]["(intercept)"]["relativity"] == pytest.approx(2.718281828**0.5)
    assert got["coefficients"]["a=x"]["folds"] == 1
    assert [(r["fold"], r["prediction"]) for r in got["attributions"] if r["kind"] == "highest"] == [(1, 3), (0, 1)]
    assert [r["fold"] for r in got["attributions"] if r["kind"] == "sample"] == [0, 1]
    assert got["gcv"]["a"] == [{"log10_weight": 0.0, "score": 4.0}, {"log10_weight": 1.0, "score": 5.0}] and "path" not in got


def test_time_bench_reports_time_ladder_and_pairs(spark):
    d = spark.range(240).select(F.col("id"), F.col("id").cast("double").alias("t"), (F.col("id") % 4).cast("double").alias("x"), (1 + F.col("id") % 4 + F.col("id") % 3).cast("double").alias("y"))
    models = {"constant": lambda: GLM("poisson"), "line": lambda: GLM("poisson", {"x": "raw"})}
    r = bench.run(d, bench.Task("y", "poisson"), models, time_col="t", folds=2, id_col="id", features=["x"], bins=4, ladder=["constant", "line"], dataset="made up")
    bench.validate(r.report)
    assert r.report["provenance"]["dataset"] == "made up" and r.to_markdown().startswith("Ladder: constant → line.")
    assert len(r.report["residuals"]["line"]["over_time"]) == 4
    (pair,) = r.report["curves"]["double_lift"]
    assert (pair["a"], pair["b"]) == ("constant", "line") and pair["bins"]
    assert set(r.report["explain"]["line"]["coefficients"]) == {"(intercept)", "x"}
    page = bench.to_html(r.report)
    assert "Over time" in page and "constant against line" in page
    del r.report["curves"]["lorenz"]["line"]
    with pytest.raises(ValueError, match="curves.lorenz.line"):
        bench.validate(r.report)


def test_summary_needs_no_report(spark, monkeypatch):
    d = spark.range(60).select((F.col("id") % 2).alias("fold"), (F.col("id") % 4).cast("double").alias("x"), (1 + F.col("id") % 4 + F.col("id") % 3).cast("double").alias("y"))
    walks = []
    gini = scorecard.m.gini
    monkeypatch.setattr(scorecard.m, "gini", lambda *a: walks.append(a) or gini(*a))
    monkeypatch.setattr(bench, "build", None)
    r = bench.run(d, bench.Task("y", "poisson"), {"line": lambda: GLM("poisson", {"x": "raw"})}, fold="fold", report=False)
    got = {(s["model"], s["metric"]): s["mean"] for s in r.summary()}
    # the model's ranking and the best one, once a fold; the constant's is 0
    assert len(walks) == 4 and got["naive", "gini"] == got["naive", "normalized_gini"] == 0 < got["line", "gini"] and r.report == {}


def test_refusals(spark):
    d = spark.range(40).select(F.col("id"), F.col("id").cast("double").alias("t"), (1 + F.col("id") % 4).cast("double").alias("y"))
    with pytest.raises(ValueError, match="ladder names other"):
        bench.run(d, bench.Task("y", "poisson"), {"a": lambda: GLM("poisson")}, time_col="t", ladder=["a", "other"])
    with pytest.raises(ValueError, match="random folds"):
        bench.run(d, bench.Task("y", "poisson"), {"a": lambda: GLM("poisson", {"t": "raw"}, alpha="cv")}, time_col="t", folds=2, id_col="id")


def test_grid_of_many_levels_is_refused(spark):
    d = spark.range(2500).select(F.col("id").cast("string").alias("name"))
    with pytest.raises(ValueError, match="more than 2000 levels"):
        explain.feature_grid(d, "name")
