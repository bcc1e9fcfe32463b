"""Splits, encoders, fits against closed forms and optimality conditions, benches and data cleaning."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions.family import ARRAYS, Family
from assayer.operators import encoders as enc
from assayer.operators import explain, splits
from assayer.operators.glm import GLM, gram, solver
from assayer.operators.mllib import MLlibGLM
from assayer.plans import bench
from assayer.sources import data


@pytest.fixture(scope="module")
def claims(spark):
    rng = np.random.default_rng(3)
    n = 1500
    age, power = rng.uniform(-1, 1, n), rng.normal(size=n)
    region = rng.choice(["north", "south", "west"], n)
    expo, w = rng.uniform(0.2, 1, n), rng.uniform(0.5, 2, n)
    eta = 0.2 + 0.5 * age - 0.3 * power + 0.4 * (region == "west")
    y = rng.poisson(np.exp(eta) * expo).astype(float)
    rows = [(i, *map(float, r[:-1]), str(r[-1])) for i, r in enumerate(zip(age, power, expo, w, y, np.exp(eta) * rng.gamma(3, 1 / 3, n), rng.random(n) < 0.5, region, strict=True))]
    return spark.createDataFrame(rows, "id long, age double, power double, exposure double, w double, y double, amount double, flag double, region string").withColumn("o", F.log("exposure")).persist()


def matrix(df, names):
    return np.array(df.select(*names).orderBy("id").toPandas())


def test_folds(claims):
    k = splits.kfold(claims, "id", 4).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in k) == [375] * 4
    s = splits.stratified(claims, "id", "region", 4).groupBy("fold", "region").count().collect()
    for region in ("north", "south", "west"):
        counts = [r["count"] for r in s if r["region"] == region]
        assert max(counts) - min(counts) <= 1
    g = splits.grouped(claims, "region", 3).groupBy("region").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in g)
    with pytest.raises(ValueError, match="fewer folds"):
        splits.grouped(claims, "region", 4)


def test_time_folds(spark):
    t = spark.createDataFrame([(float(v),) for v in (2019, 2019, 2020, 2020, 2021, 2021, 2022, 2022)], "t double")
    folds = splits.time_ordered(t, "t", 2, 0.3)
    assert [(f.low, f.high) for f in folds] == [(2021.0, 2022.0), (2022.0, None)] or all(t.filter(f.train(F.col("t"))).count() > 0 for f in folds)
    for f in folds:
        train, test = (t.filter(c).agg(F.max("t"), F.min("t")).first() for c in (f.train(F.col("t")), f.test(F.col("t"))))
        assert train[0] < test[1]


def test_encoders(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 12.0)], "k string, y double")
    t = enc.TargetEncode("k", smoothing=1).fit(d, y="y")
    new = spark.createDataFrame([("a",), ("b",), ("z",)], "k string").select(*[c.alias("v") for _, c in t.columns()])
    assert [r["v"] for r in new.collect()] == [3.5, 9.5, 6.5]
    o = enc.OneHot("k").fit(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string"))
    assert [n for n, _ in o.columns()] == ["k=b", "k=c"]
    with pytest.raises(Exception, match="not seen"):
        new.withColumn("k", F.lit("q")).select(*[c.alias(n) for n, c in o.columns()]).collect()
    s = enc.Standardize("x").fit(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double"))
    assert s.std == pytest.approx(np.sqrt(2 / 3))


def test_out_of_fold_values_ignore_own_row(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(40)], "id long, k string, y double")
    e = enc.TargetEncode("k")
    was = {r["id"]: r["v"] for r in e.out_of_fold(d, "y", "id").select("id", F.col("__encoded").alias("v")).collect()}
    moved = d.withColumn("y", F.when(F.col("id") == 7, 1e6).otherwise(F.col("y")))
    now = {r["id"]: r["v"] for r in e.out_of_fold(moved, "y", "id").select("id", F.col("__encoded").alias("v")).collect()}
    assert now[7] == pytest.approx(was[7]) and any(abs(now[i] - was[i]) > 1 for i in was)


@pytest.mark.parametrize("degree,df", [(1, 3), (2, 5), (3, 6)])
def test_basis_columns_match_the_recursion(spark, degree, df):
    x = np.linspace(-1, 5, 61)
    knots = [0.0, 0.7, 1.5, 4.0]
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array(d.select(*enc.basis_columns(F.col("x"), knots, degree)).toPandas())
    want = enc.basis(x, knots, degree)
    assert np.allclose(got, want, atol=1e-10) and np.allclose(want.sum(1), 1)
    assert ((want > 1e-12).sum(1) <= degree + 1).all()


def test_piecewise_row(spark):
    d = spark.createDataFrame([(float(v),) for v in range(5)], "x double")
    e = enc.piecewise_linear("x", 3).fit(d)
    assert d.filter("x = 2").select(*[c for _, c in e.columns()]).first()[:] == pytest.approx([0.5, 0.5, 0])


@pytest.mark.parametrize("family,y,power", [("gaussian", "amount", None), ("poisson", "y", None), ("gamma", "amount", None), ("tweedie", "y", 1.5), ("binomial", "flag", None)])
def test_fit_has_zero_score(claims, family, y, power):
    g = GLM(family, {"age": "raw", "power": "raw", "region": "onehot"}, power=power).fit(claims, y, "w")
    assert g.converged
    d = claims.orderBy("id").toPandas()
    x = np.column_stack([np.ones(len(d)), d.age, d.power, d.region == "south", d.region == "west"]).astype(float)
    f = Family.of(family, power)
    eta = x @ g.beta
    mu = f.link.inverse(eta, ARRAYS)
    score = x.T @ (d.w * (d[y] - mu) * f.link.slope(eta, ARRAYS) / f.variance(mu, ARRAYS))
    assert np.abs(score).max() < 1e-3 * len(d)
    assert g.deviance == pytest.approx((d.w * f.unit_deviance(d[y].to_numpy(), mu, ARRAYS)).sum(), rel=1e-9) if family != "binomial" else True
    assert g.deviance <= g.null_deviance and min(g.se().values()) > 0
    again = GLM.from_json(g.to_json())
    assert again.coef == g.coef and again.predict(claims).count() == claims.count()


def test_gaussian_line(spark):
    d = spark.createDataFrame([(float(x), 1.0 + 2 * x) for x in range(5)], "x double, y double")
    assert list(GLM("gaussian", {"x": "raw"}).fit(d, "y").coef.values()) == pytest.approx([1, 2])


def test_equal_rows_are_folded(monkeypatch):
    r = np.random.default_rng(3)

    def batch(n, noise):
        x = np.column_stack([np.ones(n), r.integers(0, 4, n) + noise * r.random(n)])
        return pa.RecordBatch.from_arrays([pa.array(list(x)), *(pa.array(v.astype(float)) for v in (r.integers(0, 5, n), r.integers(1, 4, n), np.zeros(n), r.integers(0, 2, n)))], names=["x", "y", "w", "o", "fold"])

    f = Family.of("poisson")
    kernel = gram.Kernel(f, f.link)
    monkeypatch.setattr(gram, "BLOCK", 500 * 7 * 8)
    for noise in (0, 1):
        batches = [batch(400, noise) for _ in range(10)]
        plain = [rows for rows, _ in gram._rows(batches)]
        blocks = [np.frombuffer(b.column("rows")[0].as_buffer()).reshape(b.column("n")[0].as_py(), -1) for b in gram._pack(batches)]
        assert sum(b[:, -2].sum() for b in blocks) == 4000 and sum(map(len, blocks)) <= (4 * 5 * 3 * 2 if not noise else 4000)
        for what, arg in (("working", None), ("working", np.array([0.4, 0.1])), ("deviances", [np.array([0.4, 0.1])]), ("inference", np.array([0.4, 0.1])), ("gradient", np.array([0.4, 0.1])), ("weight", None)):
            for fold in (None, ("out", 1), ("in", 1)):
                a, b = (gram._quiet(kernel, what, [np.concatenate(c) for c in zip(*(gram._pick(x, fold, None) for x in part), strict=True)], (arg,)) for part in (blocks, plain))
                assert all(np.allclose(u, v, rtol=1e-10) for u, v in zip(a, b, strict=True)), what
    # rows that only share a hash stay apart
    monkeypatch.setattr(gram.np, "unique", lambda k, u=np.unique, **o: u(k * np.uint64(0) if k.dtype == np.uint64 else k, **o))
    rows = np.array([[1.0, 2.0, 1.0, 0.0], [1.0, 3.0, 1.0, 0.0], [1.0, 2.0, 1.0, 0.0]])
    assert sorted(gram.folded(rows).tolist()) == [[1, 2, 2, 0], [1, 3, 1, 0]]


def test_partitions_do_not_matter(claims):
    fit = lambda d: GLM("poisson", {"age": "spline", "region": "onehot"}).fit(d, "y", offset="o")
    base = fit(claims)
    for n in (1, 40):
        m = fit(claims.repartition(n))
        assert np.allclose(m.beta, base.beta, atol=1e-9) and np.allclose(m.covariance(True), base.covariance(True), atol=1e-9)


def test_target_term_does_not_see_its_own_row(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, f"l{rng.integers(300)}", float(rng.normal())) for i in range(600)], "id long, level string, y double")
    g = GLM("gaussian", {"level": "target"}).fit(d, "y", id_col="id")
    assert g.deviance / g.null_deviance > 0.97 and abs(g.coef["level"]) < 1.2
    with pytest.raises(ValueError, match="id_col"):
        GLM("gaussian", {"level": "target"}).fit(d, "y")


def test_missing_keys_are_refused(spark):
    d = spark.createDataFrame([(i if i else None, "a" if i % 2 else None, float(i)) for i in range(20)], "id long, level string, y double")
    for call in (lambda: splits.kfold(d, "id"), lambda: splits.stratified(d, "id", "level"), lambda: enc.TargetEncode("level").out_of_fold(d, "y", "id"), lambda: enc.TargetEncode("level").past_only(d, "y", "y", "id")):
        with pytest.raises(ValueError, match="missing in (1|10)"):
            call()
    assert splits.grouped(d.withColumn("g", F.when(F.col("y") > 4, F.col("y"))), "g", 3).count() == 20


def test_unseen_level_fails_the_query(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", 4.0)], "k string, y double")
    g = GLM("gaussian", {"k": "onehot"}).fit(d, "y", check_inputs=False)
    assert g.predict(d).count() == 4
    for new in ("z", None):
        with pytest.raises(Exception, match="not seen in fitting"):
            g.contributions(d.withColumn("k", F.lit(new).cast("string"))).collect()


def test_group_steps_reach_the_minimum():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 4))
    g, rho = a.T @ a, rng.normal(size=4) * 40
    for radius, ridge in ((0.0, 0.5), (3.0, 0.0), (3.0, 2.0), (1e3, 0.0)):
        x = solver.Block(g, ridge).minimum(rho, radius)
        if x.any():
            assert np.abs(g @ x - rho + ridge * x + radius * x / np.linalg.norm(x)).max() < 1e-8
        else:
            assert np.linalg.norm(rho) <= radius


def test_smallest_refines_a_grid():
    best, seen = solver.smallest(lambda vs: [(v - 1.37) ** 2 for v in vs], -4, 7)
    assert abs(best - 1.37) <= 0.05 and len(seen) < 40


def test_agrees_with_mllib(claims):
    a = GLM("poisson", {"age": "raw", "region": "onehot"}).fit(claims, "y", offset="o")
    b = MLlibGLM("poisson", {"age": "raw", "region": "onehot"}).fit(claims, "y", offset="o")
    assert [b.fitted.intercept, *b.fitted.coefficients] == pytest.approx(list(a.coef.values()), abs=1e-6)


def test_collinear_column_is_named(claims):
    with pytest.raises(ValueError, match="twice"):
        GLM("gaussian", {"age": "raw", "twice": "raw"}).fit(claims.withColumn("twice", F.col("age") * 2), "amount")


def test_lasso_conditions(claims):
    alpha = 0.05
    g = GLM("gaussian", {"age": "standardize", "power": "standardize", "region": "onehot"}, alpha=alpha, l1_ratio=1.0).fit(claims, "amount")
    d = g.predict(claims).select("id", "amount", "prediction", *[c.alias(f"x{i}") for i, (_, c) in enumerate(g.design_columns())]).orderBy("id").toPandas()
    for i, b in enumerate(g.beta[1:], 1):
        slope = (d[f"x{i}"] * (d.amount - d.prediction)).mean()
        assert abs(slope - alpha * np.sign(b)) < 1e-5 if b else abs(slope) <= alpha + 1e-5
    with pytest.raises(ValueError, match="L1"):
        g.se()


def test_cross_validated_path(claims):
    g = GLM("poisson", {"age": "raw", "power": "raw", "region": "onehot"}, alpha="cv", n_alphas=8, cv=3, l1_ratio=1.0).fit(claims, "y", id_col="id")
    assert g.path[0]["n_nonzero"] == 0 and g.path[-1]["n_nonzero"] >= 3
    one = GLM("poisson", {"age": "raw", "power": "raw", "region": "onehot"}, alpha="cv", n_alphas=8, cv=3, l1_ratio=1.0, alpha_rule="min").fit(claims, "y", id_col="id")
    assert one.alpha_ <= g.alpha_


def test_group_enters_together(claims):
    g = GLM("gaussian", {"age": enc.BSpline("age", 5), "region": "onehot"}, alpha=0.02, l1_ratio=1.0, group_lasso=True).fit(claims, "amount")
    for at in g.slices.values():
        zero = g.beta[at] == 0
        assert zero.all() or not zero.any()


def test_smooth_and_monotone(claims):
    s = GLM("poisson", {"age": "smooth"}).fit(claims, "y", offset="o")
    assert 1 < s.edf < 9 and s.lambdas["age"] > 0
    for way, sign in (("increasing", 1), ("decreasing", -1)):
        m = GLM("gaussian", {"age": enc.BSpline("age", 6, monotone=way)}).fit(claims, "amount")
        steps = sign * np.diff(np.concatenate([[0], m.beta[1:]]))
        assert (steps >= -1e-9).all()
    flat = GLM("gaussian", {"age": enc.BSpline("age", 6, monotone="decreasing")}).fit(claims.withColumn("up", F.col("age")), "up")
    assert np.allclose(flat.beta[1:], 0, atol=1e-8) and flat.edf == pytest.approx(1)


def test_interaction_fits_better(claims):
    plain = GLM("gaussian", {"age": "spline", "region": "onehot"}).fit(claims, "amount")
    both = GLM("gaussian", {"age": "spline", "region": "onehot", "age*region": enc.Interaction("age", "region", factor=True)}).fit(claims, "amount")
    assert both.deviance <= plain.deviance


def test_contributions_add_up(claims):
    g = GLM("poisson", {"age": "spline", "region": "onehot"}).fit(claims, "y")
    c = g.contributions(g.predict(claims)).withColumn("eta", F.col("contribution_intercept") + F.col("contribution_age") + F.col("contribution_region"))
    assert c.agg(F.max(F.abs(F.exp("eta") - F.col("prediction")))).first()[0] < 1e-9


def test_partial_dependence_and_importance(spark, claims):
    d = spark.createDataFrame([(float(i), float(i % 2), 1 + 2.0 * i - i % 2) for i in range(8)], "x double, z double, y double")
    g = GLM("gaussian", {"x": "raw", "z": "raw"}).fit(d, "y")
    pd = explain.partial_dependence(g, d, "x", [0.0, 1.0]).orderBy("value").collect()
    assert pd[1]["prediction"] - pd[0]["prediction"] == pytest.approx(2)
    g = GLM("poisson", {"age": "raw", "power": "raw"}).fit(claims, "y", offset="o")
    imp = {r["feature"]: r["importance"] for r in explain.permutation_importance(g, claims, "y", "poisson", ["age", "exposure"], "id").collect()}
    assert imp["age"] > 0 and imp["exposure"] == pytest.approx(0, abs=1e-12)


def test_bench_report(claims, tmp_path):
    folded = splits.kfold(claims, "id", 2)
    task = bench.Task("y", "poisson", exposure="exposure")
    r = bench.run(folded, task, {"plain": lambda: GLM("poisson", {"age": "raw"}), "region": lambda: GLM("poisson", {"age": "raw", "region": "onehot"})}, fold="fold", id_col="id", features=["age", "region"], bins=5, explain_rows=100)
    assert r.predictions.count() == claims.count()
    bench.validate(r.report)
    r.write(tmp_path)
    assert {p.name for p in tmp_path.iterdir()} == {"report.json", "report.md", "report.html", "pinned.json"}
    assert "**" in r.to_markdown() and 'id="report"' in (tmp_path / "report.html").read_text()
    with pytest.raises(ValueError, match="schema"):
        bench.validate({"schema": "other/1"})


def test_cleaning(spark):
    raw = spark.createDataFrame([(1, 16.0, 2.01, "'D'", 15.0, 100.0, 100.0, 230.0, "'B1'", "'Diesel'", 10.0, "'R1'")], "IDpol long, ClaimNb double, Exposure double, Area string, VehPower double, VehAge double, DrivAge double, BonusMalus double, VehBrand string, VehGas string, Density double, Region string")
    f = data.clean_motor_frequency(raw)
    r = f.first()
    assert (r["ClaimNb"], r["Exposure"], r["VehPower"], r["VehAge"], r["DrivAge"], r["BonusMalus"], r["AreaCode"], r["VehGas"]) == (4, 1, 9, 20, 90, 150, 4, "Diesel")
    ids = spark.createDataFrame([(1,), (3,)], "IDpol long")
    claims = spark.createDataFrame([(1, 1000.0), (1, 3000.0), (3, 2.5e6), (99, 5.0)], "IDpol long, ClaimAmount double")
    s = data.clean_motor_severity(claims, ids).orderBy("IDpol").collect()
    assert [(r["IDpol"], r["ClaimCount"], r["ClaimTotal"], r["Severity"]) for r in s] == [(1, 2, 4000, 2000), (3, 1, 1e6, 1e6)]
    c = data.clean_churn(spark.createDataFrame([("Yes", " ", "No internet service"), ("No", "1.5", "Yes")], "Churn string, TotalCharges string, Backup string")).collect()
    assert [(r["Churn"], r["TotalCharges"], r["Backup"]) for r in c] == [(1, 0, "No"), (0, 1.5, "Yes")]
    bikes = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "at int, year int, month int")
    with pytest.raises(ValueError, match="backwards"):
        data.clean_hourly_bikes(bikes, "at")


def test_load_keeps_parquet(spark, tmp_path):
    raw = spark.createDataFrame([("'0'",), ("'1'",)], "Class string")
    first = data.load(spark, "card_fraud", {"raw": raw}, folder=str(tmp_path))
    assert sorted(r[0] for r in first.collect()) == [0, 1]
    assert data.load(spark, "card_fraud", folder=str(tmp_path)).count() == 2
    with pytest.raises(ValueError, match="raw"):
        data.load(spark, "churn", folder=str(tmp_path))


def test_report_tables_have_all_rows():
    assert bench._table([{"level": f"v{i}"} for i in range(75)]).count("<td>") == 75
