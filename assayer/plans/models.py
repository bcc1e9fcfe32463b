"""Registered queries of models, scorecards and explanations; saturated models have a closed form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import encoders as enc
from assayer.operators import explain, tables
from assayer.operators.glm import GLM
from assayer.operators.scorecard import compare, scorecard
from assayer.plans import scores
from assayer.plans.recipes import run_named
from assayer.plans.scored import LABELLED, POSITIVE, RATE, labelled, rate, rounded, table
from assayer.sources.data import clean_motor_severity

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, view, make, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(view(spark, sf_dir)), 5)
    if sql:
        SQL[name] = sql


def R(x: str) -> str:
    return f"round({x}, 5) + 0.0"


def _levels(df, model: GLM, **options):
    """Fitted means of the levels of flag."""
    return model.predict(df.select("flag").distinct(), **options).select("flag", "prediction")


_FLAG = "flag, {v} AS prediction FROM ({s}) GROUP BY flag"
_POS = POSITIVE.replace(" FROM lineitem", ", l_returnflag AS flag FROM lineitem")


def _positive(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), q.alias("w"), (5000.0 + 1000.0 * q).alias("mu"), F.col("l_returnflag").alias("flag"))


def _binary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((F.col("l_linestatus") == "O").cast("double").alias("y"), (F.col("l_quantity") / 50.0).alias("w"), F.col("l_returnflag").alias("flag"))


_BIN = "SELECT (l_linestatus = 'O')::INT::DOUBLE AS y, l_quantity / 50.0 AS w, l_returnflag AS flag FROM lineitem"
for _f, _view, _sql, _p in (("poisson", rate, RATE, None), ("gamma", _positive, _POS, None), ("gaussian", _positive, _POS, None), ("tweedie", _positive, _POS, 1.5), ("binomial", _binary, _BIN, None)):
    add(f"glm_{_f}_onehot", _view, lambda df, f=_f, p=_p: _levels(df, GLM(f, {"flag": "onehot"}, power=p, tol=1e-14).fit(df, "y", "w")), "SELECT " + _FLAG.format(v=R("sum(w * y) / sum(w)"), s=_sql))
add("glm_offset", lambda s, d: rate(s, d).withColumn("o", F.log("w")), lambda df: _levels(df, GLM("poisson", {"flag": "onehot"}, tol=1e-14).fit(df, "y", offset="o")), "SELECT " + _FLAG.format(v=R("sum(y) / sum(w)"), s=RATE))
add("glm_line", _positive, lambda df: GLM("gaussian", {"w": "raw"}).fit(df, "y").table(df.sparkSession).select("name", "coef"), f"SELECT '(intercept)' AS name, {R('regr_intercept(y, w)')} AS coef FROM ({POSITIVE}) UNION ALL SELECT 'w', {R('regr_slope(y, w)')} FROM ({POSITIVE})")
# of a saturated Poisson model the information of a level is its fitted total
add("glm_inference", rate, lambda df: GLM("poisson", {"flag": "onehot"}, tol=1e-14).fit(df, "y", "w").table(df.sparkSession),
    f"WITH s AS ({RATE}), g AS (SELECT flag, ln(sum(w * y) / sum(w)) AS b, 1 / sum(w * y) AS v, sum((w * (y - m)) ** 2) / sum(w * y) ** 2 AS rv FROM (SELECT *, sum(w * y) OVER (PARTITION BY flag) / sum(w) OVER (PARTITION BY flag) AS m FROM s) GROUP BY flag), a AS (SELECT b AS b0, v AS v0, rv AS rv0 FROM g WHERE flag = 'A'), n AS (SELECT count(*) / (count(*) - 3.0::DOUBLE) AS k FROM s) "
    f"SELECT CASE WHEN flag = 'A' THEN '(intercept)' ELSE 'flag=' || flag END AS name, {R('CASE WHEN flag = ' + chr(39) + 'A' + chr(39) + ' THEN b ELSE b - b0 END')} AS coef, {R('sqrt(CASE WHEN flag = ' + chr(39) + 'A' + chr(39) + ' THEN v ELSE v + v0 END)')} AS se, {R('sqrt(k * CASE WHEN flag = ' + chr(39) + 'A' + chr(39) + ' THEN rv ELSE rv + rv0 END)')} AS se_robust FROM g, a, n")  # fmt: skip
add("glm_deviance", rate, lambda df: (lambda g: df.sparkSession.createDataFrame([(g.deviance / 1e3, g.null_deviance / 1e3)], "deviance double, null_deviance double"))(GLM("poisson", {"flag": "onehot"}, tol=1e-14).fit(df, "y", "w")),
    f"WITH s AS (SELECT *, sum(w * y) OVER (PARTITION BY flag) / sum(w) OVER (PARTITION BY flag) AS m, sum(w * y) OVER () / sum(w) OVER () AS m0 FROM ({RATE})) SELECT {R('sum(w * ' + scores._unit('poisson', mu='m') + ') / 1000')} AS deviance, {R('sum(w * ' + scores._unit('poisson', mu='m0') + ') / 1000')} AS null_deviance FROM s")
add("glm_contributions", rate, lambda df: (lambda g: g.contributions(df).select("flag", "contribution_intercept", "contribution_flag").distinct())(GLM("poisson", {"flag": "onehot"}, tol=1e-14).fit(df, "y", "w")),
    f"WITH g AS (SELECT flag, ln(sum(w * y) / sum(w)) AS b FROM ({RATE}) GROUP BY flag), a AS (SELECT b AS b0 FROM g WHERE flag = 'A') SELECT flag, {R('b0')} AS contribution_intercept, {R('b - b0')} AS contribution_flag FROM g, a")
add("glm_smooth", rate, lambda df: GLM("poisson", {"quantity": "smooth"}).fit(df, "y", "w").table(df.sparkSession))
add("glm_monotone", rate, lambda df: GLM("poisson", {"quantity": enc.BSpline("quantity", 6, monotone="increasing")}).fit(df, "y", "w").table(df.sparkSession))
add("glm_lasso", _positive, lambda df: GLM("gaussian", {"w": "standardize", "flag": "onehot"}, alpha=500.0, l1_ratio=1.0).fit(df, "y").table(df.sparkSession).select("name", "coef"))
# with one standardised column the lasso is the slope moved towards 0 by alpha
add("glm_lasso_one", _positive, lambda df: GLM("gaussian", {"w": "standardize"}, alpha=500.0, l1_ratio=1.0).fit(df, "y").table(df.sparkSession).select("name", "coef"),
    f"WITH a AS (SELECT avg(y) AS m, covar_pop(y, w) / stddev_pop(w) AS b FROM ({POSITIVE})) SELECT '(intercept)' AS name, {R('m')} AS coef FROM a UNION ALL SELECT 'w', {R('sign(b) * greatest(abs(b) - 500, 0)')} FROM a")
add("glm_ridge_one", _positive, lambda df: GLM("gaussian", {"w": "standardize"}, alpha=0.5, l1_ratio=0.0).fit(df, "y").table(df.sparkSession).select("name", "coef"),
    f"WITH a AS (SELECT avg(y) AS m, covar_pop(y, w) / stddev_pop(w) AS b FROM ({POSITIVE})) SELECT '(intercept)' AS name, {R('m')} AS coef FROM a UNION ALL SELECT 'w', {R('b / 1.5')} FROM a")
add("glm_group_lasso", rate, lambda df: GLM("poisson", {"quantity": enc.BSpline("quantity", 6), "flag": "onehot"}, alpha=0.001, l1_ratio=1.0, group_lasso=True).fit(df, "y", "w").table(df.sparkSession).select("name", "coef"))
add("glm_cv_path", lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.log("o_totalprice").alias("y"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")),
    lambda df: df.sparkSession.createDataFrame([{k: v for k, v in r.items() if k != "coef"} for r in GLM("gaussian", {"priority": "onehot", "status": "onehot"}, alpha="cv", n_alphas=20).fit(df, "y", id_col="id").path], "alpha double, mean double, n_nonzero int, se double"))
add("partial_dependence", rate, lambda df: explain.partial_dependence(GLM("poisson", {"flag": "onehot"}, tol=1e-14).fit(df, "y", "w"), df, "flag"), f"SELECT flag AS value, {R('sum(w * y) / sum(w)')} AS prediction FROM ({RATE}) GROUP BY flag")
add("permutation_importance", lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e4).alias("y"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")),
    lambda df: explain.permutation_importance(GLM("gamma", {"priority": "onehot", "status": "onehot"}).fit(df, "y"), df, "y", "gamma", ["priority", "status"], "id"))
add("attributions", lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e4).alias("y"), F.col("o_orderpriority").alias("priority")), lambda df: explain.attributions(GLM("gamma", {"priority": "onehot"}).fit(df, "y"), df, "id"))


def _card(sql: str, panel: dict[str, tuple[str, str]]) -> str:
    return sql + " UNION ALL ".join(f"SELECT '{k}' AS metric, {R(a)} AS model, {R(b)} AS naive FROM c" for k, (a, b) in panel.items())


_d = scores._unit("poisson", mu="mu_b")
_n = scores._unit("poisson", mu="m")
add("scorecard_poisson", rate, lambda df: scorecard(df, "y", "mu_b", "poisson", "w").frame(df.sparkSession), _card(
    f"WITH s AS (SELECT *, sum(w * y) OVER () / sum(w) OVER () AS m FROM ({RATE})), c AS (SELECT sum(w * {_d}) / sum(w) AS d, sum(w * {_n}) / sum(w) AS n, sum(w) / count(*) AS k, sum(w * y) / sum(w * mu_b) AS bal, sqrt(sum(w * (y - mu_b) ** 2) / sum(w)) AS rmse, sqrt(sum(w * (y - m) ** 2) / sum(w)) AS rmse0, "
    f"sum(w * abs(y - mu_b)) / sum(w) AS mae, sum(w * abs(y - m)) / sum(w) AS mae0, ({scores._GINI.format(k='mu_b')}) AS g, ({scores._GINI.format(k='y / w')}) AS top FROM s) ",
    {"deviance": ("d", "n"), "deviance_per_row": ("d * k", "n * k"), "d2": ("1 - d / n", "0"), "gini": ("g", "0"), "normalized_gini": ("g / top", "0"), "balance": ("bal", "1"), "rmse": ("rmse", "rmse0"), "mae": ("mae", "mae0"), "r2": ("1 - rmse ** 2 / rmse0 ** 2", "0")}))
_b = scores._unit("binomial", mu="p2")
_b0 = scores._unit("binomial", mu="m")
add("scorecard_binomial", labelled, lambda df: scorecard(df, "y", "p2", "binomial", "w").frame(df.sparkSession), _card(
    f"WITH s AS (SELECT *, sum(w * y) OVER () / sum(w) OVER () AS m FROM ({LABELLED})), g AS (SELECT p2 AS k, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM s GROUP BY 1), r AS (SELECT *, sum(pos) OVER (ORDER BY k DESC) AS cp, sum(neg) OVER (ORDER BY k DESC) AS cn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g), "
    f"k AS (SELECT sum(neg * (cp - pos / 2)) / max(ap) / max(an) AS auc, sum(pos * cp / (cp + cn)) / max(ap) AS ap, max(abs(cp / ap - cn / an)) AS ks FROM r), t AS (SELECT {scores._COUNTS.replace('p >=', 'p2 >=').replace('p <', 'p2 <').format(t='0.5::DOUBLE')} FROM s), "
    f"q AS (SELECT sum(w * {_b}) / sum(w) / 2 AS ll, sum(w * {_b0}) / sum(w) / 2 AS ll0, sum(w * (y - p2) ** 2) / sum(w) AS br, max(m) AS m, sum(w * y) / sum(w * p2) AS bal FROM s), c AS (SELECT k.*, t.*, q.* FROM k, t, q) ",
    {"log_loss": ("ll", "ll0"), "brier": ("br", "m * (1 - m)"), "roc_auc": ("auc", "0.5"), "average_precision": ("ap", "m"), "ks": ("ks", "0"), "mcc": (scores._z("tp * tn - fp * fn", "(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn))"), "0"), "f1": (scores._z("2 * tp", "(2 * tp + fp + fn)"), "CASE WHEN m >= 0.5 THEN 2 * m / (1 + m) ELSE 0 END"), "balance": ("bal", "1")}))
add("compare", rate, lambda df: df.sparkSession.createDataFrame(compare(scorecard(df, "y", "mu_a", "poisson", "w"), scorecard(df, "y", "mu_b", "poisson", "w")), "a double, b double, metric string, winner string"))
add("residual_sample", lambda s, d: table(s, d, "events").select("event_id", "value"), lambda df: tables.residual_sample(df, "event_id", 500, 3), "SELECT event_id, round(value, 5) + 0.0 AS value FROM events ORDER BY md5('3:' || event_id), event_id LIMIT 500")
add("bench_summary", lambda s, d: (s, d), lambda x: x[0].createDataFrame(run_named("order_price", *x, features=(), report=False).summary(), "folds int, mean double, metric string, model string, std double"))
QUERIES["clean_severity_join"] = lambda s, d: rounded(clean_motor_severity(table(s, d, "lineitem").select(F.col("l_orderkey").alias("IDpol"), F.col("l_extendedprice").alias("ClaimAmount")), table(s, d, "orders").select(F.col("o_orderkey").alias("IDpol"), F.col("o_orderstatus").alias("Area"))), 5)
SQL["clean_severity_join"] = f"SELECT l_orderkey AS \"IDpol\", count(*)::DOUBLE AS \"ClaimCount\", {R('sum(least(l_extendedprice, 1e6))')} AS \"ClaimTotal\", {R('sum(least(l_extendedprice, 1e6)) / count(*)')} AS \"Severity\", o_orderstatus AS \"Area\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderstatus, o_orderkey"
