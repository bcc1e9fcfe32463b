"""SQL of spline bases by their recursion, and of fits that have a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import encoders as enc
from assayer.operators.glm import GLM
from assayer.plans.prep import _even
from assayer.plans.scored import POSITIVE, RATE, positive, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _r(x: str, places: int = 5) -> str:
    return f"round({x}, {places}) + 0.0"


# ---- B-splines: the recursion over the degree, a query per degree


def _bases(inner: int, degree: int = 3) -> str:
    """Common table expressions up to ``a{degree}``, where a{degree}_{i} is the i-th basis function at x = quantity of ``s``."""
    knots = [1] * degree + list(range(1, inner + 3)) + [inner + 2] * degree
    n, last = len(knots) - 1, degree + inner
    shares = ", ".join(f"{i / (inner + 1)}::DOUBLE" for i in range(inner + 2))
    t = lambda i: f"k[{knots[i]}]"

    def start(i: int) -> str:
        if not degree <= i <= last:
            return "0.0::DOUBLE"
        return f"(x >= {t(i)} AND (x < {t(i + 1)}{f' OR x = {t(i + 1)}' if i == last else ''}))::INT::DOUBLE"

    def step(p: int, i: int) -> str:
        left = f"(x - {t(i)}) / ({t(i + p)} - {t(i)}) * a{p - 1}_{i}" if knots[i + p] > knots[i] else "0"
        right = f"({t(i + p + 1)} - x) / ({t(i + p + 1)} - {t(i + 1)}) * a{p - 1}_{i + 1}" if knots[i + p + 1] > knots[i + 1] else "0"
        return f"{left} + {right} AS a{p}_{i}"

    parts = [
        f"k AS (SELECT quantile_cont(quantity, [{shares}]) AS k FROM s)",
        f"a0 AS (SELECT x, k, {', '.join(f'{start(i)} AS a0_{i}' for i in range(n))} FROM (SELECT DISTINCT quantity AS x FROM s), k)",
    ]
    parts += [f"a{p} AS (SELECT x, k, {', '.join(step(p, i) for i in range(n - p))} FROM a{p - 1})" for p in range(1, degree + 1)]
    return ", ".join(parts)


SQL["bspline_basis"] = f"""
WITH s AS ({RATE}), {_bases(3)}
SELECT x AS quantity, {", ".join(f"{_r(f'a3_{i}', 6)} AS b{i}" for i in range(1, 7))} FROM a3
"""
SQL["interaction_basis"] = f"""
WITH s AS ({RATE}), {_bases(1)}
SELECT x AS quantity, flag, {", ".join(f"CASE WHEN flag = '{v}' THEN {_r(f'a3_{i}', 6)} ELSE 0 END AS quantity_{i}_x_flag_{v}" for i in range(1, 5) for v in "NR")}
FROM (SELECT DISTINCT quantity, flag FROM s) JOIN a3 ON quantity = x
"""


# ---- a monotone line: the line itself if it rises, else the mean


def _monotone(spark, sf_dir):
    df = positive(spark, sf_dir)
    fits = {d: GLM("gaussian", {"w": enc.piecewise_linear("w", 1, d)}).fit(df, "y") for d in ("increasing", "decreasing")}
    at = df.select("w").distinct()
    for d, g in fits.items():
        at = g.predict(at, out=d)
    return rounded(at.select("w", *[(F.col(d) / 1e3).alias(d) for d in fits]), 5)


QUERIES["glm_monotone_one"] = _monotone
SQL["glm_monotone_one"] = f"""
WITH s AS ({POSITIVE}), l AS (SELECT regr_slope(y, w) AS b, avg(y) AS m, avg(w) AS c FROM s)
SELECT DISTINCT w, {_r("(m + greatest(b, 0) * (w - c)) / 1e3")} AS increasing, {_r("(m + least(b, 0) * (w - c)) / 1e3")} AS decreasing FROM s, l
"""


# ---- a cross-validated path over one column: each fit is a slope moved towards 0

_FOLDS, _ALPHAS, _RATIO = 3, 8, 0.01


def _path(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e5).alias("y"), F.col("o_custkey").cast("double").alias("x"))
    g = GLM("gaussian", {"x": "standardize"}, alpha="cv", l1_ratio=1.0, n_alphas=_ALPHAS, alpha_ratio=_RATIO, cv=_FOLDS, tol=1e-14).fit(df, "y", id_col="id")
    rows = [(i, r["alpha"], r["mean"], r["se"], r["n_nonzero"], r["alpha"] == g.alpha_) for i, r in enumerate(g.path)]
    return rounded(spark.createDataFrame(rows, "step int, alpha double, mean double, se double, n_nonzero int, chosen boolean"), 6)


QUERIES["glm_cv_path_one"] = _path
SQL["glm_cv_path_one"] = f"""
WITH o AS (SELECT o_orderkey AS id, o_totalprice / 1e5 AS y, o_custkey::DOUBLE AS x FROM orders),
z AS (SELECT id, y, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z, row_number() OVER (ORDER BY md5('0:' || id), id) - 1 AS r, count(*) OVER () AS n FROM o),
f AS (SELECT *, {_even("r", "n", _FOLDS)} AS fold FROM z),
p AS (SELECT i::INT AS step, abs(covar_pop(y, z)) * (1 + 1e-10) * pow({_RATIO}, i / {_ALPHAS - 1}.0::DOUBLE) AS alpha, covar_pop(y, z) AS c FROM f, range({_ALPHAS}) t(i) GROUP BY i),
t AS (SELECT k, avg(y) AS my, avg(z) AS mz, covar_pop(y, z) AS c, var_pop(z) AS v FROM f, range({_FOLDS}) t(k) WHERE fold <> k GROUP BY k),
b AS (SELECT step, k, my, mz, sign(t.c) * greatest(abs(t.c) - alpha, 0) / v AS b FROM p, t),
d AS (SELECT step, k, avg((y - my - b * (z - mz)) ** 2) AS d FROM b JOIN f ON fold = k GROUP BY step, k),
e AS (SELECT step, avg(d) AS m, stddev_samp(d) / sqrt({_FOLDS}) AS se FROM d GROUP BY step),
least AS (SELECT m + se AS allowed FROM e ORDER BY m, step LIMIT 1)
SELECT step, {_r("alpha", 6)} AS alpha, {_r("m", 6)} AS mean, {_r("se", 6)} AS se, (abs(c) > alpha)::INT AS n_nonzero,
  step = (SELECT min(step) FROM e, least WHERE m <= allowed) AS chosen FROM p JOIN e USING (step)
"""
