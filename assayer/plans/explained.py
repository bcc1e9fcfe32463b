"""SQL of comparisons, interactions and explanations, and the query of one boosted split."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import explain
from assayer.operators.glm import GLM
from assayer.operators.scorecard import BALANCE_TIE
from assayer.operators.trees import BoostedTrees
from assayer.plans import scores
from assayer.plans.scored import RATE, rate, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _r(x: str, places: int = 5) -> str:
    return f"round({x}, {places}) + 0.0"


# ---- interactions: the margins' factors fitted in turn, sweep by sweep


def _interaction(first: str, second: str, sweeps: int = 15) -> str:
    """Strength of a binned number and a category as one scalar query over ``s``."""
    steps = [f"x{k + 1} AS MATERIALIZED (SELECT i, j, w, a, x * sum(a) OVER (PARTITION BY {m}) / sum(x) OVER (PARTITION BY {m}) AS x FROM x{k})" for k, m in enumerate(["i", "j"] * sweeps)]
    return f"""
WITH s AS ({RATE}), {scores._bins(first, 5, "A")},
x0 AS MATERIALIZED (
  SELECT bin AS i, {second} AS j, sum(w) AS w, sum(w * y) AS a, sum(w * mu_a) AS x FROM s JOIN b ON {first} = k GROUP BY ALL
),
{", ".join(steps)}
SELECT {_r(f"sum(w * {scores._unit('poisson', 'a / w', 'x / w')}) / sum(w)", 6)} AS strength FROM x{2 * sweeps}
"""


SQL["interaction_strength"] = _interaction("discount", "flag")
SQL["rank_pairs"] = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, strength FROM ({_interaction(a, b)})" for a, b in (("quantity", "flag"), ("discount", "flag"), ("quantity", "status")))


# ---- two scorecards side by side


def _panel(mu: str) -> str:
    unit, null = (scores._unit("poisson", mu=m) for m in (mu, "m"))
    metrics = {
        "deviance": "d", "deviance_per_row": "d * k", "d2": "1 - d / n", "gini": "g", "normalized_gini": "g / top",
        "balance": "bal", "rmse": "sqrt(se)", "mae": "ae", "r2": "1 - se / se0",
    }
    return f"""
SELECT unnest({list(metrics)}) AS metric, unnest([{", ".join(metrics.values())}]) AS v FROM (
  SELECT sum(w * {unit}) / sum(w) AS d, sum(w * {null}) / sum(w) AS n, sum(w) / count(*) AS k, sum(w * y) / sum(w * {mu}) AS bal,
    sum(w * (y - {mu}) ** 2) / sum(w) AS se, sum(w * (y - m) ** 2) / sum(w) AS se0, sum(w * abs(y - {mu})) / sum(w) AS ae,
    ({scores._GINI.format(k=mu)}) AS g, ({scores._GINI.format(k="y / w")}) AS top FROM s)
"""


SQL["compare"] = f"""
WITH s AS (SELECT *, sum(w * y) OVER () / sum(w) OVER () AS m FROM ({RATE})),
a AS ({_panel("mu_a")}), b AS ({_panel("mu_b")}),
p AS (SELECT metric, a.v AS a, b.v AS b, abs(a.v - 1) - abs(b.v - 1) AS gap FROM a JOIN b USING (metric))
SELECT metric, {_r("a")} AS a, {_r("b")} AS b, CASE
  WHEN metric = 'balance' THEN CASE WHEN abs(gap) < {BALANCE_TIE} THEN 'tie' WHEN gap < 0 THEN 'a' ELSE 'b' END
  WHEN abs(a - b) <= 1e-8 + 1e-5 * abs(b) THEN 'tie'
  WHEN (a > b) = (metric IN ('d2', 'gini', 'normalized_gini', 'r2')) THEN 'a' ELSE 'b' END AS winner FROM p
"""


# ---- explanations of models with one factor, whose means are those of its levels

_ORDERS = "SELECT o_orderkey AS id, o_totalprice / 1e4 AS y, o_orderpriority AS priority FROM orders"
SQL["attributions"] = f"""
WITH o AS ({_ORDERS}), g AS (SELECT priority, ln(avg(y)) AS b FROM o GROUP BY priority),
p AS (SELECT id, b, (SELECT arg_min(b, priority) FROM g) AS b0 FROM o JOIN g USING (priority)),
k AS (
  SELECT *, 'highest' AS kind, row_number() OVER (ORDER BY b DESC, id) AS i FROM p
  UNION ALL SELECT *, 'lowest', row_number() OVER (ORDER BY b, id) FROM p
  UNION ALL SELECT *, 'sample', row_number() OVER (ORDER BY md5('0:' || id)) FROM p
)
SELECT id, {_r("exp(b)")} AS prediction, {_r("b0")} AS contribution_intercept, {_r("b - b0")} AS contribution_priority, kind FROM k WHERE i <= 10
"""


def _permutation(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e4).alias("y"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    model = GLM("gamma", {"priority": "onehot"}, tol=1e-14).fit(df, "y")
    return rounded(explain.permutation_importance(model, df, "y", "gamma", ["priority", "status"], "id"), 5)


QUERIES["permutation_importance_one"] = _permutation
SQL["permutation_importance_one"] = f"""
WITH o AS ({_ORDERS}), g AS (SELECT priority, avg(y) AS mu FROM o GROUP BY priority),
l AS (SELECT y, priority, row_number() OVER (ORDER BY md5('0:' || id)) AS i FROM o),
d AS (SELECT priority AS dealt, row_number() OVER (ORDER BY md5('1000003:' || id)) AS i FROM o),
e AS (SELECT y, own.mu AS before, got.mu AS after FROM l JOIN d USING (i) JOIN g own ON own.priority = l.priority JOIN g got ON got.priority = dealt)
SELECT 'priority' AS feature, {_r(f"avg({scores._unit('gamma', mu='after')}) - avg({scores._unit('gamma', mu='before')})")} AS importance FROM e
UNION ALL SELECT 'status', 0.0::DOUBLE
"""


# ---- boosted trees: the first split, by the gain of every cut


def _split(spark, sf_dir):
    df = rate(spark, sf_dir)
    trees = BoostedTrees("poisson", ["discount"], ["status"], n_trees=1, max_depth=1, learning_rate=1.0, ridge=0.001, valid_fraction=0.0).fit(df, "y", "w")
    return rounded(trees.predict(df.select("discount", "status").distinct()), 5)


QUERIES["boosted_split"] = _split
_GAIN = "g * g / (h + 0.001) + (tg - g) ** 2 / (th - h + 0.001) - tg * tg / (th + 0.001)"
SQL["boosted_split"] = f"""
WITH s AS (SELECT *, sum(w * y) OVER () / sum(w) OVER () AS m FROM ({RATE})),
r AS (SELECT discount, status, w * (m - y) AS g, w * m AS h, m FROM s),
t AS (SELECT sum(g) AS tg, sum(h) AS th, count(*) AS tn, max(m) AS m FROM r),
a AS (SELECT 0 AS f, discount::VARCHAR AS v, discount AS o, sum(g) AS g, sum(h) AS h, count(*) AS n FROM r GROUP BY discount
  UNION ALL SELECT 1, status, sum(g) / (sum(h) + 0.001), sum(g), sum(h), count(*) FROM r GROUP BY status),
c AS (SELECT f, v, o, sum(g) OVER p AS g, sum(h) OVER p AS h, sum(n) OVER p AS n FROM a WINDOW p AS (PARTITION BY f ORDER BY o)),
best AS (SELECT f, o AS cut, g, h FROM c, t WHERE n >= 20 AND tn - n >= 20 ORDER BY {_GAIN} DESC, f, o LIMIT 1),
side AS (SELECT DISTINCT discount, status, (SELECT o FROM c WHERE c.f = best.f AND v = CASE WHEN best.f = 0 THEN discount::VARCHAR ELSE status END) <= cut AS lower FROM r, best)
SELECT discount, status, {_r("m * exp(CASE WHEN lower THEN -g / (h + 0.001) ELSE -(tg - g) / (th - h + 0.001) END)")} AS prediction FROM side, best, t
"""
