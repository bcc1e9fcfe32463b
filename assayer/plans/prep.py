"""Registered queries of splits and encoders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import encoders as e
from assayer.operators import splits
from assayer.plans.scored import RATE, TIMED, rate, rounded, table, timed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, view, make, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(view(spark, sf_dir)))
    if sql:
        SQL[name] = sql


def R(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("cust"))


_ORDERS = "SELECT o_orderkey AS id, o_orderpriority AS label, o_custkey AS cust FROM orders"


def _even(rank: str, n: str, k: int) -> str:
    return f"(CASE WHEN {rank} < ({n} % {k}) * ({n} // {k} + 1) THEN {rank} // ({n} // {k} + 1) ELSE {n} % {k} + ({rank} - ({n} % {k}) * ({n} // {k} + 1)) // greatest({n} // {k}, 1) END)::INT"


add("kfold", _orders, lambda df: splits.kfold(df, "id", 5, 7).select("id", "fold"), f"WITH s AS ({_ORDERS}), r AS (SELECT id, row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS r, count(*) OVER () AS n FROM s) SELECT id, {_even('r', 'n', 5)} AS fold FROM r")
add("stratified", _orders, lambda df: splits.stratified(df, "id", "label", 5, 7).select("id", "fold"), f"WITH s AS ({_ORDERS}) SELECT id, ((row_number() OVER (PARTITION BY label ORDER BY md5('7:' || id), id) - 1 + ('0x' || substr(md5('7:' || label), 1, 6))::BIGINT) % 5)::INT AS fold FROM s")
add("grouped", _orders, lambda df: splits.grouped(df, "cust", 5, 7).select("id", "fold"), f"WITH s AS ({_ORDERS}), g AS (SELECT DISTINCT cust FROM s), r AS (SELECT cust, row_number() OVER (ORDER BY md5('7:' || cust), cust) - 1 AS r, count(*) OVER () AS n FROM g) SELECT id, {_even('r', 'n', 5)} AS fold FROM s JOIN r USING (cust)")
add("time_ordered", timed, lambda df: splits.time_folds(df, "t", 4, 0.3).select("id", "fold"),
    f"WITH s AS ({TIMED}), n AS (SELECT count(*) AS n, ceil(0.3::DOUBLE * count(*))::BIGINT AS f FROM s), g AS (SELECT t, count(*) AS c FROM s GROUP BY t), st AS (SELECT t, sum(c) OVER (ORDER BY t) - c AS start FROM g), "
    "cuts AS (SELECT DISTINCT min(t) AS cut FROM st, n, range(4) r(i) WHERE start >= f + round_even(i * (n - f) / 4.0::DOUBLE, 0) GROUP BY i) SELECT id, (SELECT count(*) FROM cuts WHERE cut <= t)::INT - 1 AS fold FROM s")  # fmt: skip

add("onehot", rate, lambda df: df.select("flag", "quantity", *[c.alias(n) for n, c in e.OneHot("flag").fit(df).columns()]), f"SELECT flag, quantity, (flag = 'N')::INT::DOUBLE AS \"flag=N\", (flag = 'R')::INT::DOUBLE AS \"flag=R\" FROM ({RATE})")
add("standardize", rate, lambda df: df.select("flag", *[c.alias("z") for _, c in e.Standardize("quantity").fit(df, "w").columns()]), f"WITH s AS ({RATE}), a AS (SELECT sum(w * quantity) / sum(w) AS m FROM s), b AS (SELECT m, sqrt(sum(w * (quantity - m) ** 2) / sum(w)) AS sd FROM s, a GROUP BY m) SELECT flag, {R('(quantity - m) / sd')} AS z FROM s, b")
add("target_table", timed, lambda df: e.TargetEncode("level").table_of(df, "y"), f"WITH s AS ({TIMED}), p AS (SELECT avg(y) AS p FROM s) SELECT level, {R('(sum(y) + 10 * p) / (count(*) + 10)')} AS value FROM s, p GROUP BY level, p")
add("target_encoded", timed, lambda df: df.select("id", *[c.alias("value") for _, c in e.TargetEncode("level").fit(df, y="y").columns()]), f"WITH s AS ({TIMED}), p AS (SELECT avg(y) AS p FROM s), t AS (SELECT level, (sum(y) + 10 * p) / (count(*) + 10) AS v FROM s, p GROUP BY level, p) SELECT id, {R('v')} AS value FROM s JOIN t USING (level)")
add("target_oof", timed, lambda df: e.TargetEncode("level", seed=3).out_of_fold(df, "y", "id").select("id", F.col("__encoded").alias("value")),
    f"WITH s AS ({TIMED}), r AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || id), id) - 1 AS r, count(*) OVER () AS n FROM s), f AS (SELECT *, {_even('r', 'n', 5)} AS fold FROM r), "
    "pr AS (SELECT a.fold, (SELECT avg(y) FROM f b WHERE b.fold <> a.fold) AS p FROM (SELECT DISTINCT fold FROM f) a), tb AS (SELECT a.fold, f.level, sum(y) AS sy, count(*) AS c FROM (SELECT DISTINCT fold FROM f) a JOIN f ON f.fold <> a.fold GROUP BY ALL) "
    f"SELECT id, {R('(coalesce(sy, 0) + 10 * p) / (coalesce(c, 0) + 10)')} AS value FROM f JOIN pr USING (fold) LEFT JOIN tb USING (fold, level)")  # fmt: skip
add("target_past_only", timed, lambda df: e.TargetEncode("level").past_only(df, "y", "t", "id").select("id", F.col("__encoded").alias("value")),
    f"WITH s AS ({TIMED}), r AS (SELECT id, coalesce(sum(y) OVER lv, 0) AS sy, coalesce(count(y) OVER lv, 0) AS c, coalesce(avg(y) OVER al, 0) AS p FROM s WINDOW lv AS (PARTITION BY level ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), al AS (ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, {R('(sy + 10 * p) / (c + 10)')} AS value FROM r")
add("piecewise_basis", rate, lambda df: df.select("quantity", *[c.alias(f"b{i}") for i, (_, c) in enumerate(e.piecewise_linear("quantity", 4).fit(df).columns(), 1)]).groupBy("quantity").agg(*[F.max(f"b{i}").alias(f"b{i}") for i in range(1, 5)]),
    f"WITH s AS ({RATE}), k AS (SELECT quantile_cont(quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS k FROM s), d AS (SELECT DISTINCT quantity AS x FROM s) SELECT x AS quantity, "
    + ", ".join(f"{R(f'greatest(0, least((x - k[{i}]) / (k[{i + 1}] - k[{i}]), ' + (f'(k[{i + 2}] - x) / (k[{i + 2}] - k[{i + 1}])' if i < 4 else '1') + '))')} AS b{i}" for i in range(1, 5)) + " FROM d, k")
add("bspline_basis", rate, lambda df: df.select("quantity", *[c.alias(f"b{i}") for i, (_, c) in enumerate(e.BSpline("quantity", 6).fit(df).columns(), 1)]).distinct())
add("interaction_basis", rate, lambda df: df.select("quantity", "flag", *[c.alias(n.replace("[", "_").replace("]", "").replace("=", "_").replace("*", "_x_")) for n, c in e.Interaction("quantity", "flag", factor=True).fit(df).columns()]).distinct())
