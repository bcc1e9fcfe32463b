"""Registered queries of the scores, the tables and the tournament, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import metrics as m
from assayer.operators import tables as t
from assayer.plans.scored import LABELLED, POSITIVE, RATE, labelled, positive, rate, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, view, make, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(view(spark, sf_dir)))
    if sql:
        SQL[name] = sql


def R(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _unit(family: str, y: str = "y", mu: str = "mu", p: float = 0.0) -> str:
    if family == "gaussian":
        return f"({y} - {mu}) ** 2"
    if family == "poisson":
        return f"greatest(2 * (CASE WHEN {y} > 0 THEN {y} * (ln({y}) - ln({mu})) ELSE 0 END - ({y} - {mu})), 0)"
    if family == "gamma":
        return f"greatest(2 * (({y} - {mu}) / {mu} - (ln({y}) - ln({mu}))), 0)"
    if family == "binomial":
        return f"greatest(2 * (CASE WHEN {y} > 0 THEN {y} * (ln({y}) - ln({mu})) ELSE 0 END + CASE WHEN {y} < 1 THEN (1 - {y}) * (ln(1 - {y}) - ln(1 - {mu})) ELSE 0 END), 0)"
    return f"greatest(2 * (pow({y}, {2 - p}) / {(1 - p) * (2 - p)} - {y} * pow({mu}, {1 - p}) / {1 - p} + pow({mu}, {2 - p}) / {2 - p}), 0)"


FAMILIES = {
    "gaussian": ("gaussian", None, positive, POSITIVE, "mu"), "poisson": ("poisson", None, rate, RATE, "mu_a"), "gamma": ("gamma", None, positive, POSITIVE, "mu"),
    "tweedie15": ("tweedie", 1.5, positive, POSITIVE, "mu"), "tweedie25": ("tweedie", 2.5, positive, POSITIVE, "mu"), "binomial": ("binomial", None, labelled, LABELLED, "p"),
}
for _name, (_f, _p, _view, _sql, _mu) in FAMILIES.items():
    _d = _unit(_f, "y", _mu, _p or 0.0)
    _null = _unit(_f, "y", "m", _p or 0.0)
    add(f"deviance_{_name}", _view, lambda df, f=_f, p=_p, mu=_mu: m.deviance(df, "y", mu, f, "w", p), f"SELECT {R(f'sum(w * {_d}) / sum(w)')} AS deviance FROM ({_sql})")
    add(f"d2_{_name}", _view, lambda df, f=_f, p=_p, mu=_mu: m.d2(df, "y", mu, f, "w", p), f"WITH s AS ({_sql}), a AS (SELECT sum(w * y) / sum(w) AS m FROM s) SELECT {R(f'1 - sum(w * {_d}) / sum(w * {_null})')} AS d2 FROM s, a")

add("deviance_per_row", rate, lambda df: m.deviance_per_row(df, "y", "mu_a", "poisson", "w"), f"SELECT {R('sum(w * ' + _unit('poisson', mu='mu_a') + ') / count(*)')} AS deviance_per_row FROM ({RATE})")
add("balance", rate, lambda df: m.balance(df, "y", "mu_a", "w"), f"SELECT {R('sum(w * y) / sum(w * mu_a)')} AS balance FROM ({RATE})")
add("naive", rate, lambda df: m.naive(df, "y", "w"), f"SELECT {R('sum(w * y) / sum(w)')} AS naive FROM ({RATE})")
for _name, _loss in (("rmse", "sqrt(sum(w * (y - mu) ** 2) / sum(w))"), ("mae", "sum(w * abs(y - mu)) / sum(w)"), ("mape", "sum(w * abs(y - mu) / abs(y)) / sum(w)"), ("smape", "sum(w * 2 * abs(y - mu) / (abs(y) + abs(mu))) / sum(w)"), ("msle", "sum(w * (ln(1 + y) - ln(1 + mu)) ** 2) / sum(w)")):
    add(_name, positive, lambda df, f=getattr(m, _name): f(df, "y", "mu", "w"), f"SELECT {R(_loss)} AS {_name} FROM ({POSITIVE})")
add("r2", positive, lambda df: m.r2(df, "y", "mu", "w"), f"WITH s AS ({POSITIVE}), a AS (SELECT sum(w * y) / sum(w) AS m FROM s) SELECT {R('1 - sum(w * (y - mu) ** 2) / sum(w * (y - m) ** 2)')} AS r2 FROM s, a")
add("log_loss", labelled, lambda df: m.log_loss(df, "y", "p", "w"), f"SELECT {R('sum(w * ' + _unit('binomial', mu='p') + ') / sum(w) / 2')} AS log_loss FROM ({LABELLED})")
add("brier", labelled, lambda df: m.brier(df, "y", "p", "w"), f"SELECT {R('sum(w * (y - p) ** 2) / sum(w)')} AS brier FROM ({LABELLED})")

_COUNTS = "sum(CASE WHEN p >= {t} AND y = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN p >= {t} AND y = 0 THEN w ELSE 0 END) AS fp, sum(CASE WHEN p < {t} AND y = 1 THEN w ELSE 0 END) AS fn, sum(CASE WHEN p < {t} AND y = 0 THEN w ELSE 0 END) AS tn"


def _z(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END"


_FROM_COUNTS = ", ".join(
    f"{R(e)} AS {n}"
    for n, e in {
        "tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn", "accuracy": _z("tp + tn", "tp + fp + fn + tn"), "balanced_accuracy": f"({_z('tp', '(tp + fn)')} + {_z('tn', '(tn + fp)')}) / 2", "precision": _z("tp", "(tp + fp)"), "recall": _z("tp", "(tp + fn)"),
        "f1": _z("2 * tp", "(2 * tp + fp + fn)"), "mcc": _z("tp * tn - fp * fn", "(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn))"),
    }.items()
)
add("confusion", labelled, lambda df: m.confusion(df, "y", "p", 0.4, "w"), f"WITH c AS (SELECT {_COUNTS.format(t='0.4::DOUBLE')} FROM ({LABELLED})) SELECT {', '.join(R(c) + ' AS ' + c for c in ('tp', 'fp', 'fn', 'tn'))} FROM c")
add("threshold_metrics", labelled, lambda df: m.threshold_metrics(df, "y", "p", 0.4, "w"), f"WITH c AS (SELECT {_COUNTS.format(t='0.4::DOUBLE')} FROM ({LABELLED})) SELECT {_FROM_COUNTS}, 0.4::DOUBLE AS threshold FROM c")
# p2 scaled away from the marks, so that no score sits on a threshold by rounding alone
add("threshold_grid", lambda s, d: labelled(s, d).withColumn("p", F.col("p2") + 0.0003),
    lambda df: m.threshold_grid(df, "y", "p", "w"),
    f"WITH s AS (SELECT y, w, p2 + 0.0003 AS p FROM ({LABELLED})), g AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(101) r(i)), c AS (SELECT threshold, {_COUNTS.format(t='threshold')} FROM g, s GROUP BY threshold) "
    f"SELECT {R('threshold')} AS threshold, {_FROM_COUNTS}, {R('tp + fp')} AS alerts, {R('CASE WHEN tp > 0 THEN (tp + fp) / tp END')} AS alerts_per_tp FROM c")  # fmt: skip

_GINI = "SELECT greatest(-1, least(1, 1 - 2 * sum(w / sw * (2 * cy - y) / sy / 2))) FROM (SELECT w, y, sum(y) OVER (ORDER BY k) AS cy, sum(w) OVER () AS sw, sum(y) OVER () AS sy FROM (SELECT {k} AS k, sum(w) AS w, sum(y) AS y FROM s GROUP BY 1))"
add("gini", rate, lambda df: m.gini(df, "y", "mu_b", "w"), f"WITH s AS ({RATE}) SELECT {R('(' + _GINI.format(k='mu_b') + ')')} AS gini")
add("normalized_gini", rate, lambda df: m.normalized_gini(df, "y", "mu_b", "w"), f"WITH s AS ({RATE}) SELECT {R('(' + _GINI.format(k='mu_b') + ') / (' + _GINI.format(k='y / w') + ')')} AS normalized_gini")
add("lorenz_curve", rate, lambda df: m.lorenz_curve(df, "y", "mu_a", "w"),
    f"WITH s AS ({RATE}), g AS (SELECT mu_a AS k, sum(w) AS w, sum(y) AS y FROM s GROUP BY 1) SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y UNION ALL SELECT {R('least(1, sum(w) OVER (ORDER BY k) / sum(w) OVER ())')}, {R('least(1, sum(y) OVER (ORDER BY k) / sum(y) OVER ())')} FROM g")

_RANK = "WITH s AS ({v}), g AS (SELECT {k} AS k, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY k DESC) AS cp, sum(neg) OVER (ORDER BY k DESC) AS cn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g) "
for _s, _k in (("", "p2"), ("_ties", "p")):
    _w = _RANK.format(v=LABELLED, k=_k)
    add(f"roc_auc{_s}", labelled, lambda df, k=_k: m.roc_auc(df, "y", k, "w"), _w + f"SELECT {R('sum(neg * (cp - pos / 2)) / max(ap) / max(an)')} AS roc_auc FROM c")
    add(f"average_precision{_s}", labelled, lambda df, k=_k: m.average_precision(df, "y", k, "w"), _w + f"SELECT {R('sum(pos * cp / (cp + cn)) / max(ap)')} AS average_precision FROM c")
    add(f"ks{_s}", labelled, lambda df, k=_k: m.ks(df, "y", k, "w"), _w + f"SELECT {R('max(abs(cp / ap - cn / an))')} AS ks FROM c")
_w = _RANK.format(v=LABELLED, k="p")
add("roc_curve", labelled, lambda df: m.roc_curve(df, "y", "p", "w"), _w + f"SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'infinity'::DOUBLE AS threshold UNION ALL SELECT {R('least(1, cn / an)')}, {R('least(1, cp / ap)')}, {R('k')} FROM c")
add("pr_curve", labelled, lambda df: m.pr_curve(df, "y", "p", "w"), _w + f"SELECT {R('least(1, cp / ap)')} AS recall, {R('cp / (cp + cn)')} AS precision, {R('k')} AS threshold, {R('ap / (ap + an)')} AS positive_rate FROM c")
add("weighted_quantiles", rate, lambda df: m.weighted_quantiles(df, "quantity", [0.05, 0.25, 0.5, 0.75, 0.95], "w"),
    f"WITH s AS ({RATE}), g AS (SELECT quantity AS k, sum(w) AS w FROM s GROUP BY 1), c AS (SELECT k, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS share FROM g) SELECT p::DOUBLE AS p, min(k) AS value FROM c, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) v(p) WHERE share >= p GROUP BY p")


def _bins(key: str, n: int, rule: str, extra: str = "") -> str:
    """CTEs s, b(k, bin): tie groups with the bin of rule A (midpoints) or B (one step a group)."""
    bins = {
        "A": f"SELECT k, least(dense_rank() OVER (ORDER BY cell) - 1, {n - 1})::INT AS bin FROM cells",
        "B": f"SELECT k, least(i + min(CASE WHEN i = 0 THEN 0 ELSE cell - i END) OVER (ORDER BY k), {n - 1})::INT AS bin FROM cells",
    }
    return (
        f"g AS (SELECT {key} AS k, sum(w) AS w FROM s GROUP BY 1), tot AS (SELECT list_transform(range(1, {n}), lambda j: list_reduce(list_transform(range(j), lambda z: tw / {n}), lambda a, x: a + x)) AS e FROM (SELECT sum(w) AS tw FROM s)), "
        f"mids AS (SELECT k, sum(w) OVER (ORDER BY k) - w / 2 AS mid, row_number() OVER (ORDER BY k) - 1 AS i FROM g), cells AS (SELECT k, i, len(list_filter(e, lambda x: mid >= x)) AS cell FROM mids, tot), b AS ({bins[rule]})"
    )


_CELL = f"count(*) AS n_rows, {R('sum(w)')} AS weight, {R('sum(w * {mu}) / sum(w)')} AS predicted, {R('sum(w * y) / sum(w)')} AS actual, {R('sum(w * y) / sum(w * {mu})')} AS actual_over_expected"
for _s, _k in (("", "mu_b"), ("_ties", "mu_a")):
    add(f"calibration_table{_s}", rate, lambda df, k=_k: t.calibration_table(df, "y", k, "w", 10), f"WITH s AS ({RATE}), {_bins(_k, 10, 'A')} SELECT bin, {_CELL.format(mu=_k)} FROM s JOIN b ON {_k} = k GROUP BY bin")
add("binned_table", rate, lambda df: t.binned_table(df, "heavy", "y", "mu_a", "w", 10), f"WITH s AS ({RATE}), {_bins('heavy', 10, 'A')} SELECT bin, {_CELL.format(mu='mu_a')} FROM s JOIN b ON heavy = k GROUP BY bin")
add("bin_index", rate, lambda df: t.bin_index(df, "heavy", "w", 10).groupBy("heavy", "bin").agg(F.count(F.lit(1)).alias("n")), f"WITH s AS ({RATE}), {_bins('heavy', 10, 'A')} SELECT heavy, bin, count(*) AS n FROM s JOIN b ON heavy = k GROUP BY ALL")
add("lift", rate, lambda df: t.lift(df, "y", "mu_b", "w", 20), f"WITH s AS ({RATE}), {_bins('mu_b', 20, 'A')} SELECT bin, {_CELL.format(mu='mu_b')}, {R('sum(w * y) / sum(w) / (SELECT sum(w * y) / sum(w) FROM s)')} AS lift FROM s JOIN b ON mu_b = k GROUP BY bin")
_DL = f"count(*) AS n_rows, {R('sum(w)')} AS weight, {R('sum(w * {p} / {q}) / sum(w)')} AS ratio, {R('sum(w * y) / sum(w)')} AS actual, {R('sum(w * {p}) / sum(w)')} AS predicted_a, {R('sum(w * {q}) / sum(w)')} AS predicted_b"
add("double_lift", rate, lambda df: t.double_lift(df, "y", "mu_a", "mu_b", "w", 10), f"WITH s AS ({RATE}), {_bins('mu_a / mu_b', 10, 'B')} SELECT bin, {_DL.format(p='mu_a', q='mu_b')} FROM s JOIN b ON mu_a / mu_b = k GROUP BY bin")
add("double_lift_heavy", lambda s, d: rate(s, d).withColumn("one", F.lit(1.0)), lambda df: t.double_lift(df, "y", "heavy", "one", "w", 10), f"WITH s AS (SELECT *, 1.0::DOUBLE AS one FROM ({RATE})), {_bins('heavy / one', 10, 'B')} SELECT bin, {_DL.format(p='heavy', q='one')} FROM s JOIN b ON heavy / one = k GROUP BY bin")

for _kind, _e in (("deviance", f"sign(y - mu_a) * sqrt(greatest(w * {_unit('poisson', mu='mu_a')}, 0))"), ("pearson", "(y - mu_a) * sqrt(w / mu_a)")):
    add(f"residuals_{_kind}", rate, lambda df, k=_kind: t.residuals(df, "y", "mu_a", "poisson", "w", kind=k).groupBy("flag", "status").agg(F.sum("residual").alias("total"), F.min("residual").alias("low"), F.max("residual").alias("high")),
        f"SELECT flag, status, {R(f'sum({_e})')} AS total, {R(f'min({_e})')} AS low, {R(f'max({_e})')} AS high FROM ({RATE}) GROUP BY ALL")
_RES = f"SELECT sign(y - mu_b) * sqrt(greatest(w * {_unit('poisson', mu='mu_b')}, 0)) AS r FROM ({RATE})"
add("residual_summary", rate, lambda df: t.residual_summary(t.residuals(df, "y", "mu_b", "poisson", "w")),
    f"SELECT count(r) AS n, {R('avg(r)')} AS mean, {R('stddev_pop(r)')} AS std, {R('min(r)')} AS min, " + ", ".join(f"{R(f'quantile_cont(r, {p})')} AS {n}" for n, p in (("q05", 0.05), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q95", 0.95))) + f", {R('max(r)')} AS max FROM ({_RES})")
add("residual_histogram", rate, lambda df: t.residual_histogram(t.residuals(df, "y", "mu_b", "poisson", "w")).select("bin", "n_rows"),
    f"WITH r AS ({_RES}), e AS (SELECT min(r) AS lo, max(r) AS hi FROM r), h AS (SELECT least(39, greatest(0, floor((r - lo) / (hi - lo) * 40)))::INT AS bin, count(*) AS n FROM r, e GROUP BY 1) SELECT i::INT AS bin, coalesce(n, 0)::BIGINT AS n_rows FROM range(40) g(i) LEFT JOIN h ON bin = i")

add("ae_by_numeric", rate, lambda df: t.ae_by_feature(df, "quantity", "y", "mu_a", "w", 10).drop("label"), f"WITH s AS ({RATE}), {_bins('quantity', 10, 'A')} SELECT bin AS position, {_CELL.format(mu='mu_a')} FROM s JOIN b ON quantity = k GROUP BY bin")
add("ae_by_category", rate, lambda df: t.ae_by_feature(df, "flag", "y", "mu_a", "w"), f"WITH s AS ({RATE}), a AS (SELECT flag AS label, (row_number() OVER (ORDER BY flag) - 1)::INT AS position FROM (SELECT DISTINCT flag FROM s)) SELECT position, label, {_CELL.format(mu='mu_a')} FROM s JOIN a ON flag = label GROUP BY ALL")
add("ae_by_two", rate, lambda df: t.ae_by_two(df, "quantity", "flag", "y", "mu_a", "w", 5).drop("label_a"),
    f"WITH s AS ({RATE}), {_bins('quantity', 5, 'A')}, a AS (SELECT flag AS label_b, (row_number() OVER (ORDER BY flag) - 1)::INT AS position_b FROM (SELECT DISTINCT flag FROM s)) SELECT bin AS position_a, position_b, label_b, {_CELL.format(mu='mu_a')}, sum(w) < 0.2 * (SELECT sum(w) FROM s) / (5 * (SELECT count(*) FROM a)) AS thin FROM s JOIN b ON quantity = k JOIN a ON flag = label_b GROUP BY ALL")
add("interaction_strength", rate, lambda df: df.sparkSession.createDataFrame([(t.interaction_strength(t.ae_by_two(df, "discount", "flag", "y", "mu_a", "w", 5)),)], "strength double"))
add("rank_pairs", rate, lambda df: df.sparkSession.createDataFrame(t.rank_pairs({(a, b): t.ae_by_two(df, a, b, "y", "mu_a", "w", 5) for a, b in (("quantity", "flag"), ("discount", "flag"), ("quantity", "status"))}), "a string, b string, strength double"))

_WIN = "{p} = least(mu_a, mu_b, naive)"
_N = "((mu_a = least(mu_a, mu_b, naive))::INT + (mu_b = least(mu_a, mu_b, naive))::INT + (naive = least(mu_a, mu_b, naive))::INT)"
add("tournament", lambda s, d: rate(s, d).withColumn("naive", F.lit(2.0)), lambda df: t.win_sets(df, "y", ["mu_a", "mu_b", "naive"], "w"),
    f"WITH s AS (SELECT *, 2.0::DOUBLE AS naive, sum(w) OVER () AS tw FROM ({RATE})), u AS (" + " UNION ALL ".join(f"SELECT '{p}' AS model, w / {_N} AS v, y, {p} AS p, tw FROM s WHERE {_WIN.format(p=p)}" for p in ("mu_a", "mu_b", "naive"))
    + f") SELECT model, {R('sum(v)')} AS weight, {R('sum(v * p)')} AS predicted, {R('sum(v * y)')} AS actual, {R('sum(v) / max(tw)')} AS share, {R('sum(v * p) - sum(v * y)')} AS profit, {R('sum(v * y) / sum(v * p)')} AS actual_over_expected FROM u GROUP BY model")

add("profile_categorical", lambda s, d: rate(s, d).withColumn("level", F.concat("flag", F.col("quantity").cast("int").cast("string"))), lambda df: t.categorical_profile(df, "level", "y", "w", 20).drop("position"),
    f"WITH s AS (SELECT *, flag || quantity::INT::VARCHAR AS level FROM ({RATE})), l AS (SELECT level, count(*) AS n, sum(w) AS w, sum(w * y) AS wy FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY w DESC, level) AS i, count(*) OVER () AS c FROM l) "
    f"SELECT CASE WHEN i > 20 THEN '(other: ' || (c - 20)::VARCHAR || ' levels)' ELSE level END AS level, sum(n)::BIGINT AS n_rows, {R('sum(w)')} AS weight, {R('sum(wy) / sum(w)')} AS actual FROM r GROUP BY 1")  # fmt: skip
_EDGES = f"WITH s AS ({RATE}), g AS (SELECT quantity AS k, sum(w) AS w FROM s GROUP BY 1), c AS (SELECT k, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS share FROM g), e AS (SELECT min(quantity) AS lo, (SELECT min(k) FROM c WHERE share >= 0.9) AS top FROM s), "
_H = "h AS (SELECT CASE WHEN quantity >= top THEN {last} ELSE floor((quantity - lo) / (top - lo) * {last})::INT END AS bin, * FROM s, e) "
add("histogram", rate, lambda df: t.histogram(df, "quantity", "w", 12, 0.9).select("bin", "n_rows", "weight"), _EDGES + _H.format(last=12) + f"SELECT i::INT AS bin, count(bin) AS n_rows, {R('coalesce(sum(w), 0)')} AS weight FROM range(13) r(i) LEFT JOIN h ON bin = i GROUP BY i")
add("profile_numeric", rate, lambda df: t.numeric_profile(df, "quantity", "y", "w", 12, 0.9).select("bin", "n_rows", "weight", "actual"), _EDGES + _H.format(last=12) + f"SELECT i::INT AS bin, count(bin) AS n_rows, {R('coalesce(sum(w), 0)')} AS weight, {R('sum(w * y) / sum(w)')} AS actual FROM range(13) r(i) LEFT JOIN h ON bin = i GROUP BY i")
add("summary", rate, lambda df: t.summary(df, "quantity", "w"),
    f"WITH s AS ({RATE}), g AS (SELECT quantity AS k, sum(w) AS w FROM s GROUP BY 1), c AS (SELECT k, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS share FROM g), a AS (SELECT sum(w * quantity) / sum(w) AS m FROM s) SELECT {R('max(m)')} AS mean, min(quantity) AS min, max(quantity) AS max, {R('sum(CASE WHEN quantity = 0 THEN w ELSE 0 END) / sum(w)')} AS zero_share, {R('sqrt(sum(w * (quantity - m) ** 2) / sum(w))')} AS std, "
    + ", ".join(f"(SELECT min(k) FROM c WHERE share >= {p}) AS {n}" for n, p in (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95))) + " FROM s, a")
