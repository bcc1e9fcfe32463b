"""Tables of a prediction: calibration, lift, residuals, actual over expected, profiles, tournaments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.family import ARRAYS, Family, column
from assayer.functions.validate import Rule, check, finite, inputs
from assayer.operators import ordered
from assayer.operators.metrics import Name, ratio, weighted_quantiles

NAN = float("nan")
#: Most levels of a feature on the axis of a table; more are refused, as an axis is listed whole.
MAX_LEVELS = 10_000


def _cell(w: Column, y: Column, mu: Column) -> list[Column]:
    sw = F.sum(w)
    return [F.count(F.lit(1)).alias("n_rows"), sw.alias("weight"), ratio(F.sum(w * mu), sw).alias("predicted"), ratio(F.sum(w * y), sw).alias("actual"), ratio(F.sum(w * y), F.sum(w * mu)).alias("actual_over_expected")]


def bin_index(df: DataFrame, key: Name, weight: Name | None = None, bins: int = 10) -> DataFrame:
    """``df`` with its equal-weight bin by ``key``."""
    k, w = column(key), column(weight)
    return ordered.with_bin(df, k, ordered.equal_weight_bins(df, k, w, bins))


def binned_table(df: DataFrame, key: Name, y: Name, mu: Name, weight: Name | None = None, bins: int = 10, check_inputs: bool = True) -> DataFrame:
    """Equal-weight bins of any column with rows, weight, mean prediction, mean actual and their ratio."""
    a, b, w = column(y), column(mu), column(weight)
    if check_inputs:
        check(df, inputs(a, b, w, positive_weight=True) + finite(column(key), "the key"), w)
    return bin_index(df, key, weight, bins).groupBy("bin").agg(*_cell(w, a, b))


def calibration_table(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, bins: int = 10, check_inputs: bool = True) -> DataFrame:
    return binned_table(df, mu, y, mu, weight, bins, check_inputs)


def lift(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, bins: int = 10, check_inputs: bool = True) -> DataFrame:
    """The calibration table with the share of actuals over the mean in each bin."""
    t = calibration_table(df, y, mu, weight, bins, check_inputs)
    whole = Window.partitionBy(F.lit(0))
    mean = F.sum(F.col("weight") * F.col("actual")).over(whole) / F.sum("weight").over(whole)
    return t.withColumn("lift", ratio(F.col("actual"), mean))


def double_lift(df: DataFrame, y: Name, a: Name, b: Name, weight: Name | None = None, bins: int = 10, check_inputs: bool = True) -> DataFrame:
    """Bins of the ratio of two predictions: where they disagree, which is closer to the actual."""
    t, p, q, w = column(y), column(a), column(b), column(weight)
    if check_inputs:
        rules = inputs(t, p, w, positive_weight=True) + finite(q, "the second prediction")
        check(df, [*rules, Rule(q <= 0, "the second prediction is 0 or below, and the ratio divides by it", "use predictions above 0")], w)
    key = p / q
    binned = ordered.with_bin(df, key, ordered.stepped_bins(df, key, w, bins))
    mean = lambda c: ratio(F.sum(w * c), F.sum(w))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(w).alias("weight"), mean(key).alias("ratio"), mean(t).alias("actual"), mean(p).alias("predicted_a"), mean(q).alias("predicted_b"))


# ---- residuals


def deviance_residual(y: Column, mu: Column, w: Column, f: Family) -> Column:
    return F.signum(y - mu) * F.sqrt(F.greatest(w * f.unit_deviance(y, mu), F.lit(0.0)))


def pearson_residual(y: Column, mu: Column, w: Column, f: Family) -> Column:
    return (y - mu) * F.sqrt(w / f.variance(mu))


def residuals(df: DataFrame, y: Name, mu: Name, family: str | Family, weight: Name | None = None, power: float | None = None, kind: str = "deviance", check_inputs: bool = True) -> DataFrame:
    """``df`` with a residual column."""
    f, a, b, w = Family.of(family, power), column(y), column(mu), column(weight)
    if check_inputs:
        check(df, inputs(a, b, w, f), w)
    made = {"deviance": deviance_residual, "pearson": pearson_residual}
    if kind not in made:
        raise ValueError(f"residual kind {kind!r} is unknown; use deviance or pearson")
    return df.withColumn("residual", made[kind](a, b, w, f))


def residual_summary(df: DataFrame, residual: Name = "residual") -> DataFrame:
    """Unweighted mean, population deviation and quantiles by linear interpolation."""
    r, ps = column(residual), [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    q = F.percentile(r, F.array(*[F.lit(p) for p in ps]))
    names = ["min", "q05", "q25", "median", "q75", "q95", "max"]
    got = df.agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), q.alias("__q"))
    return got.select("n", "mean", "std", *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def _counted(df: DataFrame, v: Column, w: Column, marks: Sequence[float], more: Sequence[Column] = ()) -> DataFrame:
    """Rows and weight between even edges, empty bins included; the last bin is closed."""
    at = ordered.place(v, list(marks[1:-1]), inclusive=True)
    got = df.withColumn("bin", at).groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(w).alias("weight"), *more)
    grid = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(marks[:-1], marks[1:], strict=True))], "bin int, low double, high double")
    return grid.join(got, "bin", "left").na.fill(0, ["n_rows"]).na.fill(0.0, ["weight"])


def residual_histogram(df: DataFrame, residual: Name = "residual", bins: int = 40) -> DataFrame:
    r = column(residual)
    lo, hi = df.agg(F.min(r), F.max(r)).first()
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    return _counted(df, r, F.lit(1.0), np.linspace(lo, hi, bins + 1).tolist()).select("bin", "low", "high", "n_rows")


def residual_sample(df: DataFrame, id_col: str, rows: int = 5000, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of seed and id."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), id_col).limit(rows)


# ---- actual over expected


def feature_axis(df: DataFrame, feature: str, weight: Name | None, bins: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the position of the feature on its axis, and the axis (position, label).

    A numeric feature has equal-weight bins labelled by their smallest values, any other its levels in order.
    """
    numeric = dict(df.dtypes)[feature] not in ("string",)
    spark = df.sparkSession
    if not numeric:
        rows = [r[0] for r in df.select(feature).distinct().orderBy(feature).limit(MAX_LEVELS + 1).collect()]
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"{feature} has more than {MAX_LEVELS} levels; pool the rare ones, or use the categorical profile, which does")
        axis = spark.createDataFrame(list(enumerate(rows)), f"{name} int, label string")
        return df.join(F.broadcast(axis.withColumnRenamed("label", "__level")), F.col(feature).eqNullSafe(F.col("__level"))).drop("__level"), axis
    binned = bin_index(df, feature, weight, bins).withColumnRenamed("bin", name)
    ends = binned.groupBy(name).agg(F.min(column(feature)).alias("lo"), F.max(column(feature)).alias("hi")).orderBy(name).collect()
    text = [f"[{r['lo']:.4g}, {ends[i + 1]['lo']:.4g})" if i + 1 < len(ends) else f"[{r['lo']:.4g}, {r['hi']:.4g}]" for i, r in enumerate(ends)]
    return binned, spark.createDataFrame(list(enumerate(text)), f"{name} int, label string")


def ae_by_feature(df: DataFrame, feature: str, y: Name, mu: Name, weight: Name | None = None, bins: int = 10, check_inputs: bool = True) -> DataFrame:
    """Actual over expected along one feature: position, label, rows, weight, means, ratio."""
    a, b, w = column(y), column(mu), column(weight)
    if check_inputs:
        check(df, [*inputs(a, b, w, positive_weight=True), Rule(F.col(feature).isNull(), f"{feature} is missing", "fill or drop those rows")], w)
    placed, axis = feature_axis(df, feature, weight, bins, "position")
    return axis.join(placed.groupBy("position").agg(*_cell(w, a, b)), "position")


def grid_table(df: DataFrame, first: str, n_first: int, second: str, n_second: int, y: Name, mu: Name, weight: Name | None = None) -> DataFrame:
    """All cells of two index columns, empty ones with NaN means."""
    a, b, w = column(y), column(mu), column(weight)
    got = df.groupBy(first, second).agg(*_cell(w, a, b))
    spark = df.sparkSession
    cells = spark.range(n_first * n_second).select((F.col("id") / n_second).cast("int").alias(first), (F.col("id") % n_second).cast("int").alias(second))
    return cells.join(F.broadcast(got), [first, second], "left").na.fill(0, ["n_rows"]).na.fill(0.0, ["weight"]).na.fill(NAN, ["predicted", "actual", "actual_over_expected"])


def ae_by_two(df: DataFrame, a: str, b: str, y: Name, mu: Name, weight: Name | None = None, bins: int = 10, floor: float = 0.2, check_inputs: bool = True) -> DataFrame:
    """Actual over expected on the grid of two features; ``thin`` marks cells below the weight floor."""
    t, m, w = column(y), column(mu), column(weight)
    if check_inputs:
        missing = [Rule(F.col(f).isNull(), f"{f} is missing", "fill or drop those rows") for f in (a, b)]
        check(df, inputs(t, m, w, positive_weight=True) + missing, w)
    one, axis_a = feature_axis(df, a, weight, bins, "position_a")
    two, axis_b = feature_axis(one, b, weight, bins, "position_b")
    na, nb = axis_a.count(), axis_b.count()
    grid = grid_table(two, "position_a", na, "position_b", nb, y, mu, weight)
    whole = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    grid = grid.withColumn("thin", F.col("weight") < floor * whole / (na * nb))
    return grid.join(F.broadcast(axis_a.withColumnRenamed("label", "label_a")), "position_a").join(F.broadcast(axis_b.withColumnRenamed("label", "label_b")), "position_b")


def margin_fit(expected: np.ndarray, rows: np.ndarray, cols: np.ndarray, close: float = 1e-11, most: int = 500) -> np.ndarray:
    """``expected`` times a factor for each row and one for each column, so that its margins are ``rows`` and ``cols``.

    The factors are fitted in turn until the margin fitted before still holds.
    """
    inverse = lambda want, now: np.where(now > 0, want / np.where(now > 0, now, 1), 0.0)
    right = np.ones(expected.shape[1])
    for _ in range(most):
        left = inverse(rows, expected @ right)
        right = inverse(cols, left @ expected)
        if np.abs(left * (expected @ right) - rows).sum() <= close * rows.sum():
            break
    return left[:, None] * expected * right[None, :]


def interaction_strength(grid: DataFrame) -> float:
    """What two features add together: Poisson deviance per weight of the cells' actuals around the best correction
    of the expected by a factor for each level of either. The grid has at most bins x bins cells and comes to the driver.
    """
    cells = grid.select("position_a", "position_b", "weight", F.nanvl(F.col("weight") * F.col("actual"), F.lit(0.0)).alias("a"), F.nanvl(F.col("weight") * F.col("predicted"), F.lit(0.0)).alias("e")).toPandas()
    if not cells["weight"].sum() > 0:
        raise ValueError("the grid has no weight; an interaction needs rows with weight in its cells")
    wide = lambda c: cells.pivot(index="position_a", columns="position_b", values=c).fillna(0.0).to_numpy()
    w, actual = wide("weight"), wide("a")
    fitted = margin_fit(wide("e"), actual.sum(1), actual.sum(0))
    on = (w > 0) & (fitted > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = Family.of("poisson").unit_deviance(actual[on] / w[on], fitted[on] / w[on], ARRAYS)
    return float(max((w[on] * unit).sum(), 0.0) / w.sum())


def rank_pairs(grids: dict[tuple[str, str], DataFrame]) -> list[tuple[str, str, float]]:
    """Pairs of features by the strength of their interaction, strongest first."""
    found = [(a, b, interaction_strength(g)) for (a, b), g in grids.items()]
    return sorted(found, key=lambda x: -x[2])


# ---- tournament


def win_sets(df: DataFrame, y: Name, predictions: Sequence[Name], weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """Per model the rows where its prediction is lowest: weight, predicted and actual sums, share, profit, actual over expected.

    Exact ties share a row evenly.
    """
    t, w, ps = column(y), column(weight), [column(p) for p in predictions]
    if check_inputs:
        rules = inputs(t, None, w)
        for p in ps:
            rules += finite(p, "a prediction")
        check(df, rules, w)
    if len(ps) < 2:
        raise ValueError(f"a tournament needs at least 2 predictions, not {len(ps)}")
    low = F.least(*ps)
    hits = [(p == low).cast("double") for p in ps]
    tied = sum(hits[1:], hits[0])
    sums = [F.struct(F.lit(n if isinstance(n, str) else f"model{i}").alias("model"), F.sum(w * h / tied).alias("weight"), F.sum(w * h / tied * p).alias("predicted"), F.sum(w * h / tied * t).alias("actual")) for i, (n, p, h) in enumerate(zip(predictions, ps, hits, strict=True))]
    one = df.agg(F.array(*sums).alias("m"), F.sum(w).alias("total"))
    rows = one.select("total", F.explode("m").alias("m")).select("m.*", "total")
    return rows.select("model", "weight", "predicted", "actual", (F.col("weight") / F.col("total")).alias("share"), (F.col("predicted") - F.col("actual")).alias("profit"), ratio(F.col("actual"), F.col("predicted")).alias("actual_over_expected"))


# ---- data profile


def _edges(df: DataFrame, v: Column, w: Column, bins: int, tail: float) -> list[float]:
    """``bins`` even bins from the smallest value to a high quantile, and one more for the tail."""
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    top = weighted_quantiles(df, v, [tail], w, False).first()["value"]
    if not lo < top < hi:
        return (np.linspace(lo - 0.5, hi + 0.5, bins + 1) if lo == hi else np.linspace(lo, hi, bins + 1)).tolist()
    return [*np.linspace(lo, top, bins + 1).tolist(), hi]


def histogram(df: DataFrame, value: Name, weight: Name | None = None, bins: int = 40, tail: float = 0.99, check_inputs: bool = True) -> DataFrame:
    v, w = column(value), column(weight)
    if check_inputs:
        check(df, finite(v, "the value") + finite(w, "the weight"), w)
    return _counted(df, v, w, _edges(df, v, w, bins, tail))


def summary(df: DataFrame, value: Name, weight: Name | None = None) -> DataFrame:
    """Weighted mean, deviation, quantiles, range and share of zeros."""
    v, w = column(value), column(weight)
    mean = F.greatest(F.min(v), F.least(F.max(v), F.sum(w * v) / F.sum(w)))
    first = df.agg(mean.alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(w * (v == 0).cast("double")) / F.sum(w)).alias("zero_share"))
    m = first.first()["mean"]
    spread = df.agg(F.sqrt(F.sum(w * (v - m) * (v - m)) / F.sum(w)).alias("std"))
    ps = [0.05, 0.25, 0.5, 0.75, 0.95]
    q = weighted_quantiles(df, v, ps, w, False).groupBy().pivot("p", ps).agg(F.first("value"))
    q = q.toDF("q05", "q25", "q50", "q75", "q95")
    return first.join(F.broadcast(spread)).join(F.broadcast(q))


def numeric_profile(df: DataFrame, value: Name, y: Name, weight: Name | None = None, bins: int = 20, tail: float = 0.99) -> DataFrame:
    """The histogram of a feature with the weighted mean of y in each bin."""
    v, w, a = column(value), column(weight), column(y)
    check(df, finite(v, "the value") + inputs(a, None, w), w)
    t = _counted(df, v, w, _edges(df, v, w, bins, tail), [ratio(F.sum(w * a), F.sum(w)).alias("actual")])
    return t.na.fill(NAN, ["actual"])


def categorical_profile(df: DataFrame, value: str, y: Name, weight: Name | None = None, max_levels: int = 30) -> DataFrame:
    """The heaviest levels with weight and mean of y, and the rest pooled in one row.

    The limit is on the rows shown; every row of the table counts in one of them.
    """
    w, a = column(weight), column(y)
    levels = df.groupBy(F.col(value).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * a).alias("wy"))
    n = levels.count()
    shown = levels.orderBy(F.col("w").desc(), "level").limit(max_levels)
    rank = F.row_number().over(Window.orderBy(F.col("w").desc(), "level"))  # at most max_levels rows
    top = shown.select(rank.alias("position"), "level", F.col("n").alias("n_rows"), F.col("w").alias("weight"), ratio(F.col("wy"), F.col("w")).alias("actual"))
    if n <= max_levels:
        return top
    rest = levels.join(F.broadcast(shown.select(F.col("level").alias("l"))), F.col("level").eqNullSafe(F.col("l")), "left_anti")
    return top.unionByName(rest.agg(F.lit(max_levels + 1).alias("position"), F.lit(f"(other: {n - max_levels} levels)").alias("level"), F.sum("n").alias("n_rows"), F.sum("w").alias("weight"), ratio(F.sum("wy"), F.sum("w")).alias("actual")))
