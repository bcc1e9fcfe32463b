"""Weighted scores of a prediction: one-row DataFrames, one aggregate each.

Every function takes a DataFrame and column names (or Columns). ``check`` runs the input
rules first, in one pass; composed plans validate once and pass False.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.family import Family, column
from assayer.functions.validate import Rule, binary, check, finite, inputs
from assayer.operators import ordered

Name = str | Column


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0 or missing."""
    return F.when(b.isNull() | (b == 0), F.lit(float("nan"))).otherwise(a / F.when(b == 0, None).otherwise(b))


def _family(df: DataFrame, y: Name, mu: Name, weight: Name | None, family: str | Family, power: float | None, run: bool) -> tuple[Column, Column, Column, Family]:
    f = Family.of(family, power)
    cols = column(y), column(mu), column(weight)
    if run:
        check(df, inputs(*cols, f), cols[2])
    return *cols, f


def deviance(df: DataFrame, y: Name, mu: Name, family: str | Family, weight: Name | None = None, power: float | None = None, check_inputs: bool = True) -> DataFrame:
    """Weighted mean unit deviance."""
    a, b, w, f = _family(df, y, mu, weight, family, power, check_inputs)
    return df.agg((F.sum(w * f.unit_deviance(a, b)) / F.sum(w)).alias("deviance"))


def deviance_per_row(df: DataFrame, y: Name, mu: Name, family: str | Family, weight: Name | None = None, power: float | None = None, check_inputs: bool = True) -> DataFrame:
    """Weighted deviance over the number of rows."""
    a, b, w, f = _family(df, y, mu, weight, family, power, check_inputs)
    return df.agg((F.sum(w * f.unit_deviance(a, b)) / F.count(F.lit(1))).alias("deviance_per_row"))


def gaussian_deviance(df: DataFrame, y: Name, mu: Name, weight: Name | None = None) -> DataFrame:
    return deviance(df, y, mu, "gaussian", weight)


def poisson_deviance(df: DataFrame, y: Name, mu: Name, weight: Name | None = None) -> DataFrame:
    return deviance(df, y, mu, "poisson", weight)


def gamma_deviance(df: DataFrame, y: Name, mu: Name, weight: Name | None = None) -> DataFrame:
    return deviance(df, y, mu, "gamma", weight)


def tweedie_deviance(df: DataFrame, y: Name, mu: Name, power: float, weight: Name | None = None) -> DataFrame:
    return deviance(df, y, mu, "tweedie", weight, power)


def binomial_deviance(df: DataFrame, y: Name, mu: Name, weight: Name | None = None) -> DataFrame:
    return deviance(df, y, mu, "binomial", weight)


def naive(df: DataFrame, y: Name, weight: Name | None = None) -> DataFrame:
    """The constant prediction: the weighted mean of y."""
    w = column(weight)
    return df.agg((F.sum(w * column(y)) / F.sum(w)).alias("naive"))


def d2(df: DataFrame, y: Name, mu: Name, family: str | Family, weight: Name | None = None, power: float | None = None, check_inputs: bool = True) -> DataFrame:
    """Share of the constant prediction's deviance that the prediction saves."""
    a, b, w, f = _family(df, y, mu, weight, family, power, check_inputs)
    mean = df.agg((F.sum(w * a) / F.sum(w)).alias("m"), F.min(a).alias("lo"), F.max(a).alias("hi")).first()
    if mean["lo"] == mean["hi"]:
        raise ValueError(f"y is {mean['lo']} in all rows; D2 compares with its mean and needs two values")
    null = f.unit_deviance(a, F.lit(float(mean["m"])))
    return df.agg((1 - F.sum(w * f.unit_deviance(a, b)) / F.sum(w * null)).alias("d2"))


def balance(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """Actual total over predicted total."""
    a, b, w = column(y), column(mu), column(weight)
    if check_inputs:
        check(df, inputs(a, b, w, positive_weight=True), w)
    return df.agg(ratio(F.sum(w * a), F.sum(w * b)).alias("balance"))


def _regression(df: DataFrame, name: str, y: Name, mu: Name, weight: Name | None, run: bool, extra: list[Rule], loss: Column, wrap=lambda c: c) -> DataFrame:
    w = column(weight)
    if run:
        check(df, inputs(column(y), column(mu), w) + extra, w)
    return df.agg(wrap(F.sum(w * loss) / F.sum(w)).alias(name))


def rmse(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    e = column(y) - column(mu)
    return _regression(df, "rmse", y, mu, weight, check_inputs, [], e * e, F.sqrt)


def mae(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    return _regression(df, "mae", y, mu, weight, check_inputs, [], F.abs(column(y) - column(mu)))


def mape(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    a = column(y)
    loss = F.abs(a - column(mu)) / F.abs(F.when(a != 0, a))
    return _regression(df, "mape", y, mu, weight, check_inputs, [Rule(a == 0, "y is 0, where MAPE has no value", "use MAE or sMAPE")], loss)


def smape(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    a, b = column(y), column(mu)
    size = F.abs(a) + F.abs(b)
    return _regression(df, "smape", y, mu, weight, check_inputs, [Rule(size == 0, "y and the prediction are both 0, where sMAPE has no value", "use MAE")], 2 * F.abs(a - b) / F.when(size != 0, size))


def msle(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    a, b = column(y), column(mu)
    e = F.log1p(a) - F.log1p(b)
    return _regression(df, "msle", y, mu, weight, check_inputs, [Rule((a <= -1) | (b <= -1), "y or the prediction is -1 or below, where the log has no value", "use MAE")], e * e)


def r2(df: DataFrame, y: Name, mu: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    a, b, w = column(y), column(mu), column(weight)
    if check_inputs:
        check(df, inputs(a, b, w), w)
    m = df.agg((F.sum(w * a) / F.sum(w)).alias("m"), F.min(a).alias("lo"), F.max(a).alias("hi")).first()
    if m["lo"] == m["hi"]:
        raise ValueError(f"y is {m['lo']} in all rows; R2 compares with its mean and needs two values")
    return df.agg((1 - F.sum(w * (a - b) * (a - b)) / F.sum(w * (a - float(m["m"])) * (a - float(m["m"])))).alias("r2"))


def log_loss(df: DataFrame, y: Name, p: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    d = deviance(df, y, p, "binomial", weight, None, check_inputs)
    return d.select((F.col("deviance") / 2).alias("log_loss"))


def brier(df: DataFrame, y: Name, p: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    return deviance(df, y, p, "gaussian", weight, None, check_inputs).select(F.col("deviance").alias("brier"))


# ---- classification at a threshold


def confusion(df: DataFrame, y: Name, score: Name, threshold: float = 0.5, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """Weighted tp, fp, fn, tn; a score at the threshold is positive."""
    a, s, w = column(y), column(score), column(weight)
    if check_inputs:
        check(df, inputs(a, s, w) + binary(a), w)
    part = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    return df.agg(*[part(c).alias(n) for n, c in (("tp", (s >= threshold) & (a == 1)), ("fp", (s >= threshold) & (a == 0)), ("fn", (s < threshold) & (a == 1)), ("tn", (s < threshold) & (a == 0)))])


def _or_zero(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def from_counts(df: DataFrame) -> DataFrame:
    """Adds accuracy, balanced_accuracy, precision, recall, f1 and mcc to tp, fp, fn, tn; what is undefined is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, special = _or_zero(tp, tp + fn), _or_zero(tn, tn + fp)
    down = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    mcc = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _or_zero(tp * tn - fp * fn, down)))
    return df.withColumns(
        {"accuracy": _or_zero(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + special) / 2, "precision": _or_zero(tp, tp + fp), "recall": recall, "f1": _or_zero(2 * tp, 2 * tp + fp + fn), "mcc": mcc}
    )


def threshold_metrics(df: DataFrame, y: Name, score: Name, threshold: float = 0.5, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    return from_counts(confusion(df, y, score, threshold, weight, check_inputs)).withColumn("threshold", F.lit(float(threshold)))


def threshold_grid(df: DataFrame, y: Name, score: Name, weight: Name | None = None, points: int = 101, check_inputs: bool = True) -> DataFrame:
    """Threshold metrics at ``points`` even thresholds from 0 to 1, with alerts and alerts per true positive.

    One pass: rows fall between thresholds, and sums from above run over that small table.
    """
    a, s, w = column(y), column(score), column(weight)
    if check_inputs:
        check(df, inputs(a, s, w) + binary(a), w)
    marks = [i / (points - 1) for i in range(points)]
    at = ordered.place(s, marks, inclusive=True)
    spark = df.sparkSession
    part = df.select(at.alias("i"), (w * (a == 1).cast("double")).alias("pos"), (w * (a == 0).cast("double")).alias("neg")).groupBy("i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = spark.createDataFrame([(i, m) for i, m in enumerate(marks, 1)], "i int, threshold double").unionByName(spark.createDataFrame([(0, None)], "i int, threshold double"))
    dense = grid.join(part, "i", "left").na.fill(0.0, ["pos", "neg"])
    above = ordered.Window.orderBy(F.col("i").desc()).rowsBetween(ordered.Window.unboundedPreceding, 0)  # at most points + 1 rows
    everything = ordered.Window.partitionBy(F.lit(0))
    counts = dense.select("threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(everything).alias("p"), F.sum("neg").over(everything).alias("q"))
    counts = counts.select("threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn")).filter("threshold is not null")
    alerts = F.col("tp") + F.col("fp")
    return from_counts(counts).withColumns({"alerts": alerts, "alerts_per_tp": F.when(F.col("tp") > 0, alerts / F.when(F.col("tp") > 0, F.col("tp")))})


# ---- ranking


def _ranked(df: DataFrame, y: Name, score: Name, weight: Name | None, run: bool, descending: bool) -> DataFrame:
    """Tie groups with pos, neg and their running sums and totals."""
    a, s, w = column(y), column(score), column(weight)
    if run:
        check(df, inputs(a, s, w) + binary(a), w, both_classes=a)
    g = ordered.walk(df, s, {"pos": w * a, "neg": w * (1 - a)}, descending)
    totals = df.agg(F.sum(w * a).alias("all_pos"), F.sum(w * (1 - a)).alias("all_neg"))
    return g.join(F.broadcast(totals))


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def roc_auc(df: DataFrame, y: Name, score: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """Area under the ROC curve, ties by trapezoids."""
    g = _ranked(df, y, score, weight, check_inputs, True)
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return g.agg(_clamp(F.sum(area) / F.max("all_pos") / F.max("all_neg"), 0.0, 1.0).alias("roc_auc"))


def average_precision(df: DataFrame, y: Name, score: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """Sum of precision over the steps of recall."""
    g = _ranked(df, y, score, weight, check_inputs, True)
    seen = F.col("cum_pos") + F.col("cum_neg")
    step = F.when(seen > 0, F.col("pos") * F.col("cum_pos") / F.when(seen > 0, seen)).otherwise(0.0)
    return g.agg(_clamp(F.sum(step) / F.max("all_pos"), 0.0, 1.0).alias("average_precision"))


def ks(df: DataFrame, y: Name, score: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """Largest distance between the score distributions of the classes."""
    g = _ranked(df, y, score, weight, check_inputs, False)
    return g.agg(F.max(F.abs(F.col("cum_pos") / F.col("all_pos") - F.col("cum_neg") / F.col("all_neg"))).alias("ks"))


def roc_curve(df: DataFrame, y: Name, score: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) per distinct score, after an origin with threshold infinity."""
    g = _ranked(df, y, score, weight, check_inputs, True)
    points = g.select(_clamp(F.col("cum_neg") / F.col("all_neg"), 0.0, 1.0).alias("fpr"), _clamp(F.col("cum_pos") / F.col("all_pos"), 0.0, 1.0).alias("tpr"), F.col("key").alias("threshold"))
    return df.sparkSession.createDataFrame([(0.0, 0.0, float("inf"))], "fpr double, tpr double, threshold double").unionByName(points)


def pr_curve(df: DataFrame, y: Name, score: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """(recall, precision, threshold) per distinct score, and the share of positives."""
    g = _ranked(df, y, score, weight, check_inputs, True)
    seen = F.col("cum_pos") + F.col("cum_neg")
    return g.select(
        _clamp(F.col("cum_pos") / F.col("all_pos"), 0.0, 1.0).alias("recall"), F.when(seen > 0, F.col("cum_pos") / F.when(seen > 0, seen)).otherwise(0.0).alias("precision"), F.col("key").alias("threshold"),
        (F.col("all_pos") / (F.col("all_pos") + F.col("all_neg"))).alias("positive_rate"),
    )


def _lorenz(df: DataFrame, y: Column, score: Column, w: Column) -> DataFrame:
    """Tie groups in ascending order with x and y shares: x sums weights, y sums y itself."""
    g = ordered.walk(df, score, {"w": w, "y": y})
    return g.join(F.broadcast(df.agg(F.sum(w).alias("all_w"), F.sum(y).alias("all_y"))))


def _check_ranking(df: DataFrame, y: Column, score: Column, w: Column) -> None:
    check(df, [*inputs(y, score, w, positive_weight=True), Rule(y < 0, "y is negative, and a Lorenz curve needs totals", "rank a target of 0 or above")], w)


def gini(df: DataFrame, y: Name, score: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """1 - 2 * area under the Lorenz curve of y by ascending score."""
    a, s, w = column(y), column(score), column(weight)
    if check_inputs:
        _check_ranking(df, a, s, w)
    g = _lorenz(df, a, s, w)
    area = F.col("w") / F.col("all_w") * (2 * F.col("cum_y") - F.col("y")) / F.col("all_y") / 2
    return g.agg(_clamp(1 - 2 * F.sum(area), -1.0, 1.0).alias("gini"))


def normalized_gini(df: DataFrame, y: Name, score: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """Gini over the Gini of the perfect order, that by y / weight."""
    a, w = column(y), column(weight)
    top = gini(df, y, a / w, weight, check_inputs).select(F.col("gini").alias("top"))
    if check_inputs and not (top.first()["top"] or 0) > 0:
        raise ValueError("no order of the rows separates y: the Gini of the perfect order is 0; y needs two values")
    return gini(df, y, score, weight, False).join(F.broadcast(top)).select(ratio(F.col("gini"), F.col("top")).alias("normalized_gini"))


def lorenz_curve(df: DataFrame, y: Name, score: Name, weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """(x, y) per distinct score after the origin, in ascending order of score."""
    a, s, w = column(y), column(score), column(weight)
    if check_inputs:
        _check_ranking(df, a, s, w)
    g = _lorenz(df, a, s, w).select(_clamp(F.col("cum_w") / F.col("all_w"), 0.0, 1.0).alias("x"), _clamp(F.col("cum_y") / F.col("all_y"), 0.0, 1.0).alias("y"))
    return df.sparkSession.createDataFrame([(0.0, 0.0)], "x double, y double").unionByName(g)


def weighted_quantiles(df: DataFrame, value: Name, probs: list[float], weight: Name | None = None, check_inputs: bool = True) -> DataFrame:
    """(p, value): the smallest value whose running share of the weight is at least p."""
    v, w = column(value), column(weight)
    if check_inputs:
        check(df, finite(v, "the value") + finite(w, "the weight"), w)
    g = ordered.walk(df, v, {"w": w}).join(F.broadcast(df.agg(F.sum(w).alias("all_w"))))
    share = F.col("cum_w") / F.col("all_w")
    found = g.agg(*[F.coalesce(F.min(F.when(share >= p, F.col("key"))), F.max("key")).alias(f"q{i}") for i, p in enumerate(probs)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("value")) for i, p in enumerate(probs)])).alias("r")).select("r.*")
