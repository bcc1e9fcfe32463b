"""Named bench recipes over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import encoders as enc
from assayer.operators.glm import GLM
from assayer.operators.mllib import MLlibGLM
from assayer.operators.splits import kfold, stratified
from assayer.operators.trees import BoostedTrees
from assayer.plans import bench
from assayer.plans.scored import table


@dataclass(frozen=True)
class Recipe:
    about: str
    load: Callable[[SparkSession, str], DataFrame]
    task: bench.Task
    models: dict[str, Callable[[], bench.Model]]
    fold: Callable[[DataFrame], DataFrame] | None = None
    time: str | None = None
    features: tuple[str, ...] = ()
    ladder: tuple[str, ...] = ()


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return o.join(n, "o_orderkey").select(F.col("o_orderkey").alias("id"), "lines", (F.col("quantity") / 50.0).alias("exposure"), "discount", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "O").cast("double").alias("is_open"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("value").alias("y"), F.col("event_type").alias("kind"), F.hour("ts").cast("double").alias("hour"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of the lines of an order and flag, weighted by their number."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("price"), F.count(F.lit(1)).cast("double").alias("lines"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return lines.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_returnflag").alias("id"), F.col("l_returnflag").alias("flag"), "price", "lines", "quantity", "discount")


def _rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line is among the few of a small quantity at the highest discount: a rare binary target."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rare = (F.col("l_discount") >= 0.1) & (F.col("l_quantity") <= 10)
    return l.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"), rare.cast("double").alias("y"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by hour and type."""
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return e.select(F.concat_ws("-", F.unix_timestamp("at").cast("string"), "kind").alias("id"), F.unix_timestamp("at").cast("double").alias("t"), "y", "kind", F.hour("at").cast("double").alias("hour"), F.date_format("at", "E").alias("day"))


def _shallow(family: str, features: list[str], categorical: list[str], depth: int = 2, rate: float = 0.1) -> BoostedTrees:
    return BoostedTrees(family, features, categorical, n_trees=40, max_depth=depth, max_leaves=2**depth, learning_rate=rate, early_stopping=10)


_RATE_FOLD = lambda df: stratified(df, "id", "status", 3)
RECIPES: dict[str, Recipe] = {
    "order_rate": Recipe("lines per order as a rate of the quantity, stratified folds", _orders, bench.Task("lines", "poisson", exposure="exposure"), {
        "factors": lambda: GLM("poisson", {"priority": "onehot"}), "splines": lambda: GLM("poisson", {"priority": "onehot", "discount": "spline"}), "smooth": lambda: GLM("poisson", {"discount": "smooth"}), "mllib": lambda: MLlibGLM("poisson", {"priority": "onehot"})},
        fold=lambda df: stratified(df, "id", "status", 3), features=("priority", "discount")),
    "order_price": Recipe("price of an order, gamma", _orders, bench.Task("price", "gamma"), {"factors": lambda: GLM("gamma", {"priority": "onehot", "status": "onehot"}), "piecewise": lambda: GLM("gamma", {"exposure": enc.piecewise_linear("exposure", 5, "increasing")})}, fold=lambda df: kfold(df, "id", 3), features=("priority", "exposure")),
    "order_open": Recipe("whether an order is open, binary", _orders, bench.Task("is_open", "binomial"), {"logistic": lambda: GLM("binomial", {"priority": "onehot", "exposure": "standardize"}), "lasso": lambda: GLM("binomial", {"priority": "onehot", "exposure": "standardize"}, alpha=0.001, l1_ratio=1.0)}, fold=lambda df: stratified(df, "id", "status", 3), features=("priority",)),
    "event_value": Recipe("value of an event, folds in time", _events, bench.Task("y", "gamma"), {"factors": lambda: GLM("gamma", {"kind": "onehot"}), "hours": lambda: GLM("gamma", {"kind": "onehot", "hour": "spline"})}, time="t", features=("kind", "hour")),
    "order_challengers": Recipe("the same rate: a linear model, what each step of freedom adds, and boosted trees", _orders, bench.Task("lines", "poisson", exposure="exposure"), {
        "full": lambda: GLM("poisson", {"priority": "onehot", "status": "onehot", "discount": "standardize"}),
        "splines": lambda: GLM("poisson", {"priority": "onehot", "status": "onehot", "discount": "spline"}),
        "piecewise": lambda: GLM("poisson", {"priority": "onehot", "status": "onehot", "discount": "piecewise"}),
        "smooth": lambda: GLM("poisson", {"priority": "onehot", "status": "onehot", "discount": "smooth"}),
        "interaction": lambda: GLM("poisson", {"priority": "onehot", "status": "onehot", "discount": "spline", "discount*status": enc.Interaction("discount", "status", factor=True)}),
        "stumps": lambda: _shallow("poisson", ["discount"], ["priority", "status"], 1), "pairs": lambda: _shallow("poisson", ["discount"], ["priority", "status"], 2),
        "trees": lambda: _shallow("poisson", ["discount"], ["priority", "status"], 5, 0.05)},
        fold=_RATE_FOLD, features=("priority", "status", "discount"), ladder=("full", "splines", "interaction", "stumps", "pairs", "trees")),
    "order_vs_mllib": Recipe("one design fitted by two libraries", _orders, bench.Task("lines", "poisson", exposure="exposure"), {
        "own": lambda: GLM("poisson", {"priority": "onehot", "status": "onehot"}), "mllib": lambda: MLlibGLM("poisson", {"priority": "onehot", "status": "onehot"})},
        fold=_RATE_FOLD, features=("priority",)),
    "order_selection": Recipe("binary, with penalties chosen by cross validation", _orders, bench.Task("is_open", "binomial"), {
        "logistic": lambda: GLM("binomial", {"priority": "onehot", "exposure": "standardize", "discount": "standardize"}), "splines": lambda: GLM("binomial", {"priority": "onehot", "exposure": "spline", "discount": "standardize"}),
        "lasso": lambda: GLM("binomial", {"priority": "onehot", "exposure": "standardize", "discount": "standardize"}, alpha="cv", l1_ratio=1.0, alpha_rule="min", n_alphas=20, cv=3),
        "group_lasso": lambda: GLM("binomial", {"priority": "onehot", "exposure": "spline", "discount": "standardize"}, alpha="cv", l1_ratio=1.0, group_lasso=True, n_alphas=20, cv=3)},
        fold=_RATE_FOLD, features=("priority", "exposure", "discount")),
    "item_severity": Recipe("mean price of lines, gamma, weighted by their number", _items, bench.Task("price", "gamma", weight="lines"), {
        "factors": lambda: GLM("gamma", {"flag": "onehot", "quantity": "standardize"}), "splines": lambda: GLM("gamma", {"flag": "onehot", "quantity": "spline"}),
        "stumps": lambda: _shallow("gamma", ["quantity", "discount"], ["flag"], 1), "trees": lambda: _shallow("gamma", ["quantity", "discount"], ["flag"], 4)},
        fold=lambda df: kfold(df, "id", 3), features=("flag", "quantity"), ladder=("factors", "splines", "stumps", "trees")),
    "line_rare": Recipe("a rare binary target", _rare, bench.Task("y", "binomial", threshold=0.05), {"logistic": lambda: GLM("binomial", {"price": "standardize", "tax": "standardize", "flag": "onehot"}), "trees": lambda: _shallow("binomial", ["price", "tax"], ["flag"], 3)}, fold=lambda df: stratified(df, "id", "y", 3), features=("price",)),
    "event_counts": Recipe("events by hour, folds in time", _hourly, bench.Task("y", "poisson"), {
        "factors": lambda: GLM("poisson", {"kind": "onehot", "hour": "standardize", "day": enc.OneHot("day", unknown="zero")}),
        "interaction": lambda: GLM("poisson", {"kind": "onehot", "hour": "spline", "hour*kind": enc.Interaction("hour", "kind", factor=True)}), "trees": lambda: _shallow("poisson", ["hour"], ["kind", "day"], 3)},
        time="t", features=("kind", "hour"), ladder=("factors", "interaction", "trees")),
}


def run_named(name: str, spark: SparkSession, sf_dir: str, progress: Callable[[str], None] | None = None, features: tuple[str, ...] | None = None, report: bool = True) -> bench.Result:
    if name not in RECIPES:
        raise ValueError(f"recipe {name!r} is unknown; use one of {', '.join(RECIPES)}")
    r = RECIPES[name]
    df = r.load(spark, sf_dir)
    df = (r.fold(df) if r.fold else df).persist()
    try:
        return bench.run(df, r.task, r.models, fold="fold" if r.fold else None, time_col=r.time, folds=3, id_col="id", features=r.features if features is None else features, progress=progress, ladder=r.ladder, dataset=f"{r.load.__name__.strip('_')} of {sf_dir}", report=report)
    finally:
        df.unpersist()
