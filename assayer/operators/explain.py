"""What a model does with its inputs: partial dependence and permutation importance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.family import Family, column
from assayer.operators.encoders import MAX_LEVELS
from assayer.operators.metrics import Name
from assayer.operators.splits import hash_rank


def is_categorical(df: DataFrame, feature: str) -> bool:
    return dict(df.dtypes)[feature] in ("string", "boolean")


def feature_grid(df: DataFrame, feature: str, points: int = 20) -> list:
    """Levels of a category, at most ``MAX_LEVELS``, or the distinct quantiles of a number."""
    if is_categorical(df, feature):
        levels = [r[0] for r in df.select(feature).distinct().orderBy(feature).limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{feature} has more than {MAX_LEVELS} levels; every row is repeated once a level: give a grid of those that matter")
        return levels
    ps = [i / (points - 1) for i in range(points)]
    return sorted(set(df.agg(F.percentile(column(feature), F.array(*[F.lit(p) for p in ps]))).first()[0]))


def partial_dependence(model, df: DataFrame, feature: str, grid: list | None = None, points: int = 20) -> DataFrame:
    """(value, prediction): the unweighted mean prediction with the feature set to each value.

    Rows are repeated once a grid value, which is a list of known length, within one scan.
    """
    values = feature_grid(df, feature, points) if grid is None else grid
    kind = dict(df.dtypes)[feature]
    spread = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(v) for v in values])))
    if kind in ("string", "boolean"):
        spread = spread.withColumn(feature, F.col(feature).cast(kind))
    return model.predict(spread, out="__p").groupBy(F.col(feature).alias("value")).agg(F.avg("__p").alias("prediction"))


def shuffled(df: DataFrame, feature: str, id_col: str, seed: int) -> DataFrame:
    """``df`` with the feature's values dealt anew: rows ranked by one hash take the value of the rows ranked by another."""
    left = hash_rank(df.drop(feature), id_col, seed)
    right = hash_rank(df.select(F.col(id_col), F.col(feature)), id_col, seed + 1_000_003).select("__rank", feature)
    return left.join(right, "__rank").drop("__rank")


def permutation_importance(model, df: DataFrame, y: Name, family: str | Family, features: list[str], id_col: str, weight: Name | None = None, power: float | None = None, seed: int = 0) -> DataFrame:
    """(feature, importance): the rise of the deviance after one shuffle of the feature."""
    f, a, w = Family.of(family, power), column(y), column(weight)
    score = lambda d: d.agg(F.sum(w * f.unit_deviance(a, F.col("__p"))) / F.sum(w)).first()[0]
    base = score(model.predict(df, out="__p"))
    rows = [(name, float(score(model.predict(shuffled(df, name, id_col, seed + i), out="__p")) - base)) for i, name in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def coefficients(model) -> dict[str, float] | None:
    """Name to value, if the model has coefficients."""
    return getattr(model, "coef", None)


def attributions(model, df: DataFrame, id_col: str, top: int = 10, seed: int = 0) -> DataFrame:
    """The rows with the highest, the lowest and a few hashed predictions, with the model's contributions by term."""
    p = model.predict(model.contributions(df), out="prediction")
    keep = [id_col, "prediction", *[c for c in p.columns if c.startswith("contribution_")]]
    p = p.select(*keep)
    mark = lambda d, kind: d.limit(top).withColumn("kind", F.lit(kind))
    return mark(p.orderBy(F.col("prediction").desc(), id_col), "highest").unionByName(mark(p.orderBy("prediction", id_col), "lowest")).unionByName(mark(p.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))), "sample"))
