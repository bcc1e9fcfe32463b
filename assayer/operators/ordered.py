"""Tie groups, running sums and equal-weight bins.

Rows with exactly equal keys form one group before anything walks in key order. Running
sums are two-level: groups fall into ranges of the key, a window runs within each range,
and the sums of the ranges before it are added from a table of as many rows as there are
ranges. So no task ever sorts all groups, however many distinct keys there are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def tie_groups(df: DataFrame, key: Column, sums: Mapping[str, Column]) -> DataFrame:
    """(key, n, sums...), one row per distinct key; -0.0 and 0.0 are one key."""
    return df.groupBy(key.cast("double").alias("key")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def ranges(df: DataFrame, key: Column, parts: int = RANGES) -> list[float]:
    """Bounds that cut the keys into ranges of about equal numbers of rows; they shape tasks, not results."""
    if parts <= 1:
        return []
    found = df.select(key.cast("double").alias("key")).approxQuantile("key", [i / parts for i in range(1, parts)], 0.5 / parts)
    return sorted(set(found))


def place(v: Column, bounds: list[float], inclusive: bool = False) -> Column:
    """How many sorted bounds lie below v, or at or below it: a binary search as nested choices."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        mark = F.lit(float(bounds[mid]))
        return F.when(v >= mark if inclusive else v > mark, among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, len(bounds))


def running(groups: DataFrame, names: list[str], bounds: list[float], descending: bool = False) -> DataFrame:
    """Adds cum_<name>, the inclusive running sum in key order."""
    g = groups.withColumn("__range", place(F.col("key"), bounds))
    order = F.col("key").desc() if descending else F.col("key").asc()
    side = F.col("__range").desc() if descending else F.col("__range").asc()
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(side).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = g.groupBy("__range").agg(*[F.sum(n).alias(f"__t_{n}") for n in names])
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names])
    out = g.join(F.broadcast(offsets), "__range")
    return out.select(*groups.columns, "__range", *[(F.sum(n).over(within) + F.col(f"__o_{n}")).alias(f"cum_{n}") for n in names])


def running_min(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds least_<name>, the inclusive running minimum by ``order``, over the ranges that :func:`running` left."""
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lows = df.groupBy("__range").agg(F.min(name).alias("__l"))
    lows = lows.select("__range", F.min("__l").over(before).alias("__b"))
    return df.join(F.broadcast(lows), "__range").withColumn(f"least_{name}", F.least(F.min(name).over(within), F.col("__b"))).drop("__b")


def edges(total: float, bins: int) -> list[float]:
    """Inner edges of bins of equal weight, by repeated addition."""
    width, out, at = total / bins, [], 0.0
    for _ in range(bins - 1):
        at += width
        out.append(at)
    return out


def walk(df: DataFrame, key: Column, sums: Mapping[str, Column], descending: bool = False, bounds: list[float] | None = None) -> DataFrame:
    """Tie groups of ``key`` with n, sums, cum_n and cum_<sum>."""
    bounds = ranges(df, key) if bounds is None else bounds
    return running(tie_groups(df, key, sums), ["n", *sums], bounds, descending)


def _cells(df: DataFrame, key: Column, w: Column, bins: int, bounds: list[float] | None) -> DataFrame:
    if bins < 1:
        raise ValueError(f"there must be at least 1 bin, not {bins}")
    total = df.agg(F.sum(w)).first()[0] or 0.0
    g = walk(df, key, {"w": w}, bounds=bounds)
    mid = F.col("cum_w") - F.col("w") / 2
    marks = edges(float(total), bins)
    return g.withColumn("mid", mid).withColumn("cell", place(F.col("mid"), marks, inclusive=True)).drop("mid")


def equal_weight_bins(df: DataFrame, key: Column, w: Column, bins: int, bounds: list[float] | None = None) -> DataFrame:
    """(key, bin): a group goes to the bin that holds the midpoint of its weight; bins are numbered without gaps."""
    g = _cells(df, key, w, bins, bounds)
    dense = g.select("cell").distinct().select("cell", F.least(F.row_number().over(Window.orderBy("cell")) - 1, F.lit(bins - 1)).alias("bin"))
    return g.join(F.broadcast(dense), "cell").select("key", "bin")


def stepped_bins(df: DataFrame, key: Column, w: Column, bins: int, bounds: list[float] | None = None) -> DataFrame:
    """(key, bin): each group advances at most one bin beyond the one before and never past its cell."""
    g = _numbered(_cells(df, key, w, bins, bounds))
    g = g.withColumn("slack", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("cell") - F.col("k")))
    g = running_min(g, "slack", "k")
    return g.select("key", F.least(F.col("k") + F.col("least_slack"), F.lit(bins - 1)).cast("int").alias("bin"))


def _numbered(g: DataFrame) -> DataFrame:
    """Adds k, the number of groups before this one."""
    counts = g.groupBy("__range").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    within = Window.partitionBy("__range").orderBy("key")
    return g.join(F.broadcast(offsets), "__range").withColumn("k", F.row_number().over(within) - 1 + F.col("__o")).drop("__o")


def with_bin(df: DataFrame, key: Column, bins: DataFrame) -> DataFrame:
    """Rows with the bin of their key.

    The bins of a range of keys are intervals, so the table of bins reduces to the largest
    key of each bin and the lookup is a comparison with as many bounds as there are bins.
    """
    tops = [r["top"] for r in bins.groupBy("bin").agg(F.max("key").alias("top")).orderBy("bin").collect()]
    return df.withColumn("bin", place(key.cast("double"), tops[:-1]))
