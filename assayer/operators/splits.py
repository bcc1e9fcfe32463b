"""Fold assignment: a fold column on the frame, decided by hashes of ids.

Ranks in hash order are two-level: rows fall into buckets by the first digits of the hash,
a window numbers each bucket, and the counts of the buckets before are added. No window
holds all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import ordered

DIGITS = 3  # 4096 buckets


def hashed(id_col: str, seed: int) -> Column:
    """md5 of 'seed:id' in hexadecimal; the same text in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def _rows(df: DataFrame, id_col: str) -> int:
    """Number of rows; rows without an id are refused, as nothing would fix their fold."""
    n, known = df.agg(F.count(F.lit(1)), F.count(F.col(id_col))).first()
    if known < n:
        raise ValueError(f"{id_col} is missing in {n - known} of {n} rows; fill or drop them")
    return n


def _check_k(k: int, n: int, what: str) -> None:
    if k < 2:
        raise ValueError(f"there must be at least 2 folds, not {k}")
    if n < k:
        raise ValueError(f"{n} {what} do not fill {k} folds; use fewer folds")


def hash_rank(df: DataFrame, id_col: str, seed: int, by: str | None = None) -> DataFrame:
    """Adds __rank, the place from 0 of each row in hash order, within each value of ``by``."""
    keys = [by] if by else []
    d = df.withColumn("__h", hashed(id_col, seed)).withColumn("__b", F.substring("__h", 1, DIGITS))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(*[F.col(k).alias("__k") for k in keys], F.col("__b").alias("__c"), "__from")
    same = F.col("__b") == F.col("__c")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("__k"))
    within = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", id_col)) - 1
    out = d.withColumn("__w", within).join(counts, same).withColumn("__rank", (F.col("__from") + F.col("__w")).cast("long"))
    return out.drop("__h", "__b", "__c", "__k", "__from", "__w")


def _even(rank: Column, n: int, k: int) -> Column:
    """Fold of a rank among n: the first n % k folds have one row more."""
    size, more = divmod(n, k)
    return F.when(rank < more * (size + 1), F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - more * (size + 1)) / max(size, 1))).cast("int")


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with fold: random folds of even size."""
    n = _rows(df, id_col)
    _check_k(k, n, "rows")
    return hash_rank(df, id_col, seed).withColumn("fold", _even(F.col("__rank"), n, k)).drop("__rank")


def stratified(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with fold: every class is dealt round, from a start that its hash gives."""
    _check_k(k, _rows(df, id_col), "rows")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(label).cast("string"), F.lit("null"))).cast("binary")), 1, 6), 16, 10).cast("long")
    return hash_rank(df, id_col, seed, by=label).withColumn("fold", F.pmod(F.col("__rank") + start, F.lit(k)).cast("int")).drop("__rank")


def grouped(df: DataFrame, group: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with fold: all rows of a group share one; rows without a group are one group."""
    names = df.select(F.col(group).alias("__g")).distinct()
    n = names.count()
    _check_k(k, n, f"groups of {group}")
    folds = hash_rank(names, "__g", seed).select("__g", _even(F.col("__rank"), n, k).alias("fold"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


@dataclass(frozen=True)
class TimeFold:
    """Train on time < low, test on low <= time < high (no upper end if None)."""

    low: float
    high: float | None

    def train(self, time: Column) -> Column:
        return time < self.low

    def test(self, time: Column) -> Column:
        return (time >= self.low) if self.high is None else (time >= self.low) & (time < self.high)


def time_ordered(df: DataFrame, time: str, folds: int = 5, min_train: float = 0.3) -> list[TimeFold]:
    """Expanding windows over time: cuts move forward past equal times, empty blocks are dropped."""
    if folds < 1:
        raise ValueError(f"there must be at least 1 fold, not {folds}")
    if not 0 < min_train < 1:
        raise ValueError(f"the first training share must lie between 0 and 1, not {min_train}")
    n = df.count()
    first = -(-min_train * n // 1)
    targets = [int(first) + round(i * (n - int(first)) / folds) for i in range(folds)]
    g = ordered.walk(df, F.col(time).cast("double"), {}).withColumn("start", F.col("cum_n") - F.col("n"))
    row = g.agg(*[F.min(F.when(F.col("start") >= t, F.col("key"))).alias(f"c{i}") for i, t in enumerate(targets)]).first()
    cuts = sorted({row[f"c{i}"] for i in range(folds) if row[f"c{i}"] is not None})
    if not cuts:
        raise ValueError(f"no time cut leaves {min_train:.0%} of {n} rows for training and rows to test; times are too tied")
    return [TimeFold(a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]


def time_folds(df: DataFrame, time: str, folds: int = 5, min_train: float = 0.3) -> DataFrame:
    """``df`` with fold, the block that tests the row; -1 for rows that only train."""
    cuts = [f.low for f in time_ordered(df, time, folds, min_train)]
    return df.withColumn("fold", ordered.place(F.col(time).cast("double"), cuts, inclusive=True) - 1)
