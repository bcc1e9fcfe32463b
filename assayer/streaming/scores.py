"""Scores over windows of event time.

Only scores that are sums of rows can follow a stream; those that rank rows need all of
them. The same aggregate runs on a batch frame, so a backfill gives the stream's numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.family import Family, column
from assayer.operators.metrics import Name, ratio


def windowed_scores(df: DataFrame, y: Name, mu: Name, family: str | Family, time: str, window: str, watermark: str | None = None, weight: Name | None = None, power: float | None = None) -> DataFrame:
    """(start, end, n, weight, deviance, balance, rmse, mae) per window; rows outside the family's support count in ``refused``.

    With a ``watermark`` late rows are dropped and a stream can append closed windows.
    """
    f, a, b, w = Family.of(family, power), column(y), column(mu), column(weight)
    if watermark:
        df = df.withWatermark(time, watermark)
    ok = F.coalesce(f.accepts_y(a) & f.accepts_mu(b) & (w >= 0), F.lit(False))
    some = lambda c: F.sum(F.when(ok, c))
    total = some(w)
    got = df.groupBy(F.window(time, window).alias("w")).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("refused"), total.alias("weight"), ratio(some(w * f.unit_deviance(a, b)), total).alias("deviance"), ratio(some(w * a), some(w * b)).alias("balance"),
        F.sqrt(ratio(some(w * (a - b) * (a - b)), total)).alias("rmse"), ratio(some(w * F.abs(a - b)), total).alias("mae"),
    )
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "refused", "weight", "deviance", "balance", "rmse", "mae")
