"""Scored tables that the registered queries run on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with two predictions, the first with few distinct values."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        (q / 50.0).alias("w"), (F.col("l_linenumber") - 1).cast("double").alias("y"), (1.0 + 20.0 * d).alias("mu_a"), (1.0 + 25.0 * t + q / 100.0).alias("mu_b"),
        F.when(q.between(8, 42), 20.0).otherwise(q).alias("heavy"), q.alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (100.0 * d).alias("discount"),
    )


def positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), q.alias("w"), (5000.0 + 1000.0 * q).alias("mu"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), (0.05 + 8.1 * d).alias("p"), (0.05 + 4.0 * d + 0.008 * q).alias("p2"), (q / 50.0).alias("w")
    )


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("y"), F.col("event_type").alias("level"), F.col("user_id").alias("user"))


RATE = """SELECT l_quantity / 50.0 AS w, (l_linenumber - 1)::DOUBLE AS y, 1.0 + 20.0 * l_discount AS mu_a, 1.0 + 25.0 * l_tax + l_quantity / 100.0 AS mu_b,
  CASE WHEN l_quantity BETWEEN 8 AND 42 THEN 20.0::DOUBLE ELSE l_quantity END AS heavy, l_quantity AS quantity, l_returnflag AS flag, l_linestatus AS status, 100.0 * l_discount AS discount FROM lineitem"""
POSITIVE = "SELECT l_extendedprice AS y, l_quantity AS w, 5000.0 + 1000.0 * l_quantity AS mu FROM lineitem"
LABELLED = "SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, 0.05 + 8.1 * l_discount AS p, 0.05 + 4.0 * l_discount + 0.008 * l_quantity AS p2, l_quantity / 50.0 AS w FROM lineitem"
TIMED = "SELECT event_id AS id, epoch_us(ts) AS t, value AS y, event_type AS level, user_id AS \"user\" FROM events"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in their last bits with the order of rows; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
