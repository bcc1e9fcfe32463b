"""Loading and cleaning of the five public modelling data sets, as DataFrame expressions.

Raw tables come from any source that Spark reads; cleaned ones are kept as Parquet.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _plain(c: str) -> Column:
    return F.regexp_replace(F.col(c).cast("string"), "^['\"]|['\"]$", "")


def _capped(c: str, most: float) -> Column:
    return F.least(F.col(c).cast("double"), F.lit(float(most)))


def clean_motor_frequency(raw: DataFrame) -> DataFrame:
    """Caps claims, exposure and the rating factors, strips quotes, adds log density, area code and frequency."""
    # Caps of the published cleaning.
    caps = {"ClaimNb": 4, "Exposure": 1, "VehPower": 9, "VehAge": 20, "DrivAge": 90, "BonusMalus": 150}
    out = raw.select(
        F.col("IDpol").cast("long").alias("IDpol"), *[_capped(c, m).alias(c) for c, m in caps.items()], F.col("Density").cast("double").alias("Density"), *[_plain(c).alias(c) for c in ("Area", "VehBrand", "VehGas", "Region")]
    )
    code = F.ascii("Area") - F.ascii(F.lit("A")) + 1
    return out.withColumns({"LogDensity": F.log("Density"), "AreaCode": code.cast("double"), "Frequency": F.col("ClaimNb") / F.col("Exposure")})


def clean_card_fraud(raw: DataFrame) -> DataFrame:
    return raw.withColumn("Class", _plain("Class").cast("double"))


def clean_motor_severity(claims: DataFrame, frequency: DataFrame) -> DataFrame:
    """Claims by policy with their number, capped-free total and mean, for policies that the frequency table has."""
    per = claims.groupBy(F.col("IDpol").cast("long").alias("IDpol")).agg(F.count(F.lit(1)).cast("double").alias("ClaimCount"), F.sum(F.least(F.col("ClaimAmount").cast("double"), F.lit(1e6))).alias("ClaimTotal"))
    return per.withColumn("Severity", F.col("ClaimTotal") / F.col("ClaimCount")).join(frequency, "IDpol", "inner")


def clean_hourly_bikes(raw: DataFrame, order: str) -> DataFrame:
    """Numbers as doubles, booleans as 0/1 and hour_index by an explicit order; refuses hours that do not follow each other."""
    numbers = ["year", "month", "hour", "weekday", "temp", "feel_temp", "humidity", "windspeed", "count"]
    flags = [c for c in ("holiday", "workingday") if c in raw.columns]
    asdouble = {c: F.col(c).cast("double") for c in numbers if c in raw.columns} | {c: F.lower(_plain(c)).isin("true", "1", "1.0").cast("double") for c in flags}
    one = Window.orderBy(order)  # the published table has 17 379 hours
    out = raw.withColumns(asdouble).withColumn("hour_index", (F.row_number().over(one) - 1).cast("long"))
    stamp = F.col("year") * 100 + F.col("month")
    back = out.select((stamp < F.lag(stamp).over(one)).alias("back")).filter("back").count()
    if back:
        raise ValueError(f"time runs backwards in {back} rows; give the table in its published order")
    return out


def clean_churn(raw: DataFrame) -> DataFrame:
    """Label to 0/1, 'No ... service' to No, blank charges to 0."""
    out = raw.withColumn("Churn", (_plain("Churn") == "Yes").cast("double"))
    number = lambda c: F.coalesce(F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)"), F.lit(0.0))
    out = out.withColumns({c: number(c) for c in ("TotalCharges", "MonthlyCharges", "tenure", "SeniorCitizen") if c in raw.columns})
    texts = [c for c, t in out.dtypes if t == "string" and c != "customerID"]
    return out.withColumns({c: F.when(F.col(c).startswith("No ") & F.col(c).endswith(" service"), "No").otherwise(_plain(c)) for c in texts})


@dataclass(frozen=True)
class Dataset:
    name: str
    about: str
    task: str
    clean: Callable[..., DataFrame]


DATASETS = {
    d.name: d
    for d in (
        Dataset("motor_frequency", "French motor liability, claims by policy", "poisson rate by exposure", clean_motor_frequency), Dataset("motor_severity", "French motor liability, mean claim by policy", "gamma, weight ClaimCount", clean_motor_severity),
        Dataset("card_fraud", "European card transactions", "binomial", clean_card_fraud), Dataset("hourly_bikes", "hourly bike rentals", "poisson in time order", clean_hourly_bikes), Dataset("churn", "telecom customers", "binomial", clean_churn),
    )
}


def cache_dir() -> str:
    return os.environ.get("ASSAYER_DATA", os.path.expanduser("~/.cache/assayer"))


def describe(name: str) -> str:
    d = DATASETS[name]
    return f"{d.name}: {d.about}; {d.task}. {(d.clean.__doc__ or '').strip()}"


def load(spark: SparkSession, name: str, raw: dict[str, DataFrame] | None = None, refresh: bool = False, folder: str | None = None, **options) -> DataFrame:
    """The cleaned table: from Parquet if kept there, else from ``raw`` tables, cleaned and kept."""
    if name not in DATASETS:
        raise ValueError(f"data set {name!r} is unknown; use one of {', '.join(DATASETS)}")
    path = f"{folder or cache_dir()}/{name}.parquet"
    if not refresh:
        try:
            return spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if raw is None:
        raise ValueError(f"{name} is not kept below {path} and no raw table was given; pass raw={{...}}")
    DATASETS[name].clean(*raw.values(), **options).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
