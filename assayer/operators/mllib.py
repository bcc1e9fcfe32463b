"""Comparator: Spark's own generalised linear regression on the same design."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.family import Family, column
from assayer.operators import encoders as enc


@dataclass
class MLlibGLM:
    family: str
    terms: dict = field(default_factory=dict)
    power: float | None = None
    max_iter: int = 50
    tol: float = 1e-8

    def _design(self, df: DataFrame) -> DataFrame:
        cols: list[tuple[str, Column]] = [c for e in self.encoders for c in e.columns()]
        wide = df.withColumns({f"__x{i}": c for i, (_, c) in enumerate(cols)})
        return VectorAssembler(inputCols=[f"__x{i}" for i in range(len(cols))], outputCol="__features").transform(wide)

    def fit(self, df: DataFrame, y: str, weight: str | None = None, offset: str | None = None) -> MLlibGLM:
        f = Family.of(self.family, self.power)
        self.encoders = [(enc.make(k, n) if isinstance(k, str) else k).fit(df, weight, y) for n, k in self.terms.items()]
        d = self._design(df).withColumns({"__y": column(y), "__w": column(weight), "__o": column(offset, 0.0)})
        options = {"family": f.name, "labelCol": "__y", "featuresCol": "__features", "weightCol": "__w", "offsetCol": "__o", "maxIter": self.max_iter, "tol": self.tol}
        options |= {"variancePower": f.power, "linkPower": 0.0} if f.name == "tweedie" else {"link": f.link.name}
        self.fitted = GeneralizedLinearRegression(**options).fit(d)
        return self

    def predict(self, df: DataFrame, offset: str | None = None, out: str = "prediction") -> DataFrame:
        d = self._design(df)
        link = Family.of(self.family, self.power).link
        eta, o = F.lit(float(self.fitted.intercept)), column(offset, 0.0)
        for i, b in enumerate(self.fitted.coefficients.toArray()):
            eta = eta + F.col(f"__x{i}") * float(b)
        return d.withColumn(out, link.inverse(eta + o)).select(*df.columns, out)
