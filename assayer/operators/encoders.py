"""Encoders of one input column into design Columns, fitted on training rows alone.

``fit(df, weight, y)`` learns from a frame, ``columns()`` returns (name, Column) pairs that
Catalyst plans like any projection, ``to_dict``/``from_dict`` keep the fitted state.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.family import column
from assayer.operators import ordered
from assayer.operators.splits import hash_rank


#: Most levels of a factor whose indicators are design columns; more are refused, as passes return squares of the number of columns.
MAX_LEVELS = 2000


def _refuse_missing(df: DataFrame, name: str) -> None:
    n = df.filter(F.col(name).isNull()).count()
    if n:
        raise ValueError(f"{name} is missing in {n} rows; fill or drop them")


@dataclass
class OneHot:
    """Indicators of the levels in order; the first is the reference."""

    name: str
    drop_first: bool = True
    unknown: str = "error"
    levels: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, weight: str | None = None, y: str | None = None) -> OneHot:
        _refuse_missing(df, self.name)
        found = df.select(F.col(self.name).cast("string")).distinct().limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{self.name} has more than {MAX_LEVELS} levels; a design holds a column for each: encode it by its target, or pool levels")
        self.levels = sorted(r[0] for r in found)
        if len(self.levels) < 2:
            raise ValueError(f"{self.name} has {len(self.levels)} level; an indicator needs at least 2")
        return self

    def columns(self) -> list[tuple[str, Column]]:
        """Indicators; the first one fails on missing and unseen levels, unless ``unknown`` is 'zero'."""
        level = F.col(self.name).cast("string")
        shown = self.levels[int(self.drop_first) :]
        out = [(f"{self.name}={v}", F.coalesce((level == v).cast("double"), F.lit(0.0))) for v in shown]
        if self.unknown == "error":
            told = F.concat(F.lit(f"{self.name} has a level that was not seen in fitting: "), F.coalesce(level, F.lit("(missing)")), F.lit("; refit, or encode unseen levels as zeros"))
            out[0] = (out[0][0], F.when(level == shown[0], 1.0).when(level.isin(self.levels), 0.0).otherwise(F.raise_error(told).cast("double")))
        return out


@dataclass
class Standardize:
    """Weighted mean 0 and population deviation 1."""

    name: str
    mean: float = 0.0
    std: float = 1.0

    def fit(self, df: DataFrame, weight: str | None = None, y: str | None = None) -> Standardize:
        v, w = column(self.name), column(weight)
        self.mean = float(df.agg(F.sum(w * v) / F.sum(w)).first()[0])
        self.std = float(df.agg(F.sqrt(F.sum(w * (v - self.mean) * (v - self.mean)) / F.sum(w))).first()[0])
        if not self.std > 0:
            raise ValueError(f"{self.name} is constant; it cannot be standardised")
        return self

    def columns(self) -> list[tuple[str, Column]]:
        return [(self.name, (column(self.name) - self.mean) / self.std)]


@dataclass
class Raw:
    """The column itself."""

    name: str

    def fit(self, df: DataFrame, weight: str | None = None, y: str | None = None) -> Raw:
        return self

    def columns(self) -> list[tuple[str, Column]]:
        return [(self.name, column(self.name))]


@dataclass
class TargetEncode:
    """Means of y by level, drawn towards the overall mean by ``smoothing`` rows.

    Training rows get values from other folds, or with ``time`` from strictly earlier rows,
    so that no row sees its own y; new rows get the table, unseen levels the overall mean.
    Rows without a level are refused.
    """

    name: str
    smoothing: float = 10.0
    inner: int = 5
    seed: int = 0
    prior: float = 0.0
    time: str | None = None
    table: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, weight: str | None = None, y: str | None = None) -> TargetEncode:
        _refuse_missing(df, self.name)
        rows = self.table_of(df, y, weight).collect()
        self.table = {r["level"]: r["value"] for r in rows}
        w, a = column(weight), column(y)
        self.prior = float(df.agg(F.sum(w * a) / F.sum(w)).first()[0])
        return self

    def table_of(self, df: DataFrame, y: str, weight: str | None = None) -> DataFrame:
        """(level, value), as a DataFrame."""
        w, a = column(weight), column(y)
        total = df.agg((F.sum(w * a) / F.sum(w)).alias("prior"))
        level = df.groupBy(F.col(self.name).cast("string").alias("level")).agg(F.sum(w).alias("w"), F.sum(w * a).alias("wy"))
        return level.join(F.broadcast(total)).select("level", ((F.col("wy") + self.smoothing * F.col("prior")) / (F.col("w") + self.smoothing)).alias("value"))

    def columns(self) -> list[tuple[str, Column]]:
        pairs = [F.lit(x) for kv in self.table.items() for x in kv]
        found = F.try_element_at(F.create_map(*pairs), F.col(self.name).cast("string")) if pairs else F.lit(None)
        return [(self.name, F.coalesce(found, F.lit(self.prior)))]

    def transform_training(self, df: DataFrame, y: str, id_col: str, weight: str | None = None) -> DataFrame:
        """``df`` with __encoded, values for the rows that the encoder is fitted on."""
        return self.past_only(df, y, self.time, id_col, weight) if self.time else self.out_of_fold(df, y, id_col, weight)

    def out_of_fold(self, df: DataFrame, y: str, id_col: str, weight: str | None = None) -> DataFrame:
        """``df`` with __encoded: sums of all folds less those of the row's own, one aggregate."""
        _refuse_missing(df, self.name)
        _refuse_missing(df, id_col)
        w, a = column(weight), column(y)
        n = df.count()
        ranked = hash_rank(df, id_col, self.seed)
        size, more = divmod(n, self.inner)
        r = F.col("__rank")
        fold = F.when(r < more * (size + 1), F.floor(r / (size + 1))).otherwise(more + F.floor((r - more * (size + 1)) / max(size, 1)))
        d = ranked.withColumn("__f", fold.cast("int")).withColumn("__l", F.col(self.name).cast("string"))
        cell = d.groupBy("__l", "__f").agg(F.sum(w).alias("w"), F.sum(w * a).alias("wy"))
        level = cell.groupBy("__l").agg(F.sum("w").alias("lw"), F.sum("wy").alias("lwy"))
        own = cell.groupBy("__f").agg(F.sum("w").alias("fw"), F.sum("wy").alias("fwy"))
        whole = own.agg(F.sum("fw").alias("tw"), F.sum("fwy").alias("twy"))
        t = cell.join(level, "__l").join(F.broadcast(own), "__f").join(F.broadcast(whole))
        prior = F.when(F.col("tw") > F.col("fw"), (F.col("twy") - F.col("fwy")) / F.when(F.col("tw") > F.col("fw"), F.col("tw") - F.col("fw"))).otherwise(0.0)
        value = (F.col("lwy") - F.col("wy") + self.smoothing * prior) / (F.col("lw") - F.col("w") + self.smoothing)
        return d.join(t.select("__l", "__f", value.alias("__encoded")), ["__l", "__f"]).drop("__l", "__f", "__rank")

    def past_only(self, df: DataFrame, y: str, time: str, id_col: str, weight: str | None = None) -> DataFrame:
        """``df`` with __encoded from strictly earlier rows in the order of time and id; the first row gets 0.

        Running sums are two-level over ranges of time, for the overall mean and for every level.
        """
        _refuse_missing(df, self.name)
        _refuse_missing(df, time)
        w, a = column(weight), column(y)
        bounds = ordered.ranges(df, F.col(time).cast("double"))
        d = df.withColumns({"__r": ordered.place(F.col(time).cast("double"), bounds), "__l": F.col(self.name).cast("string"), "__w": w, "__wy": w * a})
        cell = d.groupBy("__r", "__l").agg(F.sum("__w").alias("w"), F.sum("__wy").alias("wy"))
        of_level = cell.select("__r", "__l", *[F.coalesce(F.sum(c).over(Window.partitionBy("__l").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"l_{c}") for c in ("w", "wy")])
        whole = cell.groupBy("__r").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
        of_all = whole.select("__r", *[F.coalesce(F.sum(c).over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"a_{c}") for c in ("w", "wy")])
        order = [F.col(time), F.col(id_col)]
        inside = lambda keys, c: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        d = d.withColumns({"__lw": inside(["__r", "__l"], "__w"), "__lwy": inside(["__r", "__l"], "__wy"), "__aw": inside(["__r"], "__w"), "__awy": inside(["__r"], "__wy")})
        d = d.join(F.broadcast(of_all), "__r").join(of_level, ["__r", "__l"])
        seen = F.col("__aw") + F.col("a_w")
        prior = F.when(seen > 0, (F.col("__awy") + F.col("a_wy")) / F.when(seen > 0, seen)).otherwise(0.0)
        below = F.col("__lw") + F.col("l_w") + self.smoothing
        value = F.when(below > 0, (F.col("__lwy") + F.col("l_wy") + self.smoothing * prior) / F.when(below > 0, below)).otherwise(prior)
        return d.withColumn("__encoded", value).select(*df.columns, "__encoded")


# ---- splines


def basis(x: np.ndarray, knots: list[float], degree: int) -> np.ndarray:
    """B-spline basis by the Cox-de Boor recursion, clamped to the outer knots; rows x (knots + degree - 1)."""
    t = np.concatenate(([knots[0]] * degree, knots, [knots[-1]] * degree)).astype(float)
    x = np.clip(np.asarray(x, float), knots[0], knots[-1])
    n = len(t) - 1
    last = max(i for i in range(n) if t[i] < t[i + 1])
    b = np.stack([((t[i] <= x) & (x < t[i + 1])) | ((i == last) & (x == t[i + 1])) if t[i] < t[i + 1] else np.zeros(len(x), bool) for i in range(n)], 1).astype(float)
    for p in range(1, degree + 1):
        new = np.zeros((len(x), n - p))
        for i in range(n - p):
            if t[i + p] > t[i]:
                new[:, i] += (x - t[i]) / (t[i + p] - t[i]) * b[:, i]
            if t[i + p + 1] > t[i + 1]:
                new[:, i] += (t[i + p + 1] - x) / (t[i + p + 1] - t[i + 1]) * b[:, i + 1]
        b = new
    return b


def basis_columns(x: Column, knots: list[float], degree: int) -> list[Column]:
    """The same basis as Columns: per interval a polynomial in Horner form, found by interpolation on the driver."""
    x = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), x))
    n = len(knots) + degree - 1
    made: list[Column] = [F.lit(0.0)] * n
    for lo, hi in reversed(list(zip(knots[:-1], knots[1:], strict=True))):
        u = np.array([0.5]) if degree == 0 else (1 - np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))) / 2
        coefs = np.linalg.solve(np.vander(u, increasing=True), basis(lo + u * (hi - lo), knots, degree))
        z = (x - float(lo)) / float(hi - lo)
        inside = x >= float(lo)
        for j in range(n):
            c = np.where(np.abs(coefs[:, j]) < 1e-13, 0, coefs[:, j])
            value: Column = F.lit(float(c[-1]))
            for a in c[-2::-1]:
                value = value * z + float(a)
            # from the right: the first interval that starts at or below x wins
            made[j] = F.when(inside, value) if hi == knots[-1] else made[j].when(inside, value)
    return made


@dataclass
class BSpline:
    """Spline with knots at quantiles; ``df`` columns, the first basis function is dropped."""

    name: str
    df: int = 6
    degree: int = 3
    monotone: str | None = None
    knots: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, weight: str | None = None, y: str | None = None) -> BSpline:
        inner = self.df - self.degree
        if inner < 0:
            raise ValueError(f"a spline of degree {self.degree} needs df of at least {self.degree}, not {self.df}")
        ps = np.linspace(0, 1, inner + 2).tolist()
        found = df.agg(F.percentile(column(self.name), F.array(*[F.lit(p) for p in ps]))).first()[0]
        self.knots = sorted(set(map(float, found)))
        if len(self.knots) < 2:
            raise ValueError(f"{self.name} is constant; a spline needs two values")
        return self

    def columns(self) -> list[tuple[str, Column]]:
        return [(f"{self.name}[{i}]", c) for i, c in enumerate(basis_columns(column(self.name), self.knots, self.degree)) if i]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return basis(x, self.knots, self.degree)[:, 1:]


@dataclass
class Smooth(BSpline):
    """Spline with even knots and a penalty on second differences, its weight ``lam`` given or found by GCV."""

    df: int = 9
    lam: float | None = None

    def fit(self, df: DataFrame, weight: str | None = None, y: str | None = None) -> Smooth:
        if self.df < self.degree:
            raise ValueError(f"a smooth of degree {self.degree} needs df of at least {self.degree}, not {self.df}")
        lo, hi = df.agg(F.min(column(self.name)), F.max(column(self.name))).first()
        if lo == hi:
            raise ValueError(f"{self.name} is constant; a smooth needs two values")
        self.knots = np.linspace(lo, hi, self.df - self.degree + 2).tolist()
        return self

    def penalty(self) -> np.ndarray:
        n = len(self.knots) + self.degree - 1
        d = np.diff(np.eye(n), 2, axis=0)
        return (d.T @ d)[1:, 1:]


def piecewise_linear(name: str, df: int = 5, monotone: str | None = None) -> BSpline:
    return BSpline(name, df=df, degree=1, monotone=monotone)


@dataclass
class Interaction:
    """Products of two splines, or of a spline and a factor's indicators."""

    a: str
    b: str
    df: int = 4
    degree: int = 3
    factor: bool = False
    parts: list = field(default_factory=list)

    @property
    def name(self) -> str:
        return f"{self.a}*{self.b}"

    def fit(self, df: DataFrame, weight: str | None = None, y: str | None = None) -> Interaction:
        right = OneHot(self.b) if self.factor else BSpline(self.b, self.df, self.degree)
        self.parts = [BSpline(self.a, self.df, self.degree).fit(df, weight, y), right.fit(df, weight, y)]
        return self

    def columns(self) -> list[tuple[str, Column]]:
        return [(f"{m}*{n}", c * d) for m, c in self.parts[0].columns() for n, d in self.parts[1].columns()]


KINDS = {"onehot": OneHot, "target": TargetEncode, "standardize": Standardize, "spline": BSpline, "smooth": Smooth, "interaction": Interaction, "piecewise": piecewise_linear, "raw": Raw}
_CLASSES = {c.__name__: c for c in (OneHot, TargetEncode, Standardize, BSpline, Smooth, Interaction, Raw)}


def make(kind: str, name: str):
    """An encoder by the name of its kind; an interaction takes 'a*b'."""
    if kind not in KINDS:
        raise ValueError(f"encoder {kind!r} is unknown; use one of {', '.join(KINDS)}")
    return Interaction(*name.split("*", 1)) if kind == "interaction" else KINDS[kind](name)


def to_dict(encoder) -> dict:
    d = {k: v for k, v in asdict(encoder).items() if k != "parts"}
    if isinstance(encoder, Interaction):
        d["parts"] = [to_dict(p) for p in encoder.parts]
    return {"class": type(encoder).__name__, **d}


def from_dict(d: dict):
    d = dict(d)
    cls = _CLASSES[d.pop("class")]
    if "parts" in d:
        d["parts"] = [from_dict(p) for p in d["parts"]]
    return cls(**d)
