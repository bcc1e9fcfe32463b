"""A model's panel of scores next to those of the constant prediction, and comparisons of two panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.family import Family, column
from assayer.functions.validate import binary, check, inputs
from assayer.operators import metrics as m
from assayer.operators.metrics import Name, ratio

HIGHER_IS_BETTER = {"d2": True, "gini": True, "normalized_gini": True, "r2": True, "roc_auc": True, "average_precision": True, "ks": True, "mcc": True, "f1": True}
LOWER_IS_BETTER = ("deviance", "deviance_per_row", "rmse", "mae", "log_loss", "brier")
#: Distances of a balance from 1 that differ by less count as a tie.
BALANCE_TIE = 1e-3


def naive_prediction(df: DataFrame, y: Name, weight: Name | None = None) -> float:
    return float(m.naive(df, y, weight).first()[0])


def _family_panel(df: DataFrame, y, mu, w, f: Family, weighted: bool, mean: float, walks: bool = True) -> dict[str, float]:
    """Order-free scores in one aggregate, the Gini pair in one walk each, unless ``walks`` is false."""
    null = f.unit_deviance(y, F.lit(mean))
    total, n = F.sum(w), F.count(F.lit(1))
    aggs = {
        "deviance": F.sum(w * f.unit_deviance(y, mu)) / total, "null": F.sum(w * null) / total, "balance": ratio(F.sum(w * y), F.sum(w * mu)), "rmse": F.sqrt(F.sum(w * (y - mu) * (y - mu)) / total),
        "mae": F.sum(w * F.abs(y - mu)) / total, "spread": F.sum(w * (y - mean) * (y - mean)) / total, "error": F.sum(w * (y - mu) * (y - mu)) / total, "least": F.min(y), "total": total, "n": n,
    }
    r = df.agg(*[c.cast("double").alias(k) for k, c in aggs.items()]).first()
    out = {"deviance": r["deviance"]}
    if weighted:
        out["deviance_per_row"] = r["deviance"] * r["total"] / r["n"]
    nan = float("nan")
    out |= {"d2": 1 - r["deviance"] / r["null"] if r["null"] else nan, "gini": nan, "normalized_gini": nan}
    if walks and r["least"] >= 0:
        g, top = (m.gini(df, y, s, w, False).first()[0] for s in (mu, y / w))
        out |= {"gini": g, "normalized_gini": g / top if top and top > 0 else nan}
    return out | {"balance": r["balance"], "rmse": r["rmse"], "mae": r["mae"], "r2": 1 - r["error"] / r["spread"] if r["spread"] else nan}


def _binomial_panel(df: DataFrame, y, p, w, threshold: float) -> dict[str, float]:
    f = Family.of("binomial")
    r = df.agg((F.sum(w * f.unit_deviance(y, p)) / F.sum(w) / 2).alias("log_loss"), (F.sum(w * (y - p) * (y - p)) / F.sum(w)).alias("brier"), ratio(F.sum(w * y), F.sum(w * p)).alias("balance")).first()
    g = m._ranked(df, y, p, w, False, True)
    seen = F.col("cum_pos") + F.col("cum_neg")
    step = F.when(seen > 0, F.col("pos") * F.col("cum_pos") / F.when(seen > 0, seen)).otherwise(0.0)
    k = g.agg(
        (F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)) / F.max("all_pos") / F.max("all_neg")).alias("roc_auc"), (F.sum(step) / F.max("all_pos")).alias("average_precision"),
        F.max(F.abs(F.col("cum_pos") / F.col("all_pos") - F.col("cum_neg") / F.col("all_neg"))).alias("ks"),
    ).first()
    t = m.threshold_metrics(df, y, p, threshold, w, False).first()
    return {"log_loss": r["log_loss"], "brier": r["brier"], "roc_auc": k["roc_auc"], "average_precision": k["average_precision"], "ks": k["ks"], "mcc": t["mcc"], "f1": t["f1"], "balance": r["balance"]}


@dataclass(frozen=True)
class Scorecard:
    family: str
    label: str
    rows: int
    model: dict[str, float]
    naive: dict[str, float]

    def frame(self, spark) -> DataFrame:
        """(metric, model, naive)."""
        return spark.createDataFrame([(k, float(v), float(self.naive[k])) for k, v in self.model.items()], "metric string, model double, naive double")

    def to_dict(self) -> dict:
        return {"family": self.family, "label": self.label, "rows": self.rows, "model": self.model, "naive": self.naive}

    def __str__(self) -> str:
        return "\n".join([f"{self.label} ({self.family}, {self.rows} rows)", *(f"  {k:<18} {v:>12.5g}  naive {self.naive[k]:>12.5g}" for k, v in self.model.items())])


def scorecard(df: DataFrame, y: Name, mu: Name, family: str | Family, weight: Name | None = None, power: float | None = None, threshold: float = 0.5, label: str = "model") -> Scorecard:
    """Scores of a prediction and of the constant that is the mean of y."""
    f, a, b, w = Family.of(family, power), column(y), column(mu), column(weight)
    if f.name == "binomial":
        found = check(df, inputs(a, b, w, f) + binary(a), w, both_classes=a)
        base = float(df.agg(F.sum(w * a) / F.sum(w)).first()[0])
        model = _binomial_panel(df, a, b, w, threshold)
        # a constant ranks nothing, so its panel has a closed form
        loss = m.log_loss(df, a, F.lit(base), w, False).first()[0]
        flat = m.threshold_metrics(df, a, F.lit(base), threshold, w, False).first()
        naive = {"log_loss": loss, "brier": base * (1 - base), "roc_auc": 0.5, "average_precision": base, "ks": 0.0, "mcc": 0.0, "f1": flat["f1"], "balance": 1.0}
    else:
        found = check(df, inputs(a, b, w, f, positive_weight=True), w)
        mean = naive_prediction(df, a, w)
        model = _family_panel(df, a, b, w, f, weight is not None, mean)
        ranked = model["gini"] == model["gini"]  # a constant ranks nothing then
        naive = _family_panel(df, a, F.lit(mean), w, f, weight is not None, mean, not ranked) | {"d2": 0.0, "r2": 0.0, "balance": 1.0}
        if ranked:
            naive |= {"gini": 0.0, "normalized_gini": 0.0}
    return Scorecard(f.name, label, int(found["n"]), model, naive)


def verdict(metric: str, a: float, b: float) -> str:
    """'a', 'b' or 'tie'."""
    if metric == "balance":
        gap = abs(a - 1) - abs(b - 1)
        return "tie" if abs(gap) < BALANCE_TIE else "a" if gap < 0 else "b"
    if a != a or b != b or abs(a - b) <= 1e-8 + 1e-5 * abs(b):
        return "tie"
    return "a" if (a > b) == HIGHER_IS_BETTER.get(metric, False) else "b"


def compare(a: Scorecard, b: Scorecard) -> list[dict]:
    """Rows of metric, a, b and winner; the cards must score the same rows with the same family."""
    if a.family != b.family:
        raise ValueError(f"{a.label} is scored as {a.family} and {b.label} as {b.family}; score both alike")
    if a.rows != b.rows:
        raise ValueError(f"{a.label} has {a.rows} rows and {b.label} {b.rows}; score the same rows")
    return [{"metric": k, "a": v, "b": b.model[k], "winner": verdict(k, v, b.model[k])} for k, v in a.model.items() if k in b.model]
