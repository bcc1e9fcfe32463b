"""Input rules, all counted in one aggregate; a broken rule says what, how many rows and what to do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.family import Family


@dataclass(frozen=True)
class Rule:
    """``broken`` marks rows that break the rule."""

    broken: Column
    what: str
    fix: str


def finite(c: Column, name: str) -> list[Rule]:
    return [
        Rule(c.isNull() | F.isnan(c), f"{name} is missing", "drop or fill those rows"),
        Rule(F.abs(c) == float("inf"), f"{name} is infinite", "cap or drop those rows"),
    ]


def inputs(y: Column, mu: Column | None, w: Column, family: Family | None = None, positive_weight: bool = False) -> list[Rule]:
    """Rules of a target, a prediction and a weight; a family adds its supports."""
    rules = finite(y, "y") + (finite(mu, "the prediction") if mu is not None else []) + finite(w, "the weight")
    rules.append(Rule(w <= 0, "the weight is 0 or below", "drop rows without weight") if positive_weight else Rule(w < 0, "the weight is negative", "use weights of 0 or above"))
    if family is not None:
        rules.append(Rule(~family.accepts_y(y), f"y is outside the support of {family.name}: it must be {family.y_rule}", "choose another family or clean y"))
        if mu is not None:
            rules.append(Rule(~family.accepts_mu(mu), f"the prediction is not a {family.name} mean: it must be {family.mu_rule}", "clip the prediction"))
    return rules


def binary(y: Column) -> list[Rule]:
    return [Rule((y != 0) & (y != 1), "a label is neither 0 nor 1", "recode the labels to 0 and 1")]


def check(df: DataFrame, rules: list[Rule], w: Column | None = None, both_classes: Column | None = None, least_rows: int = 1) -> dict[str, float]:
    """Runs all rules in one pass and raises ValueError for the first that is broken; returns n and the sum of weights."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(w if w is not None else F.lit(1.0)).alias("weight")]
    aggs += [F.count_if(F.coalesce(r.broken, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    if both_classes is not None:
        weight = w if w is not None else F.lit(1.0)
        aggs += [F.sum(F.when(both_classes == v, weight)).alias(f"class{v}") for v in (0, 1)]
    row = df.agg(*aggs).first()
    for i, r in enumerate(rules):
        if row[f"r{i}"]:
            raise ValueError(f"{r.what} in {row[f'r{i}']} of {row['n']} rows; {r.fix}")
    if row["n"] < least_rows:
        raise ValueError(f"there are {row['n']} rows; at least {least_rows} are needed")
    if not row["weight"] or row["weight"] <= 0:
        raise ValueError(f"the weights of {row['n']} rows sum to {row['weight']}; give a positive total")
    if both_classes is not None and not (row["class0"] and row["class1"]):
        raise ValueError(f"all {row['n']} rows are of one class; ranking needs both with a positive weight")
    return {"n": row["n"], "weight": row["weight"]}
