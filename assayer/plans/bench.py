"""Models by folds: out-of-fold predictions, scores per fold, and a report of all of it."""

from __future__ import annotations

import html
import inspect
import json
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators import explain, tables
from assayer.operators.metrics import lorenz_curve, pr_curve, roc_curve, threshold_grid
from assayer.operators.scorecard import HIGHER_IS_BETTER, Scorecard, compare, scorecard
from assayer.operators.splits import time_ordered
from assayer.plans import views

SCHEMA = "assayer-report/1"
PRIMARY = {"binomial": "log_loss"}


class Model(Protocol):
    """What a bench asks of a model."""

    def fit(self, df: DataFrame, y: str, weight: str | None = None, offset: str | None = None): ...

    def predict(self, df: DataFrame, offset: str | None = None, out: str = "prediction") -> DataFrame: ...


@dataclass(frozen=True)
class Task:
    """Target, family and weight; with ``exposure`` y is a count that is fitted with an offset and scored as a rate."""

    y: str
    family: str
    weight: str | None = None
    exposure: str | None = None
    power: float | None = None
    threshold: float = 0.5

    @property
    def primary(self) -> str:
        return PRIMARY.get(self.family, "deviance")


@dataclass
class Result:
    task: Task
    cards: dict[str, list[Scorecard]]
    seconds: dict[str, list[float]]
    predictions: DataFrame
    pooled: dict[str, Scorecard] = field(default_factory=dict)
    report: dict = field(default_factory=dict)
    ladder: Sequence[str] = ()

    def summary(self) -> list[dict]:
        """Mean and population deviation over folds of every metric of every model, and of the constant prediction."""
        rows = []
        for name, cards in self.cards.items():
            for who in ("model", "naive") if name == next(iter(self.cards)) else ("model",):
                panels = [getattr(c, who) for c in cards]
                for metric in panels[0]:
                    v = np.array([p[metric] for p in panels], float)
                    rows.append({"model": name if who == "model" else "naive", "metric": metric, "mean": float(v.mean()), "std": float(v.std()), "folds": len(v)})
        return rows

    def to_markdown(self) -> str:
        rows = self.summary()
        names = list(dict.fromkeys(r["model"] for r in rows))
        lines = ["| metric | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
        for metric in dict.fromkeys(r["metric"] for r in rows):
            got = {r["model"]: r for r in rows if r["metric"] == metric}
            better = (lambda x: -abs(x - 1)) if metric == "balance" else (lambda x, m=metric: x if HIGHER_IS_BETTER.get(m) else -x)
            finite = [n for n in names if n in got and n != "naive" and math.isfinite(got[n]["mean"])]
            best = max(finite, key=lambda n: better(got[n]["mean"]), default=None)
            lines.append(f"| {metric} | " + " | ".join((("**{}**" if n == best else "{}").format(f"{got[n]['mean']:.5g} ± {got[n]['std']:.2g}") if n in got else "") for n in names) + " |")
        lines.append("| seconds | " + " | ".join(f"{sum(self.seconds[n]):.1f}" if n in self.seconds else "" for n in names) + " |")
        if self.ladder:
            lines = [f"Ladder: {' → '.join(self.ladder)}.", "", *lines]
        return "\n".join(lines)

    def write(self, folder: str | Path) -> None:
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        (out / "report.json").write_text(json.dumps(clean(self.report), indent=1))
        (out / "report.md").write_text(self.to_markdown() + "\n")
        (out / "report.html").write_text(to_html(self.report))
        (out / "pinned.json").write_text(json.dumps(clean(self.summary()), indent=1))


def clean(x):
    """NaN and infinities as null, all the way down."""
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if isinstance(x, (float, np.floating)):
        return float(x) if math.isfinite(x) else None
    return x.item() if isinstance(x, np.generic) else x


def held_name(model: str) -> str:
    """Column of a model's out-of-fold predictions; a model may be named like an input."""
    return f"prediction_{model}"


def scored(df: DataFrame, task: Task) -> tuple[DataFrame, str, str | None]:
    """The frame with the target and weight that scores use: a rate weighs by its exposure."""
    if not task.exposure:
        return df, task.y, task.weight
    return df.withColumn("__rate", F.col(task.y) / F.col(task.exposure)), "__rate", task.exposure


def run(
    df: DataFrame, task: Task, models: dict[str, Callable[[], Model]], fold: str | None = None, time_col: str | None = None, folds: int = 5, id_col: str | None = None, features: Sequence[str] = (), bins: int = 10,
    explain_rows: int = 5000, progress: Callable[[str], None] | None = None, ladder: Sequence[str] = (), dataset: str | None = None, report: bool = True,
) -> Result:
    """Fits every model on every training part and scores it on the part held out.

    ``fold`` names a column of fold numbers; with ``time_col`` folds are expanding windows.
    A rate task fits counts with the log of the exposure as offset and predicts without it.
    Models are explained on ``explain_rows`` rows of each part held out, those of the smallest
    id hashes; scores are of all rows. ``ladder`` names models in the order in which each adds
    to the one before, ``dataset`` says where the rows come from. Without ``report`` neither
    the report nor the pooled scorecards are made, which the summary over folds does not need.
    """
    strange = [n for n in ladder if n not in models]
    if strange:
        raise ValueError(f"the ladder names {', '.join(strange)}, which this bench does not run; it runs {', '.join(models)}")
    needed = [c for c in (task.y, task.weight, task.exposure, fold, time_col, id_col, *features) if c]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"the frame lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    if (fold is None) == (time_col is None):
        raise ValueError("give either a fold column or a time column")
    df, y, w = scored(df, task)
    if task.exposure:
        df = df.withColumn("__offset", F.log(task.exposure))
    if fold:
        ks = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
        parts = [(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)) for k in ks]
    else:
        t = F.col(time_col).cast("double")
        parts = [(df.filter(f.train(t)), df.filter(f.test(t))) for f in time_ordered(df, time_col, folds)]
    cards: dict[str, list[Scorecard]] = {n: [] for n in models}
    seconds: dict[str, list[float]] = {n: [] for n in models}
    held, looks = [], {n: [] for n in models}
    grids = {f: explain.feature_grid(df, f) for f in features} if features and id_col else {}
    for i, (train, test) in enumerate(parts):
        for name, make in models.items():
            began = time.time()
            model = make()
            if time_col and getattr(model, "alpha", None) == "cv":
                raise ValueError(f"{name} chooses its penalty on random folds, which mix past and future; give it an alpha, or bench it on random folds")
            options = {"offset": "__offset"} if task.exposure else {"weight": task.weight}
            if id_col and "id_col" in inspect.signature(model.fit).parameters:
                options["id_col"] = id_col
            model.fit(train, task.y, **options)
            test = model.predict(test, out=held_name(name))
            cards[name].append(scorecard(test, y, held_name(name), task.family, w, task.power, task.threshold, name))
            if grids:
                sample = tables.residual_sample(test, id_col, explain_rows, i)
                looks[name].append(views.look(model, sample, y, task.family, task.power, grids, id_col, w, i))
            seconds[name].append(time.time() - began)
            if progress:
                progress(f"{name}, fold {i + 1} of {len(parts)}: {seconds[name][-1]:.1f} s")
        held.append(test)
    oof = held[0]
    for h in held[1:]:
        oof = oof.unionByName(h)
    result = Result(task, cards, seconds, oof, ladder=tuple(ladder))
    if report:
        build(result, oof, y, w, features, bins, {n: views.merged(v) for n, v in looks.items() if v}, time_col, dataset)
    return result


def _rows(df: DataFrame) -> list[dict]:
    """A table of bins, levels or quantiles as records, all of them."""
    return [r.asDict(recursive=True) for r in df.collect()]


def curve_points(df: DataFrame, along: Column, order: Sequence[str], points: int = 500) -> DataFrame:
    """A curve thinned for drawing: the first and the last of its points in each of ``points`` steps of ``along``, 0 to 1.

    The curve may have a point per row, so it is thinned by an aggregate before it is
    collected. Points keep their exact values, and scores never come from them.
    """
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    ends = df.groupBy(F.floor(along * points).alias("__step")).agg(F.min(row).alias("__a"), F.max(row).alias("__b"))
    return ends.select(F.explode(F.array_distinct(F.array("__a", "__b"))).alias("r")).select("r.*").orderBy(*order).select(*df.columns)


def build(
    result: Result, df: DataFrame, y: str, w: str | None, features: Sequence[str], bins: int, explained: dict[str, dict], time_col: str | None = None, dataset: str | None = None
) -> None:
    """The report document: every block is a small table."""
    task, names = result.task, list(result.cards)
    df = df.persist()
    try:
        for n in names:
            result.pooled[n] = scorecard(df, y, held_name(n), task.family, w, task.power, task.threshold, n)
        by_label = lambda make: {n: make(n) for n in names}
        binary = task.family == "binomial"
        curves: dict[str, dict] = {"calibration": by_label(lambda n: _rows(tables.calibration_table(df, y, held_name(n), w, bins).orderBy("bin")))}
        if binary:
            curves["roc"] = by_label(lambda n: _rows(curve_points(roc_curve(df, y, held_name(n), w), (F.col("fpr") + F.col("tpr")) / 2, ["fpr", "tpr"])))
            curves["pr"] = by_label(lambda n: _rows(curve_points(pr_curve(df, y, held_name(n), w), F.col("recall"), ["recall", "precision"])))
            curves["thresholds"] = by_label(lambda n: _rows(threshold_grid(df, y, held_name(n), w)))
        elif df.agg(F.min(y)).first()[0] >= 0:
            curves["lorenz"] = by_label(lambda n: _rows(curve_points(lorenz_curve(df, y, held_name(n), w), F.col("x"), ["x", "y"])))
        pairs_of = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        curves["double_lift"] = [{"a": a, "b": b, "bins": _rows(tables.double_lift(df, y, held_name(a), held_name(b), w, bins).orderBy("bin"))} for a, b in pairs_of]
        res = {}
        for n in names:
            r = tables.residuals(df, y, held_name(n), task.family, w, task.power)
            res[n] = {"summary": _rows(tables.residual_summary(r))[0], "histogram": _rows(tables.residual_histogram(r).orderBy("bin")), "by_feature": {f: _rows(tables.ae_by_feature(df, f, y, held_name(n), w, bins).orderBy("position")) for f in features}}
            if time_col:
                res[n]["over_time"] = _rows(tables.ae_by_feature(df.withColumn("__time", F.col(time_col).cast("double")), "__time", y, held_name(n), w, bins).orderBy("position"))
            pairs = {(a, b): tables.ae_by_two(df, a, b, y, held_name(n), w, 5) for i, a in enumerate(features) for b in features[i + 1 :]}
            res[n]["pairs_ranked"] = [{"a": a, "b": b, "strength": s} for a, b, s in tables.rank_pairs(pairs)]
        document = {
            "schema": SCHEMA, "task": {"family": task.family, "power": task.power, "threshold": task.threshold, "primary_metric": task.primary, "n_bins": bins, "rate": bool(task.exposure)}, "models": names,
            "provenance": {"dataset": dataset, "rows": df.count(), "weight_sum": df.agg(F.sum(w) if w else F.count(F.lit(1))).first()[0]}, "scorecards": {n: c.to_dict() for n, c in result.pooled.items()},
            "comparisons": [{"a": a, "b": b, "rows": compare(result.pooled[a], result.pooled[b])} for a, b in pairs_of], "curves": curves, "residuals": res,
            "data": {f: _rows(tables.categorical_profile(df, f, y, w) if explain.is_categorical(df, f) else tables.numeric_profile(df, f, y, w)) for f in features},
            "bench": {"summary": result.summary(), "seconds": result.seconds, "ladder": list(result.ladder)}, "explain": explained,
        }
        if not binary and len(names) > 1:
            document["tournament"] = _rows(tables.win_sets(df, y, [held_name(n) for n in names], w))
        result.report = document
    finally:
        df.unpersist()


REQUIRED = {
    "schema": str, "task": dict, "models": list, "provenance": dict, "scorecards": dict, "comparisons": list, "curves": dict, "residuals": dict, "data": dict, "bench": dict, "explain": dict,
}
WITHIN = {"task": ("family", "primary_metric", "n_bins", "rate"), "provenance": ("dataset", "rows", "weight_sum"), "curves": ("calibration", "double_lift"), "bench": ("summary", "seconds", "ladder")}


def validate(document: dict) -> None:
    """Refuses documents of another schema and such as lack a block, a part of it, or a model in it."""
    if document.get("schema") != SCHEMA:
        raise ValueError(f"the document has schema {document.get('schema')!r}, not {SCHEMA!r}; rebuild it")
    wrong = [k for k, kind in REQUIRED.items() if not isinstance(document.get(k), kind)]
    wrong += [f"{k}.{part}" for k, parts in WITHIN.items() if k not in wrong for part in parts if part not in document[k]]
    per_model = {k: document[k] for k in ("scorecards", "residuals") if k not in wrong}
    per_model |= {f"curves.{k}": v for k, v in document["curves"].items() if isinstance(v, dict)} if "curves" not in wrong else {}
    wrong += [f"{k}.{n}" for k, v in per_model.items() for n in (document["models"] if "models" not in wrong else ()) if n not in v]
    if wrong:
        raise ValueError(f"the document lacks {', '.join(wrong)}; rebuild it")


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>empty</p>"
    cell = lambda v: html.escape(f"{v:.5g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(str(k))}</th>" for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def to_html(document: dict) -> str:
    """One self-contained page of tables, with the document inlined."""
    validate(document)
    parts = []
    for n, c in document["scorecards"].items():
        parts.append(f"<h2>{html.escape(n)}</h2>" + _table([{"metric": k, "model": v, "naive": c["naive"][k]} for k, v in c["model"].items()]) + "<h3>Calibration</h3>" + _table(document["curves"]["calibration"][n]))
        parts += [f"<h3>By {html.escape(f)}</h3>" + _table(rows) for f, rows in document["residuals"][n]["by_feature"].items()]
        if "over_time" in document["residuals"][n]:
            parts.append("<h3>Over time</h3>" + _table(document["residuals"][n]["over_time"]))
        seen = document["explain"].get(n, {})
        parts += [f"<h3>{title}</h3>" + _table([{"name": k, **v} for k, v in seen[block].items()]) for block, title in (("importance", "Importance"), ("coefficients", "Coefficients")) if block in seen]
        parts += [f"<h3>Mean prediction by {html.escape(f)}</h3>" + _table(rows) for f, rows in seen.get("partial_dependence", {}).items()]
    for pair in document["curves"]["double_lift"]:
        parts.append(f"<h2>{html.escape(pair['a'])} against {html.escape(pair['b'])}</h2>" + _table(pair["bins"]))
    if "tournament" in document:
        parts.append("<h2>Tournament</h2>" + _table(document["tournament"]))
    ladder = document["bench"]["ladder"]
    rungs = f"<p>Ladder: {html.escape(' → '.join(ladder))}</p>" if ladder else ""
    inlined = json.dumps(clean(document)).replace("</", "<\\/")
    style = "body{font:14px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:right}"
    return f'<!doctype html><meta charset="utf-8"><title>Model report</title><style>{style}</style><h1>Model report</h1>{rungs}{"".join(parts)}<script type="application/json" id="report">{inlined}</script>'
