"""What the fits of a bench say about their inputs: small tables per fold, merged into bands over the folds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from assayer.operators import explain

#: Rows of each kind that the merged attributions show.
SHOWN = 10


def _link(model) -> str | None:
    link = getattr(model, "_link", None) or getattr(getattr(model, "_family", None), "link", None)
    return getattr(link, "name", None)


def look(model, sample: DataFrame, y: str, family: str, power: float | None, grids: dict[str, list], id_col: str, weight: str | None, seed: int) -> dict:
    """One fit seen on ``sample``: importance, partial dependence on shared grids, and what the model itself offers.

    ``grids`` maps a feature to the values that all folds are asked for, so that their curves can be merged.
    """
    deviances = explain.permutation_importance(model, sample, y, family, list(grids), id_col, weight, power, seed)
    out = {
        "importance": {r["feature"]: r["importance"] for r in deviances.collect()},
        "dependence": {f: {r["value"]: r["prediction"] for r in explain.partial_dependence(model, sample, f, values).collect()} for f, values in grids.items()},
        "coefficients": explain.coefficients(model),
        "link": _link(model),
        "path": getattr(model, "path", None) or None,
        "gcv": getattr(model, "gcv_trace", None) or None,
    }
    if hasattr(model, "contributions"):
        out["attributions"] = [r.asDict() for r in explain.attributions(model, sample, id_col, SHOWN, seed).collect()]
    return out


def _spread(values: Sequence[float]) -> dict[str, float]:
    v = np.array(values, float)
    return {"mean": float(v.mean()), "std": float(v.std()), "low": float(v.min()), "high": float(v.max()), "folds": len(v)}


def _by_name(folds: list[dict[str, float]]) -> dict[str, dict]:
    """Spread of every name over the folds that have it."""
    return {n: _spread([f[n] for f in folds if n in f]) for n in dict.fromkeys(n for f in folds for n in f)}


def _attributions(folds: list[dict]) -> list[dict]:
    """Of all folds' rows the highest and the lowest predictions; every hashed row stays. Terms that a fold's model lacks are null."""
    rows = [{"fold": k, **r} for k, f in enumerate(folds) for r in f.get("attributions", [])]
    names = list(dict.fromkeys(c for r in rows for c in r))
    rows = [{c: r.get(c) for c in names} for r in rows]
    ends = {kind: sorted((r for r in rows if r["kind"] == kind), key=lambda r: sign * r["prediction"])[:SHOWN] for kind, sign in (("highest", -1), ("lowest", 1))}
    return [*ends["highest"], *ends["lowest"], *(r for r in rows if r["kind"] == "sample")]


def merged(folds: list[dict]) -> dict:
    """Bands over the folds of one model: mean, standard deviation (of the folds themselves), least and largest.

    On a log scale a coefficient has a relativity beside it. The path of penalties and the
    curves of cross validation are those of the first fold, as their grids differ by fold.
    """
    out: dict = {"importance": _by_name([f["importance"] for f in folds])}
    out["partial_dependence"] = {n: [{"value": v, **s} for v, s in _by_name([f["dependence"][n] for f in folds]).items()] for n in folds[0]["dependence"]}
    for curve in out["partial_dependence"].values():
        curve.sort(key=lambda r: (r["value"] is None, r["value"]))
    out["link"] = folds[0]["link"]
    if all(f["coefficients"] for f in folds):
        found = _by_name([f["coefficients"] for f in folds])
        if out["link"] == "log":
            found = {n: s | {"relativity": float(np.exp(s["mean"]))} for n, s in found.items()}
        out["coefficients"] = found
    shown = _attributions(folds)
    if shown:
        out["attributions"] = shown
    if folds[0]["path"]:
        out["path"] = folds[0]["path"]
    if folds[0]["gcv"]:
        out["gcv"] = {n: [{"log10_weight": a, "score": b} for a, b in sorted(seen)] for n, seen in folds[0]["gcv"].items()}
    return out
