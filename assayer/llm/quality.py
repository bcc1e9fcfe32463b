"""Quality classifier: naive Bayes support vectors.

Features are indicators of unigrams and bigrams of tokens and of runs of one to three token
shapes (case, marks, repetition), hashed to ``2**bits`` columns. Each
column is scaled by the log ratio of its smoothed counts in the two classes, and a linear
hinge-loss model is fitted to the scaled, length-normalised rows by dual coordinate
descent. A logistic map of the margin, fitted on the margins that rows get from descents
which leave them out, gives the score.

The fit runs on the driver over at most ``max_rows`` labelled rows and ``max_chars``
characters; scoring is one Arrow pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import lean, rest, small_batches
from assayer.llm.words import grams, tokens

#: Bounds of the fitted sample: rows, and characters of their texts together.
MAX_ROWS, MAX_CHARS = 4000, 9_000_000
#: Parts of the cross-fit that calibrates the score.
PARTS = 4


def features(texts: list[str | None], bits: int) -> list[np.ndarray]:
    """Distinct columns of each text."""
    doc, h, shape = tokens(texts)
    parts = [grams(doc, h, 1), grams(doc, h, 2), *(grams(doc, shape + np.uint64(n), n) for n in (1, 2, 3))]
    d, g = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    key = (d.astype(np.int64) << bits) | (g >> np.uint64(64 - bits)).astype(np.int64)
    key.sort()
    key = key[np.concatenate((key[:1] == key[:1], key[1:] != key[:-1]))]
    at = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << bits)
    cols = (key & ((1 << bits) - 1)).astype(np.int32)
    return [cols[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@dataclass(frozen=True)
class Model:
    """Margin = weights of a text's columns / sqrt(their number) + intercept; score = 1 / (1 + exp(-(a * margin + b)))."""

    bits: int
    weights: np.ndarray
    intercept: float
    a: float
    b: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margins = np.array([_margin(self.weights, self.intercept, cols) for cols in features(texts, self.bits)])
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -500, 500)))


def _margin(weights: np.ndarray, intercept: float, cols: np.ndarray) -> float:
    return float(weights[cols].sum() / np.sqrt(max(len(cols), 1)) + intercept)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log of (smoothed share of each column among the rows of class 1 / among class 0)."""
    counts = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == k] or [np.zeros(0, np.int32)]), minlength=size) + smooth for k in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Hinge-loss weights of the unscaled columns, and the intercept.

    Maximises the dual of ``|w|^2 / 2 + sum(cost * hinge)`` over one multiplier at a time,
    within its box, in a new random order each epoch; stops when no projected gradient
    exceeds 1e-3. Rows are divided by the root of their number of columns.
    """
    w, bias = np.zeros(len(scale)), 0.0
    alpha, sign = np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0)
    values = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            grad = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            projected = min(grad, 0) if alpha[i] <= 0 else max(grad, 0) if alpha[i] >= cost[i] else grad
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w * scale, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic map, by Newton steps with smoothed targets."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (t - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


def train(texts: list[str | None], y: np.ndarray, bits: int = 18, c: float = 1.0) -> Model:
    """A model of the given rows; with one class or none a constant score, the smoothed share of class 1."""
    y = np.asarray(y, int)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(bits, np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / (1 - share))))
    rows = [r.copy() for at in range(0, len(texts), 256) for r in features(texts[at : at + 256], bits)]
    weigh = lambda v: c * np.where(v == 1, len(v) / (2 * max((v == 1).sum(), 1)), len(v) / (2 * max((v == 0).sum(), 1)))

    def fit(keep: np.ndarray) -> tuple[np.ndarray, float]:
        mine = [rows[i] for i in np.flatnonzero(keep)]
        return dual_coordinate_descent(mine, log_count_ratio(mine, y[keep], 1 << bits), y[keep], weigh(y[keep]))

    # margins of rows that the descent did not see: each class is dealt round the parts
    part = np.zeros(len(y), int)
    for v in (0, 1):
        part[y == v] = np.arange((y == v).sum()) % PARTS
    margins = np.zeros(len(y))
    for k in range(PARTS):
        keep = part != k
        w, b = fit(keep if len(set(y[keep].tolist())) == 2 else np.ones(len(y), bool))
        margins[~keep] = [_margin(w, b, rows[i]) for i in np.flatnonzero(~keep)]
    a, b = logistic(margins, y)
    weights, intercept = fit(np.ones(len(y), bool))
    return Model(bits, weights, intercept, a, b)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0; rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_chars: int) -> tuple[list[str | None], np.ndarray]:
    """The labelled rows with the smallest id hashes, at most ``max_rows``; of these each whose text still fits into ``max_chars`` characters."""
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id is not null and __y in (0, 1)").groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = marks.filter(~held_out(F.col("__id"))).orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # repeated ids: one text, so that the sample keeps its bound
    got = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.max("__text").alias("__text"))
    chars = F.coalesce(F.length("__text"), F.lit(0))
    order = F.md5(F.col("__id").cast("string").cast("binary"))
    sized = got.select("__id", "__y", "__text", chars.alias("__w"), order.alias("__o"))
    lengths = sized.select("__id", "__w", "__o").orderBy("__o", "__id").collect()
    left, keep = max_chars, []
    for r in lengths:
        if r["__w"] <= left:
            left -= r["__w"]
            keep.append(r["__id"])
    if not keep:
        return [], np.zeros(0, int)
    wanted = docs.sparkSession.createDataFrame([(i,) for i in keep], f"__id {sized.schema['__id'].dataType.simpleString()}")
    out = sized.join(F.broadcast(wanted), "__id").orderBy("__o", "__id").select("__text", "__y").toPandas()
    return [t if isinstance(t, str) else None for t in out["__text"]], out["__y"].to_numpy(int)


def _score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 2 << 20):
        text = batch.column(batch.num_columns - 1)
        scores = pa.array(model.scores(text.to_pylist()), pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])
    rest()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 18, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """The model of the labelled rows that aren't held out.

    At most ``max_rows`` of them, those with the smallest id hashes, are fitted, and of these
    each whose text still fits into ``max_chars`` characters when taken in that order.
    """
    model = train(*training_rows(docs, labels, id_col, text_col, label_col, max_rows, max_chars), bits)
    rest()
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    The score is a function of the text alone. Null, empty and wordless texts have no
    features and get the score of the intercept. Repeated rows keep a row each, a null id
    stays null and counts as held out, other columns are not carried, an empty table gives
    an empty table.
    """
    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(lambda it: _score(it, sent.value), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``."""
    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            texts = batch.column(names.index(text_col)).to_pylist()
            yield batch.filter(pa.array(sent.value.scores(texts) >= threshold, pa.bool_()))
        rest()

    return docs.mapInArrow(keep, docs.schema)
