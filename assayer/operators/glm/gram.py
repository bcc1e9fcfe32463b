"""The passes over rows: cross products, gradients and deviances at given coefficients.

A design is packed once into blocks of rows, matrices as bytes, that stay cached on the
executors: a pass moves blocks and not rows between the JVM and Python. Equal rows of a
partition are folded into one with their number, where that makes it much smaller. Each pass is one
job for any number of requests (several folds, several penalties): a partition returns its
sums for all of them, and partials are added in groups before the driver adds the last few.
No row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.family import ARRAYS, Family, Link

GROUPS = 32
#: Bytes of a packed block, about.
BLOCK = 4 << 20
#: Bytes of the blocks in an Arrow batch; the session's own bound would hold 64 MB in each Python process.
BATCH = 8 << 20
#: A partition goes on folding equal rows while no more than this share of a block is left.
FOLDED = 0.5
Fold = tuple[str, int] | None
#: What a pass is asked for: a kernel method, its argument, and the fold that the rows are outside or inside of.
Request = tuple[str, object, Fold]


class Kernel:
    """Sums of one block of rows; plain data, so it travels to the executors."""

    def __init__(self, family: Family, link: Link) -> None:
        self.family, self.link = family, link

    def mean(self, x: np.ndarray, o: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eta = x @ beta + o
        with np.errstate(over="ignore"):
            return eta, self.link.inverse(eta, ARRAYS)

    def working(self, x, y, w, o, n, beta) -> list[np.ndarray]:
        """X'WX, X'Wz and the deviance at ``beta``; at the family's starting means if it is None."""
        f, link = self.family, self.link
        if beta is None:
            mu = f.start(y, w, ARRAYS)
            eta = link.of(mu, ARRAYS)
        else:
            eta, mu = self.mean(x, o, beta)
        slope = link.slope(eta, ARRAYS)
        ww = n * w * slope**2 / f.variance(mu, ARRAYS)
        z = eta - o + (y - mu) / slope
        wx = x * ww[:, None]
        return [x.T @ wx, wx.T @ z, np.array([(n * w * f.unit_deviance(y, mu, ARRAYS)).sum()])]

    def deviances(self, x, y, w, o, n, betas) -> list[np.ndarray]:
        """Deviance at each of several coefficient vectors; infinite where a mean leaves the support."""
        out = []
        for beta in betas:
            _, mu = self.mean(x, o, beta)
            ok = np.isfinite(mu) & self.family.accepts_mu(mu, ARRAYS)
            out.append((n * w * self.family.unit_deviance(y, np.where(ok, mu, 0.5), ARRAYS)).sum() if ok.all() else np.inf)
        return [np.array(out)]

    def inference(self, x, y, w, o, n, beta) -> list[np.ndarray]:
        """X'WX, the sum of squared scores, Pearson's statistic and the deviance at ``beta``."""
        f = self.family
        eta, mu = self.mean(x, o, beta)
        slope, v = self.link.slope(eta, ARRAYS), f.variance(mu, ARRAYS)
        s = w * (y - mu) * slope / v
        sx = x * s[:, None]
        wx = x * (n * w * slope**2 / v)[:, None]
        return [x.T @ wx, sx.T @ (sx * n[:, None]), np.array([(n * w * (y - mu) ** 2 / v).sum()]), np.array([(n * w * f.unit_deviance(y, mu, ARRAYS)).sum()])]

    def weight(self, x, y, w, o, n, _) -> list[np.ndarray]:
        return [np.array([(n * w).sum()])]

    def gradient(self, x, y, w, o, n, beta) -> list[np.ndarray]:
        """Gradient of half the deviance."""
        eta, mu = self.mean(x, o, beta)
        return [-(x.T @ (n * w * (y - mu) * self.link.slope(eta, ARRAYS) / self.family.variance(mu, ARRAYS)))]


def _quiet(kernel: Kernel, what: str, rows: tuple[np.ndarray, ...], args: tuple) -> list[np.ndarray]:
    """A kernel's sums; logs of 0 that a choice then drops don't warn."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return getattr(kernel, what)(*rows, *args)


def folded(rows: np.ndarray) -> np.ndarray:
    """Each distinct row once; the numbers in the last column but one are added up.

    Rows are equal if all other columns are, bit by bit. They are sorted by a hash, and by
    their bytes if two distinct rows share one.
    """
    bits = np.ascontiguousarray(np.delete(rows, -2, axis=1)).view(np.uint64)
    key = np.zeros(len(rows), np.uint64)
    for column in bits.T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    if not (bits[first][which] == bits).all():
        _, first, which = np.unique(bits.view(f"V{8 * bits.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    out = rows[first]
    out[:, -2] = np.bincount(which, rows[:, -2])
    return out


def _block(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([rows[:, -2].sum()], pa.float64()), pa.array([rows.tobytes()], pa.binary())], names=["n", "total", "rows"])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: one matrix of design columns, target, weight, offset, number of equal rows and fold.

    Rows wait until they would fill a block and are folded then; if most are distinct, they
    go out as they are and the partition folds no more.
    """
    held: list[np.ndarray] = []
    waiting, fold = 0, True
    for rows, step in _rows(batches):
        if not fold:
            yield _block(rows)
            continue
        held.append(rows)
        waiting += len(rows)
        if waiting >= step:
            left = folded(np.concatenate(held))
            if len(left) > FOLDED * step:
                fold = False
                yield _block(left)
                held, waiting = [], 0
            else:
                held, waiting = [left], len(left)
    if held:
        yield _block(folded(np.concatenate(held)))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Matrices of rows as they come, and the rows of a whole block."""
    for batch in batches:
        width = 5 + len(batch.column("x").flatten()) // max(batch.num_rows, 1)
        step = max(1, BLOCK // (8 * width))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            flat = [part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "o", "fold")]
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield np.column_stack([x, *flat[:3], np.ones(part.num_rows), flat[3]]).astype(float), step


def _pick(rows: np.ndarray, fold: Fold, cols: list[int] | None) -> tuple[np.ndarray, ...]:
    """Design, target, weight, offset and numbers of the rows outside or inside a fold; no columns mean a constant."""
    if fold is not None:
        rows = rows[rows[:, -1] != fold[1] if fold[0] == "out" else rows[:, -1] == fold[1]]
    x = rows[:, :-5] if cols is None else rows[:, cols] if cols else np.ones((len(rows), 1))
    return x, rows[:, -5], rows[:, -4], rows[:, -3], rows[:, -2]


class Design:
    """Rows of a fit and the passes over them."""

    def __init__(self, df: DataFrame, names: list[str], kernel: Kernel) -> None:
        self.names, self.kernel = names, kernel
        self.df = df.mapInArrow(_pack, "n long, total double, rows binary").persist()
        self.n = int(self.df.agg(F.sum("total")).first()[0] or 0)
        self.partitions = self.df.rdd.getNumPartitions()

    def close(self) -> None:
        self.df.unpersist()

    def ask(self, requests: list[Request], cols: list[int] | None = None) -> list[list[np.ndarray]]:
        """Sums over the rows for each request, all in one pass; ``cols`` selects design columns, none of them a constant."""
        kernel = self.kernel
        p = (len(cols) or 1) if cols is not None else len(self.names)
        shapes = {"working": [(p, p), (p,), (1,)], "deviances": [(-1,)], "inference": [(p, p), (p, p), (1,), (1,)], "gradient": [(p,)], "weight": [(1,)]}

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] | None = None
            for n, raw in ((n, r) for b in batches for n, r in zip(b.column("n").to_pylist(), b.column("rows"), strict=True)):
                rows = np.frombuffer(raw.as_buffer()).reshape(n, -1)
                got = [a for what, arg, fold in requests for a in _quiet(kernel, what, _pick(rows, fold, cols), (arg,))]
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.astype(float).reshape(-1) for a in total]).tobytes()], pa.binary())], names=["sums"])

        def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [np.frombuffer(v) for b in batches for v in b.column("sums").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, 0).tobytes()], pa.binary())], names=["sums"])

        conf, name = self.df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(name)
        conf.set(name, str(BATCH))
        try:
            partial = self.df.mapInArrow(part, "sums binary")
            if self.partitions > GROUPS:
                partial = partial.repartition(GROUPS).mapInArrow(merge, "sums binary")
            found = [np.frombuffer(bytes(r["sums"])) for r in partial.collect()]
        finally:
            conf.set(name, before)
        if not found:
            raise ValueError("the design has no rows")
        flat, out, at = np.sum(found, 0), [], 0
        for what, arg, _ in requests:
            mine = []
            for shape in shapes[what]:
                size = len(arg) if shape == (-1,) else int(np.prod(shape))
                mine.append(flat[at : at + size].reshape(shape))
                at += size
            out.append(mine)
        return out


def design_frame(df: DataFrame, columns: list, y, w, o, fold: str | None) -> DataFrame:
    x = F.array(*[c.cast("double") for c in columns]) if columns else F.array().cast("array<double>")
    return df.select(x.alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), o.cast("double").alias("o"), (F.col(fold) if fold else F.lit(0)).cast("double").alias("fold"))
