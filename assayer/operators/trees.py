"""Boosted trees that lower a family's deviance, grown from histograms of binned features.

Rows are packed once into blocks of bin codes that stay cached on the executors. One pass a
level of a tree returns, per open node and bin, the sums of gradients, of Fisher information
and of rows; the driver holds these sums and the trees, never a row. Scores of finished
trees are folded into the blocks every few trees, so a pass walks only the newest ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.family import ARRAYS, Family, column
from assayer.functions.validate import check, finite, inputs
from assayer.operators.encoders import MAX_LEVELS

GROUPS = 32
#: Rows of a packed block, and trees after which their scores are folded into the blocks.
BLOCK, FOLD_IN = 65_536, 10
#: Gains closer than this share count as equal; the first feature and bin then win.
TIE = 1e-9


@dataclass
class Bins:
    """Codes of features: bins of a number by its quantiles, levels of a category; the last code is for missing and unseen values."""

    names: list[str]
    cuts: dict[str, list[float]]
    levels: dict[str, list[str]]

    def size(self, name: str) -> int:
        return len(self.levels[name]) + 1 if name in self.levels else len(self.cuts[name]) + 2

    def struct(self) -> Column:
        return F.struct(*[F.col(n).cast("string" if n in self.levels else "double").alias(f"f{i}") for i, n in enumerate(self.names)])

    def codes(self, rows: pa.StructArray) -> np.ndarray:
        out = np.empty((len(rows), len(self.names)), np.uint16)
        for i, (name, values) in enumerate(zip(self.names, rows.flatten(), strict=True)):
            missing = self.size(name) - 1
            if name in self.levels:
                found = pc.fill_null(pc.index_in(values, value_set=pa.array(self.levels[name], pa.string()).cast(values.type)), missing)
                out[:, i] = found.to_numpy(zero_copy_only=False)
            else:
                v = values.to_numpy(zero_copy_only=False).astype(float)
                out[:, i] = np.where(np.isnan(v), missing, np.searchsorted(self.cuts[name], v))
        return out


@dataclass
class Tree:
    """Nodes in order of creation; ``feature`` is -1 in a leaf and ``left[node]`` holds the codes that go left."""

    width: int
    feature: list[int] = field(default_factory=lambda: [-1])
    child: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    left: list[np.ndarray] = field(init=False)
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def __post_init__(self) -> None:
        self.left = [np.zeros(self.width, bool)]

    def split(self, node: int, feature: int, left: np.ndarray, values: tuple[float, float]) -> tuple[int, int]:
        new = (len(self.feature), len(self.feature) + 1)
        self.feature[node], self.child[node] = feature, new
        self.left[node][: len(left)] = left
        for v in values:
            self.feature.append(-1)
            self.child.append((0, 0))
            self.left.append(np.zeros(self.width, bool))
            self.value.append(v)
        return new

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node where each row ends."""
        feature, child, left, rows = np.array(self.feature), np.array(self.child), np.array(self.left), np.arange(len(codes))
        at = np.zeros(len(codes), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            right = (~left[at, codes[rows, np.maximum(f, 0)]]).astype(np.int64)
            at = np.where(f >= 0, child[at, right], at)
        return at

    def score(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(codes)]


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    left: np.ndarray
    sums: tuple[np.ndarray, np.ndarray]


def best_split(hist: np.ndarray, sizes: list[int], ordered: list[bool], ridge: float, min_rows: int) -> Split | None:
    """The split of most gain of one node. ``hist`` has rows of gradient, information and count over the bins of all features.

    Categories are cut in the order of their own steps, which holds the best subset; missing
    values try both sides, and where there are none they follow the larger one.
    """
    best: Split | None = None
    strength = lambda s: np.where(s[1] + ridge > 0, s[0] ** 2 / np.where(s[1] + ridge > 0, s[1] + ridge, 1), 0.0)
    at = 0
    for f, size in enumerate(sizes):
        mine, at = hist[:, at : at + size], at + size
        total, miss = mine.sum(1), mine[:, -1]
        order = np.arange(size - 1)
        if not ordered[f]:
            order = np.flatnonzero(mine[2, :-1] > 0)
            order = order[np.argsort(mine[0, order] / (mine[1, order] + ridge + 1e-12), kind="stable")]
        run = np.cumsum(mine[:, order], axis=1)
        for with_missing in (False, True) if miss[2] else (False,):
            low = run + miss[:, None] if with_missing else run
            high = total[:, None] - low
            gain = strength(low) + strength(high) - strength(total[:, None])
            gain = np.where((low[2] >= min_rows) & (high[2] >= min_rows), gain, -np.inf)
            if not len(gain):
                continue
            top = gain.max()
            k = int(np.argmax(gain >= top - TIE * abs(top))) if np.isfinite(top) else 0
            if top > max(0.0, 1e-12 * total[1]) and (best is None or top > best.gain * (1 + TIE)):
                left = np.zeros(size, bool)
                left[order[: k + 1]] = True
                left[-1] = with_missing if miss[2] else low[2, k] >= high[2, k]
                best = Split(float(top), f, left, (low[:, k], high[:, k]))
    return best


@dataclass
class BoostedTrees:
    """Gradient-boosted trees in a family's canonical link of this package, with weights, offsets and early stopping.

    A hashed share ``valid_fraction`` of the rows given to ``fit`` is held out for early
    stopping; equal rows fall on one side unless ``id_col`` tells them apart. Trees grow level
    by level to ``max_depth`` and at most ``max_leaves`` leaves, those of most gain first.
    Numbers have up to ``bins`` bins; a category has at most 2 000 levels and is refused
    beyond. Missing values and levels that fitting did not see share a bin of their own, so
    prediction never fails on them. On log and logit scales a leaf moves by at most
    ``max_step`` before the learning rate.
    """

    family: str = "poisson"
    features: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    power: float | None = None
    n_trees: int = 200
    learning_rate: float = 0.1
    max_depth: int = 5
    max_leaves: int = 31
    bins: int = 64
    min_rows: int = 20
    ridge: float = 1e-3
    max_step: float = 2.0
    early_stopping: int = 20
    valid_fraction: float = 0.2
    id_col: str | None = None
    seed: int = 0

    def fit(self, df: DataFrame, y: str, weight: str | None = None, offset: str | None = None) -> BoostedTrees:
        f = self._family = Family.of(self.family, self.power)
        names = [*self.features, *[c for c in self.categorical if c not in self.features]]
        lost = [n for n in names if n not in df.columns]
        if not names or lost:
            raise ValueError(f"the trees need features; the frame lacks {', '.join(lost) or 'none'} and has {', '.join(df.columns)}")
        if self.max_depth < 1 or self.max_leaves < 2 or self.n_trees < 1:
            raise ValueError("trees need max_depth, n_trees of at least 1 and max_leaves of at least 2")
        a, w, o = column(y), column(weight), column(offset, 0.0)
        check(df, inputs(a, None, w, f) + finite(o, "the offset"), w, least_rows=2)
        self.binning = self._bin(df, names)
        self.base = self._start(df, a, w, o)
        known = [c.cast("string") for c in (F.col(n) for n in ([self.id_col] if self.id_col else names))]
        u = F.pmod(F.xxhash64(F.lit(self.seed), *known, *([] if self.id_col else [a, w, o])), F.lit(1_000_000))
        rows = df.select(self.binning.struct().alias("x"), a.alias("y"), w.alias("w"), (o + self.base).alias("s"), (u < int(self.valid_fraction * 1e6)).cast("double").alias("v"))
        self._grow(rows)
        return self

    def _bin(self, df: DataFrame, names: list[str]) -> Bins:
        levels: dict[str, list[str]] = {}
        for n in self.categorical:
            found = df.select(F.col(n).cast("string").alias("v")).filter("v is not null").distinct().limit(MAX_LEVELS + 1).collect()
            if len(found) > MAX_LEVELS:
                raise ValueError(f"{n} has more than {MAX_LEVELS} levels; encode it by its target, or pool levels")
            levels[n] = sorted(r[0] for r in found)
        numbers = [n for n in names if n not in levels]
        cuts: dict[str, list[float]] = {}
        if numbers:
            number = lambda n: F.when(~F.isnan(column(n)), column(n))
            at = [i / self.bins for i in range(1, self.bins)]
            got = df.agg(*[F.percentile_approx(number(n), at, 10_000).alias(f"q{i}") for i, n in enumerate(numbers)]).first()
            cuts = {n: sorted(set(got[f"q{i}"] or ())) for i, n in enumerate(numbers)}
        return Bins(names, cuts, levels)

    def _start(self, df: DataFrame, a: Column, w: Column, o: Column) -> float:
        kind = self._family.link.name
        wanted = {"log": F.sum(w * a) / F.sum(w * F.exp(o)), "identity": F.sum(w * (a - o)) / F.sum(w), "logit": F.sum(w * a) / F.sum(w)}[kind]
        mean = float(df.agg(wanted).first()[0])
        if kind != "identity" and not 0 < mean < (1 if kind == "logit" else np.inf):
            raise ValueError(f"the mean of y is {mean}; trees on a {kind} scale need another one to start from")
        return mean if kind == "identity" else float(np.log(mean) if kind == "log" else np.log(mean / (1 - mean)))

    # ---- passes

    def _packed(self, rows: DataFrame) -> DataFrame:
        binning = self.binning

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
                state = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "s", "v")]).astype(float)
                yield _block(binning.codes(batch.column("x")), state)

        return rows.mapInArrow(pack, "n long, codes binary, state binary").persist()

    def _rescored(self, blocks: DataFrame, trees: list[Tree]) -> DataFrame:
        width = len(self.binning.names)

        def rescore(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, state in _blocks(batches, width):
                yield _block(codes, np.column_stack([state[:, :2], state[:, 2] + sum(t.score(codes) for t in trees), state[:, 3]]))

        return blocks.mapInArrow(rescore, "n long, codes binary, state binary").persist()

    def _sums(self, blocks: DataFrame, trees: list[Tree], tree: Tree, nodes: list[int], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Histograms of the open nodes, and deviance and weight of the fitted and the held-out rows before ``tree``."""
        f, names, sizes = self._family, self.binning.names, self._sizes
        starts, total, slot_of = np.cumsum([0, *sizes[:-1]]), sum(sizes), {n: i for i, n in enumerate(nodes)}

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist, scores = np.zeros((3, len(nodes) * total)), np.zeros(4)
            for codes, state in _blocks(batches, len(names)):
                y, w, s, v = state.T
                s = s + sum(t.score(codes) for t in trees)
                with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                    mu, slope = f.link.inverse(s, ARRAYS), f.link.slope(s, ARRAYS)
                    pull = w * slope / f.variance(mu, ARRAYS)
                    dev = w * f.unit_deviance(y, mu, ARRAYS)
                scores += [dev[v == 0].sum(), w[v == 0].sum(), dev[v == 1].sum(), w[v == 1].sum()]
                lookup = np.full(len(tree.feature), -1)
                lookup[list(slot_of)] = list(slot_of.values())
                slot = lookup[tree.leaves(codes)]
                on = (v == 0) & (slot >= 0)
                values = (-(y - mu) * pull)[on], (slope * pull)[on], None
                for i in range(len(names)):
                    cell = slot[on] * total + starts[i] + codes[on, i]
                    for j, value in enumerate(values):
                        hist[j] += np.bincount(cell, value, hist.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([hist.reshape(-1), scores]).tobytes()], pa.binary())], names=["sums"])

        def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            for raw in (v for b in batches for v in b.column("sums").to_pylist()):
                total = np.frombuffer(raw) if total is None else total + np.frombuffer(raw)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        partial = blocks.mapInArrow(part, "sums binary")
        if parts > GROUPS:
            partial = partial.repartition(GROUPS).mapInArrow(merge, "sums binary")
        flat = np.sum([np.frombuffer(bytes(r["sums"])) for r in partial.collect()], 0)
        return flat[:-4].reshape(3, len(nodes), total).transpose(1, 0, 2), flat[-4:]

    # ---- growing

    def _grow(self, rows: DataFrame) -> None:
        binning = self.binning
        self._sizes = [binning.size(n) for n in binning.names]
        self.trees: list[Tree] = []
        self.trace: list[dict] = []
        self.importance = dict.fromkeys(binning.names, 0.0)
        blocks, fresh = self._packed(rows), 0
        parts, best = blocks.rdd.getNumPartitions(), (np.inf, 0)
        try:
            while True:
                tree, gains, scores = self._tree(blocks, self.trees[fresh:], parts)
                fitted, held = (scores[i] / scores[i + 1] if scores[i + 1] > 0 else np.nan for i in (0, 2))
                self.trace.append({"trees": len(self.trees), "deviance": float(fitted), "held_out": float(held)})
                if held < best[0]:
                    best = (held, len(self.trees))
                stale = np.isfinite(held) and self.early_stopping and len(self.trees) - best[1] >= self.early_stopping
                if stale or len(self.trees) >= self.n_trees or tree is None:
                    break
                self.trees.append(tree)
                for name, g in gains:
                    self.importance[name] += g
                if len(self.trees) - fresh >= FOLD_IN:
                    old, blocks = blocks, self._rescored(blocks, self.trees[fresh:])
                    blocks.count()
                    old.unpersist()
                    fresh = len(self.trees)
        finally:
            blocks.unpersist()
        self.best_trees = best[1] if np.isfinite(best[0]) and self.early_stopping else len(self.trees)
        self.trees = self.trees[: self.best_trees]

    def _step(self, sums: np.ndarray) -> float:
        step = -sums[0] / (sums[1] + self.ridge) if sums[1] + self.ridge > 0 else 0.0
        if self._family.link.name != "identity":
            step = float(np.clip(step, -self.max_step, self.max_step))
        return float(step * self.learning_rate)

    def _tree(self, blocks: DataFrame, newest: list[Tree], parts: int) -> tuple[Tree | None, list, np.ndarray]:
        """The next tree (None if nothing gains), its gains by feature, and the scores before it."""
        tree, nodes, gains, scores, leaves = Tree(max(self._sizes)), [0], [], np.zeros(4), 1
        ordered = [n not in self.binning.levels for n in self.binning.names]
        for depth in range(self.max_depth):
            hists, found = self._sums(blocks, newest, tree, nodes, parts)
            scores = found if depth == 0 else scores
            splits = [(n, best_split(h, self._sizes, ordered, self.ridge, self.min_rows)) for n, h in zip(nodes, hists, strict=True)]
            chosen = sorted(((n, s) for n, s in splits if s is not None), key=lambda x: -x[1].gain)[: self.max_leaves - leaves]
            nodes = []
            for n, s in chosen:
                nodes += tree.split(n, s.feature, s.left, (self._step(s.sums[0]), self._step(s.sums[1])))
                gains.append((self.binning.names[s.feature], s.gain))
            leaves += len(chosen)
            tree.depth = depth + 1 if chosen else tree.depth
            if not nodes or leaves >= self.max_leaves:
                break
        return (tree if tree.depth else None), gains, scores

    # ---- prediction

    def predict(self, df: DataFrame, offset: str | None = None, out: str = "prediction") -> DataFrame:
        """``df`` with the mean in ``out``, a projection."""
        binning, trees = self.binning, self.trees

        @F.arrow_udf("double")
        def raised(x: pa.Array) -> pa.Array:
            codes = binning.codes(x)
            return pa.array(sum((t.score(codes) for t in trees), np.zeros(len(codes))))

        return df.withColumn(out, self._family.link.inverse(raised(binning.struct()) + self.base + column(offset, 0.0)))


def _block(codes: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([len(codes)], pa.int64()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (codes, state))]
    return pa.RecordBatch.from_arrays(packed, names=["n", "codes", "state"])


def _blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, codes, state in zip(batch.column("n").to_pylist(), batch.column("codes"), batch.column("state"), strict=True):
            yield np.frombuffer(codes.as_buffer(), np.uint16).reshape(n, width), np.frombuffer(state.as_buffer()).reshape(n, 4)
