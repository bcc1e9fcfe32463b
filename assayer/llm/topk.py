"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to a set of pivots are computed once. For a query the largest
difference to a candidate over all pivots is a lower bound of their distance, and so an
upper bound of the inner product ``(|q|^2 + |x|^2 - d^2) / 2``. A query starts from the k-th
best score among the rows of the pivots' sample and keeps its best rows from block to block
of a task: a block whose pivot intervals bound every score below that is passed over, in
the others candidates are evaluated in the order of their bounds until the bound falls
below. Bounds carry a margin for rounding, scores are exact integers.

Candidates are packed into blocks where they are read and stay there; queries come to them
in broadcasts of at most ``CHUNK`` bytes, one after the other however many there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import groups, lean, list_matrix, parallelism, rest, stored

LONG = 2**63 - 1
#: Integer inner products in doubles are exact below this.
EXACT = float(2**53)
#: Most bytes of queries in one broadcast.
CHUNK = 16 << 20


def _pack(batches: Iterable[pa.RecordBatch], pivots: dict[int, np.ndarray], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length with their distances to the pivots, as bytes."""
    held: dict[int, list[pa.RecordBatch]] = {}
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("far", pa.binary())])

    def block(dim: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        x = list_matrix(t.column("x"), dim)
        p = pivots.get(dim, np.zeros((0, dim)))
        far = np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in p], 1) if len(p) else np.zeros((len(x), 0))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32())] + [pa.array([a.tobytes()], pa.binary()) for a in (t.column("id").to_numpy(), x, far)], schema=schema)

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in map(int, np.unique(dims)):
            part = batch.filter(pa.array(dims == dim))
            for at in range(0, part.num_rows, rows):
                mine = held.setdefault(dim, [])
                mine.append(part.slice(at, rows))
                if sum(b.num_rows for b in mine) >= rows:
                    yield block(dim, held.pop(dim))
    for dim, parts in held.items():
        yield block(dim, parts)


@dataclass
class Best:
    """The best rows of each query of a block so far, and what finding them took."""

    ids: np.ndarray
    x: np.ndarray
    far: np.ndarray
    floor: np.ndarray

    def __post_init__(self) -> None:
        self.size = (self.x**2).sum(1)
        self.scores = [np.zeros(0, np.int64) for _ in self.ids]
        self.rows = [np.zeros(0, np.int64) for _ in self.ids]
        self.evaluated = np.zeros(len(self.ids), np.int64)

    def least(self, k: int) -> np.ndarray:
        """A score that k candidates are known to reach, per query."""
        return np.array([max(f, float(s[-1])) if len(s) == k else f for f, s in zip(self.floor, self.scores, strict=True)])

    def search(self, x: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int, step: int = 256) -> None:
        """Takes in a block of candidates."""
        if not len(x) or not len(self.ids):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            x2 = (x**2).sum(1)
            exact = np.abs(self.x).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < EXACT
            score = _scores if exact else _long_scores
            gap = np.maximum(self.far - far.max(0), far.min(0) - self.far).max(1, initial=0) if far.shape[1] else np.zeros(len(self.ids))
            whole = _bound(self.size, x2.max(), np.maximum(gap, 0))
            for i in np.flatnonzero(~(whole < self.least(k))):
                bound = _bound(self.size[i], x2, np.abs(far - self.far[i]).max(1, initial=0))
                best, rows, floor = self.scores[i], self.rows[i], self.floor[i]
                order = np.argsort(-bound, kind="stable")
                at, take_n = 0, step
                while at < len(order) and not bound[order[at]] < max(floor, best[-1] if len(best) == k else -np.inf):
                    take = order[at : at + take_n]
                    at, take_n = at + take_n, 2 * take_n
                    take = take[ids[take] != self.ids[i]]
                    self.evaluated[i] += len(take)
                    got = score(x[take], self.x[i])
                    if len(best) == k:
                        take, got = take[got >= best[-1]], got[got >= best[-1]]
                    best, rows = np.concatenate([best, got]), np.concatenate([rows, ids[take]])
                    keep = np.lexsort((rows, -best))[:k]
                    best, rows = best[keep], rows[keep]
                self.scores[i], self.rows[i] = best, rows


def _bound(q2: np.ndarray | float, x2: np.ndarray | float, low: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products; not a number means no bound."""
    out = (q2 + x2 - low**2) / 2 + 1e-9 * (q2 + x2 + low**2) + 0.5
    return np.where(np.isnan(out), np.inf, out)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (x @ q).astype(np.int64)


def _long_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """By Python's integers, held at the limits of a long."""
    whole = lambda v: [int(c) for c in np.nan_to_num(v)]
    right = whole(q)
    return np.array([max(-LONG, min(LONG, sum(a * b for a, b in zip(whole(r), right, strict=True)))) for r in x], np.int64)


def _search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of this task's candidates for each query, and a row without vec_id that tells how many were evaluated."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("evaluated", pa.int64())])
    matrix = lambda raw, n: np.frombuffer(raw).reshape(n, -1)
    held: dict[tuple[int, int], Best] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
            key = get("dim"), get("qb")
            if key not in held:
                q = np.frombuffer(get("q_ids"), np.int64)
                held[key] = Best(q, matrix(get("q_x"), len(q)), matrix(get("q_far"), len(q)), np.frombuffer(get("q_floor")))
            ids = np.frombuffer(get("ids"), np.int64)
            held[key].search(matrix(get("x"), len(ids)), matrix(get("far"), len(ids)), ids, k)
    for b in held.values():
        n = [len(s) for s in b.scores]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, n)), pa.array(np.concatenate(b.rows)), pa.array(np.concatenate(b.scores)), pa.nulls(sum(n), pa.int64())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(b.ids), pa.nulls(len(b.ids), pa.int64()), pa.nulls(len(b.ids), pa.int64()), pa.array(b.evaluated)], schema=schema)
    rest()


def choose_pivots(rows: list, per_dim: int) -> dict[int, np.ndarray]:
    """Farthest-first pivots for each length; which ones decides the speed, never the result."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["x"]), []).append(r["x"])
    out = {}
    for dim, xs in by.items():
        x = np.array(xs, float).reshape(-1, dim)
        far, chosen = np.full(len(x), np.inf), [0]
        while len(chosen) < min(per_dim, len(x)):
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(far.argmax()))
        out[dim] = x[chosen]
    return out


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = 24, sample: int = 512, block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per task and query the k best candidates (query_id, vec_id, score), and rows without vec_id with the number evaluated; see :func:`top_k`."""
    spark = vectors.sparkSession
    lean(spark)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("x")).filter("id is not null and size(x) > 0").filter(F.forall("x", finite))
    # above 2**52 a double is whole already, and floor() would not fit a long
    whole = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)
    rows = rows.select("id", F.transform("x", lambda c: whole(c * F.lit(float(scale)))).alias("x"))
    rows = rows.withColumn("dim", F.size("x"))
    seeds = rows.orderBy(F.xxhash64("id", "x"), "id").limit(sample).collect()
    found = choose_pivots(seeds, pivots)
    packed = stored(rows.mapInArrow(lambda it: _pack(it, found, block), "dim int, ids binary, x binary, far binary"), "candidates")
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "x"])
    n, numbers = asked.agg(F.count(F.lit(1)), F.sum(F.col("dim") + pivots + 2)).first()
    chunks = max(1, -(-8 * (numbers or 0) // CHUNK))
    blocks = chunks * max(1, -(-n // (chunks * (block // 2))))
    dealt = asked.withColumn("qb", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
    packed_q = dealt.repartition(min(blocks, parallelism(spark)), "qb").sortWithinPartitions("qb", "dim", "id")
    queries = stored(packed_q.mapInArrow(lambda it: _ask(it, found, seeds, k), "dim int, qb int, q_ids binary, q_x binary, q_far binary, q_floor binary"), "queries")
    out: DataFrame | None = None
    for c in range(chunks):
        met = packed.join(F.broadcast(queries.filter(F.col("qb") % chunks == c)), "dim")
        part = met.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long, evaluated long")
        if chunks > 1:
            part = stored(part, "found")
        out = part if out is None else out.unionByName(part)
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = 24, sample: int = 512, block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row whose id is divisible by ``every``.

    Vectors are ``floor(scale * x)``; scores are integer inner products, ties go to the
    smaller id. A row is no candidate of a query with the same id. Rows whose vector is
    null, empty, or holds null or non-finite components take no part, nor do rows without
    an id; vectors of unequal length are not compared. Repeated rows are one query but stay
    candidates each; an id with several vectors asks with each, and its results are ranked
    together. Scores beyond a long are held at its limits. Pivots come from the ``sample``
    rows with the smallest hashes. Fewer candidates than k give fewer rows; an empty table
    gives none.
    """
    best = search(vectors, k, every, scale, pivots, sample, block, id_col, vec_col).filter("vec_id is not null")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def evaluations(vectors: DataFrame, **options) -> DataFrame:
    """query_id and how many candidates were evaluated for it, of all that are no row of its own."""
    return search(vectors, **options).filter("vec_id is null").groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))


def _ask(batches: Iterable[pa.RecordBatch], pivots: dict[int, np.ndarray], seeds: list, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries, with the k-th best score that each has among the sampled rows, which are candidates too."""
    for g in groups(batches, ["qb", "dim"]):
        packed = next(_pack(g.combine_chunks().to_batches(), pivots, g.num_rows))
        dim, ids = packed.column("dim")[0].as_py(), np.frombuffer(packed.column("ids")[0].as_py(), np.int64)
        near = [r for r in seeds if len(r["x"]) == dim]
        x, own = np.array([r["x"] for r in near], float).reshape(-1, dim), np.array([r["id"] for r in near], np.int64)
        q = np.frombuffer(packed.column("x")[0].as_py()).reshape(len(ids), dim)
        floor = np.full(len(ids), -np.inf)
        if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * dim < EXACT and len(x) > k:
            scores = np.where(own[None, :] == ids[:, None], -np.inf, q @ x.T)
            floor = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
        yield pa.RecordBatch.from_arrays([packed.column("dim"), pa.array([g.column("qb")[0].as_py()], pa.int32()), *packed.columns[1:], pa.array([floor.tobytes()], pa.binary())], names=["dim", "qb", "q_ids", "q_x", "q_far", "q_floor"])
