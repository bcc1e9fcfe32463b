"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Equal vectors are folded into one class first. Each class gets a signature of ``bits``
signs in each of ``tables`` tables, and a sketch of ``SKETCH`` further signs. Classes that
share label and signature in a table meet there with their sketches alone, 32 bytes each;
those whose sketch differs from another's in no more signs than a pair at the threshold
may fetch their vectors, and every pair of them is verified by its cosine in double
precision. A pair is counted in the first table that holds both, so no pair counts twice.

Bits follow the size of the largest label so that buckets stay near ``bucket_rows``, and
the number of tables follows the bits: with angle ``a = acos(threshold)`` a pair at the
threshold shares a table with probability ``(1 - a/pi)**bits``, and tables are added until
the chance to miss it falls below ``miss``; the sketches add a tenth of that at most, by
the binomial law of the signs that differ. Larger buckets are cut into blocks and each pair
of blocks is a task of its own, so memory is bounded by two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import groups, list_matrix, parallelism, small_batches, stored
from assayer.llm.components import connected_components


#: Signs of a sketch.
SKETCH = 256
KEY = ["label", "dim", "tab", "sig"]


def plan(rows: int, threshold: float, miss: float, bucket_rows: int) -> tuple[int, int]:
    """(bits, tables) for a label of ``rows`` classes."""
    bits = min(24, max(6, math.ceil(math.log2(max(rows, 1) / bucket_rows + 1))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-share)))


def sketch_limit(threshold: float, miss: float) -> int:
    """The fewest signs such that a pair at the threshold differs in more with a chance below ``miss``."""
    p = min(max(math.acos(threshold) / math.pi, 1e-12), 1 - 1e-12)
    tail = 0.0
    for k in range(SKETCH, 0, -1):
        tail += math.exp(math.lgamma(SKETCH + 1) - math.lgamma(k + 1) - math.lgamma(SKETCH - k + 1) + k * math.log(p) + (SKETCH - k) * math.log1p(-p))
        if tail >= miss:
            return k
    return 0


def planes(dim: int, count: int, seed: int) -> np.ndarray:
    """dim x count normals, the same on every executor."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """rows x tables signatures as int32, and the packed signs of the sketches."""
    signs = x @ planes(x.shape[1], tables * bits + SKETCH, seed) >= 0
    tabled = signs[:, : tables * bits].reshape(len(x), tables, bits)
    return (tabled * (1 << np.arange(bits))).sum(2).astype(np.int32), np.packbits(signs[:, tables * bits :], axis=1)


def _sign(batches: Iterable[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Each class with its signatures and its sketch."""
    for batch in small_batches(batches, 1 << 20):
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            sigs, sketch = signatures(list_matrix(part.column("vec"), int(dim)), bits, tables, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * tables), pa.array(sigs.reshape(-1)))
            packed = pa.array([r.tobytes() for r in sketch], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, lists, packed], names=[*part.schema.names, "sigs", "sketch"])


def _batched(found: Iterable[pa.RecordBatch], many: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held: list[pa.RecordBatch] = []
    for batch in found:
        held.append(batch)
        if len(held) >= many:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _candidates(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks the classes whose sketch is near that of another."""
    kept = ["id", "h", *KEY, "block", "bi", "bj"]

    def near() -> Iterator[pa.RecordBatch]:
        for g in groups(batches, [*KEY, "bi", "bj"]):
            if g.num_rows < 2:
                continue
            raw = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(g.num_rows, -1)
            signs = np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1
            close = signs @ signs.T >= SKETCH - 2 * limit
            np.fill_diagonal(close, False)
            if g.column("bi")[0].as_py() != g.column("bj")[0].as_py():
                block = g.column("block").to_numpy()
                close &= block[:, None] != block[None, :]
            some = close.any(1)
            if some.any():
                yield from g.select(kept).filter(pa.array(some)).combine_chunks().to_batches()

    yield from _batched(near())


def _roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable in a symmetric link matrix, by repeated minima."""
    low = ids.copy()
    while True:
        spread = np.where(link, low[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(low, spread)
        if (new == low).all():
            return low
        low = new


def _verify(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per class of a pair of blocks: copies linked with it, and the root of its links there."""
    out = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def linked() -> Iterator[pa.RecordBatch]:
        for g in groups(batches, [*KEY, "bi", "bj"]):
            if g.num_rows < 2:
                continue
            ids, n, block = (g.column(c).to_numpy() for c in ("id", "n", "block"))
            x = list_matrix(g.column("vec"), int(g.column("dim")[0].as_py()))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            link = unit @ unit.T >= threshold
            np.fill_diagonal(link, False)
            if g.column("bi")[0].as_py() != g.column("bj")[0].as_py():
                link &= block[:, None] != block[None, :]
            tab = g.column("tab")[0].as_py()
            if tab and link.any():
                s = np.array(g.column("sigs").to_pylist(), np.int32)
                for t in range(tab):
                    link &= s[:, t, None] != s[None, :, t]
            some = link.any(1)
            if some.any():
                low = _roots(link, ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array((link @ n)[some].astype(np.int64)), pa.array(low[some])], schema=out)

    yield from _batched(linked())


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", miss: float = 1e-7, bucket_rows: int = 24, block_rows: int = 1024, seed: int = 17
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows link when their labels are equal and not null, their vectors have the same length
    and their cosine in double precision is at least ``threshold``. A vector that is null,
    empty, zero, or holds null or non-finite components links with nothing, and neither
    does a row without an id (its component is null, kept is false). Rows that repeat an id
    are one vertex of the graph and keep a row each. An empty table gives an empty table;
    other columns are not carried.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("vec"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda c: c != 0)
    # a vector is divided by its largest component, so that squares neither overflow nor vanish;
    # inside a lambda the largest would be sought anew for every component
    largest = F.array_max(F.transform("vec", F.abs))
    live = rows.filter(F.coalesce(ok, F.lit(False))).select("vec_id", "label", F.zip_with("vec", F.array_repeat(largest, F.size("vec")), lambda c, m: c / m + 0.0).alias("vec"), F.size("vec").alias("dim"))
    live = live.withColumn("h", F.xxhash64("vec"))
    keyed = live.groupBy("label", "h", "vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"))
    classes = stored(keyed, "vector-classes")
    largest_label = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    bits, tables = plan(largest_label, threshold, miss, bucket_rows)
    p = parallelism(spark)
    limit = sketch_limit(threshold, miss / 10)
    spread = classes.select("id", "h", "n", "label", "dim", "vec").repartition(p, "id", "label")
    signed = stored(spread.mapInArrow(lambda it: _sign(it, bits, tables, seed), "id long, h long, n long, label long, dim int, vec array<double>, sigs array<int>, sketch binary"), "vector-signatures")
    hashed = signed.select("id", "h", "label", "dim", "sketch", F.posexplode("sigs").alias("tab", "sig"))
    hot = hashed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block_rows)
    hot = hot.select(*KEY, F.ceil(F.col("m") / block_rows).cast("int").alias("nb"))
    cutup = hashed.join(hot, KEY, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    pairs = cutup.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "id", "h", *KEY, "sketch", "block", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj")
    )
    met = pairs.repartition(p, *KEY, "bi", "bj").sortWithinPartitions(*KEY, "bi", "bj")
    near = met.mapInArrow(lambda it: _candidates(it, limit), "id long, h long, label long, dim int, tab int, sig int, block int, bi int, bj int")
    # vectors travel only to buckets that hold a candidate for them; an id may have several vectors, so the hash is in the key
    fetched = stored(near, "vector-candidates").join(signed.select("id", "h", "label", "n", "vec", "sigs"), ["id", "h", "label"])
    placed = fetched.repartition(p, *KEY, "bi", "bj").sortWithinPartitions(*KEY, "bi", "bj", "id")
    links = stored(placed.mapInArrow(lambda it: _verify(it, threshold), "id long, links long, root long"), "vector-links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    known = classes.select("label", "h", "vec", "id", "n").join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("label", "h", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    members = live.join(known, ["label", "h", "vec"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
