"""Shared folder, lineage cuts and streaming over sorted Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none (tests on one machine) a temporary folder is set; on a
    cluster that is an error, as a machine-local folder would lose data there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='assayer-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the session's bound of an Arrow batch to ``most`` bytes, as rows hold whole texts and both ends keep a batch in memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def with_groups(df: DataFrame, keys: list[str], aggs: list[Column], total: int | None = None, floor: int = 512) -> DataFrame:
    """``df`` with the aggregates of the rows that share its ``keys`` (no nulls), where one group may hold most rows.

    A group of more than ``floor`` rows and more than 1/4p of ``total`` (p shuffle
    partitions; by default the number of rows, else a bound of it) gets its one row of
    aggregates by broadcast: there are less than 4p such groups in any table. All others
    are joined on the keys. ``df`` is read more than once, so it should be stored.
    """
    p = parallelism(df.sparkSession)
    over = max(floor, (df.count() if total is None else total) // (4 * p))
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *aggs).select(*[F.col(k).alias(f"__{k}") for k in keys], "*").drop(*keys)
    found = [c for c in stats.columns if not c.startswith("__")]
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    large = cut(stats.filter(F.col("__n") > over))
    if large.isEmpty():
        return df.join(stats, same).select(*df.columns, *found)
    flagged = df.join(F.broadcast(large), same, "left")
    hot = flagged.filter("__n is not null").select(*df.columns, *found)
    cold = flagged.filter("__n is null").select(*df.columns).join(stats.filter(F.col("__n") <= over), same).select(*df.columns, *found)
    return hot.unionByName(cold)


def small_batches(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes, so that long texts don't pile up."""
    for batch in batches:
        parts = max(1, -(-batch.nbytes // limit))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rest() -> None:
    """Gives memory that a task or a fit has used back to the system: the process lives on, and the next stage counts what it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in sorted columns, and the length at the end."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate(([0] if n else [], np.flatnonzero(change) + 1, [n])).astype(np.int64)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``keys``, from batches in which such rows are adjacent.

    Keys are integers without nulls. Only the group at hand is kept, so callers bound the
    size of a group before.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        at = runs(*cols)
        for a, b in zip(at[:-1], at[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def maybe_among(df: DataFrame, key: str, wanted: DataFrame, out: str, most_bits: int = 1 << 27) -> DataFrame:
    """``df`` with a flag: false only where the key is certainly not among those of ``wanted`` (column ``key``).

    A bitmap of hashed keys, 16 bits a key and never more than ``most_bits`` (16 MB), is
    broadcast, so that rows without a partner stay out of the shuffle of the join that
    decides. With more keys than fit, more rows are flagged; the join stays right.
    """
    bits = 1 << 15
    n = wanted.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = wanted.select(place(key).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__assayer_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__assayer_map"))
    at = F.bitmap_bit_position(place(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__assayer_map"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at.bitwiseAND(F.lit(7)) + 1)
    hit = F.col(key).isNotNull() & F.coalesce(byte.bitwiseAND(mask) > 0, F.lit(False))
    return df.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col("__assayer_bucket"), "left").select(*df.columns, hit.alias(out))


def list_matrix(column: pa.Array | pa.ChunkedArray, dim: int, dtype=np.float64) -> np.ndarray:
    """A list column whose rows all have ``dim`` non-null numbers as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def parallelism(spark: SparkSession, floor: int = 1) -> int:
    """Shuffle partitions of the session, at least ``floor``."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_dir() -> str:
    """Default folder of the public tokenizer files; every operator takes the path as a parameter."""
    return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
