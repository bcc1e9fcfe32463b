"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` a hash of the document id and the child's path, and the
smallest draw wins, so a child is chosen in proportion to its weight and a changed weight
moves documents only into or out of the child it belongs to. The descent has one draw per
child on the path, not one per shard.

A grown tree gets its new shard as a region of its own: no weight on an older path
changes, so the only movement is into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAW_BITS = 52


@dataclass(frozen=True)
class Tree:
    """``regions[r][k][s]`` is the weight of shard s in rack k of region r; shards are numbered in that order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def of(cls, shards: int = 16, per_rack: int = 4, racks: int = 2) -> Tree:
        """Equal weights, filled region by region."""
        if shards < 1:
            raise ValueError(f"a tree needs at least 1 shard, not {shards}")
        rack = [tuple([1.0] * min(per_rack, shards - a)) for a in range(0, shards, per_rack)]
        return cls(tuple(tuple(rack[a : a + racks]) for a in range(0, len(rack), racks)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        return Tree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _bits(text: Column) -> Column:
    """The first 52 bits of the md5 of a string."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def _draw(key: Column, path: str, weight: float) -> Column:
    """Exponential draw of rate ``weight``; the hash is the first 52 bits of md5(path|key)."""
    return -F.ln((_bits(F.concat(F.lit(f"{path}|"), key)).cast("double") + 1.0) / float(2**DRAW_BITS + 1)) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; ties go to the first child."""
    live = [(p, w, v) for p, w, v in children if w > 0]
    if not live:
        raise ValueError("every level needs a child with a positive weight")
    if len(live) == 1:
        return live[0][2]
    return F.least(*[F.struct(_draw(key, p, w).alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (p, w, v) in enumerate(live)])["v"]


def descend(df: DataFrame, doc_id: str, tree: Tree, out: str) -> DataFrame:
    """``df`` with the tree's shard of each document in ``out``: one projection per level, no shuffle."""
    key = _key(F.col(doc_id))
    total = lambda racks: sum(sum(x) for x in racks)
    region, rack = f"__{out}_region", f"__{out}_rack"
    df = df.withColumn(region, _pick(key, [(f"r{r}", total(racks), F.lit(r)) for r, racks in enumerate(tree.regions)]))
    racks_of, shard_of, at = [], [], 0
    for r, racks in enumerate(tree.regions):
        racks_of.append(_pick(key, [(f"r{r}/k{k}", sum(x), F.lit(k)) for k, x in enumerate(racks)]) if total(racks) else F.lit(0))
        for k, shards in enumerate(racks):
            if sum(shards):
                picked = _pick(key, [(f"r{r}/k{k}/s{s}", w, F.lit(at + s)) for s, w in enumerate(shards)])
                shard_of.append(((F.col(region) == r) & (F.col(rack) == k), picked))
            at += len(shards)
    df = df.withColumn(rack, reduce(lambda e, x: F.when(F.col(region) == x[0], x[1]).otherwise(e), list(enumerate(racks_of))[:-1], racks_of[-1]))
    chosen = reduce(lambda e, x: F.when(x[0], x[1]).otherwise(e), shard_of[:-1], shard_of[-1][1])
    return df.withColumn(out, chosen.cast("int")).drop(region, rack)


def numbered(df: DataFrame, shard: str, order: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Gapless numbers from 0 within each shard, without gathering a shard in one task.

    Rows go to ``buckets`` hash buckets per shard; numbers run within a bucket and start at
    the sum of the counts of the buckets before it. The table of counts has at most
    shards x buckets rows, whatever the input.
    """
    df = df.withColumn("__b", F.pmod(_bits(F.concat_ws("|", *[_key(F.col(c)) for c in order])), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(shard, "__b").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(shard, "__b", "__from")
    )
    within = F.row_number().over(Window.partitionBy(shard, "__b").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    ranked = df.withColumn("__w", within - 1)
    return ranked.join(F.broadcast(starts), [shard, "__b"]).withColumn(out, (F.col("__from") + F.col("__w")).cast("long")).drop("__b", "__w", "__from")


def shard_documents(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """Shard of every document under law ``key``: the id and the tree decide, nothing else does.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. A null text has size 1
    and a null checksum; an empty one size 1 and checksum 0. A null id is a key like any
    other. Repeated rows get the same shard and slots of their own. Equal texts under
    different ids spread over the shards, so a group of copies loads none. Other columns
    of the input are not carried. An empty table gives an empty table.
    """
    tree = tree or Tree.of()
    raw = F.encode(F.col(text_col), "UTF-8")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = descend(descend(slim, "doc_id", tree, "shard"), "doc_id", tree.grown(), "grown_shard")
    placed = numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", buckets)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
