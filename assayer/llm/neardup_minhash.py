"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

1. Document frequencies, exact. Texts are dealt to buckets of bounded size; each bucket sends
   its distinct shingles, packed in ranges of their hash, to the counts of the range and gets
   back those that more than one document has. All others have a frequency of 1.
2. Signatures. Improved consistent weighted sampling draws ``bands * rows`` samples of each
   document's shingles, weighted by count times inverse document frequency. The gamma and
   uniform variables of a shingle come from tables that its hash points into. Samples of
   ``rows`` make a band; documents that share a band are candidates. With ``unweighted``
   the same draws at equal weights give as many bands again.
3. Candidates. Equal texts are folded into one class before. In each band bucket every
   member points at the smallest, and connected components of these pointers are the
   candidate groups: every pair that shares a bucket is inside one.
4. Verification by weighted Jaccard similarity. ``d = 1 - similarity`` is a metric, so the
   distances of a group's members to its smallest member settle most pairs: those within
   1 - threshold link to it, and two members whose distances differ by more cannot link.
   Members that may still link to one that is not settled are compared with each other, in
   blocks of bounded size, except where both are in one component already. With
   ``unweighted`` the plain Jaccard distance, a metric too, is taken beside the weighted one.
5. Connected components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut, groups, lean, maybe_among, parallelism, rest, runs, small_batches, stored, with_groups
from assayer.llm.components import connected_components
from assayer.llm.words import mix, shingles

#: Bytes of text of a bucket and of a range of shingles, about.
BUCKET_BYTES, RANGE_BYTES = 8 << 20, 4 << 20
#: Most members of a part of a group that is compared with the group's smallest member.
PART_ROWS = 128
TABLE_BITS = 16
U = np.uint64


@dataclass(frozen=True)
class Weights:
    """Values of shingles: ``rare`` for all but the ``frequent`` hashes, which are sorted."""

    rare: float
    frequent: np.ndarray
    values: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rare)
        if len(self.frequent) and len(h):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            hit = self.frequent[at] == h
            out[hit] = self.values[at[hit]]
        return out


def inverse_frequency(df: np.ndarray | float, n: int) -> np.ndarray | float:
    return 1 + np.log((n + 1) / (np.asarray(df, float) + 1))


def counted(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by hash, with their counts: (text index, hash, count)."""
    doc, h = shingles(texts, size)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.concatenate((at, [len(h)])))


def pack(h: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their steps, all lowest bytes first: the upper bytes of steps are zeros, which the shuffle's compression removes."""
    return np.diff(h, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(U).reshape(-1), dtype=U)


def _ranged(batches: Iterable[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each bucket in ``2**bits`` ranges of their hash, with the number of its rows that have each."""
    for g in groups(batches, ["bucket"]):
        parts = [counted(part.column("text").to_pylist(), size)[1] for part in small_batches(g.select(["text"]).to_batches(), 4 << 20)]
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        at = runs((h >> U(64 - bits)).astype(np.int64)) if bits else np.array([0, len(h)])
        if not len(h):
            continue
        which = (h[at[:-1]] >> U(64 - bits)).astype(np.int32) if bits else np.zeros(1, np.int32)
        cuts = list(zip(at[:-1], at[1:], strict=True))
        n = n.astype(np.uint32)
        bucket = np.full(len(cuts), g.column("bucket")[0].as_py(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(bucket), pa.array([pack(h[a:b]) for a, b in cuts], pa.binary()), pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary())], names=["range", "bucket", "h", "n"])
    rest()


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket those of its shingles that more than one document has, with their document frequencies."""
    for g in groups(batches, ["range"]):
        parts = [unpack(x) for x in g.column("h").to_pylist()]
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in g.column("n").to_pylist()])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(at, n).astype(np.uint32)[at]
        ends = np.cumsum([len(x) for x in parts])
        out_h, out_n = [], []
        for x, end in zip(parts, ends, strict=True):
            own = df[end - len(x) : end]
            out_h.append(pack(x[own > 1]))
            out_n.append(own[own > 1].tobytes())
        yield pa.RecordBatch.from_arrays([g.column("bucket").combine_chunks(), pa.array(out_h, pa.binary()), pa.array(out_n, pa.binary())], names=["bucket", "h", "n"])
    rest()


class Sampler:
    """Improved consistent weighted sampling with tabled draws; the tables are the same in every process."""

    def __init__(self, rare: float, bands: int, rows: int, seed: int = 5, unweighted: bool = False) -> None:
        rng = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        self.r, self.c, self.beta = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)
        self.odd = rng.integers(0, 2**63, bands * rows, dtype=U) * U(2) + U(1)
        self.rare, self.rows, self.unweighted = rare, rows, unweighted
        self.bands = bands * (1 + unweighted)
        self.usual = self._level(np.arange(n), np.log(rare))

    def _level(self, at: np.ndarray, log_weight: np.ndarray | float) -> np.ndarray:
        """ln a of the draw, as an ordered integer in the upper 32 bits; equal for equal t only."""
        r = self.r[at]
        t = np.floor(log_weight / r + self.beta[at])
        a = self.c[at] - r * (t - self.beta[at]) - r
        return np.clip((a + 1024) * 2.0**21, 0, 2.0**32 - 1).astype(U) << U(32)

    def samples(self, doc: np.ndarray, h: np.ndarray, count: np.ndarray, w: np.ndarray, texts: int) -> np.ndarray:
        """texts x samples keys: the level of the smallest draw and bits of its shingle; ``w`` are the inverse document frequencies.

        Samples at equal weights, if any, come after the weighted ones.
        """
        out = np.full((texts, self.bands * self.rows), np.iinfo(U).max)
        if not len(h):
            return out
        odd_ones = np.flatnonzero((count > 1) | (w != self.rare))
        log_w = np.log(w[odd_ones] * count[odd_ones])
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for j, m in enumerate(self.odd):
            x = h * m
            at = (x >> U(64 - TABLE_BITS)).astype(np.int64)
            key = self.usual[at] | (x & U(0xFFFFFFFF))
            if self.unweighted:
                out[doc[starts], len(self.odd) + j] = np.minimum.reduceat(key, starts)
            if len(odd_ones):
                key[odd_ones] = self._level(at[odd_ones], log_w) | (x[odd_ones] & U(0xFFFFFFFF))
            out[doc[starts], j] = np.minimum.reduceat(key, starts)
        return out

    def band_keys(self, doc: np.ndarray, h: np.ndarray, count: np.ndarray, w: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """texts x bands keys as signed integers, and which texts have shingles."""
        s = self.samples(doc, h, count, w, texts).reshape(texts, self.bands, self.rows)
        key = np.arange(self.bands, dtype=U)[None, :].repeat(texts, 0)
        for i in range(self.rows):
            key = mix(key + s[:, :, i])
        return key.view(np.int64), np.bincount(doc, minlength=texts) > 0


SIGNED = "doc_id long, digest binary, bands array<long>, df binary"


def _signatures(texts: pa.Table, shared: pa.Table, sampler: Sampler, size: int, n: int) -> pa.Table:
    """Band keys of a bucket's texts, and the document frequencies of each one's distinct shingles in the order of their hashes."""
    names = ["doc_id", "digest", "bands", "df"]
    h = np.concatenate([np.zeros(0, U), *map(unpack, shared.column("h").to_pylist())])
    df = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in shared.column("n").to_pylist())])
    order = np.argsort(h)
    known = Weights(1.0, h[order], df[order].astype(float))
    out = [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())], names=names)]
    for batch in small_batches(texts.select(["doc_id", "digest", "text"]).to_batches(), 4 << 20):
        doc, h, count = counted(batch.column("text").to_pylist(), size)
        df = known.of(h)
        keys, live = sampler.band_keys(doc, h, count, inverse_frequency(df, n), batch.num_rows)
        ends = np.concatenate(([0], np.cumsum(np.where(live, sampler.bands, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[live].reshape(-1)))
        df, at = df.astype(np.uint32), np.searchsorted(doc, np.arange(batch.num_rows + 1))
        packed = pa.array([df[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), lists, packed], names=names))
    return pa.Table.from_batches(out)


def signatures(docs: DataFrame, size: int, bands: int, rows: int, unweighted: bool = False) -> tuple[DataFrame, int]:
    """doc_id, digest, bands and df of every row with a text, weighted by the document frequencies of all rows, and the number of texts."""
    spark = docs.sparkSession
    p = parallelism(spark)
    n, total = docs.filter("text is not null").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(p, -(-total // BUCKET_BYTES))
    bits = (max(p, -(-total // RANGE_BYTES)) - 1).bit_length()
    sampler = spark.sparkContext.broadcast(Sampler(float(inverse_frequency(1, n)), bands, rows, unweighted=unweighted))  # tables of a fixed size
    named = docs.filter("text <> ''").select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int")).repartition(p, "bucket")
    sent = dealt.sortWithinPartitions("bucket").mapInArrow(lambda it: _ranged(it, size, bits), "range int, bucket int, h binary, n binary")
    shared = sent.repartition(p, "range").sortWithinPartitions("range").mapInArrow(_shared, "bucket int, h binary, n binary")
    pairs = dealt.groupBy("bucket").cogroup(shared.groupBy("bucket"))
    return pairs.applyInArrow(lambda t, s: _signatures(t, s, sampler.value, size, n), SIGNED), n


def weighted_sets(texts: list[str | None], size: int, weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and weights of each text."""
    doc, h, count = counted(texts, size)
    w = weights.of(h) * count
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(h[a:b], w[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def counted_sets(texts: list[str], dfs: list[bytes], size: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and weights of each text, from the document frequencies of its distinct shingles."""
    doc, h, count = counted(texts, size)
    w = inverse_frequency(np.frombuffer(b"".join(dfs), np.uint32), n) * count
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(h[a:b], w[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    low = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def plain_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of the sets of shingles; 0 if either is empty."""
    return similarity((a[0], np.ones(len(a[0]))), (b[0], np.ones(len(b[0]))))


def _to_leader(batches: Iterable[pa.RecordBatch], size: int, n: int, unweighted: bool) -> Iterator[pa.RecordBatch]:
    """Distances of each member, weighted (d) and plain (e, or 1), to its group's smallest member, which comes first in each part of the group."""
    leader = None
    for batch in small_batches(batches, 4 << 20):
        sets = counted_sets(batch.column("text").to_pylist(), batch.column("df").to_pylist(), size, n)
        leads, out = (batch.column("node").to_numpy() == batch.column("comp").to_numpy()).tolist(), ([], [])
        for leads_here, s in zip(leads, sets, strict=True):
            if leads_here:
                leader = s
            out[0].append(1 - similarity(s, leader))
            out[1].append(1 - plain_similarity(s, leader) if unweighted else 1.0)
        follows = pa.array(np.logical_not(leads))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "comp", "bytes")), *(pa.array(x, pa.float64()) for x in out)], names=["node", "comp", "bytes", "d", "e"]).filter(follows)
    rest()


def links_among(nodes: np.ndarray, d: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float, e: np.ndarray | None = None, settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the members as all their links would: pairs inside one component are not compared.

    Each member in turn is compared with all that are outside its component and whose
    distance to the leader allows a link, by one pass over the shingles of the group. With
    the plain distances ``e`` the plain similarity links as well. Members flagged
    ``settled`` are in the leader's component.
    """
    n, links = len(nodes), []
    vocab, at = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
    w = np.concatenate([s[1] for s in sets])
    ends = np.concatenate(([0], np.cumsum([len(s[0]) for s in sets])))
    total = np.array([s[1].sum() for s in sets])
    many = np.diff(ends)
    comp, own = np.arange(n), np.zeros(len(vocab))
    if settled is not None and settled.any():
        comp[settled] = np.flatnonzero(settled)[0]
    for i in range(n):
        may = np.abs(d - d[i]) <= 1 - threshold + 1e-9
        if e is not None:
            may |= np.abs(e - e[i]) <= 1 - threshold + 1e-9
        open_ = (comp != comp[i]) & may
        open_[: i + 1] = False
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        mine = slice(ends[i], ends[i + 1])
        own[at[mine]] = w[mine]
        for j in others:
            if comp[j] == comp[i]:
                continue
            part = slice(ends[j], ends[j + 1])
            mine_there = own[at[part]]
            low = np.minimum(mine_there, w[part]).sum()
            links_here = low >= threshold * (total[i] + total[j] - low)
            if e is not None and not links_here:
                both = np.count_nonzero(mine_there)
                links_here = both >= threshold * (many[i] + many[j] - both)
            if links_here:
                links.append((int(nodes[i]), int(nodes[j])))
                comp[comp == comp[j]] = comp[i]
        own[at[mine]] = 0
    return links


def _verify(batches: Iterable[pa.RecordBatch], size: int, n: int, threshold: float, unweighted: bool) -> Iterator[pa.RecordBatch]:
    for g in groups(batches, ["comp", "bi", "bj"]):
        sets = counted_sets(g.column("text").to_pylist(), g.column("df").to_pylist(), size, n)
        d, e = g.column("d").to_numpy(), g.column("e").to_numpy()
        reach = 1 - threshold + 1e-9
        found = links_among(g.column("node").to_numpy(), d, sets, threshold, e if unweighted else None, (d <= reach) | (unweighted & (e <= reach)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])
    rest()


def near_duplicate_documents(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 16, rows: int = 4, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", unweighted: bool = False) -> DataFrame:
    """doc_id, class_id (the smallest id reachable by links) and kept (doc_id = class_id) for every row.

    Documents link if their texts are equal and not empty, or if the weighted Jaccard
    similarity of their shingles of ``size`` words is at least ``threshold``; a text with
    fewer words is one shingle of all its words. The more copies a text has, the less its
    shingles weigh beside the few words that a near copy changes, so in large groups the
    weighted similarity falls as the group and the table grow; with ``unweighted`` documents
    link as well if the plain Jaccard similarity of their sets of shingles is at least
    ``threshold``. Null and empty texts link with nothing,
    and wordless ones with equal texts only. Rows that repeat an id and a text are one
    document and keep a row each; an id with several texts stands for as many documents.
    Rows without an id are in no class (class_id null, kept true). Other columns are not
    carried; an empty table gives an empty table.
    """
    return _classes(docs, threshold, size, bands, rows, block_bytes, id_col, text_col, unweighted).drop("digest")


def _classes(docs: DataFrame, threshold: float, size: int, bands: int, rows: int, block_bytes: int, id_col: str, text_col: str, unweighted: bool) -> DataFrame:
    """doc_id, digest of the text (null if it is null or empty), class_id and kept."""
    spark = docs.sparkSession
    lean(spark)
    p = parallelism(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, n = signatures(base, size, bands, rows, unweighted)
    signed = stored(found.filter("doc_id is not null"), "signatures")
    live = base.filter("doc_id is not null and text <> ''").withColumn("digest", F.unhex(F.md5("text")))
    # one class of equal texts; copies are folded before the shuffle
    first = signed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("node"), "bands", "df")).alias("m")).select("digest", "m.*")
    heads = stored(first.withColumn("room", F.octet_length("df").cast("long")), "heads")
    # pointers to the smallest member of each bucket; minima are partial before the shuffle
    band = heads.select("node", F.posexplode("bands").alias("band", "key"))
    least = band.groupBy("band", "key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pointers = band.join(least, ["band", "key"]).filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    comps = connected_components(pointers).withColumnRenamed("component", "comp")
    # a group is dealt to parts by the size of its members, and its smallest member goes to each
    sized = with_groups(cut(comps.join(heads.select("node", "room"), "node")), ["comp"], [F.sum("room").alias("whole"), F.count(F.lit(1)).alias("size")])
    sized = sized.select("node", "comp", F.ceil(F.greatest(F.col("whole") / (block_bytes // 2), F.col("size") / PART_ROWS)).cast("int").alias("parts"))
    wanted = cut(sized.join(heads.select("node", F.col("digest").alias("own"), "df"), "node"))
    texts = maybe_among(live.select(F.col("doc_id").alias("node"), "text", "digest"), "node", wanted, "maybe").filter("maybe")
    grouped = texts.join(wanted, "node").filter("digest = own").withColumn("bytes", F.octet_length("text").cast("long"))
    members = stored(grouped.select("node", "comp", "parts", "digest", "text", "df", "bytes").dropDuplicates(["node", "digest"]), "candidates")
    led = ["node", "comp", "part", "text", "df", "bytes"]
    heads_of = members.filter("node = comp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*led)
    others = members.filter("node <> comp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select(*led)
    dealt = heads_of.unionByName(others).repartition(p, "comp", "part").sortWithinPartitions("comp", "part", F.col("node") != F.col("comp"), "node")
    far = stored(dealt.mapInArrow(lambda it: _to_leader(it, size, n, unweighted), "node long, comp long, bytes long, d double, e double"), "leader-distances")
    reach = 1 - threshold + 1e-9
    # a member may link with one that is not settled only if it is about as far from the leader, by a distance that links
    measures = ["d", "e"] if unweighted else ["d"]
    open_ = F.least(*(F.col(m) for m in measures), F.lit(1.0)) > reach
    near = far.filter(~open_).select(F.col("node").alias("u"), F.col("comp").alias("v"))
    far_rows = far.count()
    least_of = with_groups(far, ["comp"], [F.min(F.when(open_, F.col(m))).alias(f"least_{m}") for m in measures], far_rows)
    left = least_of.filter(F.greatest(*(F.col(m) - F.col(f"least_{m}") for m in measures), F.lit(-1.0)) >= -reach).filter("least_d is not null").select(*far.columns)
    left = with_groups(cut(left), ["comp"], [F.sum("bytes").alias("all"), F.count(F.lit(1)).alias("c")], far_rows).filter("c > 1")
    blocks = left.withColumn("nb", F.ceil(F.col("all") / block_bytes).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.select("node", "comp", "d", "e", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj")).join(members.select("node", "text", "df"), "node")
    placed = pairs.repartition(p, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "d", "node")
    inner = placed.mapInArrow(lambda it: _verify(it, size, n, threshold, unweighted), "u long, v long")
    final = connected_components(near.unionByName(inner))
    known = heads.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"))
    classed = signed.select("doc_id", "digest").join(known, "digest").select("doc_id", "digest", "class_id")
    out = base.filter("doc_id is null or text is null or text = ''").select("doc_id", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("class_id"))
    return classed.unionByName(out).select("doc_id", "digest", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 16, rows: int = 4, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", unweighted: bool = False) -> DataFrame:
    """The rows of ``docs`` that their class keeps, all columns, each id and text once.

    Rows without an id stay as they are. Only rows whose id may go, or repeats, pass through
    a shuffle.
    """
    found = _classes(docs, threshold, size, bands, rows, block_bytes, id_col, text_col, unweighted)
    key = F.col(id_col).cast("long")
    gone = cut(found.filter("not kept").select(F.col("doc_id").alias("__assayer_id"), F.col("digest").alias("__assayer_digest")).distinct())
    twice = docs.groupBy(key.alias("__assayer_id")).agg(F.count(F.lit(1)).alias("__assayer_n")).filter("__assayer_id is not null and __assayer_n > 1").select("__assayer_id")
    flagged = maybe_among(docs.withColumn("__assayer_id", key), "__assayer_id", gone.select("__assayer_id").unionByName(twice).distinct(), "__assayer_maybe")
    sure = flagged.filter("not __assayer_maybe").select(*docs.columns)
    maybe = flagged.filter("__assayer_maybe").withColumn("__assayer_digest", F.unhex(F.md5(F.col(text_col).cast("string"))))
    left = maybe.join(gone, ["__assayer_id", "__assayer_digest"], "left_anti")
    return sure.unionByName(left.dropDuplicates(["__assayer_id", "__assayer_digest"]).select(*docs.columns))
