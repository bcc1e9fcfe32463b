"""URL rules by a sort-merge range join.

A rule ``host/path`` becomes the key ``reversed host labels + '/' + path``, and every URL
becomes one probe key per suffix of its host that has as many labels as some rule, in the same form. A rule then fits a URL
when its key is a prefix of one of the URL's keys, i.e. when the probe lies in the rule's
interval. Rule intervals are nested or disjoint, so one sweep over the merged sorted keys
with a stack of open rules finds the longest rule of each probe.

The sweep is cut into ranges of (key, salt). The salt splits a key that many URLs share,
and a rule whose interval crosses cuts is copied to each range that it reaches into:
at most the nesting depth at each cut, however many URLs there are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import parallelism

#: Follows every character of a key, so key + END bounds the interval of a prefix.
END = "\U0010ffff"
SALTS = 1 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _bins(batches: Iterable[pa.RecordBatch], cuts: list[tuple[str, int]], reach: bool) -> Iterator[pa.RecordBatch]:
    """Adds the range of each row; ``reach`` adds the last range that the key's interval touches."""
    for batch in batches:
        keys, salts = batch.column("key").to_pylist(), batch.column("salt").to_pylist()
        cols = [pa.array([bisect_right(cuts, x) for x in zip(keys, salts, strict=True)], pa.int32())]
        if reach:
            cols.append(pa.array([bisect_right(cuts, (k + END, -1)) for k in keys], pa.int32()))
        names = ["bin", "last"][: len(cols)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bin, key, salt, with rules (kind 0) before probes of the same key."""
    stack: list[tuple[str, str, str, int]] = []
    at = None
    out = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("copies", pa.int64()), ("length", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())])
    for batch in batches:
        got: list[list] = [[] for _ in out]
        for b, key, kind, rule, verdict, page, host, path, copies in zip(*(batch.column(c).to_pylist() for c in ("bin", "key", "kind", "rule", "verdict", "page_id", "host", "path", "copies")), strict=True):
            if b != at:
                stack, at = [], b
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict, len(rule)))
                continue
            top = stack[-1] if stack else (None, None, None, -1)
            for c, v in zip(got, (page, host, path, copies, top[3], top[1], top[2]), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, out, strict=True)], schema=out)


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Longest rule and verdict of every URL.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the
    URL's path starts with the rule's; the rule with the longest host + path wins, at equal
    lengths the longer host, then block before allow. Returns page_id, host, path, rule and
    verdict; a URL that no rule fits gets a null rule and ``default``. Null URLs and URLs
    without ``://`` have an empty host and path and get ``default``. Null ids are kept,
    repeated rows stay repeated, other columns are not carried, empty tables give empty tables.
    """
    spark = pages.sparkSession
    p = parallelism(spark)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    # a rule's path follows its host at once, as in the URL; the slash between them in a key is ours
    clean = rules.select(F.lower("host").alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.lower("verdict").alias("verdict")).filter("h is not null and verdict is not null")
    clean = clean.groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    # only suffixes with as many labels as some rule has can fit, and of a path only as much as the longest rule's
    sizes, longest = clean.agg(F.sort_array(F.collect_set(F.size(F.split("h", r"\.")))), F.max(F.length("p"))).first()
    labels = F.reverse(F.split("host", r"\."))
    fits = F.filter(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(fits, lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("/"), F.substring("path", 1, longest or 0)))
    probes = urls.select("*", F.explode_outer(suffixes).alias("key")).select(
        F.coalesce("key", F.lit("")).alias("key"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "page_id", "host", "path", "copies"
    )
    held = clean.select(
        F.concat(reversed_host(F.col("h")), F.lit("/"), F.col("p")).alias("key"), F.lit(-1).cast("long").alias("salt"), F.lit(0).alias("kind"), F.concat("h", "p").alias("rule"), "verdict",
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("copies"),
    )
    cuts = _cuts(probes, 4 * p)
    schema = probes.schema
    binned = probes.mapInArrow(lambda it: _bins(it, cuts, False), f"{_ddl(schema)}, bin int")
    reached = held.mapInArrow(lambda it: _bins(it, cuts, True), f"{_ddl(schema)}, bin int, last int")
    reached = reached.select(*schema.names, F.explode(F.sequence("bin", "last")).alias("bin"))
    merged = binned.unionByName(reached).repartition(p, "bin").sortWithinPartitions("bin", "key", "salt", "kind")
    found = merged.mapInArrow(_sweep, "page_id long, host string, path string, copies long, length int, rule string, verdict string")
    best = found.groupBy("page_id", "host", "path", "copies").agg(F.max(F.struct("length", F.length(F.split("rule", "/")[0]).alias("h"), "verdict", "rule")).alias("m"))
    whole = best.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__i"))
    return whole.drop("__i")


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def _cuts(probes: DataFrame, n: int, sample: int = 20_000) -> list[tuple[str, int]]:
    """At most n - 1 cuts, quantiles of the ``sample`` probes with the smallest hashes; they shape the ranges, never the result."""
    rows = probes.select("key", "salt").orderBy(F.xxhash64("key", "salt")).limit(sample).collect()
    keys = sorted((r.key, r.salt) for r in rows)
    picks = np.unique(np.linspace(0, len(keys), n + 1)[1:-1].astype(int)) if keys else []
    return sorted({keys[i] for i in picks if i < len(keys)})
