"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). Raking scales the cells until the
shares of every source, language and topic meet their targets; a cell's weight is its
raked share over its own. Documents are then sampled by Poisson sampling: a document stays
if a hash of its id falls below its cell's probability, weight times a common factor and
at most 1, with the factor calibrated so that the expected tokens meet the budget.

Only the table of cells leaves the executors, and only behind a check of its size; a
larger one is raked as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut

MARGINS = ("source", "lang", "topic")
MAX_CELLS = 100_000


def token_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+")), F.lit(0)).cast("long")


def layout_topic(text: Column) -> Column:
    """Topic by layout, where no topic column is given: table, shout, list, brief or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table").when(t.contains("!! "), "shout").when(t.contains("\n- ") | t.contains("\n* "), "list")
        .when(F.length(t) < 600, "brief").otherwise("prose")
    )


def tempered(power: float) -> Callable[[np.ndarray], np.ndarray]:
    """Targets in proportion to a power of the shares: below 1 lifts the small ones."""
    return lambda share: share**power / (share**power).sum()


@dataclass(frozen=True)
class Plan:
    """Targets of the margins, sweeps of raking, and ``budget``, the share of tokens to keep.

    ``targets`` maps, by margin, every level (None for null) to a weight above 0; weights are scaled
    to shares over the levels that have tokens, and a level that the table has and the targets
    lack is refused. A margin without targets takes a power of its own shares. Raking ends
    after ``sweeps`` rounds, or earlier when no margin is further than ``close`` from its target.
    """

    powers: tuple[float, float, float] = (0.7, 0.8, 0.9)
    sweeps: int = 25
    budget: float = 0.75
    targets: Mapping[str, Mapping[str | None, float]] = field(default_factory=dict)
    close: float = 1e-13

    def __post_init__(self) -> None:
        if set(self.targets) - set(MARGINS):
            raise ValueError(f"targets are of {', '.join(MARGINS)}, not of {', '.join(sorted(set(self.targets) - set(MARGINS)))}")
        for m, levels in self.targets.items():
            if not all(np.isfinite(v) and v > 0 for v in levels.values()):
                raise ValueError(f"a target of {m} is not above 0; leave out the rows of levels that are not wanted")


def _refuse(margin: str, levels: Sequence) -> None:
    if levels:
        raise ValueError(f"the targets of {margin} lack {', '.join(map(str, levels[:5]))}; name every level that has tokens")


def rake(cells: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], sweeps: int, close: float = 0.0) -> np.ndarray:
    """Shares of the cells after at most ``sweeps`` rounds over the margins; ``codes[m]`` is each cell's level of margin m."""
    x = cells / cells.sum()
    for _ in range(sweeps):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, x, len(target))
            off = max(off, float(np.abs(now - target).max()))
            x = x * np.divide(target, now, out=np.zeros_like(now), where=now > 0)[code]
        if off <= close:
            break
    return x


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, s * weight) whose expected tokens are ``budget`` of all; all 1 if that cannot be reached below."""
    want, order = budget * tokens.sum(), np.argsort(-weight, kind="stable")
    t, w = tokens[order], weight[order]
    full, rest = np.concatenate(([0.0], np.cumsum(t))), np.concatenate((np.cumsum((t * w)[::-1])[::-1], [0.0]))
    for k in range(len(t)):  # the k heaviest cells are taken whole
        s = (want - full[k]) / rest[k] if rest[k] > 0 else np.inf
        if s * w[k] <= 1:
            return np.minimum(1.0, s * weight)
    return np.ones_like(weight)


def cell_table(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("tokens"))


def _rake_local(cells: DataFrame, plan: Plan) -> DataFrame:
    rows = [r for r in cells.collect() if r["tokens"] > 0]
    schema = "source string, lang string, topic string, weight double, probability double"
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    rows.sort(key=lambda r: tuple((r[m] is None, r[m] or "") for m in MARGINS))
    tokens = np.array([r["tokens"] for r in rows])
    codes, targets = [], []
    for m, power in zip(MARGINS, plan.powers, strict=True):
        levels = {v: i for i, v in enumerate(dict.fromkeys(r[m] for r in rows))}
        codes.append(np.array([levels[r[m]] for r in rows]))
        if m in plan.targets:
            _refuse(m, [v for v in levels if v not in plan.targets[m]])
            wanted = np.array([plan.targets[m][v] for v in levels], float)
            targets.append(wanted / wanted.sum())
        else:
            targets.append(tempered(power)(np.bincount(codes[-1], tokens) / tokens.sum()))
    weight = rake(tokens, codes, targets, plan.sweeps, plan.close) / (tokens / tokens.sum())
    p = calibrate(tokens, weight, plan.budget)
    return cells.sparkSession.createDataFrame([(*(r[m] for m in MARGINS), float(w), float(q)) for r, w, q in zip(rows, weight, p, strict=True)], schema)


def target_frames(x: DataFrame, plan: Plan) -> list[DataFrame]:
    """Per margin (__m, t): the target share of every level of ``x``, whose shares are in column x."""
    out = []
    for m, power in zip(MARGINS, plan.powers, strict=True):
        t = x.groupBy(m).agg((F.sum("x") ** power).alias("t"))
        if m in plan.targets:
            named = x.sparkSession.createDataFrame([(k, float(v)) for k, v in plan.targets[m].items()], "__k string, t double")
            t = t.drop("t").join(named, F.col(m).eqNullSafe(F.col("__k")), "left")
            _refuse(m, [r[0] for r in t.filter("t is null").select(m).limit(5).collect()])
        scale = t.agg(F.sum("t")).first()[0]
        out.append(cut(t.select(F.col(m).alias("__m"), (F.col("t") / scale).alias("t"))))
    return out


def _distance(x: DataFrame, m: str, target: DataFrame) -> float:
    """The largest gap between a margin of ``x`` and its target."""
    now = x.groupBy(m).agg(F.sum("x").alias("now"))
    return float(now.join(target, F.col(m).eqNullSafe(F.col("__m"))).agg(F.max(F.abs(F.col("now") - F.col("t")))).first()[0] or 0.0)


def _rake_frame(cells: DataFrame, plan: Plan, bisections: int = 60) -> DataFrame:
    """The same on a DataFrame of cells, for tables too large for the driver."""
    cells = cut(cells.filter("tokens > 0"))
    total = cells.agg(F.sum("tokens")).first()[0]
    x = cells.withColumn("x", F.col("tokens") / total)
    targets = target_frames(x, plan)
    for _ in range(plan.sweeps):
        for m, target in zip(MARGINS, targets, strict=True):
            now = x.groupBy(m).agg(F.sum("x").alias("now")).select(F.col(m).alias("__l"), "now")
            ratio = now.join(target, F.col("__l").eqNullSafe(F.col("__m"))).select("__l", (F.col("t") / F.col("now")).alias("ratio"))
            x = x.join(ratio, F.col(m).eqNullSafe(F.col("__l"))).withColumn("x", F.col("x") * F.col("ratio")).drop("__l", "ratio")
        x = cut(x)
        if max(_distance(x, m, target) for m, target in zip(MARGINS, targets, strict=True)) <= plan.close:
            break
    x = x.withColumn("weight", F.col("x") * total / F.col("tokens"))
    expected = lambda s: x.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * s))).first()[0]
    low, high = 0.0, 1.0
    while expected(high) < plan.budget * total * (1 - 1e-12) and high < 1e12:
        low, high = high, 2 * high
    for _ in range(bisections):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < plan.budget * total else (low, mid)
    return x.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


def raked_cells(docs: DataFrame, plan: Plan, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """(source, lang, topic, weight, probability), and whether the table is small."""
    cells = cell_table(docs)
    small = cells.limit(max_cells + 1).count() <= max_cells
    return (_rake_local if small else _rake_frame)(cells, plan), small


def mixed(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` with __tokens, __topic, __weight, __probability and __sampled; the columns' own names can't clash.

    A null source or language is a level of its own. A document without tokens has weight 1
    and probability 1: it costs nothing and shifts no share. The hash of the id decides, so
    repeated rows and rows without an id are sampled together.
    """
    plan = plan or Plan()
    t = docs.withColumns({"__tokens": token_count(F.col(text_col)), "__topic": topic if topic is not None else layout_topic(F.col(text_col))})
    cells, small = raked_cells(t.select("source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens")), plan, max_cells)
    cells = cells.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.col("weight").alias("__weight"), F.col("probability").alias("__probability"))
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("lang").eqNullSafe(F.col("__l")) & (F.col("__topic") == F.col("__t"))
    out = t.join(F.broadcast(cells) if small else cells, same, "left").drop("__s", "__l", "__t")
    free = F.col("__tokens") == 0
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)
    out = out.withColumn("__weight", F.when(free, 1.0).otherwise(F.col("__weight"))).withColumn("__probability", F.when(free, 1.0).otherwise(F.col("__probability")))
    return out.withColumn("__sampled", u < F.col("__probability"))


def margin_report(docs: DataFrame, plan: Plan | None = None, text_col: str = "text", topic: Column | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """(margin, level, tokens, share, target, raked, sampled): how near raking comes, and the shares expected in the sample.

    ``raked`` misses ``target`` where the sweeps end early or where no weights meet all
    margins; ``sampled`` misses ``raked`` where probabilities stop at 1. Documents without
    tokens count nowhere; a table without tokens gives no rows.
    """
    plan = plan or Plan()
    t = docs.select("source", "lang", (topic if topic is not None else layout_topic(F.col(text_col))).alias("topic"), token_count(F.col(text_col)).alias("tokens"))
    raked, _ = raked_cells(t, plan, max_cells)
    own = cell_table(t).filter("tokens > 0").select(*[F.col(m).alias(f"__{m}") for m in MARGINS], "tokens")
    same = [F.col(m).eqNullSafe(F.col(f"__{m}")) for m in MARGINS]
    cells = cut(own.join(raked, same[0] & same[1] & same[2]).drop(*[f"__{m}" for m in MARGINS]))
    total, kept = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    schema = "margin string, level string, tokens double, share double, target double, raked double, sampled double"
    if not total:
        return docs.sparkSession.createDataFrame([], schema)
    parts = []
    for m, target in zip(MARGINS, target_frames(cells.withColumn("x", F.col("tokens") / total), plan), strict=True):
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("tokens"), (F.sum("tokens") / total).alias("share"), (F.sum(F.col("tokens") * F.col("weight")) / total).alias("raked"), (F.sum(F.col("tokens") * F.col("probability")) / kept).alias("sampled"))
        parts.append(sums.join(target, F.col(m).eqNullSafe(F.col("__m"))).select(F.lit(m).alias("margin"), F.col(m).alias("level"), "tokens", "share", F.col("t").alias("target"), "raked", "sampled"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mix_report(docs: DataFrame, plan: Plan | None = None, **options) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability and sampled of every row."""
    m = mixed(docs, plan, **options)
    return m.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__weight", 6).alias("weight"), F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"))


def sample_mix(docs: DataFrame, plan: Plan | None = None, **options) -> DataFrame:
    """The sampled rows of ``docs``, all columns."""
    return mixed(docs, plan, **options).filter("__sampled").select(*docs.columns)
