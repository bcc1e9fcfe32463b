"""The queries of this subpackage: one per operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import html, mixing, neardup_embedding, neardup_minhash, quality, shard, topk, urlfilter, warc, wfst

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of op8: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_embedding.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_minhash.near_duplicate_documents(table(spark, sf_dir, "documents"), unweighted=True)


def op3_mixing_raked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op6_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode_documents(table(spark, sf_dir, "documents"))


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.apply_rules(table(spark, sf_dir, "pages"), rules)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_mixing_raked": op3_mixing_raked,
    "op4_warc_salvage": op4_warc_salvage,
    "op5_html_layout": op5_html_layout,
    "op6_sentencepiece_wfst": op6_sentencepiece_wfst,
    "op7_quality_nbsvm": op7_quality_nbsvm,
    "op8_url_filter": op8_url_filter,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_shard_tree": op10_shard_tree,
}

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM ok
  UNION
  SELECT l.u, r.root FROM reach r JOIN links l ON l.w = r.node
), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
n AS (SELECT u, count(*) AS c FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n.c, 0)::BIGINT AS n_links, coalesce(comp.root, v.vec_id) AS component_id, coalesce(comp.root, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.u = v.vec_id LEFT JOIN comp ON comp.node = v.vec_id
"""

#: The digest is base32 of the SHA-1: its hexadecimal digits in groups of five, two characters each.
OP4_SQL = """
WITH p AS (SELECT row_number() OVER () AS i, page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT i, page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(x, 5 * g + 1, 5))::BIGINT) AS q FROM d),
e AS (SELECT i, page_id, payload_bytes, list_reduce(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31)::INT + 1, 1)), lambda a, c: a || c) AS payload_digest FROM b),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM e)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to FROM m
"""

OP8_SQL = """
WITH rules(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT i, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT i, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (i)
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""



def _op3_sql(plan: mixing.Plan) -> str:
    """The sweeps of raking one after the other, then the factor by sums in the order of weight."""
    steps = []
    for m, power in zip(mixing.MARGINS, plan.powers, strict=True):
        steps.append(f"share_{m} AS MATERIALIZED (SELECT {m} AS k, sum(x) ** {power} AS t FROM x0 GROUP BY {m}), target_{m} AS MATERIALIZED (SELECT k, t / (SELECT sum(t) FROM share_{m}) AS t FROM share_{m})")
    n = 0
    for _ in range(plan.sweeps):
        for m in mixing.MARGINS:
            scaled = f"x * t / (sum(x) OVER (PARTITION BY {m}))"
            steps.append(f"x{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, {scaled} AS x FROM x{n} JOIN target_{m} ON {m} IS NOT DISTINCT FROM k)")
            n += 1
    return f"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')), 0) AS tokens, coalesce(text, '') AS t FROM documents
), e AS (
  SELECT *, CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '!! ') THEN 'shout' WHEN contains(t, chr(10) || '- ') OR contains(t, chr(10) || '* ') THEN 'list'
    WHEN length(t) < 600 THEN 'brief' ELSE 'prose' END AS topic FROM d
), c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM e GROUP BY ALL HAVING sum(tokens) > 0),
x0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / (SELECT sum(tokens) FROM c) AS x FROM c),
{", ".join(steps)},
w AS MATERIALIZED (SELECT source, lang, topic, tokens, x * (SELECT sum(tokens) FROM c) / tokens AS weight FROM x{n}),
s AS (SELECT weight, {plan.budget} * (sum(tokens) OVER ()) - coalesce(sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want,
  sum(tokens * weight) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT coalesce(max_by(want / rest, weight), 1e300) AS f FROM s WHERE want / rest * weight <= 1),
j AS (SELECT e.doc_id, e.source, e.lang, e.topic, e.tokens, CASE WHEN e.tokens = 0 THEN 1 ELSE weight END AS weight, CASE WHEN e.tokens = 0 THEN 1 ELSE least(1, weight * f) END AS probability
  FROM e LEFT JOIN w ON e.source IS NOT DISTINCT FROM w.source AND e.lang IS NOT DISTINCT FROM w.lang AND e.topic = w.topic, f)
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < probability AS sampled FROM j
"""


def _draw_sql(path: str, weight: int) -> str:
    return f"(-ln((('0x' || substr(md5('{path}|' || k), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370497.0) / {weight})"


def _tree_sql(regions: list[list[int]], out: str) -> tuple[str, str, str]:
    """Shard by the smallest draw at each of three levels; regions holds the shards of each rack."""
    first = lambda paths: f"list_position({(draws := '[' + ', '.join(_draw_sql(p, w) for p, w in paths) + ']')}, list_min({draws})) - 1"
    region = first([(f"r{r}", sum(racks)) for r, racks in enumerate(regions)])
    rack = "CASE " + " ".join(f"WHEN {out}_r = {r} THEN {first([(f'r{r}/k{k}', n) for k, n in enumerate(racks)])}" for r, racks in enumerate(regions)) + " END"
    cases, at = [], 0
    for r, racks in enumerate(regions):
        for k, n in enumerate(racks):
            cases.append(f"WHEN {out}_r = {r} AND {out}_k = {k} THEN {at} + {first([(f'r{r}/k{k}/s{s}', 1) for s in range(n)])}")
            at += n
    return region, rack, "CASE " + " ".join(cases) + " END"


def _op10_sql() -> str:
    old, new = _tree_sql([[4, 4], [4, 4]], "a"), _tree_sql([[4, 4], [4, 4], [1]], "b")
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(octet_length(encode(text)), 0) + 1 AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, crc),
r AS (SELECT *, {old[0]} AS a_r, {new[0]} AS b_r FROM d),
q AS (SELECT *, {old[1]} AS a_k, {new[1]} AS b_k FROM r),
p AS (SELECT *, {old[2]} AS shard, {new[2]} AS grown_shard,
  ('0x' || substr(md5(k || '|' || coalesce(text_crc32::VARCHAR, 'null') || '|' || size), 1, 13))::BIGINT % 1024 AS b FROM q)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY b, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS slot, grown_shard::INT AS grown_shard FROM p
"""


SQL: dict[str, str] = {"op10_shard_tree": _op10_sql(), "op3_mixing_raked": _op3_sql(mixing.Plan()), "op1_embedding_near_dedup": OP1_SQL, "op4_warc_salvage": OP4_SQL, "op8_url_filter": OP8_SQL, "op9_exact_top_k": OP9_SQL}
