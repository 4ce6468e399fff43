"""The queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import decontamination, hmm, langid, lines, mixing, sharding, simhash, tokens, topk, warc
from gridlore.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def key_crc(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary"))


def op2_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), held_out=key_crc() % 7 == 2)


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("key"), F.lit(100)) == 0)


def op6_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.histogram(tokens.lengths(table(spark, sf_dir, "documents"), keep=()))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), held_out=key_crc() % 5 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.documents(table(spark, sf_dir, "documents"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 24, "bytes")


def queries():
    return {f.__name__: f for f in (op1_mix_sources, op2_hmm_score, op3_simhash_components, op4_decontaminate, op5_top_k, op6_token_histogram, op7_warc, op8_language_id, op9_line_dedup, op10_shard)}


_FOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_SQL = {
    "op1_mix_sources": """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
e AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS id, CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), 1, 15) AS BIGINT) AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM e GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * ss AS cap, CAST(3 * ss AS DOUBLE) / ((rank - 1) % 3 + 1) AS ratio, CAST(sum(ss) OVER () AS BIGINT) AS total FROM s),
l AS (SELECT *, CAST(total - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level FROM w WINDOW o AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT first(level ORDER BY ratio, rank) AS free FROM l WHERE ratio > level),
t AS (SELECT source, ss, rank, total, CASE WHEN ratio > level THEN weight * free ELSE CAST(cap AS DOUBLE) END AS target FROM l LEFT JOIN f ON true),
c AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h % 4096, h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin FROM e),
k AS (SELECT rid, size, rank, h, id, total, CAST(n * ss + fin AS DOUBLE) / target AS v FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1), (2)) AS r(n) WHERE size > 0 AND target > 0),
y AS (SELECT rid, count(*) AS copies FROM (SELECT rid, total, sum(size) OVER (ORDER BY v, rank, h, id ROWS UNBOUNDED PRECEDING) AS run FROM k) WHERE run <= total GROUP BY rid)
SELECT doc_id, size, ss AS source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken, CAST(coalesce(copies, 0) AS INTEGER) AS copies FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source LEFT JOIN y USING (rid)""",
    "op4_decontaminate": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOLD} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLD} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[i:i + 12] AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
gram AS (SELECT rid, p, n, w[p:p + n - 1] AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT len(g) AS n FROM win))),
met AS (SELECT rid, p, n, item FROM gram JOIN win USING (g)),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS at FROM met) GROUP BY rid),
own AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN own USING (rid)""",
    "op5_top_k": """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.rid <> c.rid WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op7_warc": """WITH p AS (SELECT row_number() OVER () AS rid, page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, rid) > 1 AS again FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f""",
}


def oracle_sql() -> dict[str, str]:
    """The others hash with functions that SQL lacks, train, or tokenize; tests hold them against brute force."""
    return dict(_SQL)
