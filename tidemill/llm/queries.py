"""The registered queries of this subpackage and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, mixing, packing, pq, quality, sharding, simhash, substring, toxicity, warc

HELD_OUT_SCORE = 0.3


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_history(_read(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(_read(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "copy", "place")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= HELD_OUT_SCORE).cast("int").alias("predicted"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash, op2_warc, op3_packing, op4_embeddings, op5_mixing, op6_sharding, op7_quality, op8_toxicity, op9_chat, op10_substring]
    return {f.__name__: f for f in found}


def _sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format('text')} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE r.n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(words, lambda x: lower(x) IN ({_sql_list(dict.fromkeys(quality.STOP_WORDS))}))) AS BIGINT) AS n_stop_words,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(f'{k} * {a} {op} {x} * {b}' for a, k, op, x, b in quality.RULES.values())} AS kept FROM f
"""

MIXING_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
r AS (SELECT source, sqrt(c) / sum(sqrt(c)) OVER () * sum(c) OVER () * 1.0 / c AS rate FROM n),
d AS (SELECT doc_id, d.source, rate, CAST(greatest(1, ceil(rate / 16.0)) AS INT) AS parts FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
j AS (SELECT *, rate / parts AS each, unnest(range(1, parts + 1)) AS part FROM d),
u AS (SELECT *, (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || part), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM j),
p AS (
  SELECT doc_id, source, part, each, u, 0 AS n, exp(-each) AS term, exp(-each) AS total FROM u
  UNION ALL
  SELECT doc_id, source, part, each, u, n + 1, term * each / (n + 1), total + term * each / (n + 1) FROM p WHERE u >= total AND n < 80),
k AS (SELECT doc_id, source, sum(n) AS n FROM (SELECT doc_id, source, part, max(n) AS n FROM p GROUP BY ALL) GROUP BY doc_id, source)
SELECT doc_id, source, CAST(copy AS INT) AS copy, md5('mix:place:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS place
FROM (SELECT doc_id, source, unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy FROM k)
"""

SHARDING_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, lpad(to_base(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT), 2), 60, '0') AS bits FROM documents),
a AS (SELECT doc_id, n_bytes, unnest(range(0, 40)) AS depth, bits FROM d),
n AS (SELECT depth, substr(bits, 1, depth) AS shard, sum(n_bytes) AS bytes, count(*) AS c FROM a GROUP BY ALL),
l AS (SELECT a.doc_id, a.n_bytes, a.depth, n.shard, n.bytes, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.depth) AS k FROM a JOIN n ON n.depth = a.depth AND n.shard = substr(a.bits, 1, a.depth) WHERE n.bytes <= {4 << 20} OR n.c = 1)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, shard, CAST(depth AS INT) AS depth, CAST(bytes AS BIGINT) AS shard_bytes FROM l WHERE k = 1
"""

CHAT_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT conv_id, place, coalesce('=' || role, '0') || chr(31) || coalesce('=' || text, '0') || chr(30) AS item, '{chat.START}' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '{chat.END}' || chr(10) AS shown FROM t),
p AS (SELECT conv_id, place, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix, max(place) OVER (PARTITION BY conv_id) AS n FROM e),
w AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_logs FROM p WHERE place = n GROUP BY prefix, n),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = w.prefix AND p.place < p.n)),
r AS (SELECT conv_id, string_agg(shown, '' ORDER BY place) AS rendered FROM e GROUP BY conv_id)
SELECT k.conv_id, CAST(n AS INT) AS n_turns, CAST(n_logs AS BIGINT) AS n_logs, rendered FROM k JOIN r USING (conv_id)
"""


def oracle_sql() -> dict[str, str]:
    """For queries that hash with XXH64, learn or write files there is no SQL; tests hold them against brute force."""
    return {"op5_mixing": MIXING_SQL, "op6_sharding": SHARDING_SQL, "op7_quality": QUALITY_SQL, "op9_chat": CHAT_SQL}
