"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import ship_package, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sharding import shard

    ship_package(spark)
    return shard(table(spark, sf_dir, "documents"), shards=24)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import near_dedup

    ship_package(spark)
    return near_dedup(table(spark, sf_dir, "documents"), size=3, radius=3)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secrets import find_secrets

    ship_package(spark)
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import COUNTS, quality

    ship_package(spark)
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack

    ship_package(spark)
    return pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.bpe import encode_digests

    ship_package(spark)
    return encode_digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), _pattern())


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.chat import digests, format_chats

    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(chats.unionByName(extra)))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.substring import dedup_digests

    ship_package(spark)
    return dedup_digests(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ann import nearest

    ship_package(spark)
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffix import dedup_digests

    ship_package(spark)
    return dedup_digests(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_sharding, op2_simhash, op3_secrets, op4_quality, op5_packing, op6_bpe, op7_substring, op8_ann, op9_chat, op10_suffix)}


#: Matches the control strings of chat.CONTROL; an escaped one is one character longer.
_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(role) + length(text) + len('<|turn|>') + len('<|end|>') + 3
    + length(role) - length(replace(replace(role, chr(10), ''), chr(92), ''))
    + len(regexp_extract_all(role, '</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z_]*\|>'))
    + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z_]*\|>')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def _quality_sql() -> str:
    from graphloom.llm.quality import LINE_SHARE, NGRAM_SHARE

    own = "OVER (PARTITION BY doc_id ORDER BY i)"
    grams = ", ".join("w || ' ' || " + " || ' ' || ".join(f"lead(w, {k}) {own}" for k in range(1, n)) + f" AS g{n}" for n in NGRAM_SHARE)
    again = ", ".join(f"(g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1) AS d{n}" for n in NGRAM_SHARE)
    inside = ", ".join(f"bool_or(d{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in NGRAM_SHARE)
    sums = ", ".join(f"coalesce(sum(length(w)) FILTER (WHERE c{n}), 0) AS s{n}" for n in NGRAM_SHARE)
    good = " AND ".join(f"coalesce(s{n}, 0) <= {share} * coalesce(word_chars, 0)" for n, share in NGRAM_SHARE.items())
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
    ll AS (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
    li AS (SELECT doc_id, sum(n - 1) AS dup, sum((n - 1) * length(line)) AS dup_chars, sum(n * length(line)) AS chars FROM ll GROUP BY 1),
    a AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t), w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM a),
    g AS (SELECT doc_id, i, w, {grams} FROM w), d AS (SELECT doc_id, i, w, {again} FROM g), c AS (SELECT doc_id, w, {inside} FROM d),
    s AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE c5) AS n_repeat, {sums} FROM c GROUP BY 1),
    r AS (SELECT t.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(dup_chars, 0) <= {LINE_SHARE} * coalesce(chars, 0) AND {good} AS good
      FROM t LEFT JOIN li USING (doc_id) LEFT JOIN s USING (doc_id)),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": _quality_sql().replace("\\\\", "\\"), "op9_chat": _CHAT_SQL.replace("\\\\", "\\")}
