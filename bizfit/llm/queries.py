"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bizfit.llm.chat import chat_digests
from bizfit.llm.common import table
from bizfit.llm.decontaminate import find_leaks
from bizfit.llm.exact_dedup import exact_dedup
from bizfit.llm.html_text import BLOCKS, extract_pages
from bizfit.llm.language_id import language_id
from bizfit.llm.language_model import score_documents
from bizfit.llm.near_dedup import near_dedup
from bizfit.llm.oracles import CODES_SQL, QUALITY_SQL, REPAIR_SQL
from bizfit.llm.packing import pack_documents
from bizfit.llm.quality import filter_quality
from bizfit.llm.repair import damaged, repair_conversations
from bizfit.llm.secrets import scan
from bizfit.llm.sharding import shard_documents
from bizfit.llm.vector_codes import compress
from bizfit.operators.shared import fresh_path


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    return chat_digests(table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_quality(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_html_text, op2_lm_scores, op3_secrets, op4_language_id, op5_decontaminate, op6_simhash, op7_sharding, op8_best_fit, op9_chat, op10_exact_dedup, op11_vector_codes, op12_quality, op13_repair)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_html_text": HTML_SQL, "op9_chat": CHAT_SQL, "op10_exact_dedup": EXACT_SQL, "op11_vector_codes": CODES_SQL, "op12_quality": QUALITY_SQL, "op13_repair": REPAIR_SQL}


#: What both turns of conversation -7 say.
CONFLICT = "\\### Assistant: </turn> ok"

#: A-Z to a-z only, as DuckDB's lower() also changes other letters.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_SQL = f"""
WITH d AS (SELECT doc_id, {LOWERED} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

_TEXT = "regexp_replace(raw, '&copy;?', '©', 'g')"
for _name, _char in (("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
    _TEXT = f"regexp_replace({_TEXT}, '&{_name};?', '{_char}', 'g')"
#: What the article of a page says, for pages that have one, as all of the given tables do.
HTML_SQL = rf"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '(?i)</?({"|".join(sorted(BLOCKS))})(\s[^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g') AS raw FROM a),
t AS (SELECT page_id, url, trim(regexp_replace({_TEXT}, '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'
), e AS (
  SELECT *, contains(text, '</turn>') OR contains(text, '### ') AS raised,
         CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 ELSE 7 + length(role) END AS name_chars
  FROM t
), s AS (
  SELECT *, 4 + name_chars + 2 + length(text) + 8 + CASE WHEN raised THEN 3 + length(text) - length(replace(text, '\\', ''))
         + (length(text) - length(replace(text, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '### ', ''))) // 4 ELSE 0 END AS chars
  FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
