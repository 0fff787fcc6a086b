"""The registered queries ``opN_<name>`` of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import table
from . import chat, decontam, html_crf, langid, mixing, quality, secrets, simhash, substring, toxicity


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source with the square root of each source's characters as target weight."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.secrets_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances to the language references and the verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def fold(parts: int) -> Column:
    """The remainder of CRC-32 of the document's id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(docs.select("doc_id", "text"), labels, fold(5) != 0)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_crf.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document when 13-word windows that an earlier document has are removed."""
    return substring.repeats_digest(substring.repeats(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, fold(4) != 2, reject=False)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "bits")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers and names, and the item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The conversation that holds the template's and other templates' control strings in its texts.
PROBE = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return chat.chat_digest(chat.format_chats(chat.events_from_turns(turns.unionByName(probe))))


OP1_SQL = """
WITH per AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars, 0.5) ELSE 0.0 END AS weight FROM per),
r AS (SELECT source, CASE WHEN chars > 0 THEN round((SELECT sum(chars) FROM w) * weight / (SELECT sum(weight) FROM w) / chars, 9) ELSE 0.0 END AS rate FROM w),
d AS (SELECT source, CAST(greatest(1, ceil(rate / 32.0)) AS INTEGER) AS draws, rate FROM r),
m AS (SELECT source, draws, rate / draws AS mean, CAST(ceil(rate / draws + 12 * sqrt(rate / draws) + 16) AS INTEGER) AS last FROM d),
s AS (
  SELECT source, draws, mean, last, k, p, CAST(floor(sum(p) OVER (PARTITION BY source ORDER BY k) * 1e12 + 0.5) AS BIGINT) AS step
  FROM (
    SELECT source, draws, mean, last, k,
      exp(-mean) * list_reduce([CAST(1.0 AS DOUBLE)] || list_transform(range(1, k + 1), lambda j: mean / j), lambda a, b: a * b) AS p
    FROM (SELECT *, unnest(range(0, last + 1)) AS k FROM m))),
u AS (
  SELECT doc_id, source, j, CAST(floor(CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 1e12) AS BIGINT) AS u
  FROM (SELECT doc_id, documents.source, unnest(range(1, draws + 1)) AS j FROM documents JOIN m ON documents.source IS NOT DISTINCT FROM m.source)),
n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source AND s.step <= u.u GROUP BY u.doc_id),
c AS (SELECT documents.*, unnest(range(1, n.n + 1)) AS copy_no FROM documents JOIN n ON documents.doc_id = n.doc_id)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no,
  CAST(floor(CAST(CAST('0x' || substr(md5('43:' || doc_id || ':' || copy_no), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 1e12) AS BIGINT) AS mix_key
FROM c
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(length('<turn:' || role || '>' || replace(replace(text, '\', '\s'), '<', '\l') || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

QUERIES = {
    "op1_poisson_mixing": op1_poisson_mixing,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
}
ORACLE_SQL = {"op1_poisson_mixing": OP1_SQL, "op10_chat_format": OP10_SQL}
