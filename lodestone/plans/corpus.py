"""Corpus building: paragraphs, chunks, composite documents, triplets and their enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ontology
from ..session import table
from ..sources import files
from .registry import query


@query(
    "paragraph_corpus",
    r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS par, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, len(list_filter(regexp_split_to_array(lower(par), '\s+'), lambda w: regexp_full_match(w, '\p{L}+'))) AS n FROM p)
SELECT doc_id, pos, n AS n_tokens FROM k WHERE n >= 10""",
)
def paragraph_corpus(spark, sf):
    """Paragraphs of ten or more alphabetic tokens."""
    return files.paragraphs(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.col("pos").cast("long").alias("pos"), F.size("tokens").cast("long").alias("n_tokens"))


@query(
    "composite_documents",
    "SELECT conv_id, sha256(string_agg('=== FILE: ' || turn || '-' || role || ' ===' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn)) AS content_hash, count(*) AS n_files FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY 1",
)
def composite_documents(spark, sf):
    """Files joined to one document in order, with headers; empty ones are skipped."""
    c = table(spark, sf, "conversations").select("conv_id", F.concat_ws("-", "turn", "role").alias("path"), F.col("turn").alias("place"), F.coalesce("text", F.lit("")).alias("content"))
    return files.composite(c, "conv_id").select("conv_id", F.sha2("text", 256).alias("content_hash"), F.size("files").cast("long").alias("n_files"))


@query("sentence_chunks", None)
def sentence_chunks(spark, sf):
    """Sentences gathered to chunks of over 30 tokens; the remainder of a text is dropped."""
    return files.sentence_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query("symbol_scan", "SELECT n_nationkey AS path, [n_name || '.run', 'f' || n_regionkey] AS functions, list_sort(['mod' || n_regionkey, 'net.' || n_nationkey]) AS requires FROM nation")
def symbol_scan(spark, sf):
    """Top-level functions and required modules of one Lua source a nation; an inner function is no symbol."""
    lua = F.concat(F.lit("local function f"), "n_regionkey", F.lit("(x)\n  local function inner() end\nend\nfunction "), "n_name", F.lit(".run()\nlocal a = require('mod"), "n_regionkey", F.lit("')\nrequire \"net."), "n_nationkey", F.lit('"\n'))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("path"), lua.alias("content"), "n_name", "n_regionkey")
    return files.lua_symbols(n)


@query("file_kinds", "SELECT page_id, CASE WHEN regexp_matches(url, '\\?page=') THEN 'config' WHEN regexp_matches(url, '#top$') THEN 'doc' ELSE 'other' END AS kind FROM pages")
def file_kinds(spark, sf):
    """Classification by name, first rule that fits."""
    path = F.concat(F.lit("x/"), F.when(F.col("url").rlike(r"\?page="), "a.json").when(F.col("url").rlike("#top$"), "a.md").otherwise("a.bin"))
    return table(spark, sf, "pages").select("page_id", tx.file_kind(path).alias("kind"))


@query("module_edges", "SELECT DISTINCT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")
def module_edges(spark, sf):
    """Import edges between known modules, first path component, no self edges."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("module"), F.array(F.concat("r_name", F.lit(".x")), F.concat("n_name", F.lit(".y"))).alias("imports"))
    regions = r.select(F.col("r_name").alias("module"), F.array().cast("array<string>").alias("imports"))
    return ontology.module_edges(nations.union(regions))


FIX = "SELECT * FROM (VALUES (1, '[{\"subject\":\"The Dog\",\"predicate\":\"eats\",\"object\":\"meat\"},{\"subject\":\"\",\"predicate\":\"x\",\"object\":\"y\"}]'), (2, '<think>hm</think>[{\"subject\":\"cat\",\"predicate\":\"sleeps\",\"object\":\"\"},{\"subject\":\"bird\",\"predicate\":\"flies\"}]')) AS t(id, raw)"


@query("triplet_parsing", "SELECT * FROM (VALUES (1, 0, 'the dog', 'eats', 'meat'), (2, 0, 'cat', 'sleeps', '')) AS t(id, pos, subject, predicate, object)")
def triplet_parsing(spark, sf):
    """Triplets of noisy JSON: incomplete ones are dropped, an empty object is allowed."""
    return ontology.parse_triplets(spark.sql(FIX))


@query(
    "synset_augmentation",
    """WITH w AS (SELECT n_nationkey AS id, lower(n_name) AS word FROM nation)
SELECT id, 0 AS place, word, CASE WHEN regexp_matches(word, '^[a-m]') THEN word || '.n.01' ELSE 'surface::' || replace(trim(regexp_replace(word, '[_*#>\\-•]+', ' ', 'g')), ' ', '_') END AS synset_id, CASE WHEN regexp_matches(word, '^[a-m]') THEN 'nation.n.01' ELSE '' END AS hypernym_id FROM w WHERE NOT contains(word, ' ')""",
)
def synset_augmentation(spark, sf):
    """First sense and first hypernym of content words; a surface id for unknown words."""
    n = table(spark, sf, "nation").where("NOT contains(n_name, ' ')")
    known = n.where(F.lower("n_name").rlike("^[a-m]")).select(F.lower("n_name").alias("word"))
    synsets = known.select("word", F.lit(0).alias("sense_rank"), F.concat("word", F.lit(".n.01")).alias("synset_id"))
    hyper = synsets.select("synset_id", F.lit(0).alias("hypernym_rank"), F.lit("nation.n.01").alias("hypernym_id"))
    return ontology.augment(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("element")), synsets, hyper)


@query("schema_contrast", "SELECT 'SAME' AS verdict, 0 AS n UNION ALL SELECT 'VARIES', count(DISTINCT lang) FROM documents")
def schema_contrast(spark, sf):
    """Schema by contrast: a column is SAME or VARIES over the instances."""
    d = table(spark, sf, "documents").agg(F.countDistinct("lang").alias("n"))
    return d.select(F.explode(F.array(F.struct(F.lit("SAME").alias("verdict"), F.lit(0).cast("long").alias("n")), F.struct(F.lit("VARIES").alias("verdict"), F.col("n").alias("n")))).alias("x")).select("x.*")
