"""Triplets and their enrichment against dictionary tables ``synsets`` and ``hypernyms``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

TRIPLET = "array<struct<subject:string,predicate:string,object:string>>"


def parse_triplets(raw: DataFrame, column: str = "raw", key: str = "id") -> DataFrame:
    """Triplets of a JSON array column: subject and predicate non-empty once normalised, three keys present."""
    clean = F.regexp_replace(tx.strip_thinking(F.col(column)), r"(?s)^[^\[]*", "")
    t = raw.select(key, F.posexplode(F.from_json(clean, TRIPLET)).alias("pos", "_t")).select(key, "pos", "_t.*")
    s, p, o = (tx.normalize_phrase(F.col(c)) for c in ("subject", "predicate", "object"))
    return t.select(key, "pos", s.alias("subject"), p.alias("predicate"), o.alias("object")).where("subject <> '' AND predicate <> '' AND object IS NOT NULL")


def augment(elements: DataFrame, synsets: DataFrame, hypernyms: DataFrame, key: str = "id", column: str = "element") -> DataFrame:
    """Content words with their first sense and its first hypernym; unknown words get a surface id."""
    words = elements.select(key, F.posexplode(tx.content_words(F.col(column))).alias("place", "word"))
    first = synsets.where("sense_rank = 0").select(F.col("word").alias("_w"), "synset_id")
    above = hypernyms.where("hypernym_rank = 0").select(F.col("synset_id").alias("_s"), "hypernym_id")
    j = words.join(first, words["word"] == first["_w"], "left").join(above, F.col("synset_id") == F.col("_s"), "left")
    return j.select(key, "place", "word", F.coalesce("synset_id", tx.surface_id(F.col("word"))).alias("synset_id"), F.coalesce("hypernym_id", F.lit("")).alias("hypernym_id"))


def canonical(augmented: DataFrame, key: str = "id", kind: str = "node") -> DataFrame:
    """Canonical id and lookup text of each element, words in text order."""
    per = augmented.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "synset_id", "hypernym_id"))).alias("w"))
    chain = F.flatten(F.transform("w", lambda x: F.when(x.hypernym_id == "", F.array(x.synset_id)).otherwise(F.array(x.synset_id, x.hypernym_id))))
    return per.select(key, tx.canonical_node_id(F.transform("w", lambda x: x.synset_id), kind).alias("canonical_id"), F.array_join(F.transform(chain, tx.lemma_of_synset), " ").alias("lookup_text"))


def validate(enriched: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``problems``: names of empty columns; valid rows have none."""
    return enriched.withColumn("problems", F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in columns]), lambda x: x.isNotNull()))


def zip_rows(left: DataFrame, right: DataFrame, place: str = "pos") -> DataFrame:
    """Joins two row lists by position; a length mismatch is an error."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows against {b}")
    return left.join(right, place)


def module_edges(imports: DataFrame) -> DataFrame:
    """Edges between modules of a table ``(module, imports array)``: first path component, known modules, no self edges."""
    m = imports.select(F.col("module").alias("dst")).distinct()
    e = imports.select("module", F.explode("imports").alias("i")).select(F.col("module").alias("src"), F.substring_index("i", ".", 1).alias("dst"))
    return e.join(m, "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()
