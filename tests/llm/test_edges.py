"""Every operator on the same hard rows: nulls, empties, very long texts, repeats, clashing columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, decontam, html_crf, langid, mixing, quality, secrets, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(200_000))
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000))
    return [
        (1, long, "en", "a", len(long)),
        (2, long, "en", "a", len(long)),
        (3, "key " + blob, "en", "b", None),
        (4, None, None, None, None),
        (4, None, None, None, None),
        (5, "", "de", "b", 0),
        (None, "x" * 100_000, "de", "b", 0),
        (None, None, None, None, None),
    ]


OPERATORS = {
    "mixing": lambda d: mixing.mix(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "keep_one": lambda d: simhash.keep_one(d, simhash.near_duplicates(d)),
    "secrets": lambda d: secrets.secrets_digest(secrets.find_secrets(d)),
    "redaction": lambda d: secrets.redact(secrets.find_secrets(d)),
    "quality": lambda d: quality.quality(d),
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(1).alias("toxic")).where("doc_id > 1"), F.lit(True)),
    "substring": lambda d: substring.repeats(d),
    "language": lambda d: langid.identify(d, F.lit(True)),
    "leaks": lambda d: decontam.contaminated(d, d.sparkSession.createDataFrame([(1, "one two three four five six seven eight nine apples")], "item_id long, text string")),
    "clean": lambda d: decontam.clean(d, d.sparkSession.createDataFrame([(1, None), (2, "a b c d e f g h i")], "item_id long, text string")),
    "html": lambda d: html_crf.main_text(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "lang")),
    "chat": lambda d: chat.chat_digest(chat.format_chats(chat.events_from_turns(d.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("lang").alias("role"), "text", "source")))),
}
ALL = len(rows())
EXPECTED = {"simhash": ALL, "secrets": ALL, "redaction": ALL, "quality": ALL, "toxicity": ALL, "substring": ALL, "language": ALL, "clean": ALL, "html": ALL, "leaks": 0, "keep_one": 4 + 1, "chat": 6}


@pytest.fixture(scope="module")
def hard(spark):
    clash = ["fp", "FINGERPRINT", "secrets", "kept", "score", "copy_no", "removed", "bits", "share", "_key_", "n_words", "evidence"]
    d = spark.createDataFrame(rows(), DOCS)
    return d.withColumns({c: F.lit("clash") for c in clash}).repartition(3).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(hard, name):
    got = OPERATORS[name](hard).collect()
    if name in EXPECTED:
        assert len(got) == EXPECTED[name]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(hard, name):
    assert OPERATORS[name](hard.limit(0)).collect() == []


def test_long_values(hard):
    by = {r["doc_id"]: r for r in substring.repeats(hard).where("doc_id IS NOT NULL").collect()}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == by[2]["n_words"] == 200_000
    spans = {r["doc_id"]: r["spans"] for r in secrets.secrets_digest(secrets.find_secrets(hard)).collect()}
    assert spans[3] == "entropy:4:20004" and spans[1] == spans[5] == ""
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(hard).collect()}
    assert near[2] == 1 and near[5] == 4
