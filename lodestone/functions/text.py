"""Text functions as Column expressions: normalising, tokenising, hashing, identifiers. No Python runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# What counts as boilerplate, in the order of removal (pattern, replacement). Only a line feed ends a line.
BOILERPLATE = (
    (r"(?s)\A---.*?---\s*", ""),
    (r"(?md)^#{1,6}\s+.*$", ""),
    (r"(?md)^\|.*\|$", ""),
    (r"(?s)```.*?```", ""),
    (r"(?md)^\s*[-*]\s*\*\*[^*]+\*\*\s*$", ""),
    (r"\n{3,}", "\n\n"),
)
# How a phrase is normalised after lowering (pattern, replacement).
PHRASE = ((r"\[\[([^\]]+)\]\]", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1"), (r"[_*#>\-\u2022]+", " "), (r"\s+", " "))
# A small stop list for content words.
STOP_WORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "is", "are", "was", "were", "be", "by", "with", "from", "as", "it", "this", "that")


def replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    """All replacements, one after the other; then trim."""
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def strip_boilerplate(text: Column) -> Column:
    """Front matter at the start, headings, table rows, fences, bold bullets and blank runs go, in that order."""
    return replaced(text, BOILERPLATE)


def normalize_phrase(text: Column) -> Column:
    """Lower case; ``[[x]]``, ``[x](y)`` and code marks that hold something unwrapped; marks and white space to one space."""
    return replaced(F.lower(text), PHRASE)


def line_feeds(text: Column) -> Column:
    """CR LF and CR to LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def alpha_tokens(text: Column) -> Column:
    """Lower-case tokens of letters only; mixed tokens are dropped, not cut."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))


def letter_runs(text: Column) -> Column:
    """Maximal runs of letters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def strip_marks(word: Column) -> Column:
    """``.,!?;:"'`` at both ends go."""
    return F.regexp_replace(word, r"""^[.,!?;:"']+|[.,!?;:"']+$""", "")


def content_words(element: Column) -> Column:
    """Lower-case words without marks at the ends and without stop words; order kept."""
    words = F.transform(F.split(F.lower(F.trim(element)), r"\s+"), strip_marks)
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression.

    ``**/`` any folders, ``**`` anything, ``*`` within a segment, ``?`` one character; a trailing slash
    takes all below; a leading slash anchors at the root, else a pattern without a slash matches in any folder.
    """
    rooted = pattern.startswith("/")
    body = pattern.strip("/") if rooted else pattern
    deep = body.endswith("/")
    body = body.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    front = "" if rooted or "/" in body else "(?:.*/)?"
    return f"^{front}{out}{'/.*' if deep else ''}$"


def strip_thinking(text: Column) -> Column:
    """``<think>`` blocks and code fence lines go."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?m)^```[a-z]*\s*$", ""))


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def pair_fingerprint(a: Column, b: Column) -> Column:
    """Order-free id of a pair of phrases."""
    return short_hash(F.array_join(F.array_sort(F.array_distinct(F.array(normalize_phrase(a), normalize_phrase(b)))), "|"))


def surface_id(phrase: Column) -> Column:
    """Fallback id of a phrase that no dictionary knows."""
    return F.concat(F.lit("surface::"), F.replace(normalize_phrase(phrase), F.lit(" "), F.lit("_")))


def canonical_node_id(ids: Column, kind: str) -> Column:
    """No ids: ``kind:unknown``; one: itself; several: sorted and joined by ``+``."""
    return F.when(F.size(ids) == 0, F.lit(f"{kind}:unknown")).otherwise(F.array_join(F.array_sort(ids), "+"))


def triplet_text(subject: Column, predicate: Column, obj: Column) -> Column:
    """Non-empty parts joined by `` | ``."""
    return F.concat_ws(" | ", *[F.when(c != "", c) for c in (subject, predicate, obj)])


def pos_of_synset(synset: Column) -> Column:
    """Part of speech of ``lemma.pos.nn``."""
    return F.element_at(F.split(synset, "[.]"), -2)


def lemma_of_synset(synset: Column) -> Column:
    return F.regexp_replace(synset, r"\.[a-z]\.\d+", "")


def synonym_pattern(words: list[str]) -> str:
    """Alternatives as one pattern; a space also matches ``_`` and ``-``."""
    return "(" + "|".join(w.replace(" ", "[ _-]") for w in words) + ")"


def dotless(id_: Column) -> Column:
    return F.translate(id_, ".", "_")


def preview(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def file_kind(path: Column) -> Column:
    """test, doc, config or source, by name: the first rule that fits; else other."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(name.rlike(r"(^test_|_test\.|\.test\.|\.spec\.)"), "test")
        .when(name.rlike(r"\.(md|rst|txt)$"), "doc")
        .when(name.rlike(r"\.(json|ya?ml|toml|ini|cfg)$"), "config")
        .when(name.rlike(r"\.(py|js|mjs|ts|lua|ps1|sh|rs|go|java|c|cpp|h)$"), "source")
        .otherwise("other")
    )


# Credential shapes of the governance gate.
SECRET_PATTERNS = {"aws": r"AKIA[0-9A-Z]{16}", "token": r"gh[pousr]_[A-Za-z0-9]{36}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "assignment": r"(?i)(password|secret|token|api_key)\s*[:=]\s*\S{8,}"}


def secret_patterns(text: Column) -> Column:
    """Names of the patterns that a text matches."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRET_PATTERNS.items()]), lambda x: x.isNotNull())
