"""Quality rules: repetition and length rules, and divergence from language references.

Base rules count words, symbols, repeated lines and repeated 3-word windows of the whole text. The
method then compares two histograms of each document, of character classes and of common words, with
the references of its corpus: per language, the sums over all documents that pass the base rules. The
common words are the ``COMMON`` most frequent ones of each language over the same documents. The
Jensen-Shannon distance (base 2, 0 to 1) to the nearest reference decides; guards leave documents whose
histograms, or the word histogram of whose language, are too thin to the base rules alone.

The text is read twice, for the common words and for the counts. The counts go to a table in the shared
folder; references are sums over that table, one row per language and bin, and are bounded by the number
of languages.

Defined results: a null or empty text has no words and fails the base rules; a null ``lang`` counts
towards no reference; without any reference (no passing document with a language) the base verdict
stands; repeated rows are judged alike and each counts; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialize, ship
from .common import slices, strings

#: Words of each language whose frequencies make the second histogram.
COMMON = 100
#: Distinct words that a task counts before it hands the counts on.
HELD = 400_000
SYMBOLS = b"#*$%&|<>"
GAPS = b" \t\n\x0b\x0c\r"
# Character classes: lower, upper, digit, sentence mark, symbol, gap, other ASCII, lower non-ASCII, upper non-ASCII, other.
N_CLASSES = 10

#: Guards: fewer characters (common words) than this, or common words in the reference of its language, and the
#: histogram has no say.
MIN_CHARS, MIN_HITS, MIN_REFERENCE = 200, 20, 1_000
#: Distances above these reject; a word histogram of few counts is noisier, so its limit rises by
#: ``WORD_NOISE`` over the root of its counts.
MAX_CHAR_JS, MAX_WORD_JS, WORD_NOISE = 0.3, 0.5, 2.0


def _class_table() -> np.ndarray:
    """Class of each code point."""
    t = np.full(0x110000, 9, dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if c < 128:
            t[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch in ".,;:!?'\"()-" else 4 if ch in "#*$%&|<>" else 5 if ch in " \t\n\x0b\x0c\r" else 6
        else:
            t[c] = 8 if ch.isupper() else 7 if ch.isalpha() else 9
    return t


_TABLE: list[np.ndarray] = []


def char_histogram(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_TABLE[0][points], minlength=N_CLASSES)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    n, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    gaps = len(raw) - len(raw.translate(None, GAPS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup = 0
    if b"\n" in raw:
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip(GAPS):
                seen.add(line)
    return len(words), len(text) - gaps, symbols, dup, repeated_words(words)


MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("char_hist", "word_bins", "word_hist")]
)


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[bytes]:
    """The most frequent lower-case words of each language over all documents that pass the base rules."""
    src = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, count in held.items():
                names = list(count)
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([count[w] for w in part], pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in slices(batches, "_text"):
            for g, t in zip(strings(batch, "lang"), strings(batch, "_text"), strict=True):
                n_words, _, _, _, n_repeat = base_counts(t)
                if n_words >= 50 and 100 * n_repeat <= 50 * n_words:
                    held.setdefault(g, Counter()).update(t.lower().encode("utf-8", "surrogatepass").split())
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    counts = src.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON)
    return sorted({bytes(r["word"]) for r in top.select("word").collect()})  # at most COMMON words a language


def measure(docs: DataFrame, common: list[bytes], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and histograms of each document (that of the words without zeros): one pass over the texts."""
    src = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    schema = src.select("_key", "_lang").schema
    for f in MEASURES:
        schema = schema.add(f)
    arrow = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3
    index = {w: i for i, w in enumerate(common)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            cols: list[list] = [[] for _ in range(8)]
            for t in strings(batch, "_text"):
                t = t or ""
                for c, x in zip(cols, base_counts(t), strict=False):
                    c.append(x)
                cols[5].append(char_histogram(t))
                got = Counter(t.lower().encode("utf-8", "surrogatepass").split())
                hits = sorted((index[w], got[w]) for w in got.keys() & index.keys())
                cols[6].append([i for i, _ in hits])
                cols[7].append([n for _, n in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, type=k) for c, k in zip(cols, arrow, strict=True)]], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def base_failed(measured: DataFrame) -> DataFrame:
    return measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(measured: DataFrame, n_words: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language, the two histograms summed over all documents that pass the base rules.

    What comes to the driver is one row per language and bin.
    """
    passing = measured.where("NOT base_failed AND _lang IS NOT NULL")
    chars = passing.select("_lang", F.lit(0).alias("h"), F.posexplode("char_hist").alias("bin", "n"))
    pair = passing.select("_lang", F.explode(F.arrays_zip("word_bins", "word_hist")).alias("x"))
    words = pair.select("_lang", F.lit(1).alias("h"), F.col("x.word_bins").cast("int").alias("bin"), F.col("x.word_hist").alias("n"))
    refs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in chars.unionByName(words).groupBy("_lang", "h", "bin").agg(F.sum("n").alias("n")).collect():
        refs.setdefault(r["_lang"], (np.zeros(N_CLASSES), np.zeros(n_words)))[r["h"]][r["bin"]] = r["n"]
    return refs


def js_distance(counts: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Least Jensen-Shannon distance (base 2) of each row of ``counts`` to a row of ``refs``; 1 for an empty row."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    best = np.ones(len(counts))
    for q in refs / np.maximum(refs.sum(axis=1, keepdims=True), 1):
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
            right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
        best = np.minimum(best, np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0))
    return best


def word_distances(bins: pa.Array, counts: pa.Array, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common words, distance) of each document; few documents at a time are unfolded."""
    size = np.asarray(bins.value_lengths()).astype(int)
    end = np.cumsum(size)
    at, n = np.asarray(bins.flatten()), np.asarray(counts.flatten())
    row = np.repeat(np.arange(len(size)), size)
    hits = np.bincount(row, weights=n, minlength=len(size))
    out = np.ones(len(size))
    if len(refs):
        step = max(1, 1_000_000 // refs.shape[1])
        for a in range(0, len(size), step):
            part = slice(end[a] - size[a], end[min(a + step, len(size)) - 1])
            dense = np.zeros((min(step, len(size) - a), refs.shape[1]))
            dense[row[part] - a, at[part]] = n[part]
            out[a : a + step] = js_distance(dense, refs)
    return hits, out


def judge(measured: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]], max_char_js: float = MAX_CHAR_JS, max_word_js: float = MAX_WORD_JS) -> DataFrame:
    """Adds ``char_js``, ``word_js`` (null below the guards) and ``kept``; the histograms go."""
    names = [f.name for f in measured.schema if f.name not in ("char_hist", "word_bins", "word_hist")]
    schema = measured.select(*names).schema.add("char_js", "double").add("word_js", "double").add("kept", "boolean")
    chars = np.array([a for a, _ in refs.values()]).reshape(-1, N_CLASSES)
    words = np.array([b for _, b in refs.values() if b.sum() >= MIN_REFERENCE])
    thin = {g for g, (_, b) in refs.items() if b.sum() < MIN_REFERENCE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731,B023
            hist = lambda n, k: np.asarray(col(n).flatten()).reshape(-1, k).astype(float)
            c = hist("char_hist", N_CLASSES)
            failed = np.asarray(col("base_failed").to_pylist(), dtype=bool)
            hits, dw = word_distances(col("word_bins"), col("word_hist"), words)
            dc = js_distance(c, chars)
            thin_c = (c.sum(axis=1) < MIN_CHARS) | (len(chars) == 0)
            thin_w = (hits < MIN_HITS) | (len(words) == 0) | np.array([g in thin for g in col("_lang").to_pylist()])
            bad = (~thin_c & (dc > max_char_js)) | (~thin_w & (dw > max_word_js + WORD_NOISE / np.sqrt(np.maximum(hits, 1))))
            yield pa.RecordBatch.from_arrays(
                [*[col(n) for n in names], pa.array(dc, mask=thin_c), pa.array(dw, mask=thin_w), pa.array(~failed & ~bad)], names=[f.name for f in schema]
            )

    return measured.mapInArrow(run, schema)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The operator: one row per document with counts, distances and the verdict ``kept``."""
    ship(docs.sparkSession)
    common = common_words(docs, text, lang)
    measured = materialize(base_failed(measure(docs, common, key, text, lang)), "quality")
    return judge(measured, references(measured, len(common))).withColumnRenamed("_key", key).drop("_lang")
