"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. Terms are all lower-case words, and their beginnings of 4 and 5 bytes that tell of the label. No word is cut.
2. Over the labelled training rows (at most ``MAX_LABELLED`` of each label by hash of the id: a documented bound of
   the fit, so the labels are broadcast and no text is shuffled) documents with and without the label are counted per
   term. A term's gain is its smoothed log odds ratio, less two standard errors and ``ODDS``; where positive, the term
   has a number of its own. Other words are numbered by ``BITS`` bits of a hash.
3. Document frequencies are counted over all documents. A term weighs ``(1 + ln tf) * idf * relevance``; the
   relevance of a word is ``FLOOR`` and its gain, of a beginning its gain. Vectors have length 1.
4. The labelled examples (at most ``MAX_EXAMPLES``, half of them of each label, by hash of the id: the other bound of
   the fit) are indexed. They lie in blocks of ``BLOCK``, neighbours sharing their heaviest term; beside its postings each
   term keeps its greatest weight in each block where it occurs.
5. A document's blocks are opened in the order of their upper bounds, and only the postings of opened blocks are walked,
   until the next bound is below the k-th best cosine: the k nearest are exact. Ties go to the smaller number.

The score is the vote of the neighbours, weighted by cosine and by how many labelled rows an example stands for, and
drawn to the base rate by a weight of ``SHRINK``; the neighbours are the evidence.

Defined results: null and empty texts get the base rate; without training labels every score is 0; a document with
several labels is toxic if one says so; repeated rows score alike; a null id is not in the held-out fold and never
trained on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize, ship
from .common import ranges, slices, spread_out, strings

BITS = 18
FLOOR, ODDS, ERRORS = 0.05, 1.0, 2.0
MAX_LABELLED = 20_000
MAX_EXAMPLES = 2_000
#: Texts whose votes, and words whose terms, a worker remembers; beyond, it forgets them all.
REMEMBER, WORDS = 20_000, 400_000
#: Postings (and example rows) that are searched at a time.
TOGETHER = 500_000
BLOCK, PROBE, NEIGHBOURS, SHRINK = 128, 2, 15, 0.5
EDGES = b".,;:!?*#&%$|\"'()[]<>{}-_/\\+=~`@^"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words."""
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def forms_of(word: bytes) -> tuple[bytes, ...]:
    """A word without the marks at its ends, and its beginnings, each marked by a star."""
    word = word.strip(EDGES)
    return (word, *(word[:n] + b"*" for n in (4, 5) if len(word) > n)) if word else ()


class Terms(dict):
    """Word to its term's number (-1 for marks only), remembered; ``extra`` holds the told beginnings of such words.

    A term of ``told`` (by label) has a number of its own, beyond those of hashed words.
    """

    def __init__(self, told: dict[bytes, int]):
        super().__init__()
        self.told, self.extra = told, {}

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
            self.extra.clear()
        w = word.strip(EDGES)
        got = self.told.get(w, -1)
        if got < 0 and w:
            got = crc32(w) >> (32 - BITS)
        if len(w) > 4:
            some = [self.told[f] for f in forms_of(w)[1:] if f in self.told]
            if some:
                self.extra[word] = some
        self[word] = got
        return got

    def of(self, words: Iterable[bytes]) -> tuple[list[int], list[bytes]]:
        """The words' numbers, and those words that have told beginnings."""
        ids = list(map(self.__getitem__, words))
        return ids, [w for w in words if w in self.extra] if self.extra else []


def document_frequencies(src: DataFrame, told: dict[bytes, int]) -> np.ndarray:
    """In how many rows of the column ``_text`` each term occurs; a row per term reaches the driver."""
    shared = src.sparkSession.sparkContext.broadcast(told)  # bounded by the labelled rows
    size = (1 << BITS) + len(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Terms(shared.value), np.zeros(size, dtype=np.int64)
        for batch in slices(batches, "_text"):
            found: list[int] = []
            for t in strings(batch, "_text"):
                ids, rich = known.of(set(words_of(t)))
                some = set(ids).union(*(known.extra[w] for w in rich))
                some.discard(-1)
                found += some
            total += np.bincount(np.array(found, dtype=np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    got = src.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[np.asarray(got.column("term").combine_chunks())] = np.asarray(got.column("n").combine_chunks())
    return out


def term_counts(labelled: DataFrame) -> DataFrame:
    """``(term, n1, n0)``: documents with the term, by label. Input ``(_text, _toxic)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        forms: dict[bytes, tuple[bytes, ...]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            names = list(held[0].keys() | held[1].keys())
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([held[1][t] for t in part], pa.int64()), pa.array([held[0][t] for t in part], pa.int64())], names=["term", "n1", "n0"]
                )
            held[0].clear()
            held[1].clear()

        for batch in slices(batches, "_text"):
            for t, y in zip(strings(batch, "_text"), strings(batch, "_toxic"), strict=True):
                words = set(words_of(t))
                if len(forms) > WORDS:
                    forms.clear()
                forms.update((w, forms_of(w)) for w in words if w not in forms)
                held[1 if y else 0].update(set().union(*map(forms.__getitem__, words)))
            if len(held[0]) + len(held[1]) > 400_000:
                yield from out()
        yield from out()

    return labelled.mapInArrow(run, "term binary, n1 bigint, n0 bigint").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def gains(labelled: DataFrame, n1: int, n0: int) -> dict[bytes, float]:
    """Terms that tell of the label, and how much: all of them; the labelled rows bound their number."""
    if not n1 or not n0:
        return {}
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    gain = F.round(odds - ERRORS * F.sqrt(1 / a + 1 / b) - ODDS, 9)
    return {bytes(r["term"]): r["gain"] for r in term_counts(labelled).select("term", gain.alias("gain")).where("gain > 0").orderBy("term").collect()}


class BlockMaxIndex:
    """Postings by term and block of examples. ``entry`` is a (term, block) with its postings and their greatest weight.

    ``labels`` are 0 or 1, ``stands`` says how many labelled rows an example stands for, ``weight`` is idf by relevance.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list, weight: np.ndarray, base: float, stands: list[float] | None = None):
        self.weight, self.base, self.visited = weight, base, 0
        heavy = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heavy[i], labels[i], i))
        self.number = np.array(order, dtype=np.int64)  # of the example in each row of the blocks
        self.labels, self.stands, self.ids = np.array(labels, dtype=float), np.array(stands or [1.0] * len(labels)), ids
        self.blocks = -(-len(order) // BLOCK)
        parts = [vectors[i] for i in order]
        rows = np.concatenate([np.full(len(t), i) for i, (t, _) in enumerate(parts)]) if parts else np.empty(0, np.int64)
        cols = np.concatenate([t for t, _ in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        w = np.concatenate([x for _, x in parts]) if parts else np.empty(0)
        by = np.lexsort((rows, cols))
        rows, cols, self.w = rows[by], cols[by], w[by]
        self.rows = rows.astype(np.int32)
        key = cols * max(1, self.blocks) + rows // BLOCK
        self.start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.block = (key[self.start] % max(1, self.blocks)).astype(np.int32)
        self.top = np.maximum.reduceat(self.w, self.start) if len(key) else np.empty(0)
        self.entry = np.searchsorted(cols[self.start], np.arange(len(weight) + 1)).astype(np.int32)
        self.start = np.append(self.start, len(key))

    def weigh(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.weight[terms]
        length = np.sqrt((w * w).sum())
        return w / length if length else w

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest positive cosine: (example numbers, cosines)."""
        return self.nearest_all([(terms, w)], k)[0]

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for several vectors; those of at most ``TOGETHER`` postings (or one) are searched together."""
        cost = np.cumsum([int((self.start[self.entry[t + 1]] - self.start[self.entry[t]]).sum()) + len(self.labels) for t, _ in vectors])
        out, at = [], 0
        while at < len(vectors):
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + TOGETHER, "right")))
            out += self._search(vectors[at:end], k)
            at = end
        return out

    def _search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        m, n, blocks = len(vectors), len(self.labels), self.blocks
        got = np.zeros((m, n))
        if n:
            terms, w = np.concatenate([t for t, _ in vectors]), np.concatenate([x for _, x in vectors])
            a, z = self.entry[terms], self.entry[terms + 1]
            entry, share = ranges(a, z), np.repeat(w, z - a)
            whose = np.repeat(np.repeat(np.arange(m), [len(t) for t, _ in vectors]), z - a)
            cell = whose * blocks + self.block[entry]
            bound = np.bincount(cell, self.top[entry] * share, minlength=m * blocks).reshape(m, blocks)
            rank = np.empty((m, blocks), dtype=np.int64)
            np.put_along_axis(rank, np.argsort(-bound, axis=1, kind="stable"), np.arange(blocks)[None], axis=1)
            bar, at, step = np.full(m, 1e-15), 0, PROBE
            while at < blocks:
                open_ = (rank >= at) & (rank < at + step) & (bound >= bar[:, None])
                mine = np.flatnonzero(open_.ravel()[cell])
                if not len(mine):
                    break  # every bound that is left is below its bar
                first, last = self.start[entry[mine]], self.start[entry[mine] + 1]
                p, size = ranges(first, last), last - first
                self.visited += len(p)
                got += np.bincount(np.repeat(whose[mine] * n, size) + self.rows[p], self.w[p] * np.repeat(share[mine], size), minlength=m * n).reshape(m, n)
                if n >= k:
                    bar = np.maximum(np.partition(got, -k, axis=1)[:, -k] - 1e-9, 1e-15)
                at, step = at + step, 2 * step
        out = []
        for row in got:
            hit = np.flatnonzero(row > 0)
            if len(hit) > k:
                hit = hit[row[hit] >= np.partition(row[hit], -k)[-k] - 1e-9]
            c, number = np.round(row[hit], 12), self.number[hit]
            top = np.lexsort((number, -c))[:k]
            out.append((number[top], c[top]))
        return out

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        s = s * self.stands[i]
        return float(((s * self.labels[i]).sum() + SHRINK * self.base) / (s.sum() + SHRINK))


def vector(text: str | None, known: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(terms, how often each occurs) of a text."""
    n = Counter(words_of(text))
    ids, rich = known.of(n)
    count = list(n.values())
    for w in rich:
        ids += known.extra[w]
        count += [n[w]] * len(known.extra[w])
    at, where = np.unique(np.array(ids, dtype=np.int64), return_inverse=True)
    tf = np.bincount(where, weights=count, minlength=len(at))
    return (at[1:], tf[1:]) if len(at) and at[0] < 0 else (at, tf)


def fit(docs: DataFrame, labels: DataFrame, trained_on, key: str, text: str, label: str) -> tuple[BlockMaxIndex, dict[bytes, int]]:
    """The index and the terms of their own numbers: two passes over the labelled rows and one over all documents."""
    every = labels.where(trained_on).where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("_toxic"))
    sample = [every.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED) for y in (0, 1)]
    told = F.broadcast(materialize(sample[0].unionByName(sample[1]), "told"))  # at most 2 * MAX_LABELLED ids
    own = spread_out(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    labelled = materialize(own.join(told, own["_key"] == told["_id"]).select("_key", "_text", "_toxic"), "labelled")
    size = {r["_toxic"]: r["n"] for r in labelled.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    gain = gains(labelled, n1, n0)
    told = {t: (1 << BITS) + i for i, t in enumerate(gain)}
    relevance = np.full((1 << BITS) + len(told), FLOOR)
    for t, i in told.items():
        relevance[i] = gain[t] + (0.0 if t.endswith(b"*") else FLOOR)
    weight = (np.log((docs.count() + 1) / (document_frequencies(own, told) + 1)) + 1) * relevance
    half = MAX_EXAMPLES // 2
    rows = [r for y in (0, 1) for r in labelled.where(F.col("_toxic") == y).orderBy(F.xxhash64("_key"), "_key").limit(half).collect()]  # at most MAX_EXAMPLES rows
    base = n1 / (n1 + n0) if n1 else 0.0
    blank, known = BlockMaxIndex([], [], [], weight, base), Terms(told)
    vectors = [(t, blank.weigh(t, tf)) for t, tf in (vector(r["_text"], known) for r in rows)]
    stands = [max(1.0, size[r["_toxic"]] / half) for r in rows]
    return BlockMaxIndex(vectors, [r["_toxic"] for r in rows], [r["_key"] for r in rows], weight, base, stands), told


def toxicity(docs: DataFrame, labels: DataFrame, trained_on, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The operator: ``(key, score, predicted, evidence)`` per row of ``docs``.

    ``trained_on`` is a condition on the key of rows whose labels may be learned from; ``evidence`` lists
    the nearest examples as ``array<struct<id, cosine, label>>``.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, trained_on, key, text, label))  # bounded by MAX_EXAMPLES and BITS
    src = spread_out(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    key_type = src.schema["_key"].dataType
    schema = T.StructType(
        [
            src.schema["_key"],
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("id", key_type), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, told = shared.value
        known, votes = Terms(told), {}
        for batch in slices(batches, "_text"):
            if len(votes) > REMEMBER:
                votes.clear()
            texts = strings(batch, "_text")
            same = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            fresh = {s: t for s, t in zip(same, texts, strict=True) if s not in votes}
            vectors = [(at, index.weigh(at, tf)) for at, tf in (vector(t, known) for t in fresh.values())]
            for s, (i, c) in zip(fresh, index.nearest_all(vectors), strict=True):
                votes[s] = index.vote(i, c), [{"id": index.ids[a], "cosine": float(x), "label": int(index.labels[a])} for a, x in zip(i, c, strict=True)]
            scores, seen = [votes[s][0] for s in same], [votes[s][1] for s in same]
            kind = pa.list_(pa.struct([("id", batch.schema.field(0).type), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(seen, kind)], names=schema.names)

    return src.mapInArrow(run, schema).withColumnRenamed("_key", key)
