"""Substring dedup by level-wise doubling.

A window of ``window`` consecutive words is removed from a document if the same words also start in a
document with a smaller id. To find those windows without shuffling all of them, lengths are halved
until they are short (13, 7, 4; a length of 50 gives 50, 25, 13, 7, 4) and then climbed again:

* at each length the windows are sampled by content: every window of the next length has as its anchor the shorter one
  with the least hash in it, so equal windows have equal anchors;
* windows repeated at one length alone (found in two documents) are extended to about twice that length: a longer window
  is a candidate only if its anchor was repeated, and it is extended further only if all candidates inside the next
  length are;
* it ends at the full length, or where no candidate survives.

Documents live in blocks, dealt by a hash of their id in one exchange that every level reuses. A block
sends each distinct hash once, in sorted binary runs per bucket of hashes, and says which of them two of its own
documents hold; a bucket answers each block with the hashes that matter to it. So a passage that a third of all documents
share is one entry per block, and no link between documents is ever listed. At the full length, 96 bits of hash are
compared, inside a block too.

Defined results: a null or empty text has no words and stays; shorter texts stay; rows that share an id
don't remove each other's words; a null id counts as greater than any other; an empty table gives no rows; ids are whole
numbers of any width, other types are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import input_bytes, partitions_for, ship

#: A block aims at this much of the table's files; from ``MANY_BLOCKS`` blocks on at more, up to ``LARGE_BLOCK``.
#: Many small blocks fill the shuffle partitions evenly, few large ones keep a hot passage's entries few.
BLOCK_BYTES, LARGE_BLOCK, MANY_BLOCKS = 1 << 20, 32 << 20, 1 << 16
SHORTEST = 6
LAST_ID = (1 << 63) - 1
#: Words of more than this many 8-byte lanes are hashed one by one.
LANES = 8


def block_count(size: int) -> int:
    return max(1, min(-(-size // BLOCK_BYTES), max(MANY_BLOCKS, -(-size // LARGE_BLOCK))))


def levels(window: int) -> list[int]:
    """Lengths from short to ``window``, each at most twice the one before."""
    out = [window]
    while out[0] >= SHORTEST or len(out) == 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of ``raw`` start and end."""
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_GAP[np.frombuffer(raw, np.uint8)]
    turn = np.diff(word)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: its bytes in lanes of eight; a word of up to eight bytes enters whole."""
    size = end - start
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lanes = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    at = np.arange(len(size))
    for lane in range(LANES):
        at = at[size[at] > 8 * lane] if lane else at[size > 0]
        if not len(at):
            break
        left = np.minimum(size[at] - 8 * lane, 8).astype(np.uint64)
        piece = lanes[start[at] + 8 * lane] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        out[at] = mix(out[at] ^ piece) * np.uint64(0xD6E8FEB86659FD93) if lane else mix(out[at] ^ piece)
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]])
    return out


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` values, from two windows of about half that length."""
    if length == 1:
        return h
    half = (length + 1) // 2
    if len(h) < length:
        return np.empty(0, np.uint64)
    part = window_hashes(h, half)
    n = len(h) - length + 1
    return mix(part[:n] * np.uint64(0x9E3779B97F4A7C15) + (part[length - half : length - half + n] ^ np.uint64(length)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    if width == 1:
        return x
    half = (width + 1) // 2
    part = sliding_min(x, half)
    n = len(x) - width + 1
    return np.minimum(part[:n], part[width - half : width - half + n])


def inside(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values lie in the sorted table."""
    if not len(table) or not len(x):
        return np.zeros(len(x), dtype=bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, which a shuffle's compression can squeeze."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def repeated_in_block(values: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, least rank of each, whether two ranks have it)."""
    if not len(values):
        return values, rank, np.zeros(0, bool)
    order = np.argsort(values)
    v, r = values[order], rank[order]
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    least = np.minimum.reduceat(r, start)
    return v[start], least, np.maximum.reduceat(r, start) > least


class Block:
    """The documents of one block, by ascending id (null last), as one run of words; ranks are equal for equal ids."""

    def __init__(self, table: pa.Table, hashed: bool = True):
        key = table.column("_key").combine_chunks()
        null = np.asarray(key.is_null())
        ids = np.asarray(key.fill_null(LAST_ID))
        self.order = np.lexsort((ids, null))
        self.ids, self.null = ids[self.order], null[self.order]
        new = (self.ids[1:] != self.ids[:-1]) | (self.null[1:] != self.null[:-1])
        self.rank = np.cumsum(np.concatenate(([0], new))) if len(ids) else ids
        texts = table.column("_text").combine_chunks().cast(pa.binary()).to_pylist()
        self.texts = [texts[i] or b"" for i in self.order]
        raw = b"\n".join(self.texts)
        self.start, end = word_bounds(raw)
        first = np.cumsum([0, *(len(t) + 1 for t in self.texts)])
        self.doc = np.searchsorted(first, self.start, "right") - 1
        self.h = word_hashes(raw, self.start, end)

    def whole(self, length: int) -> np.ndarray:
        """Which windows of ``length`` words lie in one document."""
        n = len(self.doc) - length + 1
        return self.doc[:n] == self.doc[length - 1 :] if n > 0 else np.zeros(0, bool)

    def anchors(self, short: int, long: int) -> np.ndarray:
        """Anchor of every window of ``long`` words: its window of ``short`` words with the least hash."""
        if len(self.h) < long:
            return np.empty(0, np.uint64)
        return mix(sliding_min(window_hashes(self.h, short), long - short + 1))

    def ranks(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the documents of the windows that start at ``at``."""
        return self.rank[self.doc[at]]

    def sampled(self, short: int, long: int, good: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Distinct anchors of the windows of ``long`` words that are ``good``: (held by two documents, values)."""
        at = np.flatnonzero(good)
        value, rank = self.anchors(short, long)[at], self.ranks(at)
        new = np.ones(len(at), dtype=bool)  # neighbouring windows mostly share their anchor
        new[1:] = (value[1:] != value[:-1]) | (rank[1:] != rank[:-1])
        value, _, twice = repeated_in_block(value[new], rank[new])
        return [(0, value[~twice]), (TWICE, value[twice])]

    def id_of_rank(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.rank, rank)
        return self.ids[at], self.null[at]


#: The low bits of a row's origin, beside its block: two documents of the block hold the values; only rows without an id do.
TWICE, UNNAMED, FLAGS = 1, 2, 2


def shipped(block: int, buckets: int, parts: list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]) -> pa.Table:
    """Sorted values, by flags, as one row per bucket."""
    out: dict[str, list] = {"bucket": [], "origin": [], "value": [], "check": [], "least": []}
    for flags, value, check, least in parts:
        bucket = ((value >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(value) else np.empty(0, np.int64)
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(value)], strict=False):
            out["bucket"].append(int(bucket[a]))
            out["origin"].append(block << FLAGS | flags)
            out["value"].append(planes(value[a:b]))
            out["check"].append(planes(check[a:b]) if check is not None else b"")
            out["least"].append(planes(least[a:b].view(np.uint64)) if least is not None else b"")
    kinds = {"bucket": pa.int64(), "origin": pa.int64(), "value": pa.binary(), "check": pa.binary(), "least": pa.binary()}
    return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})


SHIPPED = "bucket bigint, origin bigint, value binary, check binary, least binary"
ANSWER = "block bigint, first boolean, value binary, check binary"


def answer(bucket: pa.Table) -> pa.Table:
    """To each block, the values of this bucket that matter to it.

    Without ids: values that two blocks sent, or two documents of the block hold. With ids: values that another block sent
    with a smaller id, and (``first``: the block's first document keeps them) the others that two of its documents hold.
    """
    origin = np.asarray(bucket.column("origin").combine_chunks())
    parts = [unplanes(x) for x in bucket.column("value").to_pylist()]
    value = np.concatenate(parts)
    whose = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    twice = (origin & TWICE != 0)[whose]
    least_raw = bucket.column("least").to_pylist()
    final = any(least_raw)
    check = np.concatenate([unplanes(x) for x in bucket.column("check").to_pylist()]) if final else None
    order = np.lexsort((check, value)) if final else np.argsort(value)
    v = value[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    if final:
        c = check[order]
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(v)))
    wanted: list[tuple[bool, np.ndarray]] = []
    if final:
        unnamed = (origin & UNNAMED != 0)[whose][order]
        least = np.concatenate([unplanes(x) for x in least_raw]).view(np.int64)[order]
        named = np.repeat(np.logical_or.reduceat(~unnamed, start), size)
        gone = np.where(unnamed, named, least > np.repeat(np.minimum.reduceat(least, start), size))
        wanted = [(False, order[gone]), (True, order[~gone & twice[order]])]
    else:
        wanted = [(False, order[np.repeat(size > 1, size) | twice[order]])]
    out: dict[str, list] = {"block": [], "first": [], "value": [], "check": []}
    for first, hit in wanted:
        hit = hit[np.argsort(whose[hit], kind="stable")]
        at = np.flatnonzero(np.concatenate(([True], whose[hit][1:] != whose[hit][:-1]))) if len(hit) else np.empty(0, np.int64)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(hit)], strict=False):
            out["block"].append(int(origin[whose[hit[a]]]) >> FLAGS)
            out["first"].append(first)
            out["value"].append(planes(value[hit[a:b]]))
            out["check"].append(planes(check[hit[a:b]]) if final else b"")
    kinds = {"block": pa.int64(), "first": pa.bool_(), "value": pa.binary(), "check": pa.binary()}
    return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})


def told_values(answers: pa.Table) -> np.ndarray:
    """All answered values of a block, sorted."""
    parts = [unplanes(x) for x in answers.column("value").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def told_windows(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All answered full windows of a block by value, then check: (values, checks, the block's first document keeps it)."""
    parts = [unplanes(x) for x in answers.column("value").to_pylist()]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
    value = np.concatenate(parts)
    check = np.concatenate([unplanes(x) for x in answers.column("check").to_pylist()])
    first = np.repeat(np.asarray(answers.column("first").combine_chunks()), [len(p) for p in parts])
    order = np.lexsort((check, value))
    return value[order], check[order], first[order]


def check_of(h: np.ndarray, length: int) -> np.ndarray:
    """32 further bits of each window's hash."""
    return window_hashes(h ^ np.uint64(0xA5A5A5A55A5A5A5A), length) >> np.uint64(32)


def found(v: np.ndarray, c: np.ndarray, value: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where each pair (v, c) lies among the sorted pairs (value, check), or -1."""
    left = np.searchsorted(value, v, "left")
    spot = np.minimum(left, max(0, len(value) - 1))
    out = np.where((value[spot] == v) & (check[spot] == c), spot, -1) if len(value) else np.full(len(v), -1)
    more = np.flatnonzero(np.searchsorted(value, v, "right") - left > 1)  # values of several checks
    for i in more.tolist():
        at = left[i]
        while at < len(value) and value[at] == v[i] and check[at] != c[i]:
            at += 1
        out[i] = at if at < len(value) and value[at] == v[i] else -1
    return out


def gone_windows(b: Block, window: int, value: np.ndarray, check: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the windows of a block that a document with a smaller id has."""
    v = window_hashes(b.h, window)
    at = np.flatnonzero(inside(v, value) & b.whole(window)) if len(v) else np.empty(0, np.int64)
    if not len(at):
        return at
    spot = found(v[at], check_of(b.h, window)[at], value, check)
    at, spot = at[spot >= 0], spot[spot >= 0]
    rank = b.ranks(at)
    least = np.full(len(value), len(b.rank), dtype=np.int64)
    np.minimum.at(least, spot, rank)
    return at[~first[spot] | (rank > least[spot])]


def repeats(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """The operator: ``(key, n_words, n_removed, removed, kept_text)`` per row.

    ``removed`` lists the removed word ranges as ``array<struct<start, end>>``.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number, as smaller ids go before greater ones")
    ship(docs.sparkSession)
    n = partitions or partitions_for(docs)
    src = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    size = input_bytes(docs)
    blocks = block_count(size) if size is not None else 8 * src.rdd.getNumPartitions()
    buckets = max(32, blocks // 8)
    lengths = levels(window)
    last = len(lengths) - 1
    base = src.withColumn("block", F.pmod(F.xxhash64("_key"), F.lit(blocks))).repartition(n, "block")

    def first(block: pa.Table) -> pa.Table:
        b = Block(block)
        return shipped(block.column("block")[0].as_py(), buckets, [(f, v, None, None) for f, v in b.sampled(lengths[0], lengths[1], b.whole(lengths[1]))])

    def level(k: int):
        def run(block: pa.Table, answers: pa.Table) -> pa.Table:
            if not block.num_rows:
                return shipped(0, buckets, [])
            b, own = Block(block), block.column("block")[0].as_py()
            good = inside(b.anchors(lengths[k - 1], lengths[k]), told_values(answers)) & b.whole(lengths[k])
            if k < last:
                if len(b.h) < lengths[k + 1]:
                    return shipped(own, buckets, [])
                good = sliding_min(good, lengths[k + 1] - lengths[k] + 1) & b.whole(lengths[k + 1])
                return shipped(own, buckets, [(f, v, None, None) for f, v in b.sampled(lengths[k], lengths[k + 1], good)])
            at = np.flatnonzero(good)
            if not len(at):
                return shipped(own, buckets, [])
            v, c, r = window_hashes(b.h, window)[at], check_of(b.h, window)[at], b.ranks(at)
            order = np.lexsort((r, c, v))
            v, c, r = v[order], c[order], r[order]
            start = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (c[1:] != c[:-1]))))
            ids, null = b.id_of_rank(r[start])
            flags = UNNAMED * null + TWICE * (np.maximum.reduceat(r, start) > r[start])
            return shipped(own, buckets, [(int(f), v[start][flags == f], c[start][flags == f], ids[flags == f]) for f in np.unique(flags)])

        return run

    def final(block: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(block)
        gone = gone_windows(b, window, *told_windows(answers))
        depth = np.zeros(len(b.doc) + 1, dtype=np.int64)
        np.add.at(depth, gone, 1)
        np.add.at(depth, gone + window, -1)
        removed = np.cumsum(depth[:-1]) > 0
        docs_n = len(b.texts)
        n_words = np.bincount(b.doc, minlength=docs_n)
        n_removed = np.bincount(b.doc[removed], minlength=docs_n)
        begin = np.concatenate(([0], np.cumsum(n_words)))
        spans: list[list[dict]] = [[] for _ in range(docs_n)]
        same = np.concatenate(([False], removed[:-1] & (b.doc[1:] == b.doc[:-1]))) if len(removed) else removed
        starts = np.flatnonzero(removed & ~same)
        ends = np.flatnonzero(removed & ~np.append(same[1:] & removed[1:], False)) + 1 if len(removed) else starts
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            i = b.doc[s]
            spans[i].append({"start": int(s - begin[i]), "end": int(e - begin[i])})
        kept = []
        for i, t in enumerate(b.texts):
            words = t.split()
            if spans[i]:
                left, done = [], 0
                for s in spans[i]:
                    left += words[done : s["start"]]
                    done = s["end"]
                words = left + words[done:]
            kept.append(b" ".join(words))
        return pa.table(
            {
                "_key": pa.array(b.ids, pa.int64(), mask=b.null),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    def answered(sent: DataFrame) -> DataFrame:
        return sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(answer, ANSWER).repartition(n, "block")

    told = answered(base.groupBy("block").applyInArrow(first, SHIPPED))
    for k in range(1, len(lengths)):
        told = answered(base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(level(k), SHIPPED))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span), T.StructField("kept_text", T.StringType())])
    result = base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(final, schema)
    return result.select(F.col("_key").cast(docs.schema[key].dataType).alias(key), "n_words", "n_removed", "removed", "kept_text")


def repeats_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
