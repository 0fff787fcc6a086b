"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text is lower-cased (A-Z) and split into words; its word shingles (repeats included) are hashed by
XXH64, and a bit of the fingerprint is set where over half of the hashes have it. Fingerprints at 3 or
fewer differing bits are linked; components of links are the groups of near-duplicates.

**Search.** Two fingerprints that differ in d <= 3 bits have a midpoint that each reaches by flipping
about half of them:

* d <= 2: one that each reaches by at most one flip, so every fingerprint emits its ball of radius 1;
* d = 3: their parities differ, and two of the three bits lie in the same half of the 64. The one of
  even parity flips those two, the other one flips the third. So only even fingerprints emit flips of
  two bits, and only of two in the same half: by Mantel's theorem no smaller set of pairs will do.

Variants are shuffled by some of their bits (``key_bits``: 16, more for more fingerprints). As most variants of a
fingerprint agree in those, the fingerprint travels once for each value that its variants have there (45 rows on average
for 16 bits rather than 560), and is unfolded behind the shuffle. There, fingerprints that meet in a variant are linked to
the least of them if one of them reaches it by at most one flip: any other is at most two flips away, so
each such pair is within 3, verified by construction. Pairs inside a group are never listed: a group
of n gives n links. Equal fingerprints are one node from the start.

Memory: a task unfolds some ``UNFOLD`` variants at a time, of whole keys. A key with more is split by eight further bits
of the variants, and again where that is not enough; only the fingerprints with a variant there take part, so the
work grows with the key's rows.

Defined results: a null or empty text has the fingerprint 0 and is linked like any other; a text with
fewer words than a shingle is one shingle; an empty table gives no rows; repeated rows share a class; a
null id takes part but never names a class (a class of null ids alone has a null name).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import star_components
from ..session import materialize, partitions_for, ship
from .common import helper, slices, strings

RADIUS = 3
HALF = lambda b: b // 32
#: Variants that a task unfolds at a time.
UNFOLD = 2_000_000
#: Key bits for at most so many fingerprints: some ten thousand rows a key where they are spread evenly.
WIDTHS = ((16, 1 << 24), (24, 1 << 34), (32, 1 << 63))
DEEPER = 8

_u = lambda xs: np.array(list(xs), dtype=np.uint64)


class Key:
    """A shuffle key of so many bits, half of them from each half of the variant."""

    def __init__(self, width: int):
        self.width = width
        self.bits = [*range(width // 2), *range(32, 32 + width // 2)]
        self.free = [b for b in range(64) if b not in self.bits]
        self.mask = np.uint64(sum(1 << b for b in self.bits))
        pairs = lambda bits: _u((1 << a) | (1 << b) for a, b in combinations(bits, 2) if HALF(a) == HALF(b))
        self.one, self.two = _u(1 << b for b in self.bits), pairs(self.bits)
        self.near, self.far = _u([0, *(1 << b for b in self.free)]), pairs(self.free)
        self.free_of_half = [_u(1 << b for b in self.free if HALF(b) == h) for h in (0, 1)]


@lru_cache
def key_of(width: int) -> Key:
    return Key(width)


def key_bits(fingerprints: int) -> int:
    return next(width for width, most in WIDTHS if fingerprints <= most)


KEY_BITS, FREE_BITS, KEY_MASK = key_of(16).bits, key_of(16).free, int(key_of(16).mask)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(key, fp)`` with the fingerprint as a signed 64-bit number."""
    ship(docs.sparkSession)
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = src.select("_key").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            fp = np.fromiter((fingerprint(t, shingle) for t in strings(batch, "_text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["_key", "fp"])

    return src.mapInArrow(run, schema).withColumnRenamed("_key", key)


def parity(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp) & 1


def spread(batches: Iterator[pa.RecordBatch], width: int = 16) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once for every value of the key bits among its variants."""
    k = key_of(width)
    for batch in batches:
        all_fp = np.asarray(batch.column(0)).view(np.uint64)
        for at in range(0, len(all_fp), 20_000):
            fp = all_fp[at : at + 20_000]
            even = fp[parity(fp) == 0]
            keys = np.concatenate([fp & k.mask, ((fp[:, None] ^ k.one) & k.mask).ravel(), ((even[:, None] ^ k.two) & k.mask).ravel()])
            whose = np.concatenate([fp, np.repeat(fp, len(k.one)), np.repeat(even, len(k.two))])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(whose.view(np.int64))], names=["key", "fp"])


def flips(key: np.ndarray, fp: np.ndarray, k: Key) -> tuple[np.ndarray, np.ndarray]:
    """Bits in which a fingerprint differs from a key, and whether it has a variant with that key."""
    off = (fp & k.mask) ^ key
    n = np.bitwise_count(off)
    one_half = ((off >> np.uint64(32)) == 0) | ((off & np.uint64(0xFFFFFFFF)) == 0)
    return n, (n <= 1) | ((n == 2) & one_half & (parity(fp) == 0))


def costs(key: np.ndarray, fp: np.ndarray, k: Key) -> np.ndarray:
    """How many variants each fingerprint has with its key."""
    n, even = flips(key, fp, k)[0], parity(fp) == 0
    return np.where(n == 0, len(k.near) + len(k.far) * even, np.where(n == 1, 1 + len(k.free_of_half[0]) * even, 1))


def unfold(key: np.ndarray, fp: np.ndarray, k: Key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All variants with the given keys: (variant, row, reached by at most one flip)."""
    own = fp & k.mask
    base = (fp ^ own) | key
    n = np.bitwise_count(own ^ key)
    even = parity(fp) == 0
    rows = np.arange(len(fp), dtype=np.int64)
    none, one, two = n == 0, n == 1, n == 2
    variants = [(base[none][:, None] ^ k.near).ravel(), base[one], (base[none & even][:, None] ^ k.far).ravel(), base[two]]
    whose = [np.repeat(rows[none], len(k.near)), rows[one], np.repeat(rows[none & even], len(k.far)), rows[two]]
    near = [True, True, False, False]
    for h, free in enumerate(k.free_of_half):
        at = one & even & ((((own ^ key) >> np.uint64(32)) != 0) == bool(h))
        variants.append((base[at][:, None] ^ free).ravel())
        whose.append(np.repeat(rows[at], len(free)))
        near.append(False)
    return np.concatenate(variants), np.concatenate(whose), np.repeat(near, [len(v) for v in variants])


def meet(variant: np.ndarray, row: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that share a variant which one of them reaches by at most one flip: (group, row), groups numbered from 0."""
    order = np.argsort(variant)
    v = variant[order]
    if not len(v):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate(([True], v[1:] != v[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(v)))
    some = np.logical_or.reduceat(near[order], start)
    good = (size > 1) & some
    keep = np.repeat(good, size)
    group = np.repeat(np.cumsum(good) - 1, size)[keep]
    return group, row[order][keep]


def settle(label: np.ndarray, group: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Least label of each row's component, where rows of one group are connected."""
    if not len(group):
        return label
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    while True:
        least = np.minimum.reduceat(label[row], start)
        fresh = label.copy()
        np.minimum.at(fresh, row, least[group])
        if np.array_equal(fresh, label):
            return label
        label = fresh


def chunks(key: np.ndarray, cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole keys (sorted) of at most ``UNFOLD`` variants, or of one key."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    total = np.cumsum(cost)[ends - 1]
    at, spent, before = 0, 0, 0
    for e, t in zip(ends.tolist(), total.tolist(), strict=True):
        if t - spent > UNFOLD and before > at:
            yield at, before
            at, spent = before, last
        before, last = e, t
    yield at, len(key)


def link(key: np.ndarray, fp: np.ndarray, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of whole keys (sorted) that connect all that meet: (fingerprint, lesser fingerprint)."""
    k, a, b = key_of(width), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    cost = costs(key, fp, k)
    for at, end in chunks(key, cost):
        if end - at < 2:
            continue
        if width < 64 and cost[at:end].sum() > UNFOLD:
            for part in deeper(key[at], fp[at:end], k):
                x, y = link(*part, width + DEEPER)
                a.append(x)
                b.append(y)
            continue
        own = fp[at:end].view(np.int64)
        label = settle(own, *meet(*unfold(key[at:end], fp[at:end], k)))
        moved = label != own
        a.append(own[moved])
        b.append(label[moved])
    return np.concatenate(a), np.concatenate(b)


def deeper(key: np.uint64, fp: np.ndarray, k: Key) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One key's rows for each value of ``DEEPER`` further bits: (longer key, fingerprints with a variant there)."""
    wide = key_of(k.width + DEEPER)
    fresh = [b for b in wide.bits if b not in k.bits]
    for value in range(1 << DEEPER):
        longer = key | np.uint64(sum(1 << b for i, b in enumerate(fresh) if value >> i & 1))
        some = fp[flips(longer, fp, wide)[1]]
        if len(some) > 1:
            yield np.full(len(some), longer, dtype=np.uint64), some


def meeting(batches: Iterator[pa.RecordBatch], width: int = 16) -> Iterator[pa.RecordBatch]:
    """Links of one partition whose rows are sorted by key; only whole keys are unfolded together."""
    keys: list[np.ndarray] = []
    prints: list[np.ndarray] = []
    held = 0

    def links() -> pa.RecordBatch:
        a, b = link(np.concatenate(keys), np.concatenate(prints), width)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, f = (np.asarray(batch.column(c)).view(np.uint64) for c in (0, 1))
        turns = np.flatnonzero(k[1:] != k[:-1]) + 1
        whole = int(turns[-1]) if len(turns) else 0  # rows before the batch's last key
        if not whole and keys and keys[-1][-1] != k[0]:
            yield links()
            keys, prints, held = [], [], 0
        elif whole:
            keys.append(k[:whole])
            prints.append(f[:whole])
            if held + whole >= 1 << 16:
                yield links()
                keys, prints, held = [], [], 0
            else:
                held += whole
        keys.append(k[whole:])
        prints.append(f[whole:])
        held += len(k) - whole
    if keys:
        yield links()


def fingerprint_links(distinct: DataFrame, partitions: int | None = None, width: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints (column ``fp``, distinct) within the radius."""
    n = partitions or partitions_for(distinct, 4 << 20)  # a fingerprint becomes some 45 rows or more
    bits = width or key_bits(distinct.count())
    met = distinct.select("fp").mapInArrow(lambda b: spread(b, bits), "key bigint, fp bigint").repartition(n, "key").sortWithinPartitions("key")
    return met.mapInArrow(lambda b: meeting(b, bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The operator: ``(key, fingerprint, component_id, n_component)`` for every row of ``docs``.

    ``component_id`` is the least key reachable over links, ``n_component`` the number of rows there.
    """
    prints = materialize(fingerprints(docs, key, text, shingle), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = star_components(fingerprint_links(nodes))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    sizes = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_component"))
    classes = named.select("fp", "root").join(sizes, "root").select(F.col("fp").alias("_fp"), "component_id", "n_component")
    joined = prints.join(classes, prints["fp"] == F.col("_fp"))
    return joined.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_component")


def keep_one(docs: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key isn't the least of its class; of repeated rows of that key one stays.

    Rows with a null key can't be told apart and stay. The texts are shuffled once: the join and the
    removal of repeats share their partitioning.
    """
    lead = helper(docs, "_lead")
    leads = classes.where(F.col(key) == F.col("component_id")).select(F.col(key).alias(lead))
    kept = docs.join(leads, docs[key] == F.col(lead), "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))
