"""Benchmark decontamination by template canonicalisation.

Words lose the marks at their ends and are lower-cased; numbers, units and names become typed
placeholders. Names are capitalised words; as copies may change case, windows that hold a name are
indexed both with the name as a placeholder and with it as a word, and as any word is capitalised at the
start of a sentence, the words there are taken as words, and as names in one more stream. Windows of ``WINDOW``
canonical words that hold ``LITERALS`` or more plain words are hashed and joined with the windows of the
benchmark. For each document and item, the matches are aligned, and the slots are checked: along the
matched words a slot value of the item must always meet the same value in the document, and no two names the
same (numbers and units may: 12 and 5 both become 40, 'mile' and 'miles' both 'km'). Windows with a slot that conflicts go, the others
stay. So a question asked again with other numbers or names is caught, and a chance meeting of templates
with mixed-up values isn't. A document is contaminated by an item if consistent matches cover ``COVER`` of
the item's words, or ``RUN`` words in a row; where two changed names became one, only ``RUN`` counts. Items of fewer
than ``LITERALS`` plain words have no template: they match where their very words follow each other, items of one or two
words only a document that is nothing else.

Before anything is aligned, the words that an item's windows could cover are counted from the distinct windows that it
shares with the document: of a template that many items share, only items that can reach the limits are looked at.

The benchmark is the query set: its index (sorted hashes) is broadcast in blocks of at most
``BLOCK_WINDOWS`` windows, each against all documents, so what is broadcast is bounded and nothing is
shuffled. Whole texts are read.

Defined results: null and empty texts match nothing, on either side; items shorter than a window are one window; equal items each match; repeated rows each give their rows;
null ids are kept; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship
from .common import ranges, slices, strings

WINDOW, LITERALS, COVER, RUN = 8, 4, 0.5, 25
BLOCK_WINDOWS = 1_000_000
#: Words that a worker remembers the code of; beyond, it forgets them all.
REMEMBER = 200_000

EDGES = b".,;:!?*#&%$|\"'()[]<>{}_\\=~`^"
NUMBER = re.compile(rb"[+-]?\d[\d.,:/]*")
MEASURE = re.compile(rb"([+-]?\d[\d.,]*)-?([a-z]+)")
# Number words and units (lower case).
NUMBER_WORDS = set(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = set(b"mm cm m km mg g kg t ml l s ms sec min h hr hrs hz khz mhz ghz v w kw mw j kj pa kpa bar mph kph km/h m/s inch inches foot feet ft yard yards mile miles ounce ounces oz pound pounds lb lbs gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit kelvin".split())

# The low bits of a code: capitalised, ends a sentence, is a slot.
CAPITAL, STOP, SLOT = 1, 2, 4
_kind = lambda name: (xxhash.xxh64_intdigest(name) & ~7) | SLOT
NUM, UNIT, MIXED, NAME = _kind(b"\x00number"), _kind(b"\x00unit"), _kind(b"\x00measure"), _kind(b"\x00name")
FLAGS = np.uint64(CAPITAL | STOP)
VALUES = frozenset(np.uint64(x) for x in (NUM, UNIT, MIXED))


def code_of(word: bytes) -> int:
    """Canonical code of a word, with flags in its low bits."""
    core = word.strip(EDGES)
    low = core.decode("utf-8", "replace").lower().encode() if core and max(core) > 127 else core.lower()
    flags = STOP if word.rstrip(b"\"')]").endswith((b".", b"!", b"?")) else 0
    if NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        return NUM | flags
    if low in UNITS:
        return UNIT | flags
    if low[:1].isdigit() and MEASURE.fullmatch(low) and MEASURE.fullmatch(low)[2] in UNITS:
        return MIXED | flags
    head = core.decode("utf-8", "replace")[:2]
    if len(head) == 2 and head[0].isupper() and head[1].islower():
        flags |= CAPITAL
    return (xxhash.xxh64_intdigest(low) & ~7) | flags


class Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        c = self[word] = code_of(word)
        return c


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def hashes(code: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` codes."""
    if width == 1:
        return mixed(code)
    if len(code) < width:
        return np.empty(0, np.uint64)
    half = (width + 1) // 2
    part = hashes(code, half)
    n = len(code) - width + 1
    return mixed(part[:n] * np.uint64(0x9E3779B97F4A7C15) + (part[width - half : width - half + n] ^ np.uint64(width)))


def streams(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Canonical codes with names as words, with names inside sentences as slots, and with those at sentence starts as
    slots too. Beside each of the latter two, the slots that the stream before does not have."""
    words = code & ~FLAGS
    yield words, None
    names = ((code & np.uint64(CAPITAL)) != 0) & ((code & np.uint64(SLOT)) == 0)
    starts = np.ones(len(code), dtype=bool)
    starts[1:] = (code[:-1] & np.uint64(STOP)) != 0
    named = words
    for fresh in (names & ~starts, names & starts):
        if fresh.any():
            named = np.where(fresh, NAME, named)
            yield named, fresh


def windows(code: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of the windows that hold enough plain words, from all streams."""
    if len(code) < width:
        return
    for stream, fresh in streams(code):
        h = hashes(stream, width)
        slots = np.concatenate(([0], np.cumsum((stream & np.uint64(SLOT)) != 0)))
        good = width - (slots[width:] - slots[:-width]) >= min(LITERALS, width)
        if fresh is not None:  # only those with a fresh slot differ from the stream before's
            some = np.concatenate(([0], np.cumsum(fresh)))
            good &= some[width:] > some[:-width]
        at = np.flatnonzero(good)
        yield at, h[at]


class Literals(dict):
    """Word to a code of its letters alone, without slots."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        core = word.strip(EDGES)
        c = self[word] = xxhash.xxh64_intdigest(core.decode("utf-8", "replace").lower().encode())
        return c


class Index:
    """Windows of one block of the benchmark."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.words, self.codes = [], [], []
        self.short: dict[int, dict[int, list]] = {}  # number of words -> hash of the whole item -> ids
        code, plain = Codes(), Literals()
        got: dict[int, list] = {}
        for item, text in items:
            w = text.encode("utf-8", "surrogatepass").split()
            if not w:
                continue
            c = np.fromiter(map(code.__getitem__, w), dtype=np.uint64, count=len(w))
            if int(((c & np.uint64(SLOT)) == 0).sum()) < LITERALS:
                whole = hashes(np.fromiter(map(plain.__getitem__, w), dtype=np.uint64, count=len(w)), len(w))
                self.short.setdefault(len(w), {}).setdefault(int(whole[0]), []).append(item)
                continue
            width = min(WINDOW, len(w))
            for at, h in windows(c, width):
                got.setdefault(width, []).append((h, np.full(len(h), len(self.ids)), at))
            self.ids.append(item)
            self.words.append(w)
            self.codes.append(c)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.by_width = {}
        for width, parts in got.items():
            h = np.concatenate([p[0] for p in parts])
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << 20, dtype=bool)
            table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_width[width] = (h[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order], table)

    def matches(self, words: list[bytes], code: np.ndarray) -> list[dict]:
        """Contaminating items of one document."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for width, (keys, item, spot, table) in self.by_width.items():
            met = []
            for at, h in windows(code, width):
                maybe = np.flatnonzero(table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                left, right = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
                some = right > left
                met.append((at[maybe][some], left[some], right[some]))
            at, left, right = (np.concatenate([m[c] for m in met]) if met else np.empty(0, np.int64) for c in range(3))
            if not len(at):
                continue
            first = np.unique(left, return_index=True)[1]
            entries = self.hopeful(ranges(left[first], right[first]), item, spot, width)
            of: dict[int, list[int]] = {}
            for begin, e in zip(left[first][np.searchsorted(left[first], entries, "right") - 1].tolist(), entries.tolist(), strict=True):
                of.setdefault(begin, []).append(e)
            for begin, p in zip(left.tolist(), at.tolist(), strict=True):
                for e in of.get(begin, ()):
                    found.setdefault(int(item[e]), set()).add((p - int(spot[e]), int(spot[e]), width))
        return [m for i, hits in sorted(found.items()) if (m := self.judge(i, hits, words, code))] + self.verbatim(words)

    def hopeful(self, entries: np.ndarray, item: np.ndarray, spot: np.ndarray, width: int) -> np.ndarray:
        """Those entries whose items could reach a limit if all their windows held."""
        order = np.lexsort((spot[entries], item[entries]))
        i, s = item[entries][order], spot[entries][order]
        new = np.concatenate(([True], i[1:] != i[:-1]))
        step = np.append(np.where(new[1:], width, np.minimum(width, s[1:] - s[:-1])), width)
        covered = np.add.reduceat(step, np.flatnonzero(new))
        own = i[new]
        good = (covered >= COVER * self.size[own]) | (covered >= RUN)
        return np.sort(entries[order][np.repeat(good, np.diff(np.append(np.flatnonzero(new), len(i))))])

    def verbatim(self, words: list[bytes]) -> list[dict]:
        """Items without a template whose very words the document holds."""
        out: list[dict] = []
        if not self.short or not words:
            return out
        plain = self.literals
        code = np.fromiter(map(plain.__getitem__, words), dtype=np.uint64, count=len(words))
        for n, items in sorted(self.short.items()):
            if n > len(words) or (n < 3 and n != len(words)):
                continue
            seen: dict[int, list[int]] = {}
            for at in np.flatnonzero(np.isin(h := hashes(code, n), np.fromiter(items, dtype=np.uint64, count=len(items)))).tolist():
                seen.setdefault(int(h[at]), []).append(at)
            out += [{"item": i, "share": 1.0, "run": n, "start": at[0], "end": at[-1] + n} for x, at in seen.items() for i in items[x]]
        return out

    @cached_property
    def literals(self) -> Literals:
        return Literals()

    def judge(self, i: int, hits: set[tuple[int, int, int]], words: list[bytes], code: np.ndarray) -> dict | None:
        """Slot consistency along each alignment, then coverage."""
        own = self.words[i]
        by_shift: dict[int, set[tuple[int, int]]] = {}
        for shift, spot, width in hits:
            by_shift.setdefault(shift, set()).add((spot, spot + width))
        covered: set[int] = set()
        sure: set[int] = set()
        spans: list[tuple[int, int]] = []
        for shift, found in sorted(by_shift.items()):
            odd, merged = self.odd(i, shift, found, words, code)
            spots = {s for a, z in found if odd.isdisjoint(range(a, z)) for s in range(a, z)}
            if spots:
                covered |= spots
                spans.append((min(spots) + shift, max(spots) + shift + 1))
                if not merged:
                    sure |= spots
        run = best = 0
        for s in range(len(own)):
            run = run + 1 if s in covered else 0
            best = max(best, run)
        if len(sure) < COVER * len(own) and best < RUN:
            return None
        return {"item": self.ids[i], "share": len(covered) / len(own), "run": best, "start": min(s for s, _ in spans), "end": max(e for _, e in spans)}

    def odd(self, i: int, shift: int, found: set[tuple[int, int]], words: list[bytes], code: np.ndarray) -> tuple[set[int], bool]:
        """Places of an alignment's slots that conflict with its other slots, and whether two changed names became one.

        An unchanged value goes before a changed one, then the more frequent change, then the first.
        """
        own, own_code = self.words[i], self.codes[i]
        pairs: dict[tuple[bytes, bytes], list[int]] = {}
        free = set()
        for s in sorted({s for a, z in found for s in range(a, z)}):
            a, b = own[s].strip(EDGES).lower(), words[s + shift].strip(EDGES).lower()
            literal = not (own_code[s] & np.uint64(SLOT)) and (own_code[s] & ~FLAGS) == (code[s + shift] & ~FLAGS)
            if not literal:
                pairs.setdefault((a, b), []).append(s)
                if (own_code[s] & ~FLAGS) in VALUES:
                    free.add((a, b))  # 12 and 5 may both become 40, 'mile' and 'miles' both 'km'
        there: dict[bytes, bytes] = {}
        back: dict[bytes, bytes] = {}
        odd: set[int] = set()
        merged = False
        for (a, b), at in sorted(pairs.items(), key=lambda x: (x[0][0] != x[0][1], -len(x[1]), x[1][0])):
            if a in there or ((a, b) not in free and b in back):
                odd.update(at)
                merged |= a not in there and back[b] != b
            else:
                there[a] = b
                if (a, b) not in free:
                    back[b] = a
        return odd, merged


def item_blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of at most BLOCK_WINDOWS words, each collected on its own."""
    src = items.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = src.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    n = -(-size // BLOCK_WINDOWS)
    for b in range(n):
        yield [(r["item"], r["text"]) for r in src.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()]  # size checked above


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The operator: one row ``(key, item, share, run, start, end)`` per contaminated document and item.

    ``start`` and ``end`` bound the matched words of the document.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType(
        [
            src.schema["_key"],
            T.StructField("_item", items.schema[item].dataType),
            T.StructField("share", T.DoubleType()),
            *[T.StructField(c, T.LongType()) for c in ("run", "start", "end")],
        ]
    )
    out = None
    for block in item_blocks(items, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = shared.value, Codes()
            for batch in slices(batches, "_text"):
                rows: list[tuple[int, dict]] = []
                for i, t in enumerate(strings(batch, "_text")):
                    words = t.encode("utf-8", "surrogatepass").split() if t else []
                    if words:
                        code = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                        rows += [(i, m) for m in index.matches(words, code)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([i for i, _ in rows])),
                            pa.array([m["item"] for _, m in rows], _arrow(schema["_item"].dataType)),
                            pa.array([m["share"] for _, m in rows], pa.float64()),
                            *[pa.array([m[c] for _, m in rows], pa.int64()) for c in ("run", "start", "end")],
                        ],
                        names=schema.names,
                    )

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"_key": key, "_item": item})


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows: one pass for each block of the benchmark, without a shuffle."""
    ship(docs.sparkSession)
    out = docs
    for block in item_blocks(items, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = shared.value, Codes()
            for batch in slices(batches, text):
                good = []
                for t in strings(batch, text):
                    words = t.encode("utf-8", "surrogatepass").split() if t else []
                    code = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                    good.append(not words or not index.matches(words, code))
                yield batch.filter(pa.array(good, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
