"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, everything but letters becomes one space, and three start marks go in front. From
all training documents the 4-grams of each language are counted (one pass, merged by sum). On the
driver they give, per language, interpolated Kneser-Ney probabilities of order 4 down to 1, with the
discount n1 / (n1 + 2 n2) of each order and continuation counts below the top. The models of all
languages share sorted hash arrays: one array of 64-bit gram hashes per order, beside it a row of log
probabilities (a column per language), and likewise the weights of the contexts; a lookup is a binary
search, and only grams that no language has seen go on to a lower order.

A document's language has the least cross-entropy per character. Score and rejection are fitted on a fold of the training
documents that the model was not trained on: one in ``FOLD`` by hash of the id, of each language with ``FOLD_FROM`` or more
of them (without such a language, on the training documents). Over the fold, each language's own cross-entropy has a
mean and a deviation. The score is a logistic function of the margin over the second language, the same by the root of the
length, and of how many deviations the cross-entropy lies above the mean of the language. It is fitted to whether the
prediction is right, on each document as it is, and once more with its own language taken away: then any prediction is
wrong, as for a text of a language that nobody has taught. A document with a score below 0.5 (with one language: over
``REJECT_SIGMAS`` deviations) is rejected: ``rejected`` is true, and with ``reject=True`` its language is ``und``.

Size: the distinct 4-grams of a language's letters level off; the driver refuses over ``MAX_CELLS`` grams times languages.
Letters above U+FFFF are folded into 16 bits.

Defined results: null, empty and letterless texts are ``und`` with score 0; without training documents
all are; with one language its score is 1; rows with a null id are neither held out nor trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize, ship
from .common import helper, slices, strings

ORDER = 4
#: Distinct grams times languages: the driver holds some 16 bytes for each, a worker 4.
MAX_CELLS = 30_000_000
REJECT_SIGMAS = 6.0
FOLD, FOLD_FROM = 10, 30
#: Documents of the fold that the score is fitted on, by hash order (a bounded sample).
CALIBRATION_ROWS = 20_000
#: A language's deviation is at least this; that of a text of n characters has ``NOISE / n`` more of squared bits.
LEAST_SIGMA, NOISE = 0.05, 9.0
#: Features of the score are cut at these.
MAX_SIGMAS, MAX_CHARS = 25.0, 10_000
#: Bytes of text that are looked up at a time.
STEP = 1 << 20

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point the lower-case letter in 16 bits, or a space."""
    if not _TABLE:
        t = np.full(0x110000, 32, dtype=np.uint16)
        for c in range(0x20000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                p = ord(low) if len(low) == 1 else c
                t[c] = p if p <= 0xFFFF else 0xE000 | (p & 0x1FFF)
        t[2] = 2
        for c in range(0x20000, 0x110000):
            if 0x20000 <= c < 0x32000:
                t[c] = 0xE000 | (c & 0x1FFF)
        _TABLE.append(t)
    return _TABLE[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 4-grams of the texts (16 bits a character), and the index of each one's text."""
    marked = ["\x02\x02\x02 " + t.replace("\x02", " ") + " " for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    whose = np.repeat(np.arange(len(texts), dtype=np.int32), [len(m) for m in marked])
    c = _letters()[points]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c, whose = c[keep].astype(np.uint64), whose[keep]
    if len(c) < ORDER:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    code = (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]
    same = whose[:-3] == whose[3:]
    return code[same], whose[3:][same]


def hashed(code: np.ndarray) -> np.ndarray:
    x = code * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, code, n)`` over all rows with a language."""
    src = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where("_lang IS NOT NULL AND _text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            code = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            u, inverse = np.unique(code, return_inverse=True)
            return u, np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)

        for batch in slices(batches, "_text", 4 * STEP):
            by: dict[str, list[str]] = {}
            for name, t in zip(strings(batch, "_lang"), strings(batch, "_text"), strict=True):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                code, _ = grams([t for t in texts if has_letter(t)])
                if len(code):
                    parts = held.setdefault(name, [])
                    u, n = np.unique(code, return_counts=True)
                    parts.append((u, n))
                    if len(parts) >= 8:
                        held[name] = [merged(parts)]
        for name, parts in held.items():
            code, n = merged(parts)
            for at in range(0, len(code), 100_000):
                c = code[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(c.view(np.int64)), pa.array(n[at : at + 100_000])], names=["lang", "code", "n"])

    return src.mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Sorted hash arrays per order: ``keys[k]`` with ``logp[k]``, ``contexts[k]`` with ``weight[k]``."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        per = []
        for name in self.langs:
            code, n = counts[name]
            order = np.argsort(code)
            per.append(_orders(code[order], n[order].astype(float)))
        self.keys, self.logp, self.contexts, self.weight, self.base = {}, {}, {}, {}, 0.0
        size = len(self.langs)
        if not size:
            return
        alphabet = np.unique(np.concatenate([p[1][0] for p in per]))
        prob: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.empty(0, np.uint64), np.full((1, size), 1.0 / (len(alphabet) + 1)))}
        for k in range(1, ORDER + 1):
            mask = np.uint64((1 << (16 * (k - 1))) - 1)
            g = np.unique(np.concatenate([p[k][0] for p in per]))
            h = np.unique(g >> np.uint64(16))
            lower = _find(prob[k - 1], g & mask, k - 1)
            out, gamma = np.empty((len(g), size)), np.ones((len(h), size))
            for j, p in enumerate(per):
                code, n = p[k]
                once, two = (n == 1).sum(), (n == 2).sum()
                d = once / (once + 2 * two) if once else 0.0
                ctx = code >> np.uint64(16)
                start = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
                total = np.add.reduceat(n, start)
                kinds = np.diff(np.append(start, len(code)))
                at = np.searchsorted(h, ctx[start])
                gamma[at, j] = np.maximum(d * kinds / total, 1e-9)
                tot = np.zeros(len(h))
                tot[at] = total
                spot = np.searchsorted(h, g >> np.uint64(16))
                c = np.zeros(len(g))
                c[np.searchsorted(g, code)] = np.maximum(n - d, 0)
                out[:, j] = np.where(tot[spot] > 0, c / np.maximum(tot[spot], 1), 0) + gamma[spot, j] * lower[:, j]
            prob[k] = (g, out)
            order, corder = np.argsort(hashed(g)), np.argsort(hashed(h))
            self.keys[k], self.logp[k] = hashed(g)[order], np.log2(np.maximum(out[order], 1e-12)).astype(np.float32)
            self.contexts[k], self.weight[k] = hashed(h)[corder], np.log2(gamma[corder]).astype(np.float32)
        self.base = float(np.log2(prob[0][1][0, 0]))

    def score(self, code: np.ndarray) -> np.ndarray:
        """log2 probabilities, a row per gram and a column per language."""
        out = np.empty((len(code), len(self.langs)), dtype=np.float32)
        left = np.arange(len(code))
        extra = np.zeros((len(code), len(self.langs)), dtype=np.float32)
        for k in range(ORDER, 0, -1):
            g = code[left] & np.uint64((1 << (16 * k)) - 1 if k < 4 else 0xFFFFFFFFFFFFFFFF)
            key = hashed(g)
            at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == key
            if k == ORDER and hit.all():
                return self.logp[k][at]
            out[left[hit]] = self.logp[k][at[hit]] + extra[left[hit]]
            left, g = left[~hit], g[~hit]
            if not len(left):
                return out
            key = hashed(g >> np.uint64(16))
            at = np.minimum(np.searchsorted(self.contexts[k], key), len(self.contexts[k]) - 1)
            hit = self.contexts[k][at] == key
            extra[left[hit]] += self.weight[k][at[hit]]
        out[left] = self.base + extra[left]
        return out


def _orders(code: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of the top order, continuation counts (distinct characters in front) of the lower ones."""
    out = {ORDER: (code, n)}
    g = code
    for k in range(ORDER - 1, 0, -1):
        g, n = np.unique(g & np.uint64((1 << (16 * k)) - 1), return_counts=True)
        out[k] = (g, n.astype(float))
    return out


def _find(table: tuple[np.ndarray, np.ndarray], g: np.ndarray, k: int) -> np.ndarray:
    if k == 0:
        return np.repeat(table[1], len(g), axis=0)
    return table[1][np.searchsorted(table[0], g)]


def train(counts: DataFrame) -> Model:
    """The driver's part: from gram counts, whose number is checked, to the arrays."""
    size = counts.count()
    if size:
        grams_, langs_ = counts.select("code").distinct().count(), counts.select("lang").distinct().count()
        if grams_ * langs_ > MAX_CELLS:
            raise ValueError(f"{grams_} grams of {langs_} languages; the model is meant for a product of at most {MAX_CELLS}")
    table = counts.toArrow()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    code = np.asarray(table.column("code").combine_chunks()).view(np.uint64) if size else np.empty(0, np.uint64)
    n = np.asarray(table.column("n").combine_chunks()) if size else np.empty(0)
    return Model({name: (code[langs == name], n[langs == name]) for name in sorted(set(langs))})


def entropies(docs: DataFrame, model: Model, key: str, text: str, carry: list[str]) -> DataFrame:
    """``(key, carry..., chars, bits)``: cross-entropy per character for each language; null where there is no letter."""
    src = docs.select(F.col(key).alias("_key"), *carry, F.col(text).alias("_text"))
    schema = T.StructType([*src.drop("_text").schema.fields, T.StructField("chars", T.LongType()), T.StructField("bits", T.ArrayType(T.DoubleType()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size checked in train()
    size = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "_text", STEP):
            texts = [t if t and has_letter(t) else None for t in strings(batch, "_text")]
            some = [i for i, t in enumerate(texts) if t is not None] if size else []
            total, count = np.zeros((len(some), size)), np.zeros(len(some), dtype=np.int64)
            if some:
                code, whose = grams([texts[i] for i in some])
                for at in range(0, len(code), STEP):
                    part, own = m.score(code[at : at + STEP]), whose[at : at + STEP]
                    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    total[own[start]] += np.add.reduceat(part.astype(np.float64), start, axis=0)
                    count[own[start]] += np.diff(np.append(start, len(own)))
            bits: list = [None] * len(texts)
            chars = [0] * len(texts)
            for i, t, c in zip(some, total, count, strict=True):
                bits[i], chars[i] = (-t / max(c, 1)).tolist(), int(c)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chars, pa.int64()), pa.array(bits, pa.list_(pa.float64()))], names=schema.names)

    return src.mapInArrow(run, schema)


def features(bits: np.ndarray, chars: np.ndarray, mean: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language, features of the score) of each row of cross-entropies; languages of infinite ones don't take part."""
    order = np.sort(bits, axis=1)
    best = np.argmin(bits, axis=1)
    margin = np.where(np.isfinite(order[:, 1]), order[:, 1] - order[:, 0], 0.0) if bits.shape[1] > 1 else np.ones(len(bits))
    far = (order[:, 0] - mean[best]) / np.sqrt(sigma[best] ** 2 + NOISE / np.maximum(chars, 1))
    return best, np.column_stack([margin, margin * np.sqrt(np.minimum(chars, MAX_CHARS)), np.clip(far, -MAX_SIGMAS, MAX_SIGMAS)])


def feature_columns(bits: Column, chars: Column, best: Column, mean: np.ndarray, sigma: np.ndarray) -> list[Column]:
    """The same as columns."""
    at = F.array_position(bits, best).cast("int") - 1
    listed = lambda xs: F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")
    margin = F.when(F.size(bits) > 1, F.array_sort(bits)[1] - best).otherwise(F.lit(1.0))
    sd = F.sqrt(F.pow(F.get(listed(sigma), at), F.lit(2)) + F.lit(NOISE) / F.greatest(chars, F.lit(1)))
    far = (best - F.get(listed(mean), at)) / sd
    return [margin, margin * F.sqrt(F.least(chars, F.lit(MAX_CHARS)).cast("double")), F.least(F.lit(MAX_SIGMAS), F.greatest(F.lit(-MAX_SIGMAS), far))]


def calibrate(bits: np.ndarray, chars: np.ndarray, own: np.ndarray, mean: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Weights of the score: rows as they are, and with their own language taken away."""
    without = bits.copy()
    without[np.arange(len(bits)), own] = np.inf
    best, x = features(bits, chars, mean, sigma)
    _, z = features(without, chars, mean, sigma)
    return fit_logistic(np.vstack([x, z]), np.concatenate([best == own, np.zeros(len(z), dtype=bool)]).astype(float))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression with intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def identify(docs: DataFrame, trained_on: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", reject: bool = True) -> DataFrame:
    """The operator: ``(key, trained_on, lang_pred, score, bits, rejected)`` per row.

    ``trained_on`` says which rows' texts and languages may be learned from.
    """
    ship(docs.sparkSession)
    own = {n: helper(docs, f"_{n}") for n in ("train", "fold", "lang")}
    learn = F.coalesce(trained_on, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    many = [r["g"] for r in docs.where(learn).groupBy(F.col(lang).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FOLD_FROM).collect()]  # a row per language
    folded = learn & F.col(lang).cast("string").isin(many) & (F.pmod(F.xxhash64(F.col(key), F.lit("fold")), F.lit(FOLD)) == 0)
    model = train(materialize(count_grams(docs.where(learn & ~folded), text, lang), "grams"))
    names = F.array(*[F.lit(x) for x in model.langs]).cast("array<string>")
    flagged = docs.withColumns({own["train"]: F.coalesce(trained_on, F.lit(False)), own["fold"]: folded if many else learn, own["lang"]: F.col(lang).cast("string")})
    rows = materialize(entropies(flagged, model, key, text, list(own.values())), "entropies").withColumnsRenamed({v: f"_{k}" for k, v in own.items()})
    known = rows.where("_fold AND bits IS NOT NULL").withColumn("own", F.array_position(names, F.col("_lang")).cast("int") - 1).where("own >= 0")
    mean, sigma = np.full(len(model.langs), np.inf), np.full(len(model.langs), LEAST_SIGMA)
    stats = known.groupBy("own").agg(F.avg(F.col("bits")[F.col("own")]).alias("m"), F.stddev_pop(F.col("bits")[F.col("own")]).alias("s")).collect()  # a row per language
    for r in stats:
        mean[r["own"]], sigma[r["own"]] = r["m"], max(LEAST_SIGMA, r["s"])
    if stats:
        mean[np.isinf(mean)] = np.mean([r["m"] for r in stats])  # languages too rare for the fold
    sample = known.select("bits", "chars", "own", F.xxhash64("_key").alias("h")).orderBy("h").limit(CALIBRATION_ROWS).toPandas()
    w = calibrate(np.array(sample["bits"].tolist()), sample["chars"].to_numpy(), sample["own"].to_numpy(), mean, sigma) if len(sample) and len(model.langs) > 1 else None
    best = F.array_min("bits")
    guess = F.get(names, F.array_position("bits", best).cast("int") - 1)
    columns = feature_columns(F.col("bits"), F.col("chars"), best, mean, sigma)
    z = F.lit(0.0) if w is None else sum((F.lit(float(a)) * c for a, c in zip(w[1:], columns, strict=True)), F.lit(float(w[0])))
    alone = len(model.langs) == 1
    score = F.when(guess.isNull(), F.lit(0.0)).when(F.lit(alone), F.lit(1.0)).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
    rejected = guess.isNull() | (columns[2] > REJECT_SIGMAS if alone else (score < 0.5) & F.lit(w is not None))
    pred = F.when(guess.isNull() | (rejected & F.lit(reject)), F.lit("und")).otherwise(guess)
    return rows.select(F.col("_key").alias(key), F.col("_train").alias("trained_on"), pred.alias("lang_pred"), score.alias("score"), rejected.alias("rejected"), "bits")
