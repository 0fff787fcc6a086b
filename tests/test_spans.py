"""MaxSim spans against brute force."""

import random

from lodestone import plans
from lodestone.operators import retrieval


def slow(word, others):
    cut = lambda w: {(" " + w + " ")[i : i + 3] for i in range(len(w))}
    return max((1.0 if word == o else len(cut(word) & cut(o)) / max(1, len(cut(word) | cut(o))) for o in others), default=0.0)


def test_max_sims():
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(300)]
    assert retrieval.max_sims(words[:200], words[200:]) == [slow(w, words[200:]) for w in words[:200]]
    assert retrieval.max_sims(["a"], []) == [0.0]


def test_near_words_make_spans(spark, tmp_path):
    rows = [(1, 0, "He walked home with one word"), (1, 1, "Then who walks home with a word, now"), (2, 0, None), (2, 1, "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in plans.QUERIES["max_sim_spans"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 3, 5), (1, 1, 6, 7)]
