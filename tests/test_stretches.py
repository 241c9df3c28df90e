"""Fits of words in stretches of texts against all stretches."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import search, stretches


def plain(pieces, wanted):
    best, a = 0.0, set(wanted)
    for i in range(len(pieces)):
        seen = set()
        for p in pieces[i:]:
            seen.add(p)
            best = max(best, len(a & seen) / len(a | seen))
    return best


@pytest.mark.parametrize("effort", [0, 1, 4])
def test_against_all_stretches(monkeypatch, effort):
    """Few and many kinds of pieces, repetitive texts, absent pieces; with two pointers only, and with hardly any."""
    monkeypatch.setattr(stretches, "EFFORT", effort)
    rng = random.Random(effort)
    for _ in range(400):
        kinds, n = rng.choice([2, 3, 8, 30, 200]), rng.randrange(1, 90)
        pieces = np.array([rng.randrange(kinds) for _ in range(n)])
        if rng.random() < 0.3:
            pieces = np.tile(pieces[: rng.randrange(1, 9)], 9)
        wanted = np.unique([rng.randrange(kinds + 2) for _ in range(rng.randrange(1, 9))])
        assert stretches.best_stretch(pieces, stretches.earlier_places(pieces), wanted) == plain(pieces.tolist(), wanted.tolist())


def test_time_grows_with_the_text():
    rng = random.Random(1)
    wanted = np.unique(stretches.grams("between libraries"))
    for words in (["be", "tween", "xx", "lib", "ra"], [f"w{rng.randrange(5000)}" for _ in range(5000)] + ["library"]):
        pieces = stretches.grams(" ".join(rng.choice(words) for _ in range(100_000)))
        start = time.time()
        stretches.best_stretch(pieces, stretches.earlier_places(pieces), wanted)
        assert len(pieces) > 250_000 and time.time() - start < 30


def test_word_scores(spark):
    """The same as the expression for short texts; nulls, empty texts, accents, repeated words and keys, bounds, empty tables."""
    texts = ["two words", "wörd", "", None, "a-b c9", "The public libraries", "word word word", "wo rd", "two words", "WORDS, words"]
    df = spark.createDataFrame([(None if i == 4 else i % 8, t) for i, t in enumerate(texts)], "id int, t string")
    words = ["word", "libr", "", "Wörds", "word"]
    got = sorted(map(tuple, stretches.word_scores(df, "id", F.col("t"), words).collect()), key=str)
    each = [df.select("id", F.lit(w).alias("w"), search.word_similarity(F.lit(w), F.col("t")).alias("s")) for w in dict.fromkeys(words)]
    assert got == sorted((tuple(r) for e in each for r in e.collect()), key=str)
    assert len(got) == 40
    assert {r.id for r in stretches.word_scores(df, "id", F.col("t"), ["word"], 1.0).collect()} == {1, 6}
    assert stretches.word_scores(df.limit(0), "id", F.col("t"), words).count() == 0
    assert stretches.word_scores(df, "id", F.col("t"), []).count() == 0


@pytest.mark.parametrize(("effort", "once"), [(0, 0), (1, 0), (4, 0), (4, 2000)])
def test_texts_together(monkeypatch, effort, once):
    """Texts that stand one after the other, empty and repetitive ones among them, give what each gives alone; running sums are used always or seldom."""
    monkeypatch.setattr(stretches, "EFFORT", effort)
    monkeypatch.setattr(stretches, "ONCE", once)
    rng = random.Random(effort)
    for kind in (np.uint16, np.int64):
        for _ in range(40):
            kinds = rng.choice([2, 5, 40])
            texts = [np.array([rng.randrange(kinds) for _ in range(rng.choice([0, 1, 7, 60]))], kind) for _ in range(rng.randrange(1, 9))]
            texts.append(np.tile(texts[-1][:5], 12))
            wanted = np.unique(np.array([rng.randrange(kinds + 2) for _ in range(rng.randrange(1, 9))], kind))
            back = [stretches.distances(stretches.earlier_places(t)) for t in texts]
            got = stretches.best_stretches(np.concatenate(texts), np.concatenate(back), np.cumsum([0, *map(len, texts)]), wanted)
            assert got.tolist() == [plain(t.tolist(), wanted.tolist()) for t in texts]


def test_grams_are_those_of_words():
    line = "".join(f"  {w} " for w in ["ab", "c9", "z"])
    want = [line[i : i + 3] for i in range(len(line) - 2) if line[i + 1 : i + 3] != "  "]
    got = stretches.grams("-ab..C\N{LATIN SMALL LETTER E WITH ACUTE}c9 z\n")
    assert got.dtype == np.uint16
    letters = " 0123456789abcdefghijklmnopqrstuvwxyz"
    assert ["".join(letters[x // k % 37] for k in (1369, 37, 1)) for x in got.tolist()] == want
    assert not len(stretches.grams("")) and not len(stretches.grams("\N{LATIN SMALL LETTER E WITH ACUTE} !"))


def test_scores_do_not_depend_on_what_is_together(spark, monkeypatch):
    texts = [None, "", "the library", "between libraries", None, "licence " * 30, "erat", "betw een", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    rows = lambda least: sorted(map(tuple, stretches.word_scores(df, "id", F.col("t"), ["between", "licence", "erat"], least).collect()))
    whole, some = rows(None), rows(0.4)
    monkeypatch.setattr(stretches, "TOGETHER", 5)
    assert rows(None) == whole and rows(0.4) == some and len(whole) == 27 and some == [r for r in whole if r[2] is not None and r[2] >= 0.4]
