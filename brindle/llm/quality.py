"""Quality classifier: weak labels, their accuracies by expectation-maximisation, and a hashed linear scorer.

Labellers are cheap heuristics that overlap; each says good, bad or nothing. The pattern of
their votes is counted over all documents; there are at most 3 ** len(LABELLERS) patterns,
so that the counts are small whatever the corpus. Expectation-maximisation on the counts
estimates how often each labeller says what about good and bad documents, and gives each
pattern a posterior. A bounded sample then trains a logistic scorer of hashed byte trigrams
on the posteriors, and the scorer judges every document by its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import discard, materialize

#: Documents that the scorer is fitted on, about, of each class; MOST times that is the limit for both together.
SAMPLE, MOST = 1500, 4
#: With fewer documents of either class than this, there's nothing to learn and all are kept.
LEAST = 5
BUCKETS = 1 << 11
#: Documents of a lower score go. It is low, as a lost good document costs more than a kept bad one.
THRESHOLD = 0.2
ABSTAIN, BAD, GOOD = 0, 1, 2

_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_UPPER = bytes(c for c in range(128) if chr(c).isupper())
_LOWER = bytes(c for c in range(128) if chr(c).islower())
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?")


@dataclass
class Facts:
    """What labellers look at."""

    n: int
    letters: float
    upper: float
    marks: float
    words: list[bytes]
    kinds: Counter[bytes]
    same: list[bool]  # whether each word but the first is the one before it
    lines: list[bytes]


def facts(text: str) -> Facts:
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lower = len(raw) - len(raw.translate(None, _LOWER))
    beyond = len(raw) - len(raw.translate(None, bytes(range(128, 256))))
    words = raw.split()
    return Facts(
        n=len(raw),
        letters=(upper + lower + beyond) / n,
        upper=upper / max(1, upper + lower),
        marks=(len(raw) - len(raw.translate(None, _MARKS))) / n,
        words=words,
        kinds=Counter(words),
        same=list(map(eq, words, words[1:])),
        lines=[x for x in raw.split(b"\n") if x.strip()],
    )


def _limits(value: float, good: float, bad: float) -> int:
    """good up to one limit, bad from the other."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def _shouting(f: Facts) -> int:
    return _limits(f.upper, 0.25, 0.4)


def _marked(f: Facts) -> int:
    return _limits(f.marks, 0.02, 0.06)


def _lettered(f: Facts) -> int:
    return _limits(1 - f.letters, 0.3, 0.42)


def _worded(f: Facts) -> int:
    """Words that end in several marks, or are marks alone."""
    if not f.words:
        return BAD
    ends = [(w, n) for w, n in f.kinds.items() if w[-1] in _MARKS]
    odd = sum(n for w, n in ends if len(w) > 2 and w[-2] in _MARKS or w.translate(None, _MARKS) == b"")
    return _limits(odd / len(f.words), 0.02, 0.15)


def _sentences(f: Facts) -> int:
    if not f.lines:
        return BAD
    ends = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in f.lines) / len(f.lines)
    return GOOD if ends >= 0.7 else BAD if ends <= 0.2 else ABSTAIN


def _varied(f: Facts) -> int:
    """Whether few words make up the text; short texts say nothing."""
    if len(f.words) < 50:
        return ABSTAIN
    kinds = len(f.kinds) / len(f.words) ** 0.8
    return BAD if kinds < 0.25 else GOOD if kinds > 0.8 else ABSTAIN


def _stutter(f: Facts) -> int:
    """Words that repeat the word before them; short texts say nothing."""
    if len(f.words) < 20:
        return ABSTAIN
    return _limits(sum(f.same) / max(1, len(f.words)), 0.04, 0.2)


def _runs(f: Facts) -> int:
    """The longest run of one word."""
    most = 1
    if any(f.same):
        most += max(sum(run) for _, run in groupby(f.same))
    return _limits(most, 2, 6)


def _piped(f: Facts) -> int:
    """Lists and tables that are held together by bars."""
    if not f.words:
        return BAD
    return _limits(sum(f.kinds[w] for w in (b"|", b"||", b">", b"\xc2\xbb")) / len(f.words), 0.01, 0.1)


def _cased(f: Facts) -> int:
    """Sentences that begin with a capital."""
    if not f.lines:
        return BAD
    share = sum(x.lstrip()[:1].isupper() or x.lstrip()[0] > 127 for x in f.lines) / len(f.lines)
    return GOOD if share >= 0.6 else BAD if share <= 0.2 else ABSTAIN


LABELLERS: tuple[Callable[[Facts], int], ...] = (
    _shouting, _marked, _lettered, _worded, _sentences, _varied, _stutter, _runs, _piped, _cased,
)


def votes(text: str | None, labellers=LABELLERS) -> int:
    """The labellers' votes as digits of a number to base three."""
    f = facts(text or "")
    return sum(label(f) * 3**i for i, label in enumerate(labellers))


def unfold(patterns: np.ndarray, n: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n)[None, :] % 3


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, n: int, rounds: int = 200) -> np.ndarray:
    """Posterior of good for each vote pattern.

    Labellers are taken as independent given the class. tables[c, i, v] is how often labeller
    i, if it votes at all, votes v about class c; saying nothing tells nothing. The start holds that labellers are right more often than wrong
    and that good documents seldom look bad, which names the classes; each round weighs patterns by posterior and counts again.
    """
    vote = unfold(patterns, n)
    tables = np.ones((2, n, 3))
    tables[0], tables[1] = (1, 0.5, 0.5), (1, 0.03, 0.97)
    prior = np.array([0.3, 0.7])
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        log = np.log(prior)[:, None] + np.log(tables[:, np.arange(n)[None, :], vote]).sum(2)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        for v in (BAD, GOOD):
            tables[:, :, v] = weight @ (vote == v) + 1
        tables[:, :, BAD:] /= tables[:, :, BAD:].sum(2, keepdims=True)
    return posterior


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed byte trigrams of the whole text, plain and with letters and digits as classes; then word repeats.

    Two more places, hashed from their names, hold the shares of words that do and don't
    repeat the word before them.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    total = np.zeros(buckets, np.float64)
    if len(raw) < 3:
        return total
    shape = _SHAPES[raw]
    for at in range(0, len(raw) - 2, 1 << 20):
        for kind, salt in ((raw, 0x9E3779B1), (shape, 0x85EBCA77)):
            part = kind[at : at + (1 << 20) + 2].astype(np.uint32)
            code = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(salt)
            total += np.bincount(code >> np.uint32(32 - (buckets - 1).bit_length()), minlength=buckets)
    words = (text or "").split()
    same = sum(map(eq, words, words[1:])) / max(1, len(words))
    total /= total.sum()
    for name, share in (("same", same), ("other", 1 - same)):
        total[xxhash.xxh32_intdigest(name) % buckets] += share
    return np.sqrt(total)


_SHAPES = np.array(
    [ord("0") if chr(c).isdigit() else ord("A") if chr(c).isupper() else ord("a") if chr(c).isalpha() else c for c in range(128)]
    + [ord("a")] * 128,
    np.uint8,
)


#: The bias of a scorer that keeps everything.
KEEP = 10.0


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 250, penalty: float = 1e-4) -> np.ndarray:
    """Weights and bias of a logistic scorer for soft labels; classes weigh alike."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    if not len(y):
        return np.r_[w, KEEP]
    good, bad = y.sum(), (1 - y).sum()
    weight = y / max(good, 1e-9) + (1 - y) / max(bad, 1e-9) if min(good, bad) > 1e-3 else np.ones(len(y))
    weight = weight / weight.sum()
    step, seen_w, seen_b = 4.0, np.zeros_like(w), 0.0
    for _ in range(rounds):  # with momentum
        p = 1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * seen_w) + bias + 0.9 * seen_b, -500, 500)))
        gap = (p - y) * weight
        seen_w, seen_b = 0.9 * seen_w - step * (x.T @ gap + penalty * w), 0.9 * seen_b - step * gap.sum()
        w, bias = w + seen_w, bias + seen_b
    return np.r_[w, bias]


@dataclass
class Model:
    posteriors: dict[int, float]
    weights: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Count votes over all documents, and fit the scorer on about `sample` distinct texts of each class, MOST * sample at most.

    Texts are drawn by a hash of their own, so that the draw is the same on every run and copies
    of a text are drawn as one. With fewer than LEAST documents that the labellers take for
    good, or for bad, the scorer keeps everything.
    """
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    body = docs.select(text.alias("body"), F.xxhash64(text, F.lit(2)).alias("copy"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"copy": x["copy"], "pattern": [votes(t) for t in x["body"]]})

    voted = materialize(body.mapInPandas(vote, "copy long, pattern long"), "votes")
    got = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()  # at most 3 ** len(LABELLERS) rows
    patterns, counts = got["pattern"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    posterior = fit_label_model(patterns, counts, len(LABELLERS)) if len(got) else np.zeros(0)
    known = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    sure = (posterior > 0.5).astype(int)
    total = [counts[sure == c].sum() for c in (0, 1)]
    if min(total) < LEAST:
        discard(voted)
        return Model(known, fit_scorer(np.zeros((0, BUCKETS)), np.zeros(0)))
    limit = [int(min(1.0, sample / t) * (1 << 30)) for t in total]
    table = spark.createDataFrame([(k, p, limit[p > 0.5]) for k, p in known.items()], "pattern long, p double, most long")
    draw = F.pmod("copy", F.lit(1 << 30))
    drawn = voted.join(F.broadcast(table), "pattern").where(draw < F.col("most")).select("copy", "p").distinct().orderBy(draw, "copy").limit(MOST * sample)
    drawn = materialize(drawn, "drawn", spent=[voted])  # MOST * sample rows at most, so it may be broadcast

    def see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"copy": x["copy"], "p": x["p"], "x": [features(t).astype("<f4").tobytes() for t in x["body"]]})

    seen = body.join(F.broadcast(drawn), "copy").mapInPandas(see, "copy long, p double, x binary")
    got = seen.groupBy("copy", "p").agg(F.min("x").alias("x")).orderBy(draw, "copy").toPandas()  # as many rows as drawn
    discard(drawn)
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, BUCKETS)
    return Model(known, fit_scorer(x, got["p"].to_numpy(np.float64)))


def score(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, names: tuple[str | None, str, str] = ("posterior", "score", "keep")
) -> DataFrame:
    """docs with the label model's posterior (unless its name is None), the scorer's probability and its decision; columns of these names are replaced."""
    weights, known = model.weights, model.posteriors

    @F.pandas_udf("p double, s double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        p = [known.get(votes(t), 0.5) for t in texts] if names[0] else None
        s = [1 / (1 + np.exp(-np.clip(features(t) @ weights[:-1] + weights[-1], -500, 500))) for t in texts]
        return pd.DataFrame({"p": p, "s": s}, dtype="float64")

    judged = judge(F.col(text_col).cast("string"))
    taken = {c.lower() for c in docs.columns}
    own = next(n for n in (f"_j{i}" for i in range(len(taken) + 1)) if n not in taken)
    rows = docs.withColumn(own, judged).withColumns({n: F.col(own)[k] for n, k in zip(names, "ps", strict=False) if n})
    return rows.withColumn(names[2], F.col(names[1]) >= threshold).drop(own)


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that a model fitted on docs itself doesn't reject; no column is added or replaced."""
    taken = {c.lower() for c in docs.columns}
    tag = next(t for t in (f"_q{i}_" for i in range(len(taken) + 1)) if not any(c.startswith(t) for c in taken))
    scored = score(docs, fit(docs, text_col, sample), text_col, threshold, (None, tag + "s", tag + "keep"))
    return scored.where(tag + "keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def classify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE
) -> DataFrame:
    """(doc_id, posterior, score, keep) for every row, from a model fitted on docs itself.

    Null texts count as empty. Empty texts, and those too short for a trigram, have the score
    of the scorer's bias. Where there's nothing to learn (see fit) all are kept. Null and repeated ids and rows are judged each by itself; equal
    texts have equal scores; an empty table gives none; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return score(rows, fit(docs, text_col, sample), "body", threshold).drop("body")
