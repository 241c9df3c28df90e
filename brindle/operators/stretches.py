"""How well words fit some stretch of long texts, by trigrams, in time and space that grow with the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import fold

#: Windows are looked at one by one until that took this many times the text's length; the rest goes through two pointers.
EFFORT = 4
#: More than the trigrams of any text.
FAR = (1 << 31) - 1
#: Windows of up to 2 ** LEAST_LEVEL pieces share their running sums.
LEAST_LEVEL = 4
#: Pieces that are summed up in the time that one window takes besides its own.
ONCE = 2000
#: Trigrams of texts that are looked at together.
TOGETHER = 200_000
#: Letters and digits as they are, all else as blanks; and the numbers that stand for them.
_KEPT = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in map(chr, range(256))).encode()
_NUMBERS = np.array([0 if c == 32 else c - 47 if c < 58 else c - 86 for c in _KEPT], np.uint16)


def grams(folded: str) -> np.ndarray:
    """The trigrams of text.trigram_list in order, as numbers of 16 bits (37 kinds of letters)."""
    words = folded.encode("ascii", "replace").translate(_KEPT).split()
    if not words:
        return np.zeros(0, np.uint16)
    b = _NUMBERS[np.frombuffer(b"  " + b"   ".join(words) + b" ", np.uint8)]
    # no piece of a word ends with two blanks: these are where words meet
    return (b[:-2] * np.uint16(1369) + b[1:-1] * np.uint16(37) + b[2:])[(b[1:-1] | b[2:]) != 0]


def earlier_places(pieces: np.ndarray) -> np.ndarray:
    """Where each piece stood before, -1 for the first of its kind."""
    out = np.full(len(pieces), -1)
    order = np.argsort(pieces, kind="stable")
    ordered = pieces[order]
    same = ordered[1:] == ordered[:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def _sweep(others: list, first: list, last: list) -> Iterator[int]:
    """Distinct pieces of windows of which each begins and ends no earlier than the one before; None is no piece."""
    held, i, j = Counter(), 0, 0
    for a, b in zip(first, last, strict=True):
        while j <= b:
            if others[j] is not None:
                held[others[j]] += 1
            j += 1
        while i < a:
            if (x := others[i]) is not None:
                held[x] -= 1
                if not held[x]:
                    del held[x]
            i += 1
        yield len(held)


def best_stretch(pieces: np.ndarray, earlier: np.ndarray, wanted: np.ndarray) -> float:
    """The greatest Jaccard similarity of the wanted pieces (sorted, distinct) and those of a stretch of the text."""
    return float(best_stretches(pieces, distances(earlier), np.array([0, len(pieces)]), wanted)[0])


def distances(earlier: np.ndarray) -> np.ndarray:
    """How far back each piece of a text was, from earlier_places(); more than any text is long for the first of its kind."""
    return np.where(earlier < 0, FAR, np.arange(len(earlier)) - earlier).astype(np.int32)


def best_stretches(pieces: np.ndarray, back: np.ndarray, limits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The same for texts that stand one after the other: text i from limits[i] to limits[i + 1], back being the distances() of each.

    A best stretch of s wanted pieces is a smallest one: it begins and ends with a wanted piece
    and no shorter one within it has as many. For each s the smallest stretches begin ever later,
    so that their other pieces can be counted by two pointers. A lower bound of that count, from
    running sums, spares nearly all of them.
    """
    m, n = len(wanted), len(pieces)
    best = np.zeros(len(limits) - 1)
    if not m or not n:
        return best
    slot = _slots(pieces, wanted)
    shared = slot < m
    at = np.flatnonzero(shared)
    if not len(at):
        return best
    text = np.searchsorted(limits, at, "right") - 1
    latest = np.full((m, len(at)), -1)
    latest[slot[at], np.arange(len(at))] = at
    latest = np.maximum.accumulate(latest, axis=1)
    latest[latest < limits[text]] = -1  # of a text before
    latest = -np.sort(-latest, axis=0)  # row s - 1: where a smallest stretch of s wanted pieces begins
    back = np.where(shared, 0, back)  # wanted pieces never count as others
    sums: dict[int, np.ndarray] = {}
    others: dict[int, list] = {}
    for s in range(m, 0, -1):
        ok = (latest[s - 1] >= 0) & (s / m > best[text])
        a, b, of = latest[s - 1][ok], at[ok], text[ok]
        if not len(a):
            continue
        fresh = np.ones(len(a), bool)
        fresh[1:] = a[1:] != a[:-1]
        a, b, of = a[fresh], b[fresh], of[fresh]
        # a piece that wasn't there for longer than the stretch is new in it
        level = np.maximum(2 * np.ceil(np.log2(b - a + 1) / 2).astype(int), LEAST_LEVEL)
        least = np.zeros(len(a), np.int64)
        for t in np.flatnonzero(np.bincount(level)).tolist():
            # longer stretches have what is new in their last pieces; if that is too much already, they aren't looked at again
            long = np.flatnonzero((level >= t) & (s / (m + least) > best[of]))
            if t not in sums and len(long) * ((1 << t) + ONCE) <= n:
                continue  # so few that they are looked at sooner than summed up
            if t not in sums:
                sums[t] = np.zeros(n + 1, np.int32)
                np.cumsum(back >= 1 << t, out=sums[t][1:])
            ends = b[long] + 1
            least[long] = np.maximum(least[long], sums[t][ends] - sums[t][np.maximum(a[long], ends - (1 << t))])
        open_ = np.flatnonzero(s / (m + least) > best[of])
        left: dict[int, list[int]] = {}
        spent: Counter = Counter()
        for i in open_[np.lexsort((least[open_], of[open_]))].tolist():
            d = int(of[i])
            if s / (m + int(least[i])) <= best[d]:
                continue
            x, y = int(a[i]), int(b[i]) + 1
            spent[d] += y - x
            if spent[d] > EFFORT * (limits[d + 1] - limits[d]):
                left.setdefault(d, []).append(i)
            else:
                best[d] = max(best[d], s / (m + int(np.count_nonzero(back[x:y] > np.arange(y - x)))))
        for d, windows in left.items():
            start, end = int(limits[d]), int(limits[d + 1])
            if d not in others:
                others[d] = [None if x else p for x, p in zip(shared[start:end].tolist(), pieces[start:end].tolist(), strict=True)]
            windows = np.sort(windows)
            best[d] = max(best[d], s / (m + min(_sweep(others[d], (a[windows] - start).tolist(), (b[windows] - start).tolist()))))
    return best


def _slots(pieces: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each piece among the wanted ones; their number for others."""
    m = len(wanted)
    if pieces.dtype != np.uint16:
        slot = np.minimum(np.searchsorted(wanted, pieces), m - 1)
        return np.where(wanted[slot] == pieces, slot, m)
    places = np.full(1 << 16, m, np.uint8 if m < 256 else np.int32)
    places[wanted] = np.arange(m)
    return places[pieces]


def word_scores(df: DataFrame, key: str, text: Column, words: Sequence[str], least: float | None = None) -> DataFrame:
    """(key, word, similarity) for each row and each of the words: how well the word fits some stretch of the text.

    The same as search.word_similarity, for texts of any length and many words in one pass: each
    text is cut into trigrams once. Rows stay in their partitions. A word or a text without letters
    gives 0, a null text null; with `least`, only similarities from there on have a row. Equal
    words count once.
    """
    spark = df.sparkSession
    names = list(dict.fromkeys(words))
    folded = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(names)], "i long, w string").orderBy("i").select(fold(F.col("w"))).collect()] if names else []
    wanted = [(w, np.unique(grams(x))) for w, x in zip(names, folded, strict=True)]

    def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Runs of texts of about as many trigrams as are looked at together."""
        first, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
            held += n
            if held > TOGETHER or i == len(texts) - 1:
                yield first, i + 1
                first, held = i + 1, 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("x")
            rows, found, values = [], [], []
            for first, last in parts(texts):
                cut = [grams(x.as_py() or "") for x in texts.slice(first, last - first)]
                limits = np.cumsum([0, *map(len, cut)])
                pieces, back = np.concatenate(cut), np.concatenate([distances(earlier_places(x)) for x in cut])
                none = [not x.is_valid for x in texts.slice(first, last - first)]
                for w, g in wanted:
                    for i, (v, null) in enumerate(zip(best_stretches(pieces, back, limits, g).tolist(), none, strict=True), first):
                        if least is None or (not null and v >= least):
                            rows.append(i), found.append(w), values.append(None if null else v)
            columns = [batch.column("k").take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "word", "similarity"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), fold(text).alias("x")).mapInArrow(score, f"`{key}` {kind}, word string, similarity double")
