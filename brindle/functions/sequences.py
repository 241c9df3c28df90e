"""Sequence ratios of whole texts, as difflib has them, and bounds that rule nearly all unlike texts out, for blocks of texts at once.

difflib sets aside what makes up over a hundredth of a text b of 200 characters and more.
Each matching block then holds a character that is rare in b, but for one at the very start,
so that there are few blocks, and texts with long matching parts share many runs of RUN characters.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

import numpy as np

#: Characters of the runs by which texts are compared.
RUN = 8
_STEP = 64


def _rare(b: str) -> dict[str, list[int]]:
    """Where each character of b that difflib doesn't set aside stands."""
    most = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    kept = {c for c in set(b) if b.count(c) <= most}
    at = defaultdict(list)
    for j, c in enumerate(b):
        if c in kept:
            at[c].append(j)
    return dict(at)


def _runs(a: str, b: str, spots: list[int], at: dict[str, list[int]]) -> np.ndarray:
    """(start in a, start in b, length) of all equal runs of two rare characters and more."""
    second = defaultdict(list)
    for j in sorted(j for where in at.values() for j in where):
        if j + 1 < len(b) and b[j + 1] in at:
            second[b[j : j + 2]].append(j)
    found, before, last = [], {}, -2
    for i in spots:
        now = {}
        for j in second.get(a[i : i + 2], ()):
            n = before.pop(j - 1, 1) + 1 if last == i - 1 else 2
            now[j] = n
        found += [(last + 2 - n, j + 2 - n, n) for j, n in before.items()]
        before, last = now, i
    found += [(last + 2 - n, j + 2 - n, n) for j, n in before.items()]
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def ratio(a: str, b: str, need: float = 0.0, at: dict[str, list[int]] | None = None) -> float | None:
    """SequenceMatcher(None, a, b).ratio(), or None where it is below need; at is _rare(b), if it's at hand.

    Only rare characters are gone through, and parts that can't match any more end the search.
    """
    total = len(a) + len(b)
    if a == b:
        return 1.0 if need <= 1 else None
    may = min(len(a), len(b))
    if 2.0 * may / total < need:
        return None
    at = _rare(b) if at is None else at
    spots = [i for i, c in enumerate(a) if c in at]
    open_ = [(0, len(a), 0, len(b), _runs(a, b, spots, at), False)]
    while open_:
        alo, ahi, blo, bhi, runs, bare = open_.pop()
        i, j, k = alo, blo, 0
        if len(runs):
            skip = np.maximum(np.maximum(alo - runs[:, 0], blo - runs[:, 1]), 0)
            left = np.minimum(np.minimum(ahi - runs[:, 0], bhi - runs[:, 1]), runs[:, 2]) - skip
            kept = left > 1
            runs = np.column_stack([runs[:, 0] + skip, runs[:, 1] + skip, left])[kept]
        if len(runs):
            longest = runs[runs[:, 2] == runs[:, 2].max()]
            i, j, k = map(int, longest[np.lexsort((longest[:, 1], longest[:, 0]))[0]])
        elif not bare:
            for n in range(bisect_left(spots, alo), bisect_left(spots, ahi)):
                where = at[a[spots[n]]]
                m = bisect_left(where, blo)
                if m < len(where) and where[m] < bhi:
                    i, j, k = spots[n], where[m], 1
                    break
        alone = k < 2
        while i - _STEP >= alo and j - _STEP >= blo and a[i - _STEP : i] == b[j - _STEP : j]:
            i, j, k = i - _STEP, j - _STEP, k + _STEP
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k + _STEP <= ahi and j + k + _STEP <= bhi and a[i + k : i + k + _STEP] == b[j + k : j + k + _STEP]:
            k += _STEP
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        may -= min(ahi - alo, bhi - blo) - k
        if k:
            may += min(i - alo, j - blo) + min(ahi - i - k, bhi - j - k)
            if i > alo and j > blo:  # the first match of a single character leaves none before it
                open_.append((alo, i, blo, j, runs, alone))
            if i + k < ahi and j + k < bhi:
                open_.append((i + k, ahi, j + k, bhi, runs, False))
        if 2.0 * may / total < need:
            return None
    return 2.0 * may / total


class Block:
    """Texts with what bounds their ratios; characters are counted by the last byte of their codes, which can only raise a bound."""

    def __init__(self, texts: Sequence[str], counted: bool = True):
        self.texts, self.size = list(texts), np.array([len(t) for t in texts], dtype=np.int64)
        self.letters, self.rare = (np.zeros((len(self.texts), 256), dtype=np.int32) for _ in range(2))
        self._at, self._features = {}, None
        for n, text in enumerate(self.texts if counted else ()):
            codes, counts = np.unique(_codes(text), return_counts=True)
            few = counts <= (len(text) // 100 + 1 if len(text) >= 200 else len(text))
            self.letters[n] = np.bincount(codes & 255, counts, 256)
            self.rare[n] = np.bincount(codes[few] & 255, counts[few], 256)

    def at(self, n: int) -> dict[str, list[int]]:
        if n not in self._at:
            self._at[n] = _rare(self.texts[n])
        return self._at[n]

    def some(self, rows: np.ndarray) -> Block:
        """These texts only, for features()."""
        return self if len(rows) == len(self.texts) else Block([self.texts[n] for n in rows], False)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, texts): each text's runs of RUN characters, the first, second and further ones of a kind apart, by hash."""
        if self._features is None:
            hashes = [_run_hashes(t) for t in self.texts]
            rows = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
            every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
            order = np.argsort(every)
            self._features = every[order], rows[order]
        return self._features


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _run_hashes(text: str) -> np.ndarray:
    x = _codes(text).astype(np.uint64)
    n = len(x) - RUN + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
    h.sort()
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    h = (h + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts, for all rows of a and b."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for c in np.flatnonzero(a.any(0) & b.any(0)):
        out += np.minimum.outer(a[:, c], b[:, c])
    return out


def _shared(a: Block, b: Block) -> np.ndarray:
    """How many runs of RUN characters all texts of a and b share at most."""
    (fa, ra), (fb, rb) = a.features(), b.features()
    rows, columns = len(a.texts), len(b.texts)
    (ua, sa, ca), (ub, sb, cb) = (np.unique(f, return_index=True, return_counts=True) for f in (fa, fb))
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    sa, ca, sb, cb = sa[ia], ca[ia], sb[ib], cb[ib]
    out = np.zeros(rows * columns, dtype=np.int64)
    dense = ca * cb * 16 > rows * columns if rows * columns > 4096 else np.zeros(len(ca), dtype=bool)
    for part in np.array_split(np.flatnonzero(dense), dense.sum() // 2048 + 1):
        x, y = np.zeros((len(part), rows), dtype=np.float32), np.zeros((len(part), columns), dtype=np.float32)
        for n, f in enumerate(part):
            x[n, ra[sa[f] : sa[f] + ca[f]]] = 1
            y[n, rb[sb[f] : sb[f] + cb[f]]] = 1
        out += (x.T @ y).astype(np.int64).ravel()
    some = ~dense
    sa, ca, sb, cb = sa[some], ca[some], sb[some], cb[some]
    cost = ca * cb
    ends = np.cumsum(cost)
    at = 0
    while at < len(cost):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
        c = cost[at:stop]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        width = np.repeat(cb[at:stop], c)
        i = ra[np.repeat(sa[at:stop], c) + nth // width].astype(np.int64)
        out += np.bincount(i * columns + rb[np.repeat(sb[at:stop], c) + nth % width], minlength=rows * columns)
        at = stop
    return out.reshape(rows, columns)


def possible(a: Block, b: Block, need: np.ndarray, both: bool = False) -> list[np.ndarray]:
    """Where the ratios of a's texts with b's may reach need (NaN: isn't asked for); with both also those of b's texts with a's.

    need is then a pair of matrices, of a by b and of b by a. Matching parts hold no more of
    a letter than either text; k of them hold no more than the shared runs and RUN - 1
    characters each, and there are no more parts than shared rare characters, and one.
    """
    needs = list(need) if both else [need]
    sides = [(a, b), (b, a)][: len(needs)]
    letters = _common(a.letters, b.letters)
    least = [n * (x.size[:, None] + y.size[None]) / 2 - 1e-6 for n, (x, y) in zip(needs, sides)]
    with np.errstate(invalid="ignore"):
        open_ = [((letters if x is a else letters.T) >= m) for m, (x, _) in zip(least, sides)]
        if not any(o.any() for o in open_):
            return open_
        rows, columns = (np.flatnonzero(sum((o if x is a else o.T).any(axis) for o, (x, _) in zip(open_, sides))) for axis in (1, 0))
        shared = np.zeros(letters.shape, dtype=np.int64)
        shared[np.ix_(rows, columns)] = _shared(a.some(rows), a.some(columns) if b is a else b.some(columns))
        return [o & ((_common(x.letters, y.rare) + 1) * (RUN - 1) + (shared if x is a else shared.T) >= m) for o, m, (x, y) in zip(open_, least, sides)]
