"""SimHash near-duplicates by a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint. Two fingerprints that differ in at most two bits
agree on at least one of any three blocks of bits, so fingerprints are dealt out by (block,
its value), and each such group is sorted by Gray rank and searched by a hierarchy of nodes
that hold the bit pattern all their members share. Groups that are too large are dealt out
again by three blocks of their remaining bits; after four such steps at most 13 bits remain,
so that no group can have over 8,192 members whatever the data are.

Links at a set similarity need more bits than that and a larger radius, which blocks can't
deal out. similar_groups() takes wide fingerprints and several tables of drawn bits. Rows of a
table carry a short sketch of the fingerprint only; the hierarchy searches each group of one key
by sketches, at a radius that hardly any similar pair exceeds. What these loose links connect is
searched again by whole fingerprints, again at a radius that hardly any similar pair exceeds,
and what is near there is compared by its shingles themselves: only pairs that are as similar as
was asked for link. Larger groups of either search are dealt out as pairs of blocks, so that all
pairs of a group meet whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.components import connected_components
from brindle.sources.tables import materialize

#: Fingerprints link at so many differing bits or fewer.
RADIUS = 2
#: A group of more fingerprints than this is dealt out again by its remaining bits.
GROUP_LIMIT = 2048
#: Bits that may remain open in the last and finest groups.
DEPTH = 4
FAN = 8
_ALL = (1 << 64) - 1


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included.

    A-Z are lower-cased; words are runs of characters other than space and \\t to \\r. Fewer
    words than a shingle's are one shingle; no words give none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = [len(w) + 1 for w in words]
    ends = np.cumsum(lengths)
    starts, ends = (ends - lengths).tolist(), (ends[k - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[s:e], 42) for s, e in zip(starts, ends, strict=False)), np.uint64, len(ends))


class _Words(dict):
    """word -> its XXH64; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


_WORDS = _Words()


def rolled_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A 64-bit hash of every shingle, mixed from its words' hashes; words and short texts as for shingle_hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    each = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if not len(each):
        return each
    k = min(shingle, len(each))
    out = each[: len(each) - k + 1].copy()
    for i in range(1, k):
        out = (out ^ out >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + each[i : len(each) - k + 1 + i]
    return out


_SALTS = np.array([i * 0x9E3779B97F4A7C15 & _ALL for i in range(64)], np.uint64)


def _more_words(values: np.ndarray, words: int) -> np.ndarray:
    """(hashes, words): each hash, and others mixed from it."""
    out = np.empty((len(values), words), "<u8")
    out[:, 0] = values
    x = values[:, None] + _SALTS[None, 1:words]
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    out[:, 1:] = x ^ x >> np.uint64(31)
    return out


def fingerprint_words(values: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint of shingles' hashes in 64-bit words; none give zeros. A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(values), 255 * 4):
        part = _more_words(values[at : at + 255 * 4], words).view(np.uint8)
        for low in range(0, len(part), 255):  # as many ones as a byte can count
            bits = np.unpackbits(part[low : low + 255], axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    return int(fingerprint_words(shingle_hashes(text, shingle))[0])


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp) for every row, fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fps = np.array([fingerprint(t) for t in x["body"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc": x["doc"], "fp": fps})

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInPandas(run, "doc long, fp long")


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order, shifted so that signed longs sort as unsigned ones."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_mask(mask: int, parts: int) -> list[int]:
    """mask with the open bits of each of so many equal blocks added: what a finer group agrees on."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in block.tolist()) for block in np.array_split(np.array(free), parts)]


def popcount(x: np.ndarray) -> np.ndarray:
    """Bits set in each row of words."""
    return np.bitwise_count(x).sum(-1, dtype=np.int16)


class GrayIndex:
    """Nodes over codes (rows of 64-bit words) that are sorted by group and Gray rank.

    Level 0 holds the codes. A node of a higher level stands for up to FAN neighbours of the
    same group; mask has the bits on which all codes below it agree, and pattern their values.
    """

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        codes = codes.reshape(len(codes), -1)
        self.codes = codes
        self.masks, self.patterns = [np.full(codes.shape, _ALL, np.uint64)], [codes]
        self.first: list[np.ndarray] = []
        all_one, any_one = codes, codes
        while True:
            change = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            if len(change) == len(groups):
                break
            place = np.arange(len(groups)) - np.repeat(change, np.diff(np.r_[change, len(groups)]))
            starts = np.flatnonzero(place % FAN == 0)
            all_one, any_one = np.bitwise_and.reduceat(all_one, starts, 0), np.bitwise_or.reduceat(any_one, starts, 0)
            groups = groups[starts]
            self.first.append(np.r_[starts, len(place)])
            self.masks.append(all_one | ~any_one)
            self.patterns.append(all_one)

    def _uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level, the label that all codes below a node have, or -1."""
        out = [labels]
        for first in self.first:
            low = np.minimum.reduceat(out[-1], first[:-1])
            high = np.maximum.reduceat(out[-1], first[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def _near(self, first: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of codes below nodes i and j that differ in radius bits or fewer; of a node with itself, each once."""
        place = np.arange(FAN)
        a, b = first[i][:, None] + place, first[j][:, None] + place
        there = (a < first[i + 1][:, None])[:, :, None] & (b < first[j + 1][:, None])[:, None, :] & (a[:, :, None] < b[:, None, :])
        x, y = self.codes[np.minimum(a, len(self.codes) - 1)], self.codes[np.minimum(b, len(self.codes) - 1)]
        differ = np.zeros(there.shape, np.uint16)
        for word in range(self.codes.shape[1]):
            differ += np.bitwise_count(x[:, :, None, word] ^ y[:, None, :, word])
        pair, m, n = np.nonzero(there & (differ <= radius))
        return a[pair, m], b[pair, n]

    def roots(self, radius: int, accept: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """For every code the place of the first code that it is linked with over links of radius bits or fewer.

        accept(a, b, labels), if given, tells which of such pairs link; it may leave out pairs
        that others connect anyway.

        Pairs of nodes are followed down from the groups' roots. Differences in the bits that
        both nodes share add up on the way; beyond radius the whole pair of groups is left
        out. Pairs whose codes are all of one component already are left out as well, which
        keeps dense groups far from quadratic work.
        """
        n = len(self.codes)
        labels = np.arange(n)
        top = len(self.first)
        if not top:
            return labels
        near = np.flatnonzero(popcount(self.codes[1:] ^ self.codes[:-1]) <= radius)
        group = np.zeros(n, np.int64)  # neighbours in order may be of two groups
        bounds = np.arange(len(self.masks[top]))
        for first in reversed(self.first):
            bounds = np.repeat(bounds, np.diff(first))
        group[:] = bounds
        near = near[group[near] == group[near + 1]]
        labels = _joined(labels, *(accept(near, near + 1, labels) if accept else (near, near + 1)))
        uniform = self._uniform(labels)
        i = np.flatnonzero(np.diff(self.first[-1]) > 0)
        stack = [(top, i, i, np.zeros(len(i), np.int16), np.zeros((len(i), self.codes.shape[1]), np.uint64))]
        most = max(256, 4096 // self.codes.shape[1])
        while stack:
            level, i, j, acc, seen = stack.pop()
            same = (uniform[level][i] == uniform[level][j]) & (uniform[level][i] >= 0)
            i, j, acc, seen = i[~same], j[~same], acc[~same], seen[~same]
            if not len(i):
                continue
            if len(i) > most:
                for at in range(0, len(i), most):
                    cut = slice(at, at + most)
                    stack.append((level, i[cut], j[cut], acc[cut], seen[cut]))
                continue
            first = self.first[level - 1]
            if level == 1:  # what is below are codes: blocks of them meet
                a, b = self._near(first, i, j, radius)
                merged = _joined(labels, *(accept(a, b, labels) if accept else (a, b)))
                if merged is not labels and not np.array_equal(merged, labels):
                    labels = merged
                    uniform = self._uniform(labels)
                continue
            wide, high = np.diff(first)[i], np.diff(first)[j]
            size = wide * high
            pair = np.repeat(np.arange(len(i)), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            a, b = first[i][pair] + k // high[pair], first[j][pair] + k % high[pair]
            keep = a <= b
            a, b, pair = a[keep], b[keep], pair[keep]
            shared = self.masks[level - 1][a] & self.masks[level - 1][b]
            differ = (self.patterns[level - 1][a] ^ self.patterns[level - 1][b]) & shared & ~seen[pair]
            total = acc[pair] + popcount(differ)
            keep = total <= radius
            stack.append((level - 1, a[keep], b[keep], total[keep], shared[keep]))
        return labels


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after linking a with b: every component has its smallest label."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        root = np.arange(len(labels))
        np.minimum.at(root, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(nxt := root[root], root):
            root = nxt
        labels = root[labels]
    return labels


def _search(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links that span what is linked in each (mask, key) group; rows come sorted, groups whole in a task."""
    held: list[pd.DataFrame] = []
    rows = 0

    def links(x: pd.DataFrame) -> pd.DataFrame:
        mask, key = x["mask"].to_numpy(), x["key"].to_numpy()
        groups = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        codes = x["fp"].to_numpy().view(np.uint64)
        roots = GrayIndex(codes, groups).roots(radius)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        return pd.DataFrame({"a": codes[linked].view(np.int64), "b": codes[roots[linked]].view(np.int64)})

    for x in batches:
        held.append(x)
        rows += len(x)
        if rows >= 65536:
            x = pd.concat(held, ignore_index=True)
            last = (x["mask"] == x["mask"].iloc[-1]) & (x["key"] == x["key"].iloc[-1])
            held, rows = [x[last]], int(last.sum())
            yield links(x[~last].reset_index(drop=True))
    if rows:
        yield links(pd.concat(held, ignore_index=True))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) that span the components of the distinct fingerprints in fps.fp.

    Fingerprints that differ in radius bits or fewer agree on one of radius + 1 blocks; that
    holds again for the remaining bits of any group, so finer groups lose no link.
    """
    parts = radius + 1
    masks = split_mask(0, parts)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found: DataFrame | None = None
    for step in range(DEPTH):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = materialize(rows.join(sizes, ["mask", "key"]), "groups")
        last = step == DEPTH - 1
        small = rows if last else rows.where(F.col("size") <= group_limit)
        links = (
            small.select("mask", "key", "fp", gray_rank(F.col("fp").bitwiseAND(F.bitwise_not("mask"))).alias("rank"))
            .repartition("mask", "key")
            .sortWithinPartitions("mask", "key", "rank")
            .mapInPandas(lambda it: _search(it, radius), "a long, b long")
        )
        found = links if found is None else found.unionAll(links)
        rows = rows.where(F.col("size") > group_limit)
        if last or rows.isEmpty():
            break
        finer = {m: split_mask(m, parts) for m in masks}
        masks = [x for m in masks for x in finer[m]]
        lookup = F.create_map(
            *[x for m, xs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in xs]))]
        )
        rows = rows.select("fp", F.explode(lookup[F.col("mask")]).alias("mask"))
    return found


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint has 16 lower-case hex digits; component_id is the smallest id that links of
    radius bits or fewer reach, the row's own included. Null and wordless texts have
    fingerprint zero and link like any other; null ids keep their rows, get the component of
    their fingerprint and never name one, unless a component has no other id. Repeated rows
    stay; an empty table gives none; other columns of docs are not looked at.
    """
    marked = materialize(add_fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc").alias("least")), "distinct")
    parts = connected_components(fingerprint_links(distinct, radius, group_limit))
    linked = parts.select(F.col("node").alias("fp"), "component").join(distinct, "fp")
    named = linked.groupBy("component").agg(F.min("least").alias("root"))
    roots = linked.join(named, "component").select("fp", "root")
    labels = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    labels = materialize(labels, "labels")  # so that nothing but exchanges feed the last join, and AQE can split it
    return marked.join(labels, "fp").select(
        F.col("doc").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


#: Words of a wide fingerprint and of its sketch, and how surely the tables find a pair of just the set similarity.
WIDE, SKETCH, RECALL = 16, 2, 0.97
#: Distinct fingerprints that should share a key of a table by chance.
CROWD = 1024
#: A group of more rows than this is dealt out as pairs of blocks, each an eighth of it, but from a quarter to twice this limit.
WIDE_LIMIT = 2048
#: Rows, and bytes of their shingles, that a task gathers before it searches the groups that are whole.
CHUNK, CHUNK_BYTES = 16384, 1 << 26


def differing_share(similarity: float) -> float:
    """Share of bits in which fingerprints of two texts of that Jaccard similarity and of equal length differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_radius(similarity: float, words: int = WIDE, deviations: float = 1.0) -> int:
    """Differing bits up to which texts count as that similar: the mean at that similarity and so many deviations."""
    p, n = differing_share(similarity), 64 * words
    return int(n * p + deviations * math.sqrt(n * p * (1 - p)))


def table_bits(n: int, similarity: float, words: int = WIDE, recall: float = RECALL) -> list[list[int]]:
    """The bits of each table's key: more bits the more rows there are, and as many tables as recall then takes."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / CROWD)))
    found = (1 - differing_share(similarity)) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - found))
    rng = np.random.default_rng(11)
    return [rng.choice(64 * words, bits, replace=False).tolist() for _ in range(tables)]


class Alike:
    """Accepts pairs of rows whose sets of shingles are as similar as asked; pairs that are connected already aren't looked at."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sets, self.similarity = sets, similarity
        self.size = np.array([len(s) for s in sets], np.int64)

    def similar(self, a: int, b: int) -> bool:
        shared = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
        return shared >= self.similarity * (self.size[a] + self.size[b] - shared) - 1e-9

    def __call__(self, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        open_ = (labels[a] != labels[b]) & (small >= self.similarity * large - 1e-9)
        a, b = a[open_], b[open_]
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        took = []
        for at, (i, j, la, lb) in enumerate(zip(a.tolist(), b.tolist(), labels[a].tolist(), labels[b].tolist(), strict=True)):
            la, lb = top(la), top(lb)
            if la != lb and self.similar(i, j):
                up[max(la, lb)] = min(la, lb)
                took.append(at)
        return a[took], b[took]


def _search_wide(batches: Iterator[pd.DataFrame], radius: int, similarity: float = 0.0) -> Iterator[pd.DataFrame]:
    """As _search, for each (key, part); nothing but their borders cuts the rows. Codes are in the columns w0, w1, ... or in fp; with shingles in set, only similar pairs link."""
    held: list[pd.DataFrame] = []
    rows = size = 0

    def links(x: pd.DataFrame) -> pd.DataFrame:
        key, part = x["key"].to_numpy(), x["part"].to_numpy()
        if "fp" in x:
            codes = np.frombuffer(b"".join(x["fp"]), "<u8").reshape(len(x), -1)
        else:
            codes = np.stack([x[c].to_numpy().view(np.uint64) for c in x.columns if c[0] == "w"], 1)
        accept = Alike([np.frombuffer(v, "<u8") for v in x["set"]], similarity) if "set" in x else None
        roots = GrayIndex(codes, np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])).roots(radius, accept)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        nodes = x["node"].to_numpy()
        return pd.DataFrame({"a": nodes[linked], "b": nodes[roots[linked]]})

    for x in batches:
        held.append(x)
        rows += len(x)
        size += int(x["set"].map(len).sum()) if "set" in x else 0
        if rows >= CHUNK or size >= CHUNK_BYTES:
            x = pd.concat(held, ignore_index=True)
            last = (x["key"] == x["key"].iloc[-1]) & (x["part"] == x["part"].iloc[-1])
            held, rows, size = [x[last]], int(last.sum()), 0
            if rows < len(x):
                yield links(x[~last].reset_index(drop=True))
    if rows:
        yield links(pd.concat(held, ignore_index=True))


def deal_pairs(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """rows with a part: 0, or for keys of sizes (key, size) each pair of blocks that the row's own is one of.

    A row's block is drawn by a hash of its node; blocks are an eighth of their key's rows
    each, but a quarter of the limit at least and twice the limit at most. Two rows of a key
    are in a part together at least once.
    """
    block = F.greatest(F.lit(max(1, limit // 4)), F.least(F.col("size") / 8, F.lit(2 * limit)))
    blocks = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda t: t != own)
    pairs = F.transform(others, lambda t: F.least(t, own) * blocks + F.greatest(t, own))
    parts = F.when(blocks > 1, pairs).otherwise(F.array(F.lit(0).cast("long")))
    return rows.join(sizes, "key", "left").withColumn("part", F.explode(parts)).drop("size")


def _grouped_links(rows: DataFrame, keys: DataFrame, rank: Column, radius: int, group_limit: int, similarity: float = 0.0) -> DataFrame:
    """Links (a, b) of rows (key, node, codes) that span what is linked in each key's group; keys has the same keys again, to be counted."""
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(counted.where(F.col("size") > group_limit), "sizes")  # at most the rows over group_limit
    rows = rows.withColumn("part", F.lit(0).cast("long")) if sizes.isEmpty() else deal_pairs(rows, sizes, group_limit)
    return (
        rows.repartition("key", "part")
        .withColumn("rank", rank)
        .sortWithinPartitions("key", "part", "rank")
        .drop("rank")
        .mapInPandas(lambda it: _search_wide(it, radius, similarity), "a long, b long")
        .distinct()
    )


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    words: int = WIDE,
    recall: float = RECALL,
    group_limit: int = WIDE_LIMIT,
) -> DataFrame:
    """(doc, copy, node, group): each row's id, its text's hash, its shingles' hash and its group's.

    Texts are grouped over links of pairs whose sets of shingles have a Jaccard similarity of
    `similarity` or more, as compared by the shingles themselves; equal sets always are. No
    other pair links. A pair of just that similarity is found if it shares a table's key, with
    probability `recall`, and exceeds the radius of sketches or of fingerprints with
    probability 0.001 each; more similar ones are found more surely. All pairs that share a key
    are compared by sketches, and all pairs that such links connect by whole fingerprints, then
    by shingles: a group is whole in a task up to group_limit rows; a larger connected one is
    first split by the tables' keys; and beyond that each two blocks of a group meet in a task,
    which grows with the square of such a group over group_limit. Texts without words are one
    group of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            hashes = [rolled_hashes(t, shingle) for t in x["body"]]
            nodes = [xxhash.xxh64_intdigest(np.unique(h).tobytes()) for h in hashes]
            fps = [fingerprint_words(h, words).tobytes() for h in hashes]
            yield pd.DataFrame({"doc": x["doc"].astype("Int64"), "copy": x["copy"], "fp": fps, "node": np.array(nodes, np.uint64).view(np.int64)})

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"copy": x["copy"], "set": [np.unique(rolled_hashes(t, shingle)).astype("<u8").tobytes() for t in x["body"]]})

    body = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(body).alias("copy"), body.alias("body"))
    marked = materialize(rows.mapInPandas(run, "doc long, copy long, fp binary, node long"), "wide")
    distinct = materialize(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.min("copy").alias("copy")), "distinct")
    tables = table_bits(distinct.count(), similarity, words, recall)
    sketched = min(SKETCH, words)

    def keys(batches: Iterator[pd.DataFrame], want: str) -> Iterator[pd.DataFrame]:
        """A row for each table: its key alone, or with the row's sketch, or with all that the row has."""
        for x in batches:
            codes = np.frombuffer(b"".join(x["fp"]), "<u8").reshape(len(x), -1)
            bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
            sketch = {f"w{i}": codes[:, i].view(np.int64) for i in range(sketched)} if want == "sketch" else {}
            for place, table in enumerate(tables):
                key = bits[:, table].astype(np.int64) @ (1 << np.arange(len(table), dtype=np.int64)) << np.int64(16) | place
                out = {"key": key}
                if want != "key":
                    out |= {"node": x["node"], **sketch}
                if want == "fp":
                    out |= {"group": x["group"], "fp": x["fp"], "set": x["set"]}
                yield pd.DataFrame(out)

    columns = ", ".join(f"w{i} long" for i in range(sketched))
    loose = _grouped_links(
        distinct.mapInPandas(lambda it: keys(it, "sketch"), f"key long, node long, {columns}"),
        distinct.mapInPandas(lambda it: keys(it, "key"), "key long"),
        gray_rank(F.col("w0")), wide_radius(similarity, sketched, 3), group_limit,
    )
    near = connected_components(loose).select("node", F.col("component").alias("group")).join(distinct, "node")
    near = materialize(near, "near")
    # shingles of one text for each near node; the texts of equal hashes are one row a task before they are shuffled
    texts = rows.select("copy", "body").join(near.select("copy"), "copy", "left_semi").groupBy("copy").agg(F.first("body").alias("body"))
    near = materialize(near.join(texts.mapInPandas(shingles, "copy long, set binary"), "copy").drop("copy"), "near-sets", spent=[near])
    large = near.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit).select("group")
    large = materialize(large, "large")  # at most the rows over group_limit
    fine = near.join(large, "group", "left_anti").select(F.col("group").alias("key"), "node", "fp", "set")
    if not large.isEmpty():
        crowded = near.join(large, "group", "left_semi").mapInPandas(lambda it: keys(it, "fp"), "key long, node long, group long, fp binary, set binary")
        fine = fine.unionByName(crowded.select(F.xxhash64("group", "key").alias("key"), "node", "fp", "set"))
    first_word = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")
    links = _grouped_links(fine, fine.select("key"), gray_rank(first_word), wide_radius(similarity, words, 3), group_limit, similarity)
    parts = connected_components(links)
    groups = parts.select("node", F.col("component").alias("group"))
    labels = distinct.select("node").join(groups, "node", "left").select("node", F.coalesce("group", "node").alias("group"))
    labels = materialize(labels, "labels", spent=[near, large, distinct])
    return marked.select("doc", "copy", "node").join(labels, "node")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, wordless: bool = True
) -> DataFrame:
    """docs with the row of the smallest id of each group of similar texts (see similar_groups), and all of its columns.

    Of equal ids that with the smallest hash of its text stays, of equal rows one; null ids
    come last. Texts without words (null, empty) are no copies of each other and stay if
    wordless is true; otherwise they are one group like any other, of which one row stays. An
    empty table gives none. Helper columns have names that docs doesn't use.
    """
    groups = materialize(similar_groups(docs, id_col, text_col, shingle, similarity), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "copy")).alias("first"))
    names = {c.lower() for c in docs.columns}
    tag = next(t for t in (f"_k{i}_" for i in range(len(names) + 1)) if not any(c.startswith(t) for c in names))
    none = F.lit(-(1 << 63))
    kept = first.select(F.coalesce("first.doc", none).alias(tag + "doc"), F.col("first.copy").alias(tag + "copy")).distinct()
    body = F.col(text_col).cast("string")
    rows = docs.withColumns({tag + "doc": F.coalesce(F.col(id_col).cast("long"), none), tag + "copy": F.xxhash64(body)})
    said = F.coalesce(body, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chosen = (rows.where(said) if wordless else rows).join(kept, [tag + "doc", tag + "copy"], "left_semi").dropDuplicates([tag + "doc", tag + "copy"])
    chosen = chosen.select(*docs.columns)
    return chosen.unionByName(rows.where(~said).select(*docs.columns)) if wordless else chosen
