"""Vector code compression: a byte-sized code for each part of a vector, codebooks fitted in whole numbers.

Components become whole numbers, so sums don't depend on the order of tasks and every distance
is exact. Each round, tasks assign the parts they hold and give sums and counts of each entry;
Spark adds these up, and only the codebooks themselves come to the driver.

The nearest entry is found by annular norm pruning. An entry's norm differs from a part's norm
by no more than their distance. Entries are sorted by norm; the best distance so far allows an
interval of norms, which binary search turns into a range of entries, ends included. Only these
are measured, and each better one narrows the interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import discard, materialize

#: Parts of a vector, entries of each part's codebook, rounds of fitting, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components up to here are reckoned in 64 bits; rows with larger ones in whole numbers of any size.
SMALL = 2**26


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit numbers where all are small."""
    y = np.floor(x.astype(np.float64) * scale) if scale * (np.abs(x).max() if x.size else 0) < 2.0**52 else None
    if y is not None and (not y.size or np.abs(y).max() <= SMALL):
        return y.astype(np.int64)
    exact = [[(lambda n, d: scale * n // d)(*float(v).as_integer_ratio()) for v in row] for row in x]
    return np.array(exact, object).reshape(x.shape)


def cuts(width: int, parts: int = PARTS) -> list[int]:
    """Where parts begin and end; the first ones are longer if they can't all be equal."""
    least, more = divmod(width, parts)
    return [i * least + min(i, more) for i in range(parts + 1)]


@dataclass
class Book:
    """The entries of one part, whole numbers, sorted by norm as well."""

    entries: np.ndarray  # (entries, width)

    def __post_init__(self) -> None:
        square = (self.entries * self.entries).sum(1)
        self.norm = np.sqrt(square.astype(np.float64))
        self.by_norm = np.argsort(self.norm, kind="stable")
        self.sorted_norm = self.norm[self.by_norm]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(place, squared distance) of each row's nearest entry, ties to the lower place; and how many distances were taken."""
        n = len(x)
        length = np.sqrt((x * x).sum(1).astype(np.float64)) if x.shape[1] else np.zeros(n)
        start = np.searchsorted(self.sorted_norm, length)
        before = np.maximum(start - 1, 0)
        start = np.minimum(start, len(self.norm) - 1)
        nearer = length - self.sorted_norm[before] <= self.sorted_norm[start] - length
        start = np.where(nearer, before, start)  # the entry of the closest norm is measured first
        place = self.by_norm[start]
        best = _square(x - self.entries[place])
        taken = n
        low, high = self._annulus(length, best)
        for step in range(1, len(self.norm)):  # outwards from the closest norm
            for k in (start - step, start + step):
                rows = np.flatnonzero((low <= k) & (k < high))
                if not len(rows):
                    continue
                taken += len(rows)
                at = self.by_norm[k[rows]]
                d = _square(x[rows] - self.entries[at])
                better = (d < best[rows]) | ((d == best[rows]) & (at < place[rows]))
                rows, d, at = rows[better], d[better], at[better]
                best[rows], place[rows] = d, at
                low[rows], high[rows] = self._annulus(length[rows], d)
            if not ((low < start - step) | (high > start + step + 1)).any():
                break
        return place, best, taken

    def _annulus(self, length: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of sorted entries whose norms the best squared distance allows; a little wider than rounding could err."""
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (length + reach) + 1e-9
        return np.searchsorted(self.sorted_norm, length - reach - slack, "left"), np.searchsorted(self.sorted_norm, length + reach + slack, "right")


def _square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1) if x.shape[1] else np.zeros(len(x), np.int64)


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """The vectors of a column of equally long binaries."""
    raw = column.to_pylist()
    width = len(raw[0]) // np.dtype(dtype).itemsize if raw else 0
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), width)


def _keep(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> tuple[DataFrame, str]:
    """(vec_id, label, width, v): rows without null or non-finite components, vectors as raw floats of the kind they are."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype, cast = ("<f4", "float") if kind == "float" else ("<f8", "double")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast(f"array<{cast}>").alias("v"))
    label_type = rows.schema["label"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            size = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = v.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ends = np.cumsum(np.maximum(size, 0))
            starts = ends - np.maximum(size, 0)
            good = (size >= 0) & (bad[ends] == bad[starts])
            raw = flat.astype(dtype)
            out = [raw[s:e].tobytes() for s, e in zip(starts[good], ends[good], strict=True)]
            mask = pa.array(good)
            columns = [b.column(0).filter(mask), b.column(1).filter(mask), pa.array(size[good], pa.int32()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "width", "v"])

    return rows.mapInArrow(pick, f"vec_id long, label {label_type}, width int, v binary"), dtype


def _sums(kept: DataFrame, books: list[Book], dtype: str, scale: int) -> DataFrame:
    """(part, entry, sums, n): the sum of the parts assigned to each entry, by whole numbers."""
    ends = cuts(sum(b.entries.shape[1] for b in books), len(books))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.entries.shape, object) for b in books]
        count = [np.zeros(len(b.entries), np.int64) for b in books]
        for batch in batches:
            x = whole(_matrix(batch.column(0), dtype), scale)
            for p, book in enumerate(books):
                part = x[:, ends[p] : ends[p + 1]]
                place, _, _ = book.nearest(part)
                for e in np.unique(place):
                    own = place == e
                    sums[p][e] += part[own].sum(0).astype(object)
                    count[p][e] += int(own.sum())
        found = [(p, e, [str(v) for v in sums[p][e]], int(count[p][e])) for p in range(len(books)) for e in np.flatnonzero(count[p]).tolist()]
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "sums", "n"])

    tasks = kept.select("v").mapInArrow(add, "part int, entry int, sums array<string>, n long")
    added = tasks.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at")
    return added.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))


def fit(kept: DataFrame, dtype: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[Book]:
    """Codebooks of kept rows (vec_id, v); the driver holds no more than parts * entries of them."""
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return []
    x = whole(np.stack([np.frombuffer(r["v"], dtype) for r in first]), scale)
    ends = cuts(x.shape[1], parts)
    books = [Book(x[:, a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    for _ in range(rounds):
        moved = [b.entries.astype(object) for b in books]
        for r in _sums(kept, books, dtype, scale).collect():  # a row for each component of the codebooks
            moved[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
        books = [Book(m.astype(np.int64) if not m.size or max(map(abs, m.ravel())) <= SMALL else m) for m in moved]
    return books


def digest(books: list[Book]) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(str(v) for b in books for row in b.entries for v in row)


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[Book]]:
    """(vec_id, label, code, error) of each kept row, and the codebooks.

    code has one index for each part (bytes), error the squared distances to the entries, added
    up. Rows whose vector is null or holds null or non-finite components drop out, and so do
    rows whose length isn't the commonest (the smallest of equally common ones). Components of
    a part are cut equally, the first parts a component longer where the length isn't a multiple.
    Codebooks start at the vectors of the smallest ids (ties by the vectors' bytes, null ids
    last), so fewer rows than entries give as many entries as rows. Rows that repeat, and rows
    without id or label, are rows of their own; an empty table gives no rows and no books.
    Errors that don't fit 64 bits are an ArithmeticError. Other columns aren't looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index must fit a byte")
    kept, dtype = _keep(vectors, id_col, vector_col, label_col)
    kept = materialize(kept, "vectors")
    width = kept.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if width is not None:
        kept_rows = kept.where(F.col("width") == width["width"])
    else:
        kept_rows = kept
    books = fit(kept_rows, dtype, parts, entries, rounds, scale)
    ends = cuts(width["width"] if width else 0, parts)
    label_type = kept.schema["label"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(_matrix(b.column(2), dtype), scale)
            found = [book.nearest(x[:, ends[p] : ends[p + 1]]) for p, book in enumerate(books)]
            error = sum(f[1].astype(object) if x.dtype == object else f[1] for f in found)
            if len(x) and max(error) >= 2**63:
                raise ArithmeticError("an error doesn't fit 64 bits")
            code = np.stack([f[0] for f in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(error), pa.int64())], ["vec_id", "label", "code", "error"]
            )

    coded = kept_rows.select("vec_id", "label", "v").mapInArrow(encode, f"vec_id long, label {label_type}, code binary, error long")
    coded = materialize(coded, "codes")
    discard(kept)
    return coded, books


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL, for vectors of one length that the parts divide; every distance is taken."""
    near = """a{k} AS MATERIALIZED (
    SELECT r, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
    FROM (SELECT r, p.part, entry, p.square - 2 * list_inner_product(p.vs, b.vs) + b.square AS d FROM pieces p JOIN b{k} b ON b.part = p.part)
    GROUP BY r, part)"""
    move = """b{next} AS MATERIALIZED (
    SELECT part, entry, vs, list_inner_product(vs, vs) AS square FROM (
        SELECT b.part, b.entry, coalesce(m.vs, b.vs) AS vs FROM b{k} b LEFT JOIN (
            SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS DOUBLE) ORDER BY pos) AS vs
            FROM (SELECT x.part, entry, pos, sum(v) AS s, count(*) AS c FROM x JOIN a{k} a ON a.r = x.r AND a.part = x.part GROUP BY ALL)
            GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry))"""
    steps = ",\n".join(near.format(k=k) + ",\n" + move.format(k=k, next=k + 1) for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, embedding FROM {{vectors}}
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
    SELECT r, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS pos,
           CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
    FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
pieces AS MATERIALIZED (
    SELECT r, part, vs, list_inner_product(vs, vs) AS square
    FROM (SELECT r, part, list(CAST(v AS DOUBLE) ORDER BY pos) AS vs FROM x GROUP BY r, part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, vs, square FROM pieces WHERE r <= {entries}),
{steps},
{near.format(k=rounds)},
coded AS (
    SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256((SELECT string_agg(list_aggregate(list_transform(vs, lambda e: CAST(e AS BIGINT)), 'string_agg', ','), ',' ORDER BY part, entry) FROM b{rounds})) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


CODES_SQL = _sql()
