"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the window: whole windows stand alone, and what
remains is shared out. Remainders are taken in lots; a lot starts with as few windows as its
ids fill, differencing spreads its pieces over them, and the count rises while the fullest
window is over capacity. Everything happens where the document is read, so packing needs no
shuffle and any task can be run again with the same result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.vocab import encoder

WINDOW = 1024
#: Longest piece that is shared out; more and smaller pieces make windows more equal.
PIECE = 512
#: Pieces of a lot.
LOT = 512
#: Bits of a sequence id for the windows of a task.
TASK_BITS = 36


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """The places of sizes in `ways` parts with near-equal sums.

    Every size starts as a partial partition of its own. The two with the largest imbalance
    are merged again and again, the fullest part of one with the emptiest of the other.
    Empty parts aren't written down.
    """
    if ways < 2:
        return [list(range(len(sizes)))]
    heap = [(-size, place, [(size, [place])]) for place, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - ways
        if over > 0:  # the smallest parts of each meet the largest of the other
            met = [
                (a[len(a) - over + i][0] + b[len(b) - 1 - i][0], a[len(a) - over + i][1] + b[len(b) - 1 - i][1])
                for i in range(over)
            ]
            parts = a[: len(a) - over] + b[: len(b) - over] + met
        else:
            parts = a + b
        parts.sort(key=lambda p: -p[0])
        low = parts[-1][0] if len(parts) == ways else 0
        heapq.heappush(heap, (low - parts[0][0], tie, parts))
        tie += 1
    return [places for _, places in heap[0][2]] if heap else []


def fill(sizes: list[int], window: int) -> list[list[int]]:
    """Parts of at most window: as few as the sum allows, one more while any part is too full."""
    ways = max(1, -(-sum(sizes) // window))
    while True:
        parts = difference(sizes, ways)
        if all(sum(sizes[i] for i in part) <= window for part in parts):
            return parts
        ways += 1


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def _pack(batches: Iterator[pa.RecordBatch], path: str | None, window: int, piece: int, lot: int, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << TASK_BITS
    open_: list[tuple] = []  # (doc, start, ids, doc_tokens)
    out: list[tuple] = []
    schema = None

    def close() -> None:
        nonlocal sequence
        if not open_:
            return
        sizes = [len(x[2]) // 4 for x in open_]
        for part in fill(sizes, window):
            at, total = 0, sum(sizes[i] for i in part)
            for i in part:
                doc, start, ids, n = open_[i]
                out.append((doc, start, sizes[i], ids, n, sequence, at, total))
                at += sizes[i]
            sequence += 1
        open_.clear()

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 8
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = enc.ids(text or "", control=True) + end
            n = len(ids) // 4
            whole = n - n % window
            for start in range(0, whole, window):
                out.append((doc, start, window, ids[4 * start : 4 * (start + window)], n, sequence, 0, window))
                sequence += 1
            for start in range(whole, n, piece):
                open_.append((doc, start, ids[4 * start : 4 * min(start + piece, n)], n))
            if len(open_) >= lot:
                close()
        yield rows()
    close()
    yield rows()


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    piece: int = PIECE,
    lot: int = LOT,
    end_id: int = 0,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_length.

    A document is its text's ids and end_id; the vocabulary's control string in a text is its
    control id, as the vocabulary's own reader takes it; null and empty texts have end_id alone. Every id
    is in one piece; the pieces of a sequence follow each other without a gap and fill at
    most window. ids are little-endian unsigned 32-bit numbers. Repeated rows and repeated or
    null ids are documents of their own; an empty table gives no rows; other columns are not
    looked at. Only the last lot of a task can leave a window less than nearly full.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, tokenizer_path, window, piece, lot, end_id), SCHEMA)


def crc32(ids: bytes) -> int:
    """What the query's native crc32 gives; for tests."""
    return zlib.crc32(ids)
