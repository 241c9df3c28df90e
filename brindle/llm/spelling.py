"""Spelling variants: words of a corpus that differ by one code point, and the form that each goes back to.

All deletions, replacements and insertions of each word over the observed alphabet are made,
each once, and joined with the vocabulary by hash: what meets is near, so no distances are
measured. Making them is arithmetic on whole tables of words: a word's hash is a polynomial of
its characters, and prefix and suffix sums give that of any edit at once. A bitmap of the
vocabulary's hashes, of bounded size, goes to the tasks and says which edits can be words at
all; only these are written out as text and shuffled to the join, which decides. A vocabulary
too large for the bitmap lets more of them through, and changes nothing else.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import discard, materialize

#: Shortest word, and how often it must stand in all texts.
LETTERS, TIMES = 5, 3
#: A form is at least so many times as frequent.
RATIO = 2
#: Words that a task counts before it hands its counts on.
HELD = 400_000
#: Bits of the bitmap: for each word, and at least and most.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 64, 2**16, 2**29
#: Edits that are in memory at once, about.
EDITS = 2_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode()


def no_change(doc_id: int | None) -> Callable[[str], str]:
    return lambda word: word


def planted(doc_id: int | None) -> Callable[[str], str]:
    """The slips of the test corpus: by a checksum of document and word, one word in 97 loses a letter."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def slip(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        if h % 97:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return slip


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LETTERS,
    times: int = TIMES,
    change: Callable[[int | None], Callable[[str], str]] = no_change,
) -> DataFrame:
    """(word, n): words of at least `letters` code points that stand at least `times` times in all texts.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), in lower case as to A-Z. change(doc_id)
    gives what a document's runs are read as; it may shorten a run or leave it, and depends on nothing else.
    """
    # runs too short for a word can't become longer
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found = runs.findall(lower(text))
                total.update(found)
                read = change(doc)
                for word in set(found):
                    other = read(word)
                    if other != word:
                        n = found.count(word)
                        total[word] -= n
                        total[other] += n
                if len(total) >= HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").where((F.char_length("word") >= letters) & (F.col("n") > 0))
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _values(code: np.ndarray) -> np.ndarray:
    """A number for each character."""
    x = (code.astype(np.uint64) + np.uint64(1)) * _M
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE)])[:n], dtype=np.uint64)


def hashes(words: np.ndarray) -> np.ndarray:
    """The polynomial of each row of characters; all arithmetic is modulo 2**64."""
    return (_values(words) * _powers(words.shape[1])).sum(1, dtype=np.uint64) if words.shape[1] else np.zeros(len(words), np.uint64)


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    shift = np.uint64(64 - bits.bit_length() + 1)
    return h >> shift, ((h ^ (h >> np.uint64(31))) * _M) >> shift


def _by_length(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of one length and their characters, in blocks."""
    words = sorted(words, key=len)
    at = 0
    while at < len(words):
        size = len(words[at])
        end = at
        while end < len(words) and len(words[end]) == size:
            end += 1
        yield words[at:end], np.frombuffer("".join(words[at:end]).encode("utf-32-le"), "<u4").reshape(end - at, size)
        at = end


def edits(code: np.ndarray, alphabet: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, str]]:
    """(row, text) of every distinct deletion, replacement and insertion whose hash `holds` lets through.

    Of a run of equal characters only the first is deleted, and nothing is inserted right after
    its equal, so no text is made twice of one word.
    """
    n, size = code.shape
    power = _powers(size + 1)
    term = _values(code) * power[:size]
    ahead = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(term, 1, dtype=np.uint64)], 1)  # of what stands before each place
    total = ahead[:, -1:]
    fresh = np.ones((n, size), bool)
    fresh[:, 1:] = code[:, 1:] != code[:, :-1]
    letter = _values(alphabet)
    text = [row.tobytes().decode("utf-32-le") for row in code.astype("<u4")]
    gone = ahead[:, :-1] + (total - ahead[:, 1:]) * _BACK
    for r, i in zip(*(x.tolist() for x in np.nonzero(holds(gone) & fresh)), strict=True):
        yield r, text[r][:i] + text[r][i + 1 :]
    signs = [chr(c) for c in alphabet.tolist()]
    for a, sign in enumerate(signs):
        other = total - term + letter[a] * power[:size]
        for r, i in zip(*(x.tolist() for x in np.nonzero(holds(other) & (code != alphabet[a]))), strict=True):
            yield r, text[r][:i] + sign + text[r][i + 1 :]
        more = ahead + letter[a] * power + (total - ahead) * _BASE
        new = np.ones((n, size + 1), bool)
        new[:, 1:] = code != alphabet[a]
        for r, i in zip(*(x.tolist() for x in np.nonzero(holds(more) & new)), strict=True):
            yield r, text[r][:i] + sign + text[r][i:]


def _bitmap(words: DataFrame, n: int, most: int) -> np.ndarray:
    """Bits of all words' hashes. Tasks set them; the driver gets words of 64 bits, most / 64 of them at most."""
    bits = min(most, max(LEAST_BITS, 1 << (n * BITS_A_WORD - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots = [s for _, code in _by_length(b.column(0).to_pylist()) for s in _spots(hashes(code), bits)]
            at = np.concatenate(spots) if spots else np.zeros(0, np.uint64)
            value = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(value)], ["at", "value"])

    marked = words.select("word").mapInArrow(mark, "at long, value long").groupBy("at").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[marked.column("at").to_numpy()] = marked.column("value").to_numpy().view(np.uint64)
    return out


def near_pairs(words: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(word, near, near_n): all pairs of words (word, n), both ways, that differ by exactly one code point inserted, deleted or replaced."""
    spark = words.sparkSession
    n = words.count()
    alphabet = np.array(sorted(ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r["c"]), np.uint32)
    bitmap = spark.sparkContext.broadcast(_bitmap(words, n, most_bits))  # most_bits at most

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value.view(np.uint8)
        size = 8 * len(bits)

        def one(at: np.ndarray) -> np.ndarray:
            return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

        def holds(h: np.ndarray) -> np.ndarray:
            first, second = _spots(h, size)
            out = one(first).astype(bool)
            where = np.nonzero(out)
            out[where] = one(second[where]).astype(bool)
            return out

        for b in batches:
            got: list[tuple[str, str]] = []
            for names, code in _by_length(b.column(0).to_pylist()):
                step = max(1, EDITS // (code.shape[1] + 1))
                for at in range(0, len(names), step):
                    got += [(names[at + r], text) for r, text in edits(code[at : at + step], alphabet, holds)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in (0, 1)], ["word", "edit"])

    made = words.select("word").mapInArrow(make, "word string, edit string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), F.col("edit") == F.col("near")).select("word", "near", "near_n")


def forms(words: DataFrame, ratio: int = RATIO, most_bits: int = MOST_BITS) -> DataFrame:
    """(word, n, form, form_n, n_near): each word's most frequent near word, if it is `ratio` times as frequent."""
    best = near_pairs(words, most_bits).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    )
    taken = -F.col("best.minus") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    )


def roots(linked: DataFrame) -> DataFrame:
    """(word, root): where following forms from a word ends. Jumps double each round, so few rounds do."""
    ends = materialize(linked.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots", spent=[ends])
        ends = moved
        if not moved.where("moved").limit(1).count():
            return ends.select("word", "root")


def group_spellings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LETTERS,
    times: int = TIMES,
    ratio: int = RATIO,
    change: Callable[[int | None], Callable[[str], str]] = no_change,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """(word, n, form, form_n, root, n_near): the words of whole texts and what they are variants of.

    n counts all occurrences. form is the near word of the largest n (ties: the smallest in
    code-point order) if it is at least `ratio` times as frequent, else null, and form_n its n.
    root is where forms lead to, the word itself where it has none. A form is more frequent
    than its word, so forms never lead in circles if ratio is over 1. Null and empty texts have
    no words, rows that repeat count again, rows without an id are read as of an empty id, and
    other columns aren't looked at. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = materialize(count_words(docs, id_col, text_col, letters, times, change), "words")
    linked = materialize(forms(words, ratio, most_bits), "forms", spent=[words])
    out = linked.join(roots(linked), "word", "left")
    return out.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
