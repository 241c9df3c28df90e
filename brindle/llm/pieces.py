"""SentencePiece encoding and decoding for merge-type vocabularies.

A text starts as its characters. An agenda holds the adjacent pairs whose union is a piece of
the vocabulary, the best score first and of equal ones the leftmost; the best pair is merged,
its new neighbours join the agenda, and entries whose symbols have changed since are passed
over. Characters without a piece become bytes.

Symbols merge only to what the vocabulary has. Where its pieces have signs for spaces only in
front, nothing merges over the place before such a sign: a text is cut there, and a worker
remembers the segments that it has merged. A batch's new segments are merged together, each
with an agenda that is a row of a table; long ones have a heap each. Every segment that a
worker meets for the first time is encoded by the library as well, and every document's ids are
decoded by the library as well, an Arrow batch at a time; a difference is an error.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Segments remembered by a worker, and the longest one that is remembered, in characters.
SEGMENTS, LONGEST = 600_000, 64
#: Widths of the tables that merge new segments, and rows of one.
WIDTHS, TABLE = (8, 12, 16, 24, 48, 96), 16_384
#: Kinds of pieces in a model file (fixed values): ordinary, unknown, control, given by the user, unused, byte.
ORDINARY, UNKNOWN, CONTROL, GIVEN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model type of merge vocabularies (fixed value).
MERGES = 2


#: What follows the first sign for a space of a segment.
_SEGMENT = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


class Codec:
    """ids and texts by one model; check: hold new segments and all decoded texts against the library."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        if model.trainer_spec.model_type != MERGES:
            raise ValueError("the model's vocabulary isn't of the merge type")
        kinds = [p.type for p in model.pieces]
        if UNUSED in kinds:
            raise ValueError("vocabularies with unused pieces aren't taken")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.check = check
        spec = model.normalizer_spec
        given = sorted((p.piece for p in model.pieces if p.type == GIVEN), key=len, reverse=True)
        self.given = re.compile("(" + "|".join(map(re.escape, given)) + ")") if given else None
        #: whether the normalizer only puts a space before the text and signs for spaces
        self.plain = not (spec.precompiled_charsmap or spec.remove_extra_whitespaces or given) and spec.add_dummy_prefix and spec.escape_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (ORDINARY, GIVEN)}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type in (ORDINARY, GIVEN)}
        self.unknown = kinds.index(UNKNOWN)
        by_value = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes = [by_value[b] for b in range(256)] if len(by_value) == 256 else None
        self.begin, self.end = (np.array([i] if i >= 0 else [], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        inner = any(b == SPACE != a for p in self.ids for a, b in zip(p, p[1:], strict=False))
        #: whether texts may be cut before signs for spaces
        self.cuts = self.plain and self.bytes is not None and not inner
        self._known: dict[str, bytes] = {}
        shown = {CONTROL: "", UNKNOWN: model.trainer_spec.unk_surface}
        self.shown = [_utf8(shown.get(p.type, p.piece.replace(SPACE, " "))) for p in model.pieces]
        for value, i in by_value.items():
            self.shown[i] = bytes([value])
        #: as shown, but for control pieces what no text has, as they part the bytes around them
        joined = [b"\xff" if p.type == CONTROL else s for p, s in zip(model.pieces, self.shown, strict=True)]
        self.joined = np.frombuffer(b"".join(joined), np.uint8)
        self.size = np.array([len(x) for x in joined], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.byte_ids = frozenset(by_value.values())
        self.silent = frozenset(i for i, k in enumerate(kinds) if k == CONTROL)
        self.drops_space = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.drops_all = spec.remove_extra_whitespaces
        self._lay_out(len(model.pieces))

    def _lay_out(self, n: int) -> None:
        """Symbols by number (pieces have their ids, characters of pieces that are none follow) and the pairs that merge."""
        number = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            number.setdefault(c, n + len(number))
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.symbols = max(number.values(), default=0) + 1
        self.pieces = n
        found = [
            (number[p[:k]] * self.symbols + number[p[k:]], i, self.cost[p])
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        ]
        found.sort()
        self.pair = np.array([f[0] for f in found] + [np.iinfo(np.int64).max], np.int64)
        self.pair_id = np.array([f[1] for f in found] + [-1], np.int64)
        self.pair_cost = np.array([f[2] for f in found] + [np.inf], np.float64)

    def normalize(self, text: str) -> str:
        if self.plain:
            return SPACE + text.replace(" ", SPACE) if text else ""
        return self.library.normalize(text)

    def merge(self, text: str) -> list[str]:
        """The pieces of a text by the agenda."""
        piece = list(text)
        left, right = list(range(-1, len(piece) - 1)), list(range(1, len(piece) + 1))
        right[-1:] = [-1]
        agenda: list[tuple[float, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                cost = self.cost.get(piece[a] + piece[b])
                if cost is not None:
                    heapq.heappush(agenda, (cost, a, b, len(piece[a]) + len(piece[b])))

        for i in range(len(piece) - 1):
            propose(i, i + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not piece[a] or not piece[b] or len(piece[a]) + len(piece[b]) != size:
                continue
            piece[a], piece[b] = piece[a] + piece[b], ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            propose(left[a], a)
            propose(a, right[a])
        return [p for p in piece if p]

    def _numbers(self, pieces: list[str]) -> bytes:
        """ids of pieces; those without one become bytes, or as many unknown ones in a row one unknown id."""
        out: list[int] = []
        lost = False
        for p in pieces:
            i = self.ids.get(p)
            if i is None and self.bytes is not None:
                out += [self.bytes[b] for b in _utf8(p)]
            elif i is not None or not lost:
                out.append(self.unknown if i is None else i)
            lost = i is None
        return np.array(out, "<u4").tobytes()

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols merge to, and at which cost (infinite if they don't)."""
        key = np.where((left < 0) | (right < 0), -1, left * self.symbols + right)
        at = np.searchsorted(self.pair, key)
        met = self.pair[at] == key
        return np.where(met, self.pair_id[at], -1), np.where(met, self.pair_cost[at], np.inf)

    def _merge_rows(self, texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of at most width characters, one after the other, and how many each has."""
        n = len(texts)
        code = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, width)
        length = np.fromiter(map(len, texts), np.int64, n)
        place = np.arange(width)
        symbol = np.where(place < length[:, None], self.of_char[code], -1)
        # the agenda of each text: at each symbol, the cost of its pair with the next one
        to, cost = np.full((n, width), -1, np.int64), np.full((n, width), np.inf)
        to[:, :-1], cost[:, :-1] = self._look_up(symbol[:, :-1], symbol[:, 1:])
        before, after = np.tile(place - 1, (n, 1)), np.tile(place + 1, (n, 1))
        gone = place >= length[:, None]
        row = np.arange(n)
        while len(row):
            at = np.argmin(cost[row], 1)  # the first of equal ones
            going = cost[row, at] < np.inf
            row, at = row[going], at[going]
            other = after[row, at]
            symbol[row, at] = to[row, at]
            gone[row, other] = True
            cost[row, other] = np.inf
            then = after[row, other]
            after[row, at] = then
            inside = then < width
            before[row[inside], then[inside]] = at[inside]
            beyond = np.where(inside, symbol[row, np.minimum(then, width - 1)], -1)
            to[row, at], cost[row, at] = self._look_up(symbol[row, at], beyond)
            prior = before[row, at]
            led = prior >= 0
            r, p = row[led], prior[led]
            to[r, p], cost[r, p] = self._look_up(symbol[r, p], symbol[r, at[led]])
        left = symbol[~gone]
        lost = (left < 0) | (left >= self.pieces)  # characters, all of them
        signs = code[~gone][lost]
        size = np.ones(len(left), np.int64)
        size[lost] = 1 + (signs > 0x7F) + (signs > 0x7FF) + (signs > 0xFFFF)
        ids = np.repeat(left, size)
        ids[np.repeat(lost, size)] = np.array(self.bytes)[np.frombuffer(_utf8(signs.astype("<u4").tobytes().decode("utf-32-le")), np.uint8)]
        count = np.zeros(n, np.int64)
        np.add.at(count, np.nonzero(~gone)[0], size)
        return ids.astype("<u4"), count

    def _merge_all(self, segments: Iterable[str]) -> dict[str, bytes]:
        """The ids of new segments, which are named without their first sign for a space, in tables of like lengths."""
        out: dict[str, bytes] = {}
        names = sorted(segments, key=len)
        lengths = [1 + len(t) for t in names]
        low = 0
        for width in WIDTHS:
            high = bisect.bisect_right(lengths, width)
            for at in range(low, high, TABLE):
                some = names[at : min(at + TABLE, high)]
                ids, count = self._merge_rows([SPACE + t for t in some], width)
                raw, ends = ids.tobytes(), (4 * np.cumsum(count)).tolist()
                out.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            low = high
        out.update((t, self._numbers(self.merge(SPACE + t))) for t in names[low:])
        return out

    def _by_segments(self, texts: list[str]) -> list[bytes]:
        rows = []
        for text in texts:
            if not text:
                rows.append([])
            elif text[0] == " " or "  " in text or SPACE in text:
                rows.append(_SEGMENT.findall(SPACE + text.replace(" ", SPACE)))
            else:
                rows.append(text.split(" "))
        known = self._known
        new = set().union(*rows) - known.keys()
        if len(known) + len(new) > SEGMENTS:
            known.clear()
            new = set().union(*rows)
        fresh = self._merge_all(new)
        if self.check:
            self._hold(fresh)
        known.update(fresh)
        out = [b"".join([self.begin, *map(known.__getitem__, row), self.end]) for row in rows]
        for s in [s for s in fresh if len(s) > LONGEST]:
            del known[s]
        return out

    def _hold(self, fresh: dict[str, bytes]) -> None:
        """New segments by the library, which puts the first sign in front by itself."""
        asked = [s for s in fresh if s]
        told = self.library.encode(asked, num_threads=1)
        ours = list(map(fresh.__getitem__, asked))
        same = np.array_equal(4 * np.fromiter(map(len, told), np.int64), np.fromiter(map(len, ours), np.int64))
        if not same or np.fromiter(itertools.chain.from_iterable(told), "<u4").tobytes() != b"".join(ours):
            raise RuntimeError("the library encodes a segment otherwise")

    def _wholly(self, text: str) -> bytes:
        """A text by one agenda; pieces given by the user are cut out first, the longest ones before others."""
        norm = self.normalize(text)
        parts = [norm] if self.given is None else self.given.split(norm)
        return self._numbers([p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.merge(part))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Begin, ids, end of each text as little-endian unsigned 32-bit numbers."""
        if self.cuts:
            return self._by_segments(texts)
        out = [self.begin + self._wholly(t) + self.end for t in texts]
        if self.check:
            told = self.library.encode(texts, add_bos=bool(self.begin), add_eos=bool(self.end), num_threads=1)
            if [np.array(t, "<u4").tobytes() for t in told] != out:
                raise RuntimeError("the library encodes a text otherwise")
        return out

    def _runs(self, ids: list[int]) -> str:
        """The text of any ids: bytes that form no character become U+FFFD each."""
        out: list[str] = []
        start, at = True, 0  # start: nothing has been shown yet
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] in self.byte_ids:
                end += 1
            if end > at:
                raw = b"".join(self.shown[i] for i in ids[at:end])
                out.append(_characters(raw))
                start, at = False, end
                continue
            shown = self.shown[ids[at]].decode()
            if start and ids[at] not in self.silent:
                if self.drops_space and shown.startswith(" ") and ids[at] != self.unknown:
                    shown = shown[1:]
                    start = self.drops_all and not shown
                else:
                    start = False
            out.append(shown)
            at += 1
        return "".join(out)

    def decode(self, rows: list[bytes]) -> list[str]:
        """The texts of ids; an id that the vocabulary doesn't have is an IndexError."""
        lists = [np.frombuffer(r, "<u4") for r in rows]
        out = [self._plainly(row, ids) for row, ids in zip(rows, lists, strict=True)]
        lists = [ids.tolist() for ids in lists]
        out = [self._runs(ids) if text is None else text for ids, text in zip(lists, out, strict=True)]
        if self.check:
            for ids, text, told in zip(lists, out, self.library.decode(lists) if lists else [], strict=True):
                if text != told:
                    raise RuntimeError(f"the library decodes {ids[:20]}... otherwise")
        return out


    def _plainly(self, row: bytes, ids: np.ndarray) -> str | None:
        """The text of ids as encode() gives them: their bytes one after the other; None for others."""
        first, last = len(self.begin) // 4, len(self.end) // 4
        if not self.drops_space or self.drops_all or not (row.startswith(self.begin) and row.endswith(self.end) and len(ids) > first + last):
            return None
        ids = ids[first : len(ids) - last]
        if int(ids.max()) >= self.pieces:
            return None
        size = self.size[ids]
        ends = np.cumsum(size)
        raw = self.joined[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + size, size)].tobytes()
        led = raw[:1] == b" " and ids[0] not in self.byte_ids and ids[0] != self.unknown
        try:
            return (raw[1:] if led else raw).decode()
        except UnicodeDecodeError:  # parted or broken bytes
            return None


def _characters(raw: bytes) -> str:
    """UTF-8 as it is; each byte that is part of no character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + _characters(raw[e.start + 1 :]) if len(raw) < 200 else _long(raw)


def _long(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        width = next((n for n in range(1, 5) if _is_character(raw[at : at + n])), 0)
        out.append(raw[at : at + width].decode() if width else "�")
        at += width or 1
    return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def codec(path: str | None = None, check: bool = True) -> Codec:
    """The worker's codec; its memory of segments lasts from task to task."""
    return Codec(path or default_path(), check)


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, check: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit, begin and end included), decoded.

    ids are what the library gives for the whole text, and decoded what it gives back for them
    (a sign for a space comes back as a space). Null texts count as empty: begin and end alone,
    decoded to nothing. Repeated rows and repeated or null ids are documents of their own;
    texts may have any length; an empty table gives no rows; other columns aren't looked at.
    Nothing is shuffled, and no document is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model_path, check)
        for b in batches:
            ids = made.encode([t or "" for t in b.column(1).to_pylist()])
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(made.decode(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None, check: bool = True) -> DataFrame:
    """(doc_id, decoded) of any ids in the form that encode() gives; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model_path, check)
        for b in batches:
            texts = made.decode([x or b"" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, decoded string")
