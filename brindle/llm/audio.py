"""MPEG audio as a media column: writing frames that carry bytes, and reading any stream of frames.

The reader looks for frame headers again after anything it can't follow, reads ID3 tags and
the Xing/Info and VBRI tables, checks the CRC-16 of protected frames of all layers and the
CRC-32 that the writer leaves in its tag, and gives exact durations (as samples and sampling
rate) and every frame's offset.
The writer stores bytes as they are in the main data of MPEG-1 Layer III frames at 48 kHz,
where a frame of b kbit/s has exactly 3 b bytes; the last frames take smaller bit rates, so
that the stream has a variable bit rate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bit rate index 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz by version (1, 2, 2.5) and index.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
#: What two bits say of version and layer; None is reserved.
VERSIONS = (25, None, 2, 1)
LAYERS = (None, 3, 2, 1)
#: Bits of allocation of each subband of Layer II, as (subbands, bits) in order: the four tables of version 1, then that of 2.
ALLOCATION = (
    ((11, 4), (12, 3), (4, 2)), ((11, 4), (12, 3), (7, 2)), ((2, 4), (6, 3)), ((2, 4), (10, 3)), ((4, 4), (7, 3), (19, 2)),
)


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int  # kbit/s
    rate: int
    padding: int
    mono: bool
    mode: int
    mode_extension: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.bitrate * 1000 // self.rate + self.padding) * 4
        return self.samples // 8 * self.bitrate * 1000 // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information, of Layer III only."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def read_header(four: bytes) -> Header | None:
    """The header in four bytes; None if they aren't one. Free format isn't followed."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS[four[1] >> 3 & 3], LAYERS[four[1] >> 1 & 3]
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer is None or not 1 <= index <= 14 or rate == 3 or four[3] & 3 == 2:
        return None
    kind = (1 if version == 1 else 2, layer)
    mode = four[3] >> 6
    return Header(
        version, layer, not four[1] & 1, BITRATES[kind][index - 1], RATES[version][rate], four[2] >> 1 & 1, mode == 3, mode, four[3] >> 4 & 3
    )


@lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of data's first bits (all of them by default): polynomial 0x8005, from all ones, high bit first. Frames of a kind share it."""
    value = 0xFFFF
    for at in range(8 * len(data) if bits is None else bits):
        one = data[at >> 3] >> (7 - (at & 7)) & 1
        value = (value << 1 ^ 0x8005 if (value >> 15) ^ one else value << 1) & 0xFFFF
    return value


def _subbands(h: Header) -> list[int]:
    """Bits of allocation of each subband of a Layer II frame; the table goes by version, rate and bit rate of a channel."""
    each = h.bitrate // (1 if h.mono else 2)
    if h.version != 1:
        table = 4
    elif 56 <= each <= 80 or each >= 56 and h.rate == 48000:
        table = 0
    elif each >= 96:
        table = 1
    else:
        table = 3 if h.rate == 32000 else 2
    return [bits for n, bits in ALLOCATION[table] for _ in range(n)]


def checked_bits(frame: bytes, h: Header) -> int | None:
    """How many bits after the checksum it covers, besides the header's last 16; None if the frame is too short for them.

    In Layer III that is the side information, in Layer I the allocation, in Layer II the
    allocation and two bits of scale factor selection for each allocated subband.
    """
    if h.layer == 3:
        return 8 * h.side
    widths = [4] * 32 if h.layer == 1 else _subbands(h)
    bound = len(widths) if h.mono or h.mode != 1 else min(len(widths), 4 * (h.mode_extension + 1))
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (bound * channels + len(widths) - bound)
    whole, at, chosen = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6), 0
    used = 0
    for sub, width in enumerate(widths):
        for _ in range(channels if sub < bound else 1):
            used += width
            if used > at:
                return None
            if whole >> (at - used) & ((1 << width) - 1):
                chosen += 1 if sub < bound else channels
    return used + 2 * chosen if used + 2 * chosen <= at else None


def sound(frame: bytes, h: Header) -> bool:
    """Whether a protected frame's checksum holds."""
    bits = checked_bits(frame[: 6 + 64], h) if h.layer == 2 else checked_bits(frame, h)
    if bits is None or 6 + bits / 8 > len(frame):
        return False
    return crc16(frame[2:4] + frame[6 : 6 + (bits + 7) // 8], 16 + bits) == int.from_bytes(frame[4:6], "big")


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _to_syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def read_id3(data: bytes) -> tuple[int, dict[str, bytes]]:
    """Where an ID3v2 tag at the start ends, and its frames; (0, {}) without one."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    end = 10 + _syncsafe(data[6:10]) + (10 if data[5] & 0x10 else 0)
    frames, at, stop = {}, 10, min(len(data), 10 + _syncsafe(data[6:10]))
    if data[5] & 0x40 and at + 4 <= stop:  # an extended header
        at += _syncsafe(data[at : at + 4]) if data[3] == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    while at + 10 <= stop and data[at]:
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        frames.setdefault(data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size])
        at += 10 + size
    return end, frames


def read_vbr(frame: bytes, header: Header) -> dict | None:
    """The Xing, Info or VBRI table in a frame: frames, bytes and the seek table, as far as given."""
    at = 4 + (2 if header.protected else 0) + header.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, out, p = int.from_bytes(frame[at + 4 : at + 8], "big"), {"kind": frame[at : at + 4].decode()}, at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4:
            out["toc"] = tuple(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI":
        take = lambda a, n: int.from_bytes(frame[36 + a : 36 + a + n], "big")
        entries, scale, width = take(18, 2), take(20, 2), take(22, 2)
        return {"kind": "VBRI", "bytes": take(10, 4), "frames": take(14, 4), "toc": tuple(take(26 + i * width, width) * scale for i in range(entries))}
    return None


@dataclass
class Scan:
    """What a stream of frames is found to hold."""

    tags: dict[str, bytes] = field(default_factory=dict)
    headers: list[Header] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    vbr: dict | None = None
    skipped: int = 0
    resyncs: int = 0
    bad_crc: int = 0
    cut: int = 0
    id3v1: bool = False

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly; a table's frame isn't sound."""
        return sum((Fraction(h.samples, h.rate) * n for h, n in self._kinds().items()), Fraction())

    def _kinds(self) -> dict[Header, int]:
        out: dict[Header, int] = {}
        for h in self.headers:
            out[h] = out.get(h, 0) + 1
        return out

    def seek(self, seconds: Fraction) -> int:
        """The offset of the frame that sounds at a time; the stream's last for later ones."""
        now = Fraction()
        for h, offset in zip(self.headers, self.offsets, strict=True):
            now += Fraction(h.samples, h.rate)
            if now > seconds:
                return offset
        return self.offsets[-1] if self.offsets else 0


def _kind(h: Header) -> tuple[int, int, int]:
    return h.version, h.layer, h.rate


def _follows(data: bytes, at: int, end: int, known: tuple[int, int, int] | None) -> bool:
    """Whether the header at a place, found without one before it, can be trusted.

    Its frame must be all there, and the stream's end or a header of the same kind must follow.
    Where it is of another kind than the stream so far, that holds for the next frame too.
    """
    first = read_header(data[at : at + 4])
    for _ in range(1 if known is None or first is not None and _kind(first) == known else 2):
        here = read_header(data[at : at + 4])
        if here is None or here.size < 4 or _kind(here) != _kind(first) or at + here.size > end:
            return False
        at += here.size
        if at == end:
            return True
    after = read_header(data[at : at + 4]) if at + 4 <= end else None
    return after is not None and _kind(after) == _kind(first)


def _trusted(data: bytes, at: int, stop: int, end: int, known: tuple[int, int, int] | None) -> int:
    """The first place from at and before stop whose header can be trusted, or -1."""
    while (at := data.find(b"\xff", at, stop)) >= 0 and not _follows(data, at, end, known):
        at += 1
    return at


def scan(data: bytes) -> Scan:
    """Read a stream. A first header, and one after bytes that are no frame, counts if what follows it says so too.

    Frames that follow each other without a gap are of one kind (version, layer and rate). A
    header in step whose frame isn't followed by another gives way to one within that frame
    that is. After anything else the next header is looked for; skipped and resyncs tell how
    many bytes and times. A last frame in step that isn't all there counts as cut.
    """
    out = Scan()
    at, out.tags = read_id3(data)
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end, out.id3v1 = end - 128, True
    lost, first, in_step = False, True, False
    known: tuple[int, int, int] | None = None
    while at + 4 <= end:
        header = read_header(data[at : at + 4])
        nxt = -1
        if header is None or header.size < 4:
            header = None
        elif in_step and _kind(header) == known:
            if not _follows(data, at, end, known):
                nxt = _trusted(data, at + 1, min(at + header.size, end), end, known)
                header = header if nxt < 0 else None
        elif not _follows(data, at, end, known):
            header = None
        if header is None:
            nxt = nxt if nxt >= 0 else data.find(b"\xff", at + 1, end)
            nxt = nxt if nxt >= 0 else end
            out.resyncs += not lost
            out.skipped += nxt - at
            at, lost, in_step = nxt, True, False
            continue
        after = at + header.size
        if after > end:
            break
        lost, in_step, known = False, True, _kind(header)
        frame = data[at:after]
        if header.protected:
            out.bad_crc += not sound(frame, header)
        table = read_vbr(frame, header) if first else None
        if table:
            out.vbr = table
        else:
            out.headers.append(header)
            out.offsets.append(at)
        first = False
        at = after
    out.cut = end - at if in_step else 0
    out.skipped += 0 if in_step else end - at
    return out


#: The writer's frames: MPEG-1 Layer III, 48 kHz, protected, mono.
_SIDE = bytes(17)
_LARGEST = 14


@lru_cache(maxsize=64)
def _lead(index: int) -> bytes:
    """Header, checksum and empty side information of the writer's frame of a bit rate index."""
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 3 << 6))
    return head + crc16(head[2:] + _SIDE).to_bytes(2, "big") + _SIDE


def _room(index: int) -> int:
    return 3 * BITRATES[1, 3][index - 1] - 23


def write(payload: bytes) -> bytes:
    """payload as a stream: an ID3v2.4 tag with its length and CRC-32, an Xing table, and frames."""
    largest, lead = _room(_LARGEST), _lead(_LARGEST)
    frames = [lead + payload[i : i + largest] for i in range(0, len(payload) // largest * largest, largest)]
    rest = payload[len(frames) * largest :]
    if rest:
        index = next(i for i in range(1, 15) if _room(i) >= len(rest))
        frames.append(_lead(index) + rest.ljust(_room(index), b"\0"))
    body = b"".join(frames)
    count, total = len(frames), len(body) + 3 * BITRATES[1, 3][3]
    sizes = [len(f) for f in frames]
    big = sizes[0] if sizes else 0
    toc = bytes(min(255, 256 * (3 * BITRATES[1, 3][3] + min(count * p // 100, count) * big) // total) for p in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    first = (_lead(4) + table).ljust(3 * BITRATES[1, 3][3], b"\0")
    owner = b"payload\0" + len(payload).to_bytes(8, "big") + zlib.crc32(payload).to_bytes(4, "big")
    tag = b"PRIV" + _to_syncsafe(len(owner)) + b"\0\0" + owner
    return b"ID3\4\0\0" + _to_syncsafe(len(tag)) + tag + first + body


def read(data: bytes, found: Scan) -> bytes:
    """The payload of a written stream; ValueError if its length or checksum isn't what the tag says."""
    owner = found.tags.get("PRIV", b"")
    if not owner.startswith(b"payload\0"):
        raise ValueError("the stream has no payload tag")
    size, check = int.from_bytes(owner[8:16], "big"), int.from_bytes(owner[16:20], "big")
    parts = [data[at + 23 : at + h.size] for h, at in zip(found.headers, found.offsets, strict=True)]
    payload = b"".join(parts)[:size]
    if len(payload) != size or zlib.crc32(payload) != check or found.bad_crc:
        raise ValueError("the stream's payload is damaged")
    return payload


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 with zeros up to a positive multiple of 64, and its length without them."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def feature(found: Scan) -> str:
    """A stream's durations and seek points as text."""
    seconds = found.duration
    points = ",".join(str(found.offsets[len(found.offsets) * q // 4]) for q in range(4)) if found.offsets else ""
    rates = sorted({h.bitrate for h in found.headers})
    return (
        f"frames={len(found.headers)};seconds={seconds.numerator}/{seconds.denominator};kbps={rates[0] if rates else 0}-{rates[-1] if rates else 0}"
        f";table={found.vbr['kind'] if found.vbr else 'none'};seek={points};bad_crc={found.bad_crc};skipped={found.skipped}"
    )


def add_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with media_col, each text's padded UTF-8 as an MPEG audio stream; a column of that name is replaced.

    Null texts are stored as empty ones. All rows and other columns stay.
    """

    @F.pandas_udf("binary")
    def stored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series([write(padded(t)[0]) for t in x], dtype=object)

    return docs.withColumn(media_col, stored(F.col(text_col).cast("string")))


SCAN_SCHEMA = (
    "payload binary, frames long, samples long, rate int, vbr_kind string, vbr_frames long,"
    " bad_crc long, resyncs long, skipped long, offsets array<long>, feature string, intact boolean"
)


def scan_media(docs: DataFrame, media_col: str = "media", out_col: str = "audio") -> DataFrame:
    """docs with a struct of what the reader finds in media_col; null media give null. A column of that name is replaced.

    Streams that add_media didn't write, or that are damaged, have no payload and intact false;
    their frames and durations are given as far as they can be followed.
    """

    names = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]

    @F.pandas_udf(SCAN_SCHEMA)
    def scanned(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in media:
            rows = []
            for m in x:
                if m is None:
                    rows.append((None,) * 12)
                    continue
                m = bytes(m)
                s = scan(m)
                try:
                    payload, intact = read(m, s), True
                except ValueError:
                    payload, intact = None, False
                rate = s.headers[0].rate if s.headers else 0
                rows.append(
                    (payload, len(s.headers), sum(h.samples for h in s.headers), rate, s.vbr["kind"] if s.vbr else None)
                    + (s.vbr.get("frames") if s.vbr else None, s.bad_crc, s.resyncs, s.skipped, s.offsets, feature(s), intact)
                )
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return docs.withColumn(out_col, F.when(F.col(media_col).isNotNull(), scanned(F.col(media_col))))
