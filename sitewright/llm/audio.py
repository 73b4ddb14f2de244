"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

``parse`` reads any MPEG 1, 2 or 2.5 stream of layers I to III: it skips ID3 tags, finds frame headers again after
foreign bytes, checks the CRCs of layers I and III (those of layer II cover what its allocation says and aren't checked),
reads Xing/Info and VBRI tables and gives exact durations, at whatever rates, and a byte offset per frame.
``pack`` stores a payload in the ancillary bytes of silent layer III frames: a format's own unit, read back unchanged.

Defined results: a null or empty text is a payload of 64 zero bytes; equal payloads give equal files; bytes that are no
stream parse as no frames, all skipped; repeated rows give repeated rows; other columns are ignored; an empty table
gives an empty result. One file is in memory at a time beside its batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stage, text_of

# Fixed values of the format: kbit/s by (version 1?, layer), Hz of version 1.
_KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = (44100, 48000, 32000)
_VERSION = {0: 2.5, 2: 2, 3: 1}
_LAYER = {3: 1, 2: 2, 1: 3}

RATE, UNIT = 32000, 64


def _crc_table() -> tuple[int, ...]:
    out = []
    for b in range(256):
        r = b << 8
        for _ in range(8):
            r = (r << 1) ^ 0x8005 if r & 0x8000 else r << 1
        out.append(r & 0xFFFF)
    return tuple(out)


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    r = 0xFFFF
    for b in data:
        r = (r << 8 & 0xFF00) ^ _CRC[r >> 8 ^ b]
    return r


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    hz: int
    mono: bool
    size: int
    samples: int
    #: Subbands that both channels of joint stereo have of their own (layer I).
    bound: int = 32

    @property
    def covered(self) -> int:
        """Bytes behind the checksum that it covers: side information, or the four bits of each subband's allocation."""
        return self.side if self.layer == 3 else (32 if self.mono else self.bound + 32) // 2

    @property
    def side(self) -> int:
        """Bytes of layer III's side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def body(self) -> int:
        return 6 if self.protected else 4


_headers: dict[int, Header | None] = {}
#: Headers differ in the bits of the rate, the mode and its extension; others are masked.


def header(word: int) -> Header | None:
    """The header that 32 bits make, if they do."""
    key = word & 0xFFFFFFF0
    if key not in _headers:
        _headers[key] = _header(word)
    return _headers[key]


def _header(word: int) -> Header | None:
    version, layer = _VERSION.get(word >> 19 & 3), _LAYER.get(word >> 17 & 3)
    rate, hz = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer is None or rate in (0, 15) or hz == 3:
        return None
    kbps = _KBPS[version == 1, layer][rate]
    hz = int(_HZ[hz] / version) if version != 2.5 else _HZ[hz] // 4
    pad = word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    bound = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32
    return Header(version, layer, not word >> 16 & 1, kbps, hz, word >> 6 & 3 == 3, size, samples, bound)


@dataclass
class Stream:
    hz: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    checked: int = 0
    broken: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    seek: tuple[int, ...] = ()
    #: Samples at each rate.
    at_rate: dict[int, int] = field(default_factory=dict)

    @property
    def duration_us(self) -> int:
        return int(sum(Fraction(n * 1_000_000, hz) for hz, n in self.at_rate.items()))


def _id3v2(data: bytes, out: Stream) -> int:
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, at = min(10 + size, len(data)), 10
    while at + 10 <= end and data[at : at + 4].isalnum():
        raw = data[at + 4 : at + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if data[3] == 4 else struct.unpack(">I", raw)[0]
        body = data[at + 10 : min(at + 10 + n, end)]
        if body and data[at : at + 1] == b"T":
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:].decode(code, "replace").rstrip("\0")
            name = data[at : at + 4].decode()
            if name == "TXXX" and "\0" in text:
                name, text = text.split("\0", 1)
            out.tags[name] = text
        at += 10 + n
    return end


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads a variable-bitrate table; a frame with one holds no sound."""
    mark = at + h.body + h.side
    if data[mark : mark + 4] in (b"Xing", b"Info"):
        out.table = data[mark : mark + 4].decode()
        flags, p = int.from_bytes(data[mark + 4 : mark + 8]), mark + 8
        if flags & 1:
            out.table_frames, p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & 4:
            out.seek = tuple(data[p : p + 100])
        return True
    mark = at + 4 + 32
    if data[mark : mark + 4] == b"VBRI":
        out.table = "VBRI"
        out.table_bytes, out.table_frames = struct.unpack(">II", data[mark + 10 : mark + 18])
        n, _, width = struct.unpack(">HHH", data[mark + 18 : mark + 24])
        p = mark + 26
        out.seek = tuple(int.from_bytes(data[p + k * width : p + (k + 1) * width]) for k in range(n) if p + (k + 1) * width <= at + h.size)
        return True
    return False


def parse(data: bytes) -> Stream:
    out = Stream()
    at, end = _id3v2(data, out), len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags.setdefault("v1", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    first = True
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4]))
        follows = h and at + h.size
        # A lone sync pattern isn't a frame: the next header, or the end, must be where this one says.
        if not h or follows > end or follows + 4 <= end and not header(int.from_bytes(data[follows : follows + 4])):
            found = data.find(b"\xff", at + 1, end)
            out.skipped += (found if found > 0 else end) - at
            at = found if found > 0 else end
            continue
        if h.protected:
            if h.layer != 2:
                covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.covered]
                out.checked += 1
                out.broken += crc16(covered) != int.from_bytes(data[at + 4 : at + 6])
        if not (first and h.layer == 3 and _table(data, at, h, out)):
            out.hz = out.hz or h.hz
            out.samples += h.samples
            out.at_rate[h.hz] = out.at_rate.get(h.hz, 0) + h.samples
            out.offsets.append(at)
            out.sizes.append(h.size)
        first = False
        at += h.size
    out.skipped += max(0, end - at)
    return out


# ---- a payload in silent frames -------------------------------------------------------------------------------

_HEAD = 4 + 2 + 17
_SIZES = {k: 144 * k * 1000 // RATE for k in _KBPS[True, 3] if k}
_frames: dict[int, bytes] = {}


def _head(kbps: int) -> bytes:
    """Header, CRC and empty side information of a silent mono frame."""
    if kbps not in _frames:
        word = 0x7FF << 21 | 3 << 19 | 1 << 17 | _KBPS[True, 3].index(kbps) << 12 | _HZ.index(RATE) << 10 | 3 << 6
        raw, side = word.to_bytes(4), bytes(17)
        _frames[kbps] = raw + crc16(raw[2:] + side).to_bytes(2) + side
    return _frames[kbps]


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name + len(body).to_bytes(4) + b"\0\0" + body


def pack(payload: bytes) -> bytes:
    """A file of ID3v2 tag, Xing table, frames as large as the rest of the payload needs, and ID3v1 tag."""
    large = max(_SIZES)
    parts, sizes, at = [], [], 0
    while at < len(payload):
        room = _SIZES[large] - _HEAD
        left = len(payload) - at
        kbps = large if left >= room else min(k for k, n in _SIZES.items() if n - _HEAD >= left)
        piece = payload[at : at + _SIZES[kbps] - _HEAD]
        parts.append(_head(kbps) + piece + bytes(_SIZES[kbps] - _HEAD - len(piece)))
        sizes.append(_SIZES[kbps])
        at += len(piece)
    table_kbps = 64
    total = _SIZES[table_kbps] + sum(sizes)
    n = len(parts)
    # The table's marks are 256ths of the file at each hundredth of its time; all but the last frame are of one size.
    marks = bytes(min(255, 256 * (_SIZES[table_kbps] + n * k // 100 * _SIZES[large]) // total) for k in range(100))
    table = b"Xing" + (7).to_bytes(4) + n.to_bytes(4) + total.to_bytes(4) + marks
    info = _head(table_kbps) + table
    info += bytes(_SIZES[table_kbps] - len(info))
    tag = _text_frame(b"TLEN", str(n * 1152 * 1000 // RATE)) + _text_frame(b"TXXX", f"payload\0{len(payload)}")
    size = len(tag)
    front = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag
    return front + info + b"".join(parts) + b"TAG" + b"payload".ljust(125, b"\0")


def unpack(data: bytes) -> tuple[bytes, Stream]:
    s = parse(data)
    raw = b"".join(data[a + _HEAD : a + n] for a, n in zip(s.offsets, s.sizes, strict=True))
    return raw[: int(s.tags["payload"])], s


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


# ---- columns --------------------------------------------------------------------------------------------------


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of (doc_id, text)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), t.as_py().encode()) for b in frames for i, t in zip(b.column(0), b.column(1), strict=True))
        for part in batches(rows, lambda r: len(r[1]), 4 << 20):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in part], pa.int64()), pa.array([len(t) for _, t in part], pa.int64()), pa.array([pack(padded(t)) for _, t in part], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


_FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
     ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_us", pa.int64()), ("seek_offsets", pa.list_(pa.int64()))]
)


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: the payload's digests, and the stream's duration and frame offsets."""

    def one(doc_id: int, n_bytes: int, data: bytes) -> tuple:
        payload, s = unpack(data)
        if s.broken:
            raise ValueError("a stored frame differs from its checksum")
        said = f"hz={s.hz};samples={s.samples};frames={len(s.offsets)};{s.table}={s.table_frames}/{s.table_bytes};crc={s.checked - s.broken}/{s.checked};skipped={s.skipped}"
        return (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), said, s.duration_us, s.offsets)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(x.as_py() for x in r) for b in frames for r in zip(*b.columns, strict=True))
        for part in batches(rows, lambda r: len(r[2]), 4 << 20):
            got = list(zip(*(one(*r) for r in part), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, _FEATURES.types, strict=True)], schema=_FEATURES)

    kinds = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_us bigint, seek_offsets array<bigint>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, kinds)


def digest(docs: DataFrame) -> DataFrame:
    return features(stage(encode(docs), "media"))
