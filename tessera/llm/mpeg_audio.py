"""MPEG audio media columns: carry bytes in Layer III frames, and parse any MPEG audio stream.

``encode`` writes an ID3v2.4 tag, an ``Info`` frame with frame count, byte count and a seek table, and
then MPEG-1 Layer III frames (48 kHz, mono, 224 kbit/s, with CRC) of silence whose ancillary bytes hold
576 bytes of payload each.  ``parse`` resynchronises on chains of frame headers, reads tags and
variable-bitrate tables (Xing, Info, VBRI) and compares them with the frames, verifies the frame checksums of all
layers and returns the exact duration and every seek offset.  Free-format frames are skipped as noise.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import slices, stash, text_column

#: Fixed values of ISO 11172-3 and 13818-3: kbit/s by index for version 1 and layers I, II, III; then versions 2 and 2.5, layer I and layers II, III.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: Layer II: bits of the allocation of each subband, by table (a, b, c, d of version 1, and version 2's).
ALLOCATION = {"a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10, "2": (4,) * 4 + (3,) * 7 + (2,) * 19}
#: Where a VBRI table starts in its frame.
VBRI = 36

PAYLOAD, FRAME, SIDE = 576, 672, 17
_HEAD = bytes((0xFF, 0xFA, 0xC4, 0xC0))


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    crc: bool
    kbps: int
    hertz: int
    mono: bool
    size: int
    samples: int
    bound: int

    @property
    def side(self) -> int:
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames (no stated bitrate) are not accepted."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, speed = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or speed in (0, 15) or four[3] & 3 == 2:
        return None
    kbps = KBPS[(1, layer) if version == 3 else (2, 1 if layer == 1 else 2)][speed]
    hertz, pad = HERTZ[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32  # subbands above it share joint stereo's allocation
    return Header(version, layer, not four[1] & 1, kbps, hertz, four[3] >> 6 == 3, size, samples, bound)


def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return tuple(out)


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005 and start 0xFFFF over the first ``bits`` bits, all of them by default."""
    bits = 8 * len(data) if bits is None else bits
    out = 0xFFFF
    for byte in data[: bits // 8]:
        out = (out << 8 & 0xFFFF) ^ _CRC[out >> 8 ^ byte]
    for i in range(bits % 8):
        top = out >> 15 ^ data[bits // 8] >> 7 - i & 1
        out = (out << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return out


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits behind the checksum it covers: side information, or allocation (and scale factor selection)."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        low = h.bound if channels == 2 else 32
        return 4 * (channels * low + (32 - low))
    rate = h.kbps // channels
    if h.version != 3:
        bands = ALLOCATION["2"]
    elif rate >= 56 and (h.hertz == 48000 or rate <= 80):
        bands = ALLOCATION["a"]
    elif rate >= 96:
        bands = ALLOCATION["b"]
    else:
        bands = ALLOCATION["d" if h.hertz == 32000 else "c"]
    whole, at, chosen = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(bands):
        for _ in range(channels if band < h.bound else 1):
            # a shared allocation still selects scale factors for both channels
            chosen += (channels if band >= h.bound else 1) * bool(whole >> 512 - at - width & (1 << width) - 1)
            at += width
    return at + 2 * chosen


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


_SILENT = _HEAD + crc16(_HEAD[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)
_FILL = bytes(FRAME - len(_SILENT) - PAYLOAD)


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of PAYLOAD."""
    return data + b"\xff" * (PAYLOAD - len(data) % PAYLOAD if len(data) % PAYLOAD or not data else 0)


def encode(data: bytes) -> bytes:
    """The MPEG audio stream that carries ``padded(data)``; its tag states the length without padding."""
    payload = padded(data)
    note = b"\x03payload_bytes\x00" + str(len(data)).encode()
    tag = b"TXXX" + _synchsafe(len(note)) + b"\0\0" + note
    tag = b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag
    frames = len(payload) // PAYLOAD
    total = FRAME * (frames + 1)
    table = bytes(min(255, (FRAME + frames * i // 100 * FRAME) * 256 // total) for i in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + total.to_bytes(4, "big") + table
    out = [tag, _SILENT, info, bytes(FRAME - len(_SILENT) - len(info))]
    for at in range(0, len(payload), PAYLOAD):
        out += [_SILENT, payload[at : at + PAYLOAD], _FILL]
    return b"".join(out)


@dataclass(frozen=True)
class SeekTable:
    """A variable-bitrate table: its kind, stated frames and bytes (-1: not stated) and seek points, bytes from its frame's start."""

    kind: str
    frames: int
    size: int
    points: tuple[int, ...]


@dataclass
class Stream:
    """What a stream holds: tags, a seek table and whether it is true of the frames, frames, and how much had to be skipped."""

    tags: dict[str, str] = field(default_factory=dict)
    table: SeekTable | None = None
    table_right: bool = False
    seconds: Fraction = Fraction(0)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    bad_crc: int = 0
    skipped: int = 0


def seek_table(frame: bytes, h: Header) -> SeekTable | None:
    """The Xing, Info or VBRI table in a frame, if it holds one."""
    number = lambda at, size: int.from_bytes(frame[at : at + size], "big")
    at = 4 + 2 * h.crc + h.side
    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info"):
        flags, kind, at = number(at + 4, 4), frame[at : at + 4].decode(), at + 8
        frames, at = (number(at, 4), at + 4) if flags & 1 else (-1, at)
        size, at = (number(at, 4), at + 4) if flags & 2 else (-1, at)
        points = tuple(size * b // 256 for b in frame[at : at + 100]) if flags & 4 and size >= 0 else ()
        return SeekTable(kind, frames, size, points)
    if h.layer == 3 and frame[VBRI : VBRI + 4] == b"VBRI":
        entries, scale, width = number(VBRI + 18, 2), number(VBRI + 20, 2), number(VBRI + 22, 2)
        points, place = [], h.size
        for i in range(entries if width in (1, 2, 3, 4) else 0):
            points.append(place)
            place += scale * number(VBRI + 26 + i * width, width)
        return SeekTable("VBRI", number(VBRI + 14, 4), number(VBRI + 10, 4), tuple(points))
    return None


def _true(table: SeekTable, start: int, end: int, stream: Stream) -> bool:
    """Whether stated frames and bytes are those found and every seek point lies within the stream, in order."""
    counted = table.frames in (-1, len(stream.offsets)) and table.size in (-1, end - start)
    return counted and all(a <= b for a, b in zip(table.points, table.points[1:])) and all(0 <= p <= end - start for p in table.points)


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2.3 or 2.4 tag at the start, and where the tag ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end = min(len(data), 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0))))
    at, out = 10, {}
    while at + 10 <= end and data[at]:
        name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        size = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0))) if data[3] == 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out[key] = value
        at += 10 + size
    return out, end


def parse(data: bytes) -> Stream:
    """Every frame of a stream; bytes that start no frame chain are skipped and counted.

    A header starts a chain when another of the same version, layer and rate, the end or a trailing ID3v1 tag
    follows its frame, and continues one when it agrees with the frame before; a truncated frame is skipped.
    """
    tags, at = _tags(data)
    out, end = Stream(tags), len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    last: Header | None = None
    while at < end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        if h and after <= end:
            chained = last is not None and (h.version, h.layer, h.hertz) == (last.version, last.layer, last.hertz)
            nxt = header(data[after : after + 4]) if after < end else h
            if not chained and (nxt is None or (nxt.version, nxt.layer, nxt.hertz) != (h.version, h.layer, h.hertz)):
                h = None
        else:
            h = None
        if h is None:
            nxt_at = data.find(b"\xff", at + 1, end)
            nxt_at = end if nxt_at < 0 else nxt_at
            out.skipped += nxt_at - at
            at = nxt_at
            continue
        body = at + 4 + 2 * h.crc
        if h.crc:
            bits = protected_bits(h, data[body : body + 64])
            if int.from_bytes(data[at + 4 : at + 6], "big") != crc16(data[at + 2 : at + 4] + data[body : body + -(-bits // 8)], 16 + bits):
                out.bad_crc += 1
        table = seek_table(data[at:after], h) if last is None else None
        if table:
            out.table, table_at = table, at
        else:
            out.offsets.append(at)
            out.headers.append(h)
            out.seconds += Fraction(h.samples, h.hertz)
        last, at = h, after
    if out.table:
        out.table_right = _true(out.table, table_at, end, out)
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The padded payload that ``encode`` stored."""
    skip = len(_SILENT)
    return b"".join(data[at + skip : at + skip + PAYLOAD] for at in stream.offsets)


def feature(stream: Stream) -> str:
    """Frames, exact seconds, bitrate range, seek table, checksum failures, skipped bytes and a digest of the seek offsets."""
    rates = [h.kbps for h in stream.headers] or [0]
    seeks = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in stream.offsets))
    return f"frames={len(stream.offsets)};seconds={stream.seconds};kbps={min(rates)}-{max(rates)};table={stream.table.kind if stream.table else 'none'}{'' if stream.table_right or not stream.table else '-wrong'};bad_crc={stream.bad_crc};skipped={stream.skipped};seek_crc32={seeks:08x}"


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media: the stream that carries the row's text in UTF-8 (null: empty)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([encode(t.encode()) for t in text_column(batch.column(text_col))], pa.binary())], [id_col, "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, media binary")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from streams, a row each.

    The carried payload's sizes and digests, media_bytes, media_sha256, ``feature``, and seconds, duration (the exact
    fraction of a second), seek_offsets (the byte offset of every audio frame), seek_table (its kind), seek_points,
    table_right, bad_crc, skipped.  A null stream counts as one without frames; ids may be null or repeat; an empty table
    gives an empty result.
    """
    kind = media.schema[id_col].dataType.simpleString()
    kinds = {
        "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "seconds": pa.float64(), "duration": pa.string(),
        "seek_offsets": pa.list_(pa.int64()), "seek_table": pa.string(), "seek_points": pa.list_(pa.int64()), "table_right": pa.bool_(), "bad_crc": pa.int64(), "skipped": pa.int64(),
    }
    names = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 20):
            rows = []
            for data in (d or b"" for d in batch.column("media").to_pylist()):
                stream = parse(data)
                payload = payload_of(data, stream)
                rows.append((
                    int(stream.tags.get("payload_bytes", 0)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream), float(stream.seconds), str(stream.seconds),
                    stream.offsets, stream.table.kind if stream.table else None, list(stream.table.points) if stream.table else None, stream.table_right, stream.bad_crc, stream.skipped,
                ))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], [id_col, *kinds])

    return media.select(id_col, "media").mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} {names[t]}" for n, t in kinds.items()))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``with_media`` written to the shared folder and read back. Ids may be null or repeat."""
    return stash(with_media(docs, id_col, text_col), "zstd", 32 << 20)
