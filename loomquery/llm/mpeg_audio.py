"""MPEG audio columns: build and parse MPEG audio streams.

``pack`` carries 8-bit samples losslessly in MPEG-2 Layer III frames: 576
samples a frame at 16 kHz mono, every frame with CRC-16, variable bitrate, a
tag frame with the seek table, and ID3v2 and ID3v1 tags.  The frames have valid
headers, side information and checksums; their main data region holds the raw
samples instead of Huffman-coded spectra, and the side information says so by
its (otherwise unused) scale-factor bits, so ``unpack`` is an exact inverse.

``parse`` reads any MPEG-1/2/2.5 stream of layers I to III.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 576
RATE = 16_000
PAD = 255

# Fixed values of the MPEG audio standard: kbit/s by bitrate index 1 to 14.
KBPS_V1_L1 = (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
KBPS_V1_L2 = (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
KBPS_V1_L3 = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBPS_V2_L1 = (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
KBPS_V2_L23 = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
# Sampling rates of MPEG-1 by index; MPEG-2 has half, MPEG-2.5 a quarter.
RATES = (44_100, 48_000, 32_000)

HEAD, CRC, SIDE = 4, 2, 9  # bytes of an MPEG-2 mono Layer III frame before its main data


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=1 << 16)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 8005 and initial value FFFF, as frames carry it."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFF00) ^ _CRC[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    samples: int
    length: int
    side: int


@lru_cache(maxsize=1 << 14)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None.  Free-format and reserved values are not headers."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 25}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    bits, rate_bits = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate_bits == 3 or four[3] & 3 == 2:
        return None
    if version == 1:
        kbps = (KBPS_V1_L1, KBPS_V1_L2, KBPS_V1_L3)[layer - 1][bits - 1]
    else:
        kbps = (KBPS_V2_L1 if layer == 1 else KBPS_V2_L23)[bits - 1]
    rate = RATES[rate_bits] // {1: 1, 2: 2, 25: 4}[version]
    pad, channels = four[2] >> 1 & 1, 1 if four[3] >> 6 == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12_000 * kbps // rate + pad) * 4 if layer == 1 else samples * 125 * kbps // rate + pad
    side = 0 if layer < 3 else (32 if channels == 2 else 17) if version == 1 else (17 if channels == 2 else 9)
    return Header(version, layer, not four[1] & 1, kbps, rate, channels, samples, length, side)


def _four(index: int, crc: bool) -> bytes:
    return bytes([0xFF, 0xF2 | (not crc), index << 4 | 2 << 2, 0xC0])


_LENGTHS = [header(_four(i, True)).length for i in range(1, 15)]


@lru_cache(maxsize=1024)
def _frame_start(n: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a frame with ``n`` samples' bytes, and the frame's length."""
    index = next(i for i, size in enumerate(_LENGTHS, 1) if size >= HEAD + CRC + SIDE + n)
    four = _four(index, True)
    # main_data_begin 8 bits, private 1, part2_3_length 12, big_values 9, global_gain 8,
    # scalefac_compress 9, then flags and tables: the byte count sits in private and scalefac_compress.
    bits = (n >> 9) << 63 | min(n * 8, 4095) << 51 | (n & 511) << 25
    side = bits.to_bytes(SIDE, "big")
    return four + struct.pack(">H", crc16(four[2:] + side)) + side, _LENGTHS[index - 1]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of 576."""
    return data + bytes([PAD]) * (-len(data) % BLOCK if data else BLOCK)


def pack(data: bytes) -> bytes:
    """A complete stream that holds ``padded(data)``.  Equal data give equal streams."""
    payload = padded(data)
    blocks = len(payload) // BLOCK
    last = payload[-BLOCK:].rstrip(bytes([PAD]))
    start, size = _frame_start(BLOCK)
    body = np.zeros((blocks - 1, size), np.uint8)
    body[:, : len(start)] = np.frombuffer(start, np.uint8)
    body[:, len(start) : len(start) + BLOCK] = np.frombuffer(payload[: (blocks - 1) * BLOCK], np.uint8).reshape(-1, BLOCK)
    start, last_size = _frame_start(len(last))
    audio = body.tobytes() + (start + last).ljust(last_size, b"\0")
    first = _four(4, False)
    first_size = header(first).length
    total = first_size + len(audio)
    at = np.minimum(np.arange(100) * blocks // 100, blocks - 1) * size + first_size
    toc = (at * 256 // total).clip(0, 255).astype(np.uint8).tobytes()
    table = b"Xing" + struct.pack(">III", 15, blocks, total) + toc + struct.pack(">I", 0)
    lead = (first + bytes(SIDE) + table).ljust(first_size, b"\0")
    text = b"\0" + str(blocks * BLOCK * 1000 // RATE).encode()
    frame = b"TLEN" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame + lead + audio + b"TAG".ljust(127, b"\0") + b"\xff"


@dataclass
class Stream:
    """What :func:`parse` found; offsets are from the start of the bytes."""

    frames: list[int] = field(default_factory=list)  # seek offsets of the audio frames
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    seconds: Fraction = Fraction(0)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes passed over to find the next frame
    truncated: bool = False
    id3v2: dict[str, str] = field(default_factory=dict)
    id3v1: bool = False
    table: dict | None = None  # kind, frames, bytes, toc


def _id3v2(data: bytes, found: Stream) -> int:
    """Read a tag at the start; return where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    at, end = 10, min(10 + size, len(data))
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        n = data[at + 4 : at + 8]
        length = n[0] << 21 | n[1] << 14 | n[2] << 7 | n[3] if data[3] >= 4 else int.from_bytes(n, "big")
        value = data[at + 10 : min(at + 10 + length, end)]
        name = data[at : at + 4].decode("latin-1")
        if name[0] == "T" and value:
            found.id3v2[name] = value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0] & 3], "replace").strip("\0")
        at += 10 + length
    return min(10 + size + (10 if data[5] & 0x10 else 0), len(data))


def _vbr_table(frame: bytes, h: Header) -> dict | None:
    for at in (4 + h.side, 4 + 2 + h.side):
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info"):
            flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out: dict = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                out["toc"] = list(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        entries, scale, width = (int.from_bytes(frame[54 + 2 * i : 56 + 2 * i], "big") for i in range(3))
        toc = [int.from_bytes(frame[62 + width * i : 62 + width * (i + 1)], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": int.from_bytes(frame[50:54], "big"), "bytes": int.from_bytes(frame[46:50], "big"), "toc": toc}
    return None


def _kind(h: Header) -> tuple[int, int, int, int]:
    return h.version, h.layer, h.rate, h.channels


def _followed(data: bytes, at: int, h: Header, end: int) -> bool:
    """Whether the frame is followed by a header of its kind, or by the end."""
    after = at + h.length
    follower = header(data[after : after + 4])
    return after >= end - 4 or follower is not None and _kind(follower) == _kind(h)


def _sync(data: bytes, at: int, end: int) -> int:
    """The next place from ``at`` with a header that another of its kind (or the end) follows; ``end`` if none."""
    while (at := data.find(b"\xff", at, end)) >= 0:
        h = header(data[at : at + 4])
        if h and _followed(data, at, h, end):
            return at
        at += 1
    return end


def parse(data: bytes) -> Stream:
    """Parse tags, the bitrate table and every frame; resynchronise over foreign bytes.

    Empty or foreign bytes give a stream without frames.  A last frame that
    the data cut short counts as truncated, not as a frame.  Checksums are
    verified in Layer III only: protected frames of Layers I and II count
    neither as ``crc_ok`` nor as ``crc_bad``.
    """
    found = Stream()
    at, end = _id3v2(data, found), len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        found.id3v1, end = True, end - 128
    first = True
    while at < end:
        h = header(data[at : at + 4])
        # A frame in its expected place is taken if it is like the first one; anything else must be followed by its kind.
        if h is None or not (found.headers and _kind(found.headers[0]) == _kind(h)) and not _followed(data, at, h, end):
            there = _sync(data, at + 1, end)
            found.skipped += there - at
            at = there
            continue
        if at + h.length > end:
            found.truncated = True
            break
        if first:
            first = False
            found.table = _vbr_table(data[at : at + h.length], h) if h.layer == 3 else None
            if found.table:
                at += h.length
                continue
        if h.protected and h.layer == 3:
            stored = data[at + 4] << 8 | data[at + 5]
            if crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == stored:
                found.crc_ok += 1
            else:
                found.crc_bad += 1
        found.frames.append(at)
        found.headers.append(h)
        at += h.length
    counts: dict[int, int] = {}
    for h in found.headers:
        counts[h.rate] = counts.get(h.rate, 0) + h.samples
    found.samples = sum(counts.values())
    found.seconds = sum((Fraction(n, rate) for rate, n in counts.items()), Fraction(0))
    return found


def unpack(data: bytes, found: Stream) -> bytes:
    """The padded payload of a stream made by :func:`pack`."""
    out = []
    for at in found.frames:
        side = int.from_bytes(data[at + 6 : at + 6 + SIDE], "big")
        n = (side >> 63 & 1) << 9 | side >> 25 & 511
        begin = at + HEAD + CRC + SIDE
        out.append(data[begin : begin + n])
        if n < BLOCK:
            out.append(bytes([PAD]) * (BLOCK - n))
    return b"".join(out)


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """Add binary ``out_col``: the text's UTF-8 bytes as an MPEG audio stream.

    Null text is stored as the empty text.  Rows are independent: repeated
    texts give equal streams, an empty table gives no rows, other columns pass
    through (one named like ``out_col`` is replaced).
    """

    @F.arrow_udf("binary")
    def to_media(texts: pa.Array) -> pa.Array:
        return pa.array([pack((t.as_py() or "").encode("utf-8", "replace")) for t in texts], pa.binary())

    return docs.withColumn(out_col, to_media(F.col(text_col)))


FEATURES = (
    "frames long, samples long, duration_us long, crc_ok long, crc_bad long, skipped long, truncated boolean, vbr boolean, "
    "table string, table_frames long, table_bytes long, toc array<long>, tags map<string,string>, id3v1 boolean, offsets array<long>, "
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
)
KINDS = (
    *[("frames", pa.int64()), ("samples", pa.int64()), ("duration_us", pa.int64()), ("crc_ok", pa.int64()), ("crc_bad", pa.int64()), ("skipped", pa.int64())],
    *[("truncated", pa.bool_()), ("vbr", pa.bool_()), ("table", pa.string()), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("toc", pa.list_(pa.int64()))],
    *[("tags", pa.map_(pa.string(), pa.string())), ("id3v1", pa.bool_()), ("offsets", pa.list_(pa.int64())), ("payload_bytes", pa.int64())],
    *[("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())],
)


def decode(media: DataFrame, media_col: str = "media", out_col: str = "audio", offsets: bool = True) -> DataFrame:
    """Add struct ``out_col`` with what the stored bytes hold (``FEATURES``).

    ``duration_us`` is exact wherever a frame's length in microseconds is
    whole.  ``table`` and so on are those of the bitrate table, ``tags`` the
    text frames of a leading tag, ``offsets`` the frames' seek offsets (null if
    not asked for).
    Null media give a null struct; bytes without any frame give zero frames.
    """

    @F.arrow_udf(FEATURES)
    def features(column: pa.Array) -> pa.Array:
        rows = []
        for data in column:
            data = data.as_py()
            if data is None:
                rows.append((None,) * len(KINDS))
                continue
            s = parse(data)
            payload, table = unpack(data, s), s.table or {}
            rows.append(
                (
                    len(s.frames), s.samples, int(s.seconds * 1_000_000), s.crc_ok, s.crc_bad, s.skipped, s.truncated,
                    len({h.kbps for h in s.headers}) > 1, table.get("kind"), table.get("frames"), table.get("bytes"), table.get("toc"),
                    list(s.id3v2.items()), s.id3v1, s.frames if offsets else None,
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(),
                )
            )
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(KINDS)], [name for name, _ in KINDS])

    return media.withColumn(out_col, F.when(F.col(media_col).isNotNull(), features(F.col(media_col))))
