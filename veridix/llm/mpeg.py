"""Operator 5: media columns in MPEG audio.

The writer lays a payload into MPEG-1 Layer III frames (an ID3v2 tag, a Xing frame with counts and a seek table, then
variable-bitrate data frames with checksums). The reader takes any such stream: it parses tags and the bitrate
table, resynchronises on frame headers, verifies checksums, and gives exact durations and frame offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import bounded, cut, read_table

#: Fixed values of the format: kbit/s by index for MPEG-1 and MPEG-2 Layer III, and Hz by index for MPEG-1, 2, 2.5.
BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
_VERSION = {3: 1, 2: 2, 0: 25}
#: What the writer uses: 48 kHz mono; a frame's header, checksum and side information come before its payload.
RATE, SIDE = 48000, 17
HEAD = 4 + 2 + SIDE
_SIZES = [144 * b * 1000 // RATE for b in BITRATES[1]]


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()
_KNOWN: dict[bytes, int] = {}


def frame_crc(data: bytes) -> int:
    """CRC-16 (0x8005, from 0xFFFF) over the header's last two bytes and the side information."""
    got = _KNOWN.get(data)
    if got is None:
        got = 0xFFFF
        for b in data:
            got = (got << 8 & 0xFFFF) ^ _CRC[got >> 8 ^ b]
        if len(_KNOWN) < 4096:
            _KNOWN[data] = got
    return got


def _start(index: int) -> bytes:
    """A frame's bytes before its payload: MPEG-1 Layer III with a checksum, mono."""
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(SIDE)
    return head + struct.pack(">H", frame_crc(head[2:] + side)) + side


_STARTS = [_start(i) if i else b"" for i in range(15)]


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def write_stream(payload: bytes) -> bytes:
    """The payload as a stream. Its length is in the tag, as the last frame is filled up with zeros."""
    top = _SIZES[14] - HEAD
    whole, rest = divmod(len(payload), top)
    a = np.frombuffer(payload, np.uint8)
    frames = np.zeros((whole, _SIZES[14]), np.uint8)
    frames[:, :HEAD] = np.frombuffer(_STARTS[14], np.uint8)
    frames[:, HEAD:] = a[: whole * top].reshape(whole, top)
    last = b""
    if rest:
        i = next(i for i in range(1, 15) if _SIZES[i] - HEAD >= rest)
        last = (_STARTS[i] + payload[whole * top :]).ljust(_SIZES[i], b"\0")
    n = whole + bool(rest)
    text = b"\x03payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag
    size = whole * _SIZES[14] + len(last)
    first = _SIZES[9]
    points = [min(n - 1, n * k // 100) if n else 0 for k in range(100)]
    toc = bytes(min(255, 256 * (first + p * _SIZES[14]) // (first + size)) for p in points)
    xing = (_STARTS[9] + b"Xing" + struct.pack(">III", 7, n, first + size) + toc).ljust(first, b"\0")
    return tag + xing + frames.tobytes() + last


@dataclass
class Probe:
    """What the reader finds."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bitrates: dict[int, int] = field(default_factory=dict)
    bad_crc: int = 0
    resyncs: int = 0
    lost_bytes: int = 0
    payload: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def header(data: bytes, at: int) -> tuple[int, int, int, int, bool, bool] | None:
    """(size, samples, rate, kbit/s, checked, mono) of the Layer III frame at `at`, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE6 != 0xE2:
        return None
    b1, b2 = data[at + 1], data[at + 2]
    version = _VERSION.get(b1 >> 3 & 3)
    index, rate = b2 >> 4, b2 >> 2 & 3
    if version is None or index in (0, 15) or rate == 3:
        return None
    kbit, hz = BITRATES[1 if version == 1 else 2][index], RATES[version][rate]
    samples = 1152 if version == 1 else 576
    return samples // 8 * kbit * 1000 // hz + (b2 >> 1 & 1), samples, hz, kbit, not b1 & 1, data[at + 3] >> 6 == 3


def _counted(data: bytes, at: int) -> int:
    """Where the audio that begins at `at` ends by the byte count of its bitrate table; `at` if none tells."""
    h = header(data, at)
    if h is None:
        return at
    k = at + 4 + 2 * h[4] + ((17 if h[5] else 32) if h[1] == 1152 else (9 if h[5] else 17))
    if data[k : k + 4] not in (b"Xing", b"Info") or not data[k + 7 : k + 8] or not data[k + 7] & 2:
        return at
    k += 8 + 4 * (data[k + 7] & 1)
    stop = at + int.from_bytes(data[k : k + 4], "big")
    return stop if stop <= len(data) else at


def _tags(data: bytes, out: Probe) -> tuple[int, int]:
    """Start and end of the audio; tags before and after it are read."""
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
        k, stop = at + 10, min(end, at + 10 + size)
        while k + 10 <= stop and data[k]:
            name = data[k : k + 4].decode("latin-1")
            n = data[k + 4] << 21 | data[k + 5] << 14 | data[k + 6] << 7 | data[k + 7] if data[at + 3] == 4 else int.from_bytes(data[k + 4 : k + 8], "big")
            body = data[k + 10 : k + 10 + n]
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0] if body else 3, "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[key] = value.rstrip("\0")
            k += 10 + n
        at += 10 + size
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" and end - 128 >= _counted(data, at):
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip())
    return min(at, end), end


def read_stream(data: bytes) -> Probe:
    """Frames in order. Bytes that are no frame are skipped to the next header that another header, or the end,
    follows; a frame that the end cuts off doesn't count. The first frame's bitrate table is no audio."""
    out = Probe()
    at, end = _tags(data, out)
    parts = []
    first, synced = True, True
    while at < end:
        h = header(data, at)
        if h is None or at + h[0] > end or not synced and at + h[0] < end and header(data, at + h[0]) is None:
            if synced:
                out.resyncs += 1
                synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.lost_bytes += nxt - at
            at = nxt
            continue
        synced = True
        size, samples, rate, kbit, checked, mono = h
        side = (17 if mono else 32) if samples == 1152 else (9 if mono else 17)
        body = at + 4 + 2 * checked
        if checked and int.from_bytes(data[at + 4 : at + 6], "big") != frame_crc(data[at + 2 : at + 4] + data[body : body + side]):
            out.bad_crc += 1
        body += side
        if first and data[body : body + 4] in (b"Xing", b"Info"):
            flags = int.from_bytes(data[body + 4 : body + 8], "big")
            k = body + 8
            if flags & 1:
                out.vbr_frames = int.from_bytes(data[k : k + 4], "big")
                k += 4
            if flags & 2:
                out.vbr_bytes = int.from_bytes(data[k : k + 4], "big")
                k += 4
            if flags & 4:
                out.toc = data[k : k + 100]
        else:
            out.offsets.append(at)
            out.samples += samples
            out.rate = out.rate or rate
            out.bitrates[kbit] = out.bitrates.get(kbit, 0) + 1
            parts.append(data[body : at + size])
        first = False
        at += size
    out.payload = b"".join(parts)
    size = out.tags.get("payload", "")
    if size.isdigit():
        out.payload = out.payload[: int(size)]
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def encode_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media (binary). A null or empty text is 64 zero bytes of payload; every row
    has a stream, repeated rows and null ids too, and equal texts equal ones. An empty table gives no rows; other
    columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            both = [padded(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([write_stream(p) for _, p in both], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_seconds double, frame_offsets array<long>"


def probe_media(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) -> see SCHEMA: payload digests, the stream's own, what the frames tell, the exact
    duration and the offset of every audio frame. Null or broken streams give what frames there are, none at all an empty
    payload; repeated rows are read each; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            rows = []
            for i, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = data or b""
                p = read_stream(data)
                rates = ",".join(f"{k}x{v}" for k, v in sorted(p.bitrates.items()))
                seek = zlib.crc32(np.array(p.offsets, "<u8").tobytes())
                feature = f"frames={len(p.offsets)};samples={p.samples};rate={p.rate};kbps={rates};vbr={p.vbr_frames}/{p.vbr_bytes};toc={zlib.crc32(p.toc):08x};seek={seek:08x};badcrc={p.bad_crc};resync={p.resyncs};lost={p.lost_bytes}"
                rows.append((i, n, len(p.payload), hashlib.sha256(p.payload).hexdigest(), zlib.crc32(p.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, p.seconds, p.offsets))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def op5_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams are written to the shared folder and read back from there."""
    return probe_media(cut(encode_media(read_table(spark, sf_dir, "documents"))))


QUERIES = {"op5_mpeg": op5_mpeg}
ORACLE: dict[str, str] = {}
