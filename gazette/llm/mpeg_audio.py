"""Operator 7: media columns of MPEG audio.

mux() stores bytes without loss as the main data of MPEG-1 Layer III frames: an ID3v2 tag with
the payload's size and CRC-32, a frame with a Xing table, then checksummed frames of variable
bitrate. probe() reads any MPEG audio but free format, whose frames don't state their size: it
skips and parses tags, finds the next frame header after junk, reads Xing and VBRI tables,
verifies the checksums of all layers and modes and gives the exact duration (each frame's samples
over its own rate) and the byte offset of every frame.

Null media give a null result, bytes without a frame one with no frames; null texts count as the
empty text; equal texts have equal values, so repeated rows do; an empty table gives no rows; a
text of any length is one stream, held whole by one task; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gazette.llm.common import documents, text_blocks

# Fixed values of the MPEG audio format: kbit/s by (MPEG-1, layer), sample rates of MPEG-1.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)
UNIT = 64  # payloads are whole multiples of so many bytes
SIDE = 17  # side information of a mono Layer III frame
HEAD = 4 + 2 + SIDE
RATE = 44100
SIZES = [144_000 * kbps // RATE for kbps in BITRATES[True, 3]]
ROOM = [max(0, min(n - HEAD, 2 * 511)) for n in SIZES]


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The checksum of protected frames (polynomial 0x8005); frames of one size share its input."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, n: int) -> int:
    """The same over the first n bits."""
    crc, rest = crc16(data[: n // 8]), n % 8
    for k in range(rest):
        bit = data[n // 8] >> (7 - k) & 1
        crc = ((crc << 1) ^ 0x8005 if (crc >> 15 & 1) != bit else crc << 1) & 0xFFFF
    return crc


# Fixed values of the MPEG audio format: how many subbands of Layer II have an allocation of so many bits.
ALLOCATION = {"wide": ((11, 4), (12, 3), (7, 2)), "middle": ((11, 4), (12, 3), (4, 2)), "low": ((2, 4), (6, 3)), "low32": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


@lru_cache(65536)
def _frame_head(index: int, n: int) -> bytes:
    """Header, checksum and side information of a frame whose main data are n bytes."""
    header = bytes((0xFF, 0xFA, index << 4, 0xC0))
    first = min(n, 511)
    side = ((first * 8) << (136 - 18 - 12)) | (((n - first) * 8) << (59 - 12))
    side = side.to_bytes(SIDE, "big")
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def mux(payload: bytes) -> bytes:
    body = b"\x03payload\x00%d %08x" % (len(payload), zlib.crc32(payload))
    tag = b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body
    frames, full = [], len(ROOM) - 1
    for at in range(0, len(payload), ROOM[full]):
        n = min(ROOM[full], len(payload) - at)
        index = bisect_left(ROOM, n)
        frames.append((_frame_head(index, n) + payload[at : at + n]).ljust(SIZES[index], b"\0"))
    info_index = 5  # the smallest frame that holds a whole table
    size = SIZES[info_index] + sum(map(len, frames))
    ends = np.cumsum([SIZES[info_index], *map(len, frames)])
    toc = bytes((ends[np.arange(100) * len(frames) // 100] * 256 // size).astype(np.uint8)) if frames else bytes(100)
    info = b"\xff\xfb" + bytes((info_index << 4, 0xC0)) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), size) + toc
    return b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag + info.ljust(SIZES[info_index], b"\0") + b"".join(frames)


@dataclass(frozen=True)
class Header:
    size: int
    samples: int
    rate: int
    kbps: int
    layer: int
    mpeg1: bool
    mono: bool
    protected: bool
    bound: int  # subbands before it have an allocation for each channel (Layers I and II)


@lru_cache(65536)
def parse_header(raw: bytes) -> Header | None:
    """Four bytes as a frame header, or None. Free-format frames, whose size isn't stated, are not read."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    mpeg1 = version == 3
    kbps, hz = BITRATES[mpeg1, layer][index], SAMPLE_RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    samples = 384 if layer == 1 else 1152 if layer == 2 or mpeg1 else 576
    padding = raw[2] >> 1 & 1
    size = (12_000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
    bound = 4 * ((raw[3] >> 4 & 3) + 1) if raw[3] >> 6 == 1 else 32
    return Header(size, samples, hz, kbps, layer, mpeg1, raw[3] >> 6 == 3, not raw[1] & 1, bound)


def side_bytes(header: Header) -> int:
    """Bytes of side information of a Layer III frame."""
    return (17 if header.mono else 32) if header.mpeg1 else (9 if header.mono else 17)


def allocation_bits(header: Header) -> list[int]:
    """Bits of the allocation of each subband of a frame of Layer I or II."""
    if header.layer == 1:
        return [4] * 32
    each = header.kbps if header.mono else header.kbps // 2
    kind = "lsf" if not header.mpeg1 else ("low32" if header.rate == 32000 else "low") if each <= 48 else "middle" if each <= 80 or header.rate == 48000 else "wide"
    return [bits for n, bits in ALLOCATION[kind] for _ in range(n)]


def protected_bits(frame: bytes, header: Header) -> int:
    """How many bits after the checksum it covers: side information, or allocation and scale factor selection."""
    if header.layer == 3:
        return 8 * side_bytes(header)
    channels, data, at, used = 1 if header.mono else 2, int.from_bytes(frame[6:134].ljust(128, b"\0"), "big"), 0, 0
    for band, bits in enumerate(allocation_bits(header)):
        own = channels if band < header.bound else 1
        for _ in range(own):
            at += bits
            used += (data >> (1024 - at) & ((1 << bits) - 1) > 0) * (channels // own)
    return at + 2 * used * (header.layer == 2)


def checksum_holds(frame: bytes, header: Header) -> bool:
    n = 16 + protected_bits(frame, header)
    return crc16_bits((frame[2:4] + frame[6:]).ljust(-(-n // 8), b"\0"), n) == int.from_bytes(frame[4:6], "big")


@dataclass
class Probe:
    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)
    samples: Counter = field(default_factory=Counter)  # by rate
    kbps: set = field(default_factory=set)
    checked: int = 0
    broken: int = 0
    skipped: int = 0
    main: list = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return float(sum(Fraction(n, rate) for rate, n in self.samples.items()))

    def payload(self) -> bytes:
        """What mux() stored; ValueError if it isn't whole."""
        out = b"".join(self.main)
        n, crc = self.tags.get("payload", "-1 0").split(" ")
        if self.broken or len(out) != int(n) or zlib.crc32(out) != int(crc, 16):
            raise ValueError("the payload is not whole")
        return out


def _tag(data: bytes, tags: dict) -> int:
    """Bytes of the ID3v2 tag that data begins with; its text frames go to tags."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    seven = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
    end, at = 10 + seven(data[6:10]), 10
    while at + 10 <= min(end, len(data)) and data[at]:
        n = seven(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + n]
        if data[at : at + 1] == b"T" and body:
            coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3]
            name, _, value = body[1:].decode(coding, "replace").rstrip("\0").partition("\0")
            if data[at : at + 4] == b"TXXX":
                tags[name] = value
            else:
                tags[data[at : at + 4].decode("latin-1")] = name
        at += 10 + n
    return end + 10 * (data[5] >> 4 & 1)


def _table(frame: bytes, header: Header) -> dict:
    at = 4 + 2 * header.protected + side_bytes(header)
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, out, at = int.from_bytes(frame[at + 4 : at + 8], "big"), {"kind": frame[at : at + 4].decode()}, at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(entries)], "frames_per_entry": per}
    return {}


def probe(data: bytes) -> Probe:
    out = Probe()
    at, end = _tag(data, out.tags), len(data)
    # The letters of a closing tag may also be the content of the last frame, which then ends with the data.
    tail = end - 128 if data[-128:-125] == b"TAG" else end
    sure, first = False, True
    while at + 4 <= end:
        if at == tail:
            out.tags["id3v1_title"] = data[-125:-95].rstrip(b"\0 ").decode("latin-1")
            break
        header = parse_header(data[at : at + 4])
        after = at + header.size if header else 0
        if header is None or tail < after != end or not (sure or after in (tail, end) or parse_header(data[after : after + 4])):
            limit = tail if at < tail else end
            to = data.find(b"\xff", at + 1, limit)
            to = limit if to < 0 else to
            out.skipped += to - at
            at, sure = to, False
            continue
        sure, frame = True, data[at:after]
        if first and (table := _table(frame, header)):
            out.table = table
        else:
            out.offsets.append(at)
            out.samples[header.rate] += header.samples
            out.kbps.add(header.kbps)
            if header.protected:
                out.checked += 1
                out.broken += not checksum_holds(frame, header)
            if header.layer == 3 and header.mpeg1 and header.mono:
                begin = HEAD - 2 * (not header.protected)
                side = int.from_bytes(frame[begin - SIDE : begin], "big")
                n = (side >> 106 & 0xFFF) + (side >> 47 & 0xFFF)
                out.main.append(frame[begin : begin + n // 8])
        first, at = False, after
    return out


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def feature(info: Probe, payload: bytes) -> str:
    """Exact duration, frames, bitrates, checksums, a digest of the seek offsets, mean and power of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    seek = zlib.crc32(np.array(info.offsets, "<u8").tobytes())
    samples = "+".join(f"{n}/{rate}" for rate, n in sorted(info.samples.items()))
    return f"samples={samples};frames={len(info.offsets)};kbps={min(info.kbps)}-{max(info.kbps)};crc={info.checked - info.broken}/{info.checked};seek={seek:08x};sum={int(x.sum())};power={int((x * x).sum())}"


QUERY_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, n_frames long, seek_offsets array<long>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): each text as MPEG audio."""
    schema = "doc_id long, media binary"

    def run(batches):
        for values, rows in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([mux(padded(v)) for v in values], pa.binary())], schema=_arrow(schema))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def describe(media: DataFrame) -> DataFrame:
    """doc_id with duration, frames, checksums and frame seek offsets of the column media; rate is null if the frames have several."""
    schema = "doc_id long, seconds double, samples long, rate long, n_frames long, checked long, broken long, skipped long, offsets array<long>"

    def run(batches):
        for batch in batches:
            infos = [None if m is None else probe(m) for m in batch.column(1).to_pylist()]
            rows = [[None] * 8 if i is None else [i.seconds, i.samples.total(), next(iter(i.samples)) if len(i.samples) == 1 else None, len(i.offsets), i.checked, i.broken, i.skipped, i.offsets] for i in infos]
            cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(_arrow(schema))[1:], strict=True)]], schema=_arrow(schema))

    return media.select("doc_id", "media").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, and give their digests and features."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for values, rows in text_blocks(batches):
            out = []
            for text in values:
                media = mux(padded(text))
                info = probe(media)
                back = info.payload()
                out.append((len(text), len(back), sha(back), zlib.crc32(back[-UNIT:]), len(media), sha(media), feature(info, back), info.seconds, len(info.offsets), info.offsets))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(_arrow(QUERY_SCHEMA))[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *cols], schema=_arrow(QUERY_SCHEMA))

    return docs.select("doc_id", "text").mapInArrow(run, QUERY_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
