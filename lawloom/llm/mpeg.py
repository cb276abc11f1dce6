"""Media columns: MPEG audio that carries bytes, and a parser that resynchronises.

``store`` writes a payload as MPEG-1 layer III frames with checksums: an ID3v2
tag, a Xing table of the (variable) bit rates with its seek points, then one
silent frame for each 576 bytes, which lie in the frame's ancillary data.
``parse`` reads any layer I-III stream: it skips tags, finds frame headers,
resynchronises after junk, verifies checksums, and gives exact durations and
seek offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = 576

#: kbit/s by (MPEG-1?, layer), sample rates by version, samples in a frame by (MPEG-1?, layer).
BIT_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    crc: bool
    rate: int
    samples: int
    size: int
    side: int  # bytes of side information after header and checksum


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The frame header in four bytes; None if it isn't one (free-format bit rates aren't read)."""
    if len(raw) < 4 or raw[0] != 255 or raw[1] < 224:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    bit, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or bit in (0, 15) or rate == 3:
        return None
    first = version == 3
    kbits, hertz, samples = BIT_RATES[first, layer][bit], SAMPLE_RATES[version][rate], SAMPLES[first, layer]
    slot = 4 if layer == 1 else 1
    size = (samples // 8 // slot * kbits * 1000 // hertz + (raw[2] >> 1 & 1)) * slot
    mono = raw[3] >> 6 == 3
    side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else 0
    return Header(version, layer, not raw[1] & 1, hertz, samples, size, side)


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        x = b << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        table.append(x)
    return table


CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, started at 0xFFFF."""
    x = 0xFFFF
    for b in data:
        x = (x << 8 & 0xFFFF) ^ CRC[x >> 8 ^ b]
    return x


#: MPEG-1 layer III, checksums, 48 kHz, mono: 224 kbit/s make frames of 672 bytes, 256 kbit/s, in every WIDE-th frame, of 768.
HEADS = (bytes((0xFF, 0xFA, 0xC4, 0xC0)), bytes((0xFF, 0xFA, 0xD4, 0xC0)))
FRAMES = (672, 768)
WIDE = 8
SIDE = bytes(17)
AT = 4 + 2 + len(SIDE)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def store(payload: bytes, note: str = "") -> bytes:
    """An MPEG stream that carries ``payload``, whose length is a multiple of 576; ``note`` goes into its tag."""
    if len(payload) % UNIT:
        raise ValueError("the payload is no multiple of 576 bytes")
    n = len(payload) // UNIT
    starts = [h + struct.pack(">H", crc16(h[2:] + SIDE)) + SIDE for h in HEADS]
    wide = np.arange(n) % WIDE == WIDE - 1
    sizes = np.where(wide, FRAMES[1], FRAMES[0])
    first = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), np.uint8)
    for kind in (0, 1):
        body[first[wide == kind][:, None] + np.arange(AT)] = np.frombuffer(starts[kind], np.uint8)
    body[first[:, None] + AT + np.arange(UNIT)] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    text = b"\x03note\0" + note.encode()
    tag = b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    total = FRAMES[0] + len(body)
    toc = bytes(min(255, 256 * (FRAMES[0] + int(first[k * n // 100])) // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    xing = starts[0] + table + bytes(FRAMES[0] - AT - len(table))
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + xing + body.tobytes()


@dataclass
class Stream:
    """What ``parse`` found; ``offsets`` has the byte at which each frame starts."""

    tags: list[str] = field(default_factory=list)
    note: str | None = None
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    checked: int = 0
    wrong: int = 0
    skipped: int = 0
    frame_bytes: int = 0
    last_size: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    rates: set[int] = field(default_factory=set)
    data: list[tuple[int, int]] = field(default_factory=list)


def parse(media: bytes) -> Stream:
    """Reads a stream; bytes that belong to no frame or tag are counted as skipped."""
    out, at, end = Stream(), 0, len(media)
    if media[:3] == b"ID3" and end >= 10:
        size = sum((b & 127) << s for b, s in zip(media[6:10], (21, 14, 7, 0), strict=True))
        out.tags.append(f"ID3v2.{media[3]}")
        _read_tag(out, media[10 : 10 + size], media[3])
        at = min(end, 10 + size)
    # What looks like a tag may be data of a frame that reaches over it.
    tag = end - 128 if end - at >= 128 and media[end - 128 : end - 125] == b"TAG" else end
    trusted = False
    while at < end:
        if at == tag:
            out.tags.append("ID3v1")
            break
        h = header(media[at : at + 4])
        after = at + h.size if h else 0
        follows = after in (tag, end) or header(media[after : after + 4]) is not None
        # A header counts if another one, a tag or the end follows its frame, or, short of the tag's place, if its checksum is right.
        if not h or after > end or not (follows or ((after < tag or at > tag) and (trusted or _sum_is_right(media, at, h)))):
            to = tag if at < tag else end
            found = media.find(b"\xff", at + 1, to)
            out.skipped += (found if found >= 0 else to) - at
            at, trusted = (found if found >= 0 else to), False
            continue
        trusted = follows
        body = at + 4 + 2 * h.crc
        if h.crc and h.layer == 3:
            out.checked += 1
            out.wrong += not _sum_is_right(media, at, h)
        data = body + h.side
        out.frame_bytes += h.size
        out.last_size = h.size
        if not out.offsets and out.table_frames is None and media[data : data + 4] in (b"Xing", b"Info"):
            _read_table(out, media[data:after])
        elif not out.offsets and out.table_frames is None and media[at + 36 : at + 40] == b"VBRI":
            out.table_bytes, out.table_frames = struct.unpack(">II", media[at + 46 : at + 54])
        else:
            out.offsets.append(at)
            out.data.append((data, after))
            out.samples += h.samples
            out.rate = out.rate or h.rate
            out.rates.add(h.size * 8 * h.rate // h.samples // 1000)
        at = after
    return out


def seek_points_agree(s: Stream) -> bool:
    """Whether each seek point of the table, if it has any, lies within 1/256 of the stream before the frame at that part of its time."""
    if not s.toc or s.table_bytes is None or s.table_bytes < 0 or not s.offsets:
        return not s.toc
    begin = s.offsets[-1] + s.last_size - s.table_bytes
    n, step = len(s.offsets), s.table_bytes / 256
    return len(s.toc) == 100 and all(-1e-6 <= s.offsets[k * n // 100] - begin - p * step <= step + 1e-6 for k, p in enumerate(s.toc))


def _sum_is_right(media: bytes, at: int, h: Header) -> bool:
    """Whether a layer III frame has a checksum that fits its header and side information."""
    body = at + 6
    return h.crc and h.layer == 3 and crc16(media[at + 2 : at + 4] + media[body : body + h.side]) == int.from_bytes(media[at + 4 : body])


def _read_tag(out: Stream, tag: bytes, version: int) -> None:
    at = 0
    while at + 10 <= len(tag) and tag[at : at + 4].isalnum():
        raw = tag[at + 4 : at + 8]
        size = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if version >= 4 else int.from_bytes(raw)
        if tag[at : at + 4] == b"TXXX":
            name, _, value = tag[at + 11 : at + 10 + size].partition(b"\0")
            if name == b"note":
                out.note = value.decode("utf-8", "replace")
        at += 10 + size


def _read_table(out: Stream, body: bytes) -> None:
    flags, at = int.from_bytes(body[4:8]), 8
    out.table_frames = out.table_bytes = -1
    if flags & 1:
        out.table_frames, at = int.from_bytes(body[at : at + 4]), at + 4
    if flags & 2:
        out.table_bytes, at = int.from_bytes(body[at : at + 4]), at + 4
    if flags & 4:
        out.toc = body[at : at + 100]


def add_media(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``df`` with the MPEG stream of a binary column added or replaced.

    Null and empty payloads count as empty.  A payload is filled up with bytes
    255 to a positive multiple of 576; its own length goes into the tag, so
    equal payloads give equal streams.  All rows and other columns stay.
    """
    df = df.drop(media)
    schema = df.select("*", F.lit(b"").alias(media)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, payload):
            made = []
            for x in batch.column(payload):
                raw = x.as_py() or b""
                made.append(store(raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT)), str(len(raw))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, media])

    return df.mapInArrow(run, schema)


FEATURES = "payload binary, n_frames long, sample_rate int, n_samples long, duration_s string, n_checked long, n_wrong long, n_skipped long, table_ok boolean, note string, tags array<string>, seek_offsets array<long>"


def add_features(df: DataFrame, media: str = "media", out: str = "audio") -> DataFrame:
    """``df`` with a struct of what its MPEG column holds, added or replaced as ``out``.

    ``payload`` is what the frames carry after their side information (for
    streams of ``store``: 576 bytes a frame); ``duration_s`` the exact duration
    as a fraction of samples and rate; ``seek_offsets`` the byte at which each
    frame starts.  Null media count as empty: no frames, duration 0/1.
    """
    from pyspark.sql.types import StructType

    df = df.drop(out)
    schema = StructType(list(df.schema.fields)).add(out, StructType.fromDDL(FEATURES))
    kind = pa.struct([("payload", pa.binary()), ("n_frames", pa.int64()), ("sample_rate", pa.int32()), ("n_samples", pa.int64()), ("duration_s", pa.string()), ("n_checked", pa.int64()), ("n_wrong", pa.int64()), ("n_skipped", pa.int64()), ("table_ok", pa.bool_()), ("note", pa.string()), ("tags", pa.list_(pa.string())), ("seek_offsets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, media):
            found = []
            for x in batch.column(media):
                raw = x.as_py() or b""
                s = parse(raw)
                payload = b"".join([raw[a : a + UNIT] for a, _ in s.data])
                ok = s.table_frames == len(s.offsets) and s.table_bytes == s.frame_bytes and seek_points_agree(s)
                found.append((payload, len(s.offsets), s.rate, s.samples, f"{s.samples}/{s.rate or 1}", s.checked, s.wrong, s.skipped, ok, s.note, s.tags, s.offsets))
            names = [f.name for f in kind]
            arrays = [pa.array(list(c), kind.field(i).type) for i, c in enumerate(zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, names)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def op1_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text as an MPEG column, read back; unpadded length, digests and features."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))
    stored = add_media(docs).select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), "media")
    read = add_features(stored)
    payload = F.col("audio.payload")
    joined = F.concat_ws(
        ";",
        *[F.concat(F.lit(f"{k}="), F.col(f"audio.{k}").cast("string")) for k in ("n_frames", "sample_rate", "n_samples", "duration_s", "n_checked", "n_wrong", "n_skipped", "table_ok")],
        F.concat(F.lit("tags="), F.array_join("audio.tags", ",")),
        F.concat(F.lit("first="), F.element_at("audio.seek_offsets", 1).cast("string")),
        F.concat(F.lit("last="), F.element_at("audio.seek_offsets", -1).cast("string")),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(audio.payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        joined.alias("feature"),
        F.col("audio.seek_offsets").alias("seek_offsets"),
    )


def brute(text: str | None) -> dict:
    """Row of ``op1_mpeg`` for one text, frame by frame without Spark and numpy, for tests."""
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))
    frames, places, at = [], [], 0
    for k in range(len(payload) // UNIT):
        kind = k % WIDE == WIDE - 1
        frame = HEADS[kind] + struct.pack(">H", crc16(HEADS[kind][2:] + SIDE)) + SIDE + payload[k * UNIT : (k + 1) * UNIT]
        frames.append(frame.ljust(FRAMES[kind], b"\0"))
        places.append(at)
        at += FRAMES[kind]
    n, total = len(frames), at + FRAMES[0]
    points = bytes(min(255, 256 * (FRAMES[0] + places[k * n // 100]) // total) for k in range(100))
    table = HEADS[0] + struct.pack(">H", crc16(HEADS[0][2:] + SIDE)) + SIDE + b"Xing" + struct.pack(">III", 7, n, total) + points
    note = b"\x03note\0" + str(len(raw)).encode()
    tag = b"TXXX" + struct.pack(">I", len(note)) + b"\0\0" + note
    media = b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + table.ljust(FRAMES[0], b"\0") + b"".join(frames)
    seek = [10 + len(tag) + FRAMES[0] + p for p in places]
    feature = f"n_frames={n};sample_rate=48000;n_samples={1152 * n};duration_s={1152 * n}/48000;n_checked={n + 1};n_wrong=0;n_skipped=0;table_ok=true;tags=ID3v2.3;first={seek[0]};last={seek[-1]}"
    sums = {"payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_sha256": hashlib.sha256(media).hexdigest()}
    return {"n_bytes": len(raw), "payload_bytes": len(payload), "media_bytes": len(media), "feature": feature, "seek_offsets": seek, **sums}
