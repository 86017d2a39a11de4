"""Binary columns as MPEG audio streams: written, and read back with everything a player would need.

Written: an ID3v2 tag with the payload's length, an information frame with a
variable-bitrate table (frame count, byte count, 100 seek points), and MPEG-1 layer III
frames at 48 kHz mono.  Every frame has a header, a checksum of header and side
information, empty side information (silence), and payload bytes as ancillary data.  Full
frames have the largest bitrate and the last frame the smallest that holds the rest.

Read: tags are skipped and parsed, then headers are followed from frame to frame; where
none stands, the reader looks for the next one that a second valid header follows.  Durations
are exact numbers of samples, and each frame's offset is kept for seeking.

A null text is an empty payload; so is an empty one, which is padded like others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.frames import documents, hidden, restored

UNIT = 192
# Fixed values of the format: kbit/s of MPEG-1 layer III by index, sampling rates by version and index.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_LOW = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SIDE_MONO, _OWN = 17, 4 + 2 + 17  # side information; all bytes of a frame that aren't payload


def checksum(data: bytes, crc: int = 0xFFFF) -> int:
    """The format's CRC-16 (polynomial 0x8005)."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def _frame_size(bitrate_index: int) -> int:
    return 144 * BITRATES[bitrate_index] * 1000 // 48000


def _head(bitrate_index: int) -> bytes:
    """Header, checksum and side information of a frame at 48 kHz, mono, protected, without padding."""
    header = bytes([0xFF, 0xFA, bitrate_index << 4 | 1 << 2, 0xC0])
    side = bytes(_SIDE_MONO)
    return header + struct.pack(">H", checksum(header[2:] + side)) + side


_HEADS = {i: _head(i) for i in range(1, 15)}
_ROOM = {i: _frame_size(i) - _OWN for i in range(1, 15)}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """The stored form of a payload."""
    full = len(payload) // _ROOM[14]
    rest = len(payload) - full * _ROOM[14]
    parts = []
    if full:
        body = np.frombuffer(payload, np.uint8, full * _ROOM[14]).reshape(full, _ROOM[14])
        head = np.broadcast_to(np.frombuffer(_HEADS[14], np.uint8), (full, _OWN))
        parts.append(np.concatenate([head, body], 1).tobytes())
    if rest:
        i = next(i for i in range(1, 15) if _ROOM[i] >= rest)
        parts.append(_HEADS[i] + payload[full * _ROOM[14] :] + bytes(_ROOM[i] - rest))
    audio = b"".join(parts)
    frames, size = full + bool(rest), _frame_size(9)
    total = size + len(audio)
    # Seek point k: where the frame at k hundredths of the duration begins, in 256ths of the stream.
    at = [size + min(int(frames * k / 100), full) * _frame_size(14) for k in range(100)]
    table = bytes(min(255, 256 * a // total) for a in at)
    info = _HEADS[9] + b"Xing" + struct.pack(">III", 7, frames, total) + table
    info += bytes(size - len(info))
    value = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(value), 0) + value
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + info + audio


@dataclass
class Stream:
    """What a stream holds."""

    payload: bytes = b""
    samples: int = 0
    rate: int = 0
    offsets: list[int] = field(default_factory=list)  # of audio frames
    bitrates: list[int] = field(default_factory=list)
    table: str = "none"
    declared_frames: int = -1
    bad_checksums: int = 0
    skipped: int = 0  # bytes passed over to find a header again
    tags: dict[str, str] = field(default_factory=dict)


def _parse_header(data: bytes, at: int) -> tuple[int, int, int, int, int, int] | None:
    """(version bits, protected, kbit/s, rate, frame size, side information size) of a layer III header, if one stands there."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    b, r = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or b in (0, 15) or r == 3:
        return None
    kbit = (BITRATES if version == 3 else BITRATES_LOW)[b]
    rate = RATES[version][r]
    size = (144 if version == 3 else 72) * kbit * 1000 // rate + (data[at + 2] >> 1 & 1)
    mono = data[at + 3] >> 6 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return version, 1 - (data[at + 1] & 1), kbit, rate, size, side


def decode(data: bytes) -> Stream:
    """Reads a stream, also one with junk between frames or a cut end."""
    s, at = Stream(), 0
    if data[:3] == b"ID3" and len(data) >= 10:
        end = 10 + sum((data[6 + i] & 0x7F) << 7 * (3 - i) for i in range(4))
        at = 10
        while at + 10 <= end and data[at : at + 4].strip(b"\0"):
            n = struct.unpack(">I", data[at + 4 : at + 8])[0]
            if data[at : at + 4] == b"TXXX":
                name, _, value = data[at + 11 : at + 10 + n].partition(b"\0")
                s.tags[name.decode("latin-1")] = value.decode("latin-1")
            at += 10 + n
        at = min(end, len(data))
    stop = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    parts, first, synced, sums = [], True, False, {}
    while at + 4 <= stop:
        h = _parse_header(data, at)
        follows = h and (at + h[4] == stop or (synced and at + h[4] < stop) or _parse_header(data, at + h[4]) is not None)
        if not h or at + h[4] > stop or not follows:
            at += 1
            s.skipped += 1
            synced = False
            continue
        version, protected, kbit, rate, size, side = h
        body = at + 4 + 2 * protected
        if protected:
            covered = data[at + 2 : at + 4] + data[body : body + side]
            if covered not in sums:
                sums[covered] = checksum(covered)
            s.bad_checksums += sums[covered] != int.from_bytes(data[at + 4 : at + 6], "big")
        mark = data[body + side : body + side + 4]
        if first and mark in (b"Xing", b"Info"):
            s.table = mark.decode()
            flags, s.declared_frames = struct.unpack(">II", data[body + side + 4 : body + side + 12])
        else:
            parts.append(data[body + side : at + size])
            s.offsets.append(at)
            s.bitrates.append(kbit)
            s.samples += 1152 if version == 3 else 576
            s.rate = rate
        first, synced = False, True
        at += size
    s.payload = b"".join(parts)
    if s.tags.get("payload_bytes", "").isdigit():
        s.payload = s.payload[: int(s.tags["payload_bytes"])]
    return s


def padded(text: bytes) -> bytes:
    return text + b"\x20" * (-len(text) % UNIT or (UNIT if not text else 0))


def _encode_batches(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch[text].cast(pa.binary()).to_pylist()
            for a in range(0, len(column), 256):
                part = [t or b"" for t in column[a : a + 256]]
                media = [encode(padded(t)) for t in part]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 256) for c in batch.columns), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], names=[*batch.schema.names, "n_bytes", "media"])

    return run


READ = (
    ("payload", pa.binary(), "binary"), ("n_frames", pa.int64(), "long"), ("n_samples", pa.int64(), "long"), ("sample_rate", pa.int32(), "int"), ("seconds", pa.float64(), "double"),
    ("vbr_table", pa.string(), "string"), ("checksums_ok", pa.bool_(), "boolean"), ("skipped_bytes", pa.int64(), "long"), ("frame_offsets", pa.list_(pa.int64()), "array<long>"), ("feature", pa.string(), "string"),
)


def _feature(s: Stream) -> str:
    rates = ",".join(f"{k}x{s.bitrates.count(k)}" for k in sorted(set(s.bitrates)))
    return f"mpeg1-l3;rate={s.rate};frames={len(s.offsets)};samples={s.samples};kbit={rates};table={s.table}:{s.declared_frames};crc_bad={s.bad_checksums};skipped={s.skipped}"


def _decode_batches(media: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch[media].to_pylist()
            for a in range(0, len(column), 256):
                rows = []
                for m in column[a : a + 256]:
                    s = decode(m or b"")
                    rows.append((s.payload, len(s.offsets), s.samples, s.rate, s.samples / s.rate if s.rate else 0.0, s.table, s.bad_checksums == 0, s.skipped, s.offsets, _feature(s)))
                own = [pa.array(v, k) for v, (_, k, _t) in zip(zip(*rows), READ)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 256) for c in batch.columns), *own], names=[*batch.schema.names, *(n for n, _, _t in READ)])

    return run


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_bytes (of the text in UTF-8) and media, the text padded to whole units as an audio stream."""
    rows, names = hidden(docs)
    text = next(c for c, n in names.items() if n == text_col)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return restored(rows.mapInArrow(_encode_batches(text), f"{schema}, n_bytes long, media binary"), names, n_bytes="n_bytes", media="media")


def read(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows with what their streams hold; see READ."""
    inner, names = hidden(rows)
    media = next(c for c, n in names.items() if n == media_col)
    schema = ", ".join(f"{c} {t}" for c, t in inner.dtypes)
    own = ", ".join(f"{n} {t}" for n, _, t in READ)
    return restored(inner.mapInArrow(_decode_batches(media), f"{schema}, {own}"), names, **{n: n for n, _, _t in READ})


def op7_media(spark, sf_dir: str) -> DataFrame:
    back = read(store(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    payload = F.col("payload")
    return back.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "n_frames", "n_samples", "seconds", "vbr_table", "checksums_ok", "frame_offsets",
    )
