"""Media columns: payloads stored as 8-bit samples in Matroska, read back through its packet table."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element ids of the Matroska and EBML specifications (fixed values).
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_VERSION, EBML_READ, EBML_ID_LEN, EBML_SIZE_LEN, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
VOID, CRC32 = 0xEC, 0xBF

FRAME = 576
RATE = 8000
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3
#: Frames of a laced block, blocks of a cluster: block times are 16-bit offsets from their cluster's.
PER_BLOCK, PER_CLUSTER = 8, 32


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """x as an EBML variable-length size; all ones mean an unknown size, so they are avoided."""
    width = width or next(n for n in range(1, 9) if x < (1 << 7 * n) - 1)
    return (x | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int]:
    """(value, next place); marker keeps the length bit, as in ids. -1: unknown size."""
    head = data[at]
    if not head:
        raise ValueError(f"a variable-length integer of over 8 bytes at {at}")
    width = 9 - head.bit_length()
    if at + width > len(data):
        raise ValueError(f"cut short at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return -1 if value == (1 << 7 * width) - 1 else value, at + width


def _element(name: int, body: bytes) -> bytes:
    return _id(name) + vint(len(body)) + body


def _uint(name: int, x: int) -> bytes:
    return _element(name, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lace header and the frames."""
    sizes = [len(f) for f in frames]
    if kind == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACE and len(frames) > 1:
        head += vint(sizes[0])
        for before, s in zip(sizes, sizes[1:-1], strict=False):
            d = s - before
            width = next(n for n in range(1, 9) if abs(d) < (1 << 7 * n - 1) - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block."""
    if kind == NO_LACE:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("a fixed lace that does not divide its block")
        sizes = [(end - at) // n] * n
    elif kind == XIPH:
        for _ in range(n - 1):
            s = 0
            while data[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + data[at])
            at += 1
    elif n > 1:
        s, at = read_vint(data, at)
        sizes.append(s)
        for _ in range(n - 2):
            here = at
            d, at = read_vint(data, at)
            sizes.append(sizes[-1] + d - ((1 << 7 * (at - here) - 1) - 1))
    if kind != FIXED:
        sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        if s < 0 or at + s > end:
            raise ValueError("a lace that leaves its block")
        out.append((at, at + s))
        at += s
    return out


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """The payload as one track of unsigned 8-bit PCM: laced simple blocks, clusters, cues. Equal payloads give equal files.

    Blocks of equal frames use fixed lacing, the last block of a cluster EBML lacing, the
    first of the file Xiph lacing, so that each kind is written and read.
    """
    head = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_ID_LEN, 4) + _uint(EBML_SIZE_LEN, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
    audio = _element(SAMPLING, struct.pack(">d", rate)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1 + zlib.crc32(payload)) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, audio)
    scale = 10**9 // rate  # one tick is one sample
    info = _uint(TIMESTAMP_SCALE, scale) + _element(DURATION, struct.pack(">d", len(payload))) + _element(MUXING_APP, b"lekhya") + _element(WRITING_APP, b"lekhya")
    front = _element(INFO, info) + _element(TRACKS, _element(TRACK_ENTRY, track))
    parts, cues, place = [front], [], len(front)
    step, span = frame * PER_BLOCK, min(frame * PER_BLOCK * PER_CLUSTER, 32767 // (frame * PER_BLOCK) * frame * PER_BLOCK)
    for at in range(0, len(payload), span):
        end = min(at + span, len(payload))
        body = [_uint(TIMESTAMP, at)]
        for b in range(at, end, step):
            frames = [payload[x : min(x + frame, end)] for x in range(b, min(b + step, end), frame)]
            kind = NO_LACE if len(frames) == 1 else XIPH if b == 0 else EBML_LACE if b + step >= end else FIXED
            body.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b - at, 0x80 | kind << 1) + lace(frames, kind)))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, at) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, place))))
        parts.append(cluster)
        place += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp, keyframe, first byte, end byte); times in ticks of scale nanoseconds."""

    doc_type: str
    scale: int
    duration: float
    tracks: dict[int, dict[str, object]]
    packets: list[tuple[int, int, bool, int, int]]
    cues: list[tuple[int, int, int]]
    clusters: list[int]


_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
_TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body, end) of the elements between two places; an unknown size lasts to the next top-level element."""
    while at < end:
        start = at
        name, at = read_vint(data, at, marker=True)
        size, at = read_vint(data, at)
        if size < 0:
            stop = end
            if name == CLUSTER:
                stop = next((s for n, s, _, _ in elements(data, at, end) if n in _TOP), end)
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {name:X} at {start} leaves its parent")
        yield name, start, at, stop
        at = stop


def demux(data: bytes) -> Media:
    """Parses a whole file; ValueError or IndexError if it is damaged. Unknown elements are skipped."""
    out = Media("", 1_000_000, 0.0, {}, [], [], [])
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]

    def span(track: dict[str, object], size: int, of: int, whole: int | None) -> float:
        """Ticks of a frame of size bytes: by the track's duration of a frame, else by its samples, else its share of the block."""
        if track.get("frame_ns"):
            return int(track["frame_ns"]) / out.scale  # type: ignore[call-overload]
        if track.get("codec") == "A_PCM/INT/LIT" and track.get("rate"):
            sample = max(1, int(track.get("bits") or 8) // 8) * int(track.get("channels") or 1)  # type: ignore[call-overload]
            return size / sample * 1e9 / float(track["rate"]) / out.scale  # type: ignore[arg-type]
        return (whole or 0) / of

    def block(at: int, end: int, base: int, key: bool | None, whole: int | None = None) -> None:
        number, at = read_vint(data, at)
        offset, flags = struct.unpack_from(">hB", data, at)
        ranges = unlace(data, at + 3, end, flags >> 1 & 3)
        when, track = float(base + offset), out.tracks.get(number, {})
        for a, b in ranges:
            out.packets.append((number, round(when), bool(flags & 0x80) if key is None else key, a, b))
            when += span(track, b - a, len(ranges), whole)

    def cluster(at: int, end: int) -> None:
        base = 0
        for name, _, a, b in elements(data, at, end):
            if name == TIMESTAMP:
                base = number(a, b)
            elif name == SIMPLE_BLOCK:
                block(a, b, base, None)
            elif name == BLOCK_GROUP:
                parts = [(inner, x, y) for inner, _, x, y in elements(data, a, b)]
                whole = next((number(x, y) for inner, x, y in parts if inner == BLOCK_DURATION), None)
                for inner, x, y in parts:
                    if inner == BLOCK:
                        block(x, y, base, all(name != REFERENCE for name, _, _ in parts), whole)

    def track(at: int, end: int) -> None:
        own: dict[str, object] = {}
        for name, _, a, b in elements(data, at, end):
            if name == TRACK_NUMBER:
                own["number"] = number(a, b)
            elif name == TRACK_TYPE:
                own["type"] = number(a, b)
            elif name == DEFAULT_DURATION:
                own["frame_ns"] = number(a, b)
            elif name == CODEC_ID:
                own["codec"] = data[a:b].decode("ascii", "replace")
            elif name == AUDIO:
                for inner, _, x, y in elements(data, a, b):
                    if inner == SAMPLING:
                        own["rate"] = real(x, y)
                    elif inner in (CHANNELS, BIT_DEPTH):
                        own["channels" if inner == CHANNELS else "bits"] = number(x, y)
        out.tracks[int(own.get("number", 0))] = own  # type: ignore[call-overload]

    def cue(at: int, end: int) -> None:
        """A cue point has one time and a position for each track that has a block there."""
        parts = [(n, a, b) for n, _, a, b in elements(data, at, end)]
        time = next(number(a, b) for n, a, b in parts if n == CUE_TIME)
        for n, a, b in parts:
            if n == CUE_POSITIONS:
                where = {m: number(x, y) for m, _, x, y in elements(data, a, b)}
                out.cues.append((time, where[CUE_TRACK], where[CUE_CLUSTER]))

    for name, _, at, end in elements(data, 0, len(data)):
        if name == EBML:
            out.doc_type = next((data[a:b].decode() for n, _, a, b in elements(data, at, end) if n == DOC_TYPE), "")
        elif name == SEGMENT:
            for top, start, a, b in elements(data, at, end):
                if top == INFO:
                    for n, _, x, y in elements(data, a, b):
                        if n == TIMESTAMP_SCALE:
                            out.scale = number(x, y)
                        elif n == DURATION:
                            out.duration = real(x, y)
                elif top == TRACKS:
                    for n, _, x, y in elements(data, a, b):
                        if n == TRACK_ENTRY:
                            track(x, y)
                elif top == CLUSTER:
                    out.clusters.append(start - at)
                    cluster(a, b)
                elif top == CUES:
                    for point, _, x, y in elements(data, a, b):
                        if point == CUE_POINT:
                            cue(x, y)
    return out


def track_bytes(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's packets joined in time order."""
    return b"".join(data[a:b] for _, _, _, a, b in sorted((p for p in media.packets if p[0] == track), key=lambda p: (p[1], p[3])))


def padded(text: bytes, frame: int = FRAME) -> bytes:
    """text and bytes 255 up to a positive multiple of frame."""
    return text + b"\xff" * ((-len(text)) % frame or (frame if not text else 0))


def feature(data: bytes, media: Media, payload: bytes) -> str:
    """packets:clusters:cues:ticks:mean:deviation:crossings of what was read: counts, duration, loudness and crossings of the middle value 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"{len(media.packets)}:{len(media.clusters)}:{len(media.cues)}:{int(media.duration)}:{x.mean():.3f}:{x.std():.3f}:{crossings}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """(doc_id, media): each whole text, padded, in a Matroska file; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                media = [mux(padded((t.as_py() or "").encode(), frame), frame) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """(doc_id, track, timestamp, keyframe, first_byte, end_byte, error) of every packet of media(doc_id, media); a damaged file gives one row, with what is wrong with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = [(*p, None) for p in demux(value.as_py() or b"").packets]
                except (ValueError, IndexError, KeyError, StopIteration, struct.error) as exc:
                    rows = [(None, None, None, None, None, f"{type(exc).__name__}: {exc}")]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "track", "timestamp", "keyframe", "first_byte", "end_byte", "error"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, track long, timestamp long, keyframe boolean, first_byte long, end_byte long, error string")


def digests(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """One row a document: the payload as read back from its stored form, and features of it.

    The stored form passes between the two steps of one task, so nothing but digests leaves
    it. Repeated rows repeat their result; a null text counts as empty; a null id is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                data = mux(padded(raw, frame), frame)
                media = demux(data)
                payload = track_bytes(data, media)
                rows.append((key.as_py(), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, media, payload)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
