"""RIFF/WAVE audio: samples to bytes and bytes to samples, in Arrow functions; and fetching of files."""

from __future__ import annotations

import os
import struct
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, StringType, StructType

from lekhya import lexicon as lx

#: Format tags: whole numbers, floating point, and the one whose real tag stands in the extension.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
_SOUND = StructType().add("samples", ArrayType(FloatType())).add("rate", IntegerType()).add("channels", IntegerType()).add("error", StringType())


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A WAVE file of one channel of 16 bits; samples beyond -1 and 1 are cut off, what is no number is 0."""
    level = np.rint(np.clip(np.nan_to_num(samples.astype(np.float64), nan=0.0), -1, 1) * 32767).astype("<i2").tobytes()
    form = struct.pack("<HHIIHH", PCM, 1, rate, 2 * rate, 2, 16)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(level)) + level
    return b"RIFF" + struct.pack("<I", len(body)) + body


def chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, bytes) of each chunk; ValueError where the file ends too early. Chunks begin at even places."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at = 12
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError(f"chunk header cut off at {at}")
        size = struct.unpack_from("<I", content, at + 4)[0]
        if at + 8 + size > len(content):
            raise ValueError(f"chunk at {at} cut off: {len(content) - at - 8} of {size} bytes")
        yield content[at : at + 4], content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    """(samples between -1 and 1, rate, channels): channels are averaged. Whole numbers of 8, 16, 24 or 32 bits, floating point of 32 or 64; ValueError of anything else."""
    form = data = None
    for name, body in chunks(content):
        if name == b"fmt ":
            form = body
        elif name == b"data":
            data = body
    if form is None or len(form) < 16:
        raise ValueError("no format chunk")
    if data is None:
        raise ValueError("no data chunk")
    tag, channels, rate, _, frame, bits = struct.unpack_from("<HHIIHH", form)
    if tag == EXTENSIBLE:
        if len(form) < 26:
            raise ValueError("format extension cut off")
        tag = struct.unpack_from("<H", form, 24)[0]
    if not channels or not rate or frame != channels * bits // 8:
        raise ValueError(f"{channels} channels of {bits} bits in frames of {frame} bytes")
    if len(data) % frame:
        raise ValueError(f"{len(data)} bytes of data are no whole frames of {frame}")
    if tag == PCM and bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif tag == PCM and bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0].astype(np.float64) / (1 << 31)
    elif tag == PCM and bits in (16, 32):
        x = np.frombuffer(data, f"<i{bits // 8}").astype(np.float64) / (1 << bits - 1)
    elif tag == FLOAT and bits in (32, 64):
        x = np.frombuffer(data, f"<f{bits // 8}")
    else:
        raise ValueError(f"format {tag} of {bits} bits")
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32), rate, channels


@arrow_udf(BinaryType())
def to_wav(samples: pa.Array, rate: pa.Array) -> pa.Array:
    """A WAVE file of each array of samples; null of null."""
    return pa.array([encode(np.asarray(s.values.to_numpy(zero_copy_only=False)), r.as_py()) if s.is_valid and r.is_valid else None for s, r in zip(samples, rate, strict=True)], pa.binary())


@arrow_udf(_SOUND)
def from_wav(content: pa.Array) -> pa.Array:
    """struct(samples, rate, channels, error) of each file: damage gives null samples and a message, null a null struct's fields."""
    samples, rates, channels, errors = [], [], [], []
    for c in content:
        got, said = (None, None, None), None
        if c.is_valid:
            try:
                got = decode(c.as_py())
            except ValueError as e:
                said = str(e)
        for kept, x in zip((samples, rates, channels, errors), (*got, said), strict=True):
            kept.append(x)
    return pa.StructArray.from_arrays([pa.array(samples, pa.list_(pa.float32())), pa.array(rates, pa.int32()), pa.array(channels, pa.int32()), pa.array(errors, pa.string())], names=["samples", "rate", "channels", "error"])


def decoded(files: DataFrame, keys: list[str], rate: int = lx.SAMPLE_RATE) -> DataFrame:
    """keys, samples, error of files(keys, content). A file of another rate than rate has an error: resampling is done before."""
    out = files.select(*keys, from_wav(F.col("content")).alias("_s"))
    other = F.when(F.col("_s.rate") != rate, F.concat(F.lit("rate of "), F.col("_s.rate").cast("string"), F.lit(f" instead of {rate}")))
    error = F.coalesce("_s.error", other).alias("error")
    return out.select(*keys, "_s.samples", error).withColumn("samples", F.when(F.col("error").isNull(), F.col("samples")))


def segment_name(recording: Column, index: Column) -> Column:
    """<recording>_<segment, four digits at least>.wav"""
    place = index.cast("string")
    return F.concat(recording.cast("string"), F.lit("_"), F.when(F.length(place) < 4, F.lpad(place, 4, "0")).otherwise(place), F.lit(".wav"))


def _get(url: str, path: str, attempts: int, timeout: float) -> tuple[bool, str | None, int]:
    """(ok, error, bytes): the file is complete under its name, or not there. Only failures of the request are tried again."""
    if os.path.exists(path) and os.path.getsize(path):
        return True, None, os.path.getsize(path)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    for left in range(attempts - 1, -1, -1):
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as out:
                while piece := source.read(1 << 20):
                    out.write(piece)
            os.replace(part, path)
            return True, None, os.path.getsize(path)
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if not left:
                return False, str(e), 0
        except Exception as e:
            return False, f"{type(e).__name__}: {e}", 0
        finally:
            if os.path.exists(part):
                os.remove(part)
    return False, "no attempt", 0


def fetch(assets: DataFrame, folder: str, attempts: int = 3, timeout: float = 30, tasks: int | None = None) -> DataFrame:
    """(recording_id, kind, url, path, ok, error, length): each asset (recording_id, kind, url) fetched to folder, which driver and executors share.

    Files that are there and not empty are not fetched again. A file is written beside its name
    and then renamed, so a task that is lost or runs twice leaves no half file. A failure of the
    request is tried attempts times, any other is not; either is a row, not an exception. Store
    the result: each use of it looks at the files anew. Audio is <id>_audio.wav, a transcript
    <id>_transcription.json.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_get(u, p, attempts, timeout) if u else (False, "no url", 0) for u, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ok, error, length = zip(*told, strict=True) if told else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(error, pa.string()), pa.array(length, pa.int64())], names=["recording_id", "kind", "url", "path", "ok", "error", "length"])

    name = F.concat(F.col("recording_id").cast("string"), F.when(F.col("kind") == "audio", "_audio.wav").otherwise("_transcription.json"))
    rows = assets.select(F.col("recording_id").cast("long").alias("recording_id"), "kind", "url", F.concat(F.lit(folder.removeprefix("file://").rstrip("/") + "/"), name).alias("path"))
    rows = rows.repartition(tasks) if tasks else rows
    return rows.mapInArrow(run, "recording_id long, kind string, url string, path string, ok boolean, error string, length long")
