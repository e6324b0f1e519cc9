"""Importance resampling towards a target text, with n-gram features hashed by CRC-32 algebra.

A word's CRC is computed once. That of an n-gram follows from those of its parts: the CRC of a
text A followed by B is that of A, shifted by the length of B, xor that of B, and a shift is a
32 by 32 matrix over GF(2). No string of an n-gram is ever made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.llm import textbytes as tb
from lekhya.llm.common import discard, keep
from lekhya.operators.order import number_rows

BUCKETS, LONGEST = 10_000, 3
SCALE, SEED = 1000, "42"
LEAST_WORDS, SHARE = 20, 5
#: Reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes that words are made of, capitals aside: digits, letters, and all beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
#: Words of more bytes than this have their CRC from zlib, one by one.
LONG_WORD = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


BYTE = _byte_table()
#: Of shift by 2^k zero bytes: four tables, one for each byte of the CRC that is shifted.
_shifts: list[np.ndarray] = []


def _columns(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix held in four byte tables, times each x."""
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def shift_tables(k: int) -> np.ndarray:
    """The matrix of a shift by 2^k bytes, by squaring that of one byte k times."""
    while len(_shifts) <= k:
        basis = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
        if not _shifts:
            _shifts.append(BYTE[basis & 255] ^ basis >> 8)
        else:
            _shifts.append(_columns(_shifts[-1], _columns(_shifts[-1], basis)))
    return _shifts[k]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC register moved on by its own number of zero bytes: a product with one matrix for each bit of the number."""
    out, k = crc.copy(), 0
    while (left := length >> k).any():
        on = np.flatnonzero(left & 1)
        out[on] = _columns(shift_tables(k), out[on])
        k += 1
    return out


def word_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span: all spans byte by byte together, the longest first, so that those done drop out."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    sizes = size[order]
    many = int(np.searchsorted(-sizes, -LONG_WORD, "left"))
    for r in order[:many]:
        out[r] = zlib.crc32(raw[starts[r] : ends[r]].tobytes())
    rest, sizes = order[many:], sizes[many:]
    at, c = starts[rest], np.full(len(rest), 0xFFFFFFFF, np.uint32)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -i, "left"))  # spans of over i bytes
        c[:n] = BYTE[(c[:n] ^ raw[at[:n] + i]) & 255] ^ c[:n] >> 8
    out[rest] = c ^ np.uint32(0xFFFFFFFF)
    return out


def feature_crcs(raw: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n from 1 to longest: CRCs of the n-grams of all rows, words joined by one space, and the index of each row's first."""
    starts, ends, first = tb.spans(raw, offsets, INSIDE[raw])
    size = ends - starts
    word = word_crcs(raw, starts, ends)
    spaced = shifted(np.full(len(word), zlib.crc32(b" "), np.uint32), size) ^ word
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][row] - np.arange(len(row))  # words from here to the row's end
    crc, at = word, np.arange(len(word))
    for n in range(1, longest + 1):
        if n > 1:
            keep_on = left[at] >= n
            at, crc = at[keep_on], crc[keep_on]
            last = at + n - 1
            crc = shifted(crc, size[last] + 1) ^ spaced[last]
        yield crc, np.searchsorted(at, first)


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, lower-case bytes, offsets) of pieces of a text column."""
    raw, offsets = tb.utf8(batch.column(column))
    for i, j in tb.pieces(offsets):
        yield i, j, tb.LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task adds up its own and hands on a row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, offsets in _batches(batch, 0):
                for crc, _ in feature_crcs(raw, offsets, longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])
        tb.trim()

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, scale: int = SCALE) -> np.ndarray:
    """What a feature of each bucket weighs: the scaled log ratio of its smoothed shares in target and docs, rounded down. buckets numbers, so they may go to the driver."""
    raw, wanted = (keep(bucket_counts(t, "text", buckets, longest), "buckets") for t in (docs, target))
    total = lambda t: t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    s, t = float(total(raw)), float(total(wanted))
    both = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    ratio = ((F.col("t").cast("double") + 1) * (s + buckets)) / ((F.col("s").cast("double") + 1) * (t + buckets))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(scale * F.log(ratio)).cast("long").alias("gain")).collect():
        out[r.bucket] = r.gain
    discard(raw, wanted)
    return out


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: weight is the sum of the gains of its features, 0 of none."""
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in _batches(batch, 1):
                sums = np.zeros((3, j - i), np.int64)
                for n, (crc, first) in enumerate(feature_crcs(raw, offsets, longest)):
                    total = np.concatenate([[0], np.cumsum(gain[crc % buckets])])
                    sums[1] += np.diff(first)
                    sums[2] += total[first[1:]] - total[first[:-1]]
                    if not n:
                        sums[0] = np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, sums)], names=["doc_id", "n_words", "n_features", "weight"])
        tb.trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs: a sample of share percent of the documents of least_words words or more, drawn by weight.

    Weights are sums of the gains of word runs of one to three words, of the distribution of
    target over that of docs; score adds Gumbel noise that follows from seed and doc_id, so the
    highest scores are a draw without replacement in proportion to the weights, and reruns agree.
    rank counts the drawn ones from 1, ties by the smaller doc_id, and is null of the others.
    The texts are read twice, once to count and once to weigh; the ranks come from sampled ranges
    of (score, doc_id), not from one sorted task.

    Null, empty and wordless texts have no feature and weigh 0. A null doc_id draws its noise
    from an empty one and comes last among equals. Repeated rows are documents of their own and
    rank next to each other. An empty docs gives no row; an empty target leaves the gains to the
    smoothing. Other columns, whatever their names, are not read.
    """
    rows = weighed(docs, gains(docs, target, scale=scale))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = keep(rows.withColumn("score", F.col("weight") + noise), "scored")
    enough = scored.where(F.col("n_words") >= least_words).withColumns({"_down": -F.col("score"), "_last": F.col("doc_id").isNull()})
    placed = number_rows(enough, ["_down", "_last", "doc_id", "n_features"]).drop("_down", "_last")
    drawn = F.when(F.col("row_no") < F.floor(F.col("group_rows") * share / 100), F.col("row_no") + 1)
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", drawn).drop("row_no", "group_rows").unionByName(short)
