"""Benchmark decontamination by SimHash over windows of each item's size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.llm import textbytes as tb

#: Items of one pass over the documents; a larger benchmark takes several passes, in blocks.
BLOCK_ITEMS = 4096
#: Two shingle sets of similarity 0.8 have SimHashes 10 bits apart on average, with deviation 3: four deviations.
RADIUS = 22
MATCHES = "doc_id long, item_id long, similarity double, start_word long, n_words long"


@dataclass
class Items:
    """One block of benchmark items, indexed for one shingle width."""

    k: int
    ids: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    shingles: list[Counter] = field(default_factory=list)
    fps: np.ndarray | None = None
    known: np.ndarray | None = None
    gate: np.ndarray | None = None
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def close(self) -> Items:
        """Builds the shingle gate and the multi-index tables."""
        hashes = [np.fromiter(c.elements(), tb.U) for c in self.shingles]
        self.fps = tb.bit_majority(np.concatenate(hashes), np.concatenate([[0], np.cumsum([len(h) for h in hashes])]))
        self.known = np.unique(np.concatenate(hashes))
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.known >> tb.U(44)).astype(np.int64)] = True
        return self

    def near(self, fps: np.ndarray, size: int) -> list[np.ndarray]:
        """For each fingerprint of a window of size words, all items of that size within RADIUS bits.

        Eight blocks of eight bits; a pair within RADIUS has a block within its own bound,
        for the bounds plus one add up to RADIUS + 1. Of each size, tables[b, v] marks the items
        whose block b is within the bound of value v.
        """
        if size not in self.tables:
            own = np.flatnonzero(np.array(self.sizes) == size)
            bounds = [(RADIUS + 1) // 8 + (i < (RADIUS + 1) % 8) - 1 for i in range(8)]
            blocks = self.fps[own].view(np.uint8).reshape(-1, 8)
            bits = np.bitwise_count(np.arange(256, dtype=np.uint8))
            self.tables[size] = own, np.stack([bits[np.arange(256)[:, None] ^ blocks[:, b][None, :]] <= bounds[b] for b in range(8)])
        own, tables = self.tables[size]
        out = []
        for x in fps:
            value = np.frombuffer(x.tobytes(), np.uint8)
            cand = own[np.logical_or.reduce([tables[b, value[b]] for b in range(8)])]
            out.append(cand[np.bitwise_count(self.fps[cand] ^ x) <= RADIUS])
        return out


def _item_blocks(benchmark: DataFrame, shingle: int) -> Iterator[list[Items]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    block: dict[int, Items] = {}
    n = 0
    for item_id, text in rows.toLocalIterator():
        raw = tb.LOWER[np.frombuffer(text.encode(), np.uint8)]
        starts, ends, first = tb.spans(raw, np.array([0, len(raw)]))
        if not len(starts):
            continue
        k = min(shingle, len(starts))
        i, last, _ = tb.shingle_rows(first, k)
        own = block.setdefault(k, Items(k))
        own.ids.append(item_id)
        own.sizes.append(len(starts))
        own.shingles.append(Counter(tb.shingle_hashes(tb.word_hashes(raw, starts, ends), i, last, k).tolist()))
        n += 1
        if n == BLOCK_ITEMS:
            yield [x.close() for x in block.values()]
            block, n = {}, 0
    if n:
        yield [x.close() for x in block.values()]


def _scan(raw: np.ndarray, offsets: np.ndarray, block: list[Items], similarity: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of each row's best window for each item it meets."""
    starts, ends, first = tb.spans(raw, offsets)
    words = tb.word_hashes(raw, starts, ends)
    n_words = np.diff(first)
    for items in block:
        k = items.k
        i, last, at = tb.shingle_rows(first, k)
        if not len(i):
            continue
        h = tb.shingle_hashes(words, i, last, k)
        hit = items.gate[(h >> tb.U(44)).astype(np.int64)]
        where = np.flatnonzero(hit)
        pos = np.minimum(np.searchsorted(items.known, h[where]), len(items.known) - 1)
        hit[where] = items.known[pos] == h[where]
        total = np.concatenate([[0], np.cumsum(hit)])
        per_row = total[at[1:]] - total[at[:-1]]
        sizes = sorted(set(items.sizes))
        # A window shares at most its known shingles with an item, and similarity s needs s/(1+s) of both.
        need = lambda a, m: similarity * (a + m) / (1 + similarity) - 1e-9
        least = need(similarity * (sizes[0] - k + 1), sizes[0] - k + 1)
        for row in np.flatnonzero((per_row >= max(1, least)) & (n_words >= k)):
            a, b, best = int(at[row]), int(at[row + 1]), {}
            for size in sizes:
                m = size - k + 1
                w = min(m, b - a)
                if w < similarity * m - 1e-9 or per_row[row] < need(w, m):
                    continue
                inside = total[a + w : b + 1] - total[a : b - w + 1]
                go = a + np.flatnonzero(inside >= max(1, need(w, m)))
                if not len(go):
                    continue
                flat = (go[:, None] + np.arange(w)).reshape(-1)
                fps = tb.bit_majority(h[flat], np.arange(0, len(flat) + 1, w))
                for s, near in zip(go, items.near(fps, size), strict=True):
                    window = None
                    for x in near:
                        window = window or Counter(h[s : s + w].tolist())
                        common = (window & items.shingles[x]).total()
                        sim = common / (w + m - common)
                        if sim >= similarity - 1e-12 and sim > best.get(x, (0,))[0]:
                            best[x] = (sim, int(s) - a, w + k - 1)
            for x, (sim, s, n) in best.items():
                yield int(row), items.ids[x], sim, s, n


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): where whole documents hold benchmark items.

    For each item, windows of as many words slide over each text (one window, the text, if
    it is shorter). Windows with too few shingles known to the benchmark cannot reach the
    similarity and are skipped; the others' SimHashes find, through the multi-index, every
    item of the size within RADIUS bits (simulated, 99.9 % of pairs at 0.8 or more), and the exact weighted Jaccard similarity of the two bags of
    shingles decides. The best window of each document and item is returned, the earliest of
    equals. Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased; an item shorter than a shingle
    must occur as it is. Null, blank or missing items and texts match nothing. Repeated rows
    repeat their result. One pass without a shuffle for each BLOCK_ITEMS items.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _item_blocks(benchmark, shingle):

        def run(batches: Iterator[pa.RecordBatch], block: list[Items] = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = tb.utf8(batch.column(1))
                ids = batch.column(0)
                for i, j in tb.pieces(offsets):
                    found = [(ids[i + r].as_py(), *x) for r, *x in _scan(tb.LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], block, similarity)]
                    if found:
                        cols = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])
            tb.trim()

        part = source.mapInArrow(run, MATCHES)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without a match (see matches), with all their columns, in one pass a block.

    Rows are judged by their own text, so null or repeated ids do not matter.
    """
    at = docs.columns.index("text")
    for block in _item_blocks(benchmark, shingle):

        def run(batches: Iterator[pa.RecordBatch], block: list[Items] = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = tb.utf8(batch.column(at))
                good = np.ones(batch.num_rows, bool)
                for i, j in tb.pieces(offsets):
                    for row, *_ in _scan(tb.LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], block, similarity):
                        good[i + row] = False
                yield batch.filter(pa.array(good))
            tb.trim()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def by_document(found: DataFrame) -> DataFrame:
    """Matches per document: number of items and the best similarity."""
    grouped: DataFrame = found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("similarity").alias("similarity"))
    return grouped


