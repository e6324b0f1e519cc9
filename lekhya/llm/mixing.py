"""Mixing sources to target weights: each source cut at its exact token budget in hash-random order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.llm.common import discard, keep

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one range of a source's random keys, about; ranges of a source at most, whose sums, a row each, are prefix-summed in one task.
PER_RANGE, MOST_RANGES = 256, 1 << 20
#: Sources of a plan that is broadcast; of more, it is joined.
FEW_SOURCES = 100_000
EPOCHS = 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, epochs: float = EPOCHS) -> dict[str | None, float]:
    """Words to take from each source: by weight, at most epochs times its size, the excess shared again until none is above.

    sizes is one row a source. Sources come in code-point order, null last; weights repeat.
    """
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, out, free = share * sum(size.values()), {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        want = {s: budget * weight[s] / total for s in free}
        over = [s for s in free if want[s] > epochs * size[s]]
        if not over:
            out |= want
            break
        for s in over:
            out[s] = epochs * size[s]
            budget -= out[s]
        free = [s for s in free if s not in out]
    return out


def mark(docs: DataFrame) -> DataFrame:
    """docs with _size, _key and _bits: words, random key, and the key's leading 20 bits."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marked = docs.withColumns({"_size": n_words(F.col("text").cast("string")), "_key": key})
    return marked.withColumn("_bits", F.conv(F.substring("_key", 1, 5), 16, 10).cast("int"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = EPOCHS) -> DataFrame:
    """One row a source: s, source_size, target, full (whole epochs), and where the rest of its budget ends.

    Keys are uniform, so their leading bits cut a source into ranges of about PER_RANGE
    documents. Ranges are summed and the sums prefix-summed; within the one range where the
    budget ends, documents are sorted by key, id and size and summed up to the cut: (cut_key,
    cut_id, cut_size), alike documents at it, and cut_words, what each of them gives. One row a
    source reaches the driver.
    """
    base = sized(docs)
    out = _plan(base, weights, share, epochs)
    discard(base)
    return out


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, _size, _key, _bits), kept: words are counted once."""
    return keep(mark(docs.select("doc_id", "source", "text")).drop("text"), "sizes")


def _plan(base: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    totals = [(r.source, r.n, r.c) for r in base.groupBy("source").agg(F.sum("_size").alias("n"), F.count("*").alias("c")).collect()]
    want = targets([(s, n) for s, n, _ in totals], weights, share, epochs)
    rows = []
    for s, n, c in totals:
        full = int(want[s] // n) if n else 0
        bits = min(MOST_RANGES, max(1, c // PER_RANGE)).bit_length() - 1
        rows.append((s, n, float(want[s]), full, math.floor(want[s] - full * n + 0.5), 20 - bits))
    sources = base.sparkSession.createDataFrame(rows, "s string, source_size long, target double, full long, rest long, shift int")
    side = F.broadcast(sources) if len(rows) <= FEW_SOURCES else sources
    ranged = base.join(side, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.expr("shiftright(_bits, shift)"))
    sums = ranged.groupBy("s", "range").agg(F.sum("_size").alias("n"), F.first("rest").alias("rest"))
    up = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = sums.withColumn("upto", F.sum("n").over(up)).where("n > 0 and upto >= rest and upto - n < rest")
    last = last.select(F.col("s").alias("ls"), F.col("range").alias("lr"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    side = F.broadcast(last) if len(rows) <= FEW_SOURCES else last
    inside = ranged.join(side, F.col("s").eqNullSafe(F.col("ls")) & (F.col("range") == F.col("lr")))
    alike = inside.groupBy("s", "_key", "doc_id", "_size").agg(F.count("*").alias("m"), F.first("left").alias("left"))
    order = Window.partitionBy("s").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("before", F.coalesce(F.sum(F.col("_size") * F.col("m")).over(order), F.lit(0)))
    cut = placed.where("_size > 0 and before < left and left <= before + _size * m")
    cut = cut.select(F.col("s").alias("cs"), F.col("_key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("_size").alias("cut_size"), F.expr("(left - before) div m").alias("cut_words"))
    return keep(sources.join(cut, F.col("s").eqNullSafe(F.col("cs")), "left").drop("cs", "shift", "rest"), "plan")


def taken(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs with _size, source_size, target and taken by a plan, in one pass without a shuffle: before the cut a document gives all its words once more, after it none."""
    return _taken(mark(docs.select(F.struct(*docs.columns).alias("_own"), "source", "doc_id", "text")).drop("text", "_bits"), sources)


def _taken(marked: DataFrame, sources: DataFrame) -> DataFrame:
    few = sources.count() <= FEW_SOURCES
    both = marked.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("s")))
    place = F.struct("_key", "doc_id", "_size")
    cut = F.struct(F.col("cut_key").alias("_key"), F.col("cut_id").alias("doc_id"), F.col("cut_size").alias("_size"))
    once = F.when(F.col("cut_key").isNull(), 0).when(place < cut, F.col("_size")).when(place == cut, F.col("cut_words")).otherwise(0)
    return both.select("_own", "_size", "source_size", "target", (F.col("full") * F.col("_size") + once).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = EPOCHS) -> DataFrame:
    """docs' own id and source with size, source_size, target and taken: how many words the mix takes of each row.

    Whole epochs take every document; the rest of a source's budget goes to its documents in
    the order of a random key, md5 of the id, up to the word where the budget ends (see plan).
    Null texts have size 0; documents of size 0 take 0; equal ids are ordered by size; rows
    equal in id and size at the cut give alike, so a source can miss its target by fewer words
    than there are such rows. Other columns are not read. An empty table gives no row.
    """
    base = sized(docs)
    out = _taken(base.withColumn("_own", F.struct("doc_id", "source")), _plan(base, weights, share, epochs))
    return out.select("_own.doc_id", "_own.source", F.col("_size").alias("size"), "source_size", "target", "taken")
