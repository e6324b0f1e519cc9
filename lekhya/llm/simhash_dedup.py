"""Near-duplicate documents by SimHash, with pivot distance tables as the pair filter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.llm import textbytes as tb
from lekhya.llm.common import attach, bucket_links, connected_components, differ_little, discard, keep, row_hash

#: Reference fingerprints: rows of the 64 x 64 Walsh matrix, pairwise 32 bits apart, so their tables are uncorrelated.
PIVOTS = [sum(((i & j).bit_count() & 1) << j for j in range(64)) for i in (21, 42, 7, 56, 35, 14, 28, 49, 11, 22, 44, 25, 50, 37, 19, 63)]
#: Longs of parity bits of a text's shingles.
LANES = 16
#: Fingerprints that share a block pair are compared with each other up to this many; beyond it they are linked through one-bit neighbours.
FULL_BUCKET = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit SimHash of all word shingles of each whole text, repeats included.

    A-Z are lower-cased; words are runs of [^\\x20\\x09-\\x0D]. A text with fewer words than a
    shingle has one shingle, its whole word sequence; null or blank texts get fingerprint 0.
    Shingles, joined by single spaces, hash by XXH64 with seed 42; a bit is 1 if set in over
    half the hashes. Numpy per Arrow batch: a few array passes per byte, no Python per word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.utf8(batch.column(1))
            found = [np.zeros(0, tb.U)]
            for i, j in tb.pieces(offsets):
                own = tb.LOWER[raw[offsets[i] : offsets[j]]]
                starts, ends, first = tb.spans(own, offsets[i : j + 1] - offsets[i])
                own, starts, ends = tb.joined(own, offsets[i : j + 1] - offsets[i], starts, ends)
                a, last, at = tb.shingle_rows(first, shingle)
                found.append(tb.bit_majority(tb.xxh64(own, starts[a], ends[last]), at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found).view(np.int64))], names=["id", "fp"])
        tb.trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def with_pivots(fps: DataFrame) -> DataFrame:
    """Adds the distance table of each fingerprint: 16 Hamming distances, eight to a long."""
    tables = []
    for part in (PIVOTS[:8], PIVOTS[8:]):
        lanes = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * i) for i, p in enumerate(part)]
        tables.append(reduce(Column.bitwiseOR, lanes))
    return fps.withColumns({"t0": tables[0], "t1": tables[1]})


def within(a: str, b: str, radius: int) -> Column:
    """The pivot test, then the exact distance: by the triangle inequality no pair within radius differs more in any coordinate."""
    lane = lambda side, t, i: F.shiftright(F.col(f"{side}.t{t}"), 8 * i).bitwiseAND(F.lit(127))
    near = [F.abs(lane(a, t, i) - lane(b, t, i)) <= radius for t in (0, 1) for i in range(8)]
    return reduce(Column.__and__, near) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius)


def block_keys(radius: int) -> Column:
    """Keys of which any two fingerprints within radius share one: of radius+2 blocks at least two are equal."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(masks[i] | masks[j])))) for k, (i, j) in enumerate(combinations(range(n), 2))]
    return F.array(*keys)


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) over distinct fingerprints column fp: edges with the same components as all pairs within radius (1 or 2).

    Candidates share two equal blocks; their pivot tables discard pairs by the largest
    coordinate difference, and the exact distance verifies the rest. Every bucket of up to
    FULL_BUCKET fingerprints is compared in full. The members of a fuller bucket are linked
    exactly and without pairs: two are within 2 bits if and only if some value is within one
    bit of both, and at most 65 fingerprints are within one bit of a value.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    keyed = with_pivots(fps).withColumn("key", F.explode(block_keys(radius)))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    shared = keep(keyed.join(counts, F.col("key") == F.col("k")).select("key", "n", "fp", "t0", "t1"), "shared")
    small = shared.where(F.col("n") <= FULL_BUCKET)
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & within("x", "y", radius)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    full = shared.where(F.col("n") > FULL_BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    around = full.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    stars = around.groupBy("z").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    if radius == 1:  # neighbours of one another, not of a third value
        stars = full.join(around.where("fp <> z").select(F.col("fp").alias("f"), "z"), F.col("fp") == F.col("z")).select(F.col("fp").alias("a"), F.col("f").alias("b"))
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: fingerprints within radius bits are linked.

    component_id is the smallest doc_id reachable, itself included. Repeated rows give
    repeated results; equal texts, and all blank or null texts (fingerprint 0), are linked.
    A null doc_id keeps its row, with the smallest non-null id of its component if any.
    Other columns, whatever their names, are not read. An empty table gives no row.
    """
    fps = keep(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = connected_components(links(distinct.select("fp"), radius))
    own = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    own = keep(own, "own")
    least = own.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    named = attach(own, least, {"root": "r"}, "c").select(F.col("fp").alias("f"), "component_id", "n")
    out = attach(fps, named, {"fp": "f"})
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similarity_keys(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """(id, row, fp, keys, sh, bits): the row's key, SimHash, band keys, the sorted distinct shingle hashes of each text, and their parity bits."""
    mult = np.random.default_rng(17).integers(0, 1 << 63, rows * bands, np.uint64) * tb.U(2) + tb.U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.utf8(batch.column(1))
            for i, j in tb.pieces(offsets):
                own = tb.LOWER[raw[offsets[i] : offsets[j]]]
                starts, ends, first = tb.spans(own, offsets[i : j + 1] - offsets[i])
                a, last, at = tb.shingle_rows(first, shingle)
                h = tb.shingle_hashes(tb.word_hashes(own, starts, ends), a, last, shingle)
                fp = tb.bit_majority(h, at)
                full = np.flatnonzero(np.diff(at) > 0)
                keys = np.zeros((j - i, bands), tb.U)
                if len(full):
                    for band in range(bands):
                        for m in mult[band * rows : (band + 1) * rows]:
                            least = np.minimum.reduceat(tb.mix(h * m), at[:-1][full])
                            keys[full, band] = tb.mix(keys[full, band] * tb.U(31) + least + tb.U(band))
                own_sets = [np.unique(h[at[r] : at[r + 1]]) for r in range(j - i)]
                sets = [x.tobytes() for x in own_sets]
                bits = [np.packbits(np.bincount((x >> tb.U(20)).astype(np.int64) & (64 * LANES - 1), minlength=64 * LANES).astype(np.uint8) & 1).view(np.int64) for x in own_sets]
                bits_col = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * LANES, LANES), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bits])))
                flat = pa.array(keys.reshape(-1).view(np.int64))
                keys_col = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(fp.view(np.int64)), keys_col, pa.array(sets, pa.binary()), bits_col], names=["id", "row", "fp", "keys", "sh", "bits"])
        tb.trim()

    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), row_hash(F.col("text")).alias("row"))
    return given.mapInArrow(run, "id long, row long, fp long, keys array<long>, sh binary, bits array<long>")


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 22, rows: int = 2, bands: int = 8) -> DataFrame:
    """(id, row, component, first) of each row of docs, joined by Jaccard similarity of word shingles of at least similarity.

    For a similarity far below what 2 bits cover: at 0.8 two SimHashes differ in 10 of 64 bits on
    average, so equal blocks cannot find such pairs. Candidates share a band of shingle minima
    (rows=2, bands=8: 99.97 % of pairs at 0.8 do); bucket_links compares all pairs of a band's
    bucket that are not yet joined, however full it is. Pivot tables and Hamming distance
    discard those beyond radius (22 bits lie over four standard deviations above the mean at
    0.8), parity bits those that cannot be similar, and the exact Jaccard similarity of the
    whole shingle sets verifies the others. Equal shingle sets are one node and compared once,
    so a group of copies of any size is one candidate. Blank and null texts are equal to each
    other. row is a hash of the text, which with id names a row where ids are null or repeated.
    component is the least id of the group, null if it has none; first marks the group's row of
    the least id (null counts as the largest) and, of equal ids, of the least hash; rows equal
    in id and text are marked alike. An empty table gives no row; other columns are not read.
    """
    node = F.xxhash64("sh", "fp")
    keys = keep(_similarity_keys(docs, shingle, rows, bands).withColumns({"node": node, "nth": F.monotonically_increasing_id()}), "keys")
    place = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), F.col("row").alias("row"), F.col("nth").alias("nth"))
    leads = keep(keys.groupBy("node").agg(F.min(place).alias("lead"), F.count("*").alias("n")), "leads")
    told = leads.select(F.col("node").alias("k"), "lead", "n")
    reps = attach(keys, told, {"node": "k"}).where(F.col("nth") == F.col("lead.nth"))
    reps = keep(reps.select("node", "fp", "keys", "sh", "bits"), "reps")
    own = with_pivots(reps.select("node", "fp", "keys", (F.octet_length("sh") / 8).alias("m"), *[F.get("bits", F.lit(i)).alias(f"s{i}") for i in range(LANES)]))
    payload = ["fp", "t0", "t1", "m", *[f"s{i}" for i in range(LANES)]]
    keyed = own.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    shared = keyed.join(met, F.col("key") == F.col("k")).select("key", "node")
    members = shared.join(own.select(F.col("node").alias("o"), *payload), F.col("node") == F.col("o")).select("key", "node", *payload)
    shs = reps.select("node", "sh")
    left, right = shs.withColumnsRenamed({"node": "a", "sh": "sa"}), shs.withColumnsRenamed({"node": "b", "sh": "sb"})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), tb.U), np.frombuffer(y.as_py(), tb.U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common >= similarity * (len(p) + len(q) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def similar(pairs: DataFrame) -> DataFrame:
        return keep(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long"), "linked")

    linked = bucket_links(members, lambda x, y: within(x, y, radius) & differ_little(x, y, similarity, LANES), similar)
    roots = connected_components(linked).select(F.col("node").alias("k"), "root")
    nodes = keep(leads.join(roots, F.col("node") == F.col("k"), "left").select("node", "lead", "n", F.coalesce("root", "node").alias("root")), "nodes")
    groups = nodes.groupBy(F.col("root").alias("r")).agg(F.min("lead").alias("least"), F.count("*").alias("c"))
    named = attach(nodes.select("node", "root", "n"), groups, {"root": "r"}, "c").select(F.col("node").alias("k"), "n", "least")
    ids = keep(keys.select("id", "row", "node"), "ids")
    out = attach(ids, named, {"node": "k"})
    discard(keys, leads, reps, nodes)
    first = (F.coalesce("id", F.lit((1 << 63) - 1)) == F.col("least.id")) & (F.col("row") == F.col("least.row"))
    return out.select("id", "row", F.nullif(F.col("least.id"), F.lit((1 << 63) - 1)).alias("component"), first.alias("first"))
