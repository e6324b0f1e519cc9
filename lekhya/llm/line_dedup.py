"""Near-duplicate lines by MinHash, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.functions.once import let
from lekhya.llm.common import BROADCAST_KEYS, attach, bucket_links, connected_components, differ_little, discard, keep, mask64, row_hash

#: Shingle: this many characters from every place of a line; a shorter line is one shingle.
SHINGLE = 10
PATTERN = r"(?s)(?=(.{%d}|^.{1,%d}$))." % (SHINGLE, SHINGLE - 1)
SIMILARITY, ROWS, BANDS = 0.8, 3, 8
#: Shingles in a row of the table whose minima are taken.
STEP = 8
#: Longs of parity bits of a line's shingles.
LANES = 16
#: A null doc_id counts as the largest.
LAST = (1 << 63) - 1


def normal(low: Column) -> Column:
    """A lower-case text whose lines are as they are compared: trimmed, runs of spaces and tabs as one space."""
    spaced = F.regexp_replace(F.regexp_replace(low, "[ \\t\\r]+", " "), " ?\n ?", "\n")
    odd = [F.contains(low, F.lit(x)) for x in ("  ", "\t", "\r", " \n", "\n ")]
    odd += [F.startswith(low, F.lit(" ")), F.endswith(low, F.lit(" "))]
    return F.when(reduce(Column.__or__, odd), F.btrim(spaced, F.lit(" "))).otherwise(low)


def shingles(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(PATTERN), F.lit(1))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, pos, line, lh) of every line that is not blank: normal form, and its 64-bit hash as the line's id. id and row, a hash of the text, tell rows apart."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), row_hash(text).alias("row"), F.lower(text).alias("low"))
    rows = rows.select("id", "row", normal(F.col("low")).alias("norm"))  # steps of their own: within a generator each use would be worked out again
    rows = rows.select("id", "row", F.posexplode(F.split("norm", "\n", -1)).alias("pos", "line"))
    return rows.where("line <> ''").withColumn("lh", F.xxhash64("line"))


def shingle_hashes(rows: DataFrame, step: int = STEP) -> DataFrame:
    """(id, lh, at, h0, h1, ...): 64-bit hashes of a line's shingles, step of them a row; the last one again where a line has no more. at is 0 in a line's first row.

    In UTF-32 a shingle is a slice at a known place, so none is searched for.
    """
    wide = rows.select("id", "lh", F.encode("line", "UTF-32").alias("b")).withColumn("last", F.greatest(F.lit(0), F.octet_length("b") - 4 * SHINGLE))
    cut = wide.select("id", "lh", "b", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(4 * step))).alias("at"))
    slices = [F.substring("b", F.least(F.col("at") + 4 * k, F.col("last")) + 1, F.lit(4 * SHINGLE)) for k in range(step)]
    return cut.select("id", "lh", "at", *[F.xxhash64(x).alias(f"h{k}") for k, x in enumerate(slices)])


def order(h: str, j: int) -> Column:
    """A hash's place in order j: two windows of its bits, their distance the order's own, and a mask."""
    at = 5 * j % 16
    return F.shiftleft(h, at).bitwiseXOR(F.shiftleft(h, at + 1 + j % 24)).bitwiseXOR(F.lit(mask64(j)))


def signatures(rows: DataFrame, rows_per_band: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(lh, least, n, keys): for each distinct line its first document, occurrences and band keys.

    Minima are taken within each row of STEP shingles, then in one hash aggregation by line, which
    also removes exact copies before anything is shuffled. The orders (order) need no product,
    which Spark checks for overflow, and are as good as independent for sets of any size (of
    pairs at 0.8, simulated, 0.3 % share no band from 5 shingles to 300).
    """
    n = rows_per_band * bands
    minima = [F.min(F.least(*[order(f"h{k}", j) for k in range(STEP)])).alias(f"m{j}") for j in range(n)]
    grouped = shingle_hashes(rows).groupBy("lh").agg(F.min("id").alias("least"), F.count_if(F.col("at") == 0).alias("n"), *minima)
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{j}") for j in range(b * rows_per_band, (b + 1) * rows_per_band)]) for b in range(bands)]
    return grouped.select("lh", "least", "n", F.array(*keys).alias("keys"))


def candidates(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): the pair of every band bucket of two lines; and (key, node): the lines of every fuller bucket.

    Ends of a pair are found by partial minima. Keys of fuller buckets, few as a rule, are
    broadcast up to BROADCAST_KEYS of them, else joined by a shuffle.
    """
    keyed = sig.select("lh", F.explode("keys").alias("key"))
    met = keep(keyed.groupBy("key").agg(F.min("lh").alias("a"), F.max("lh").alias("b"), F.count("*").alias("c")).where("c > 1"), "buckets")
    full = met.where("c > 2").select(F.col("key").alias("k"))
    full = F.broadcast(full) if full.count() <= BROADCAST_KEYS else full.hint("shuffle_hash")
    shared = keyed.join(full, F.col("key") == F.col("k")).select("key", F.col("lh").alias("node"))
    return keep(met.where("c = 2").select("a", "b").distinct(), "candidates"), keep(shared, "shared")


def texts_of(nodes: DataFrame, rows: DataFrame, sig: DataFrame) -> DataFrame:
    """(node, line) of the given nodes."""
    nodes = keep(nodes.join(sig.select("lh", "least"), F.col("node") == F.col("lh")).select("node", "least"), "nodes")
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_KEYS else nodes
    texts = keep(rows.join(wanted, (F.col("lh") == F.col("node")) & (F.col("id") == F.col("least"))).select("node", "line").dropDuplicates(["node"]), "texts")
    discard(nodes)
    return texts


def hashed(line: str) -> Column:
    """64-bit hashes of a line's distinct shingles: slices in UTF-32, as in shingle_hashes."""
    first = lambda b: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(b) - 4 * SHINGLE + 1), F.lit(4))
    return F.array_distinct(let(F.encode(line, "UTF-32"), lambda b: F.transform(first(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE))))))


def parities(texts: DataFrame) -> DataFrame:
    """(id, m, s0, s1, ...): the number of a line's distinct shingles, and their parity bits."""
    each = texts.select(F.col("node").alias("id"), hashed("line").alias("set")).select("id", F.explode("set").alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    lane = F.shiftright(F.col("h"), 6).bitwiseAND(F.lit(LANES - 1))
    return each.groupBy("id").agg(F.count("*").alias("m"), *[F.bit_xor(F.when(lane == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(LANES)])


def verified(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The edges whose lines' whole shingle sets have Jaccard similarity of at least similarity."""
    left, right = texts.select(F.col("node").alias("na"), F.col("line").alias("la")), texts.select(F.col("node").alias("nb"), F.col("line").alias("lb"))
    both = edges.hint("merge").join(left.hint("merge"), F.col("a") == F.col("na")).join(right.hint("merge"), F.col("b") == F.col("nb"))
    both = both.select("a", "b", hashed("la").alias("sa"), hashed("lb").alias("sb")).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return keep(both.where(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9).select("a", "b"), "verified")


def linked_lines(sig: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified edges with the components of all similar pairs of lines that share a band."""
    pairs, shared = candidates(sig)
    crowded = shared.select("node").distinct()
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).union(crowded).distinct(), rows, sig)
    own = keep(parities(texts.join(crowded.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left_semi")), "parities")
    members = shared.join(own, F.col("node") == F.col("id")).drop("id")
    out = bucket_links(members, lambda x, y: differ_little(x, y, similarity, LANES), lambda e: verified(e, texts, similarity))
    out = keep(verified(pairs, texts, similarity).union(out), "linked")
    discard(pairs, shared, texts, own)
    return out


def places(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, row, root, at, home): where each row of the table holds lines of a class; home if it has the class's least doc_id."""
    first = classes.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("least_id"), F.count("*").alias("c"))
    info = attach(classes.drop("least"), first, {"root": "r"}, "c").select("line_id", "root", "least_id")
    met = rows.select("id", "row", "pos", "lh").join(info.hint("merge"), F.col("lh") == F.col("line_id")).select("id", "row", "pos", "root", "least_id").repartition("id", "row")
    found = met.groupBy("id", "row", "root").agg(F.min("least_id").alias("least_id"), F.collect_list("pos").alias("at"))
    found = keep(found.select("id", "row", "root", "at", (F.col("id") == F.col("least_id")).alias("home")), "places")
    several = found.where("home").groupBy(F.col("root").alias("r")).agg(F.min("row").alias("chosen"), F.count("*").alias("c")).where("c > 1")
    several = keep(several, "several")
    if several.isEmpty():  # each class's first row is the only one of its id, unless ids are null or repeated
        return found
    told = attach(found, several, {"root": "r"}, "c", "left")
    return told.select("id", "row", "root", "at", (F.col("home") & (F.coalesce("chosen", "row") == F.col("row"))).alias("home"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY, rows_per_band: int = ROWS, bands: int = BANDS) -> DataFrame:
    """docs with text, n_lines and removed: every line of a class but its first is taken out.

    Lines are equal in normal form, or linked by a Jaccard similarity of their shingles of at
    least similarity; classes are the components. With three rows and eight bands 99.7 % of the
    pairs at 0.8 share a bucket, and more above; however full it is, its lines not yet joined
    are compared. The first line is that of the smallest doc_id, the topmost there; of rows
    with one doc_id and different texts, or with none, that of the least hash of its text.
    removed lists the places (from 0) of the lines taken out; blank lines stay. Null texts stay
    null; a null doc_id counts as the largest; rows equal in doc_id and text are treated alike.
    Columns called n_lines or removed are replaced; others are kept. An empty table stays empty.
    """
    rows = keep(lines(docs), "lines", "zstd")
    sig = keep(signatures(rows, rows_per_band, bands), "signatures")
    linked = linked_lines(sig, rows, similarity)
    roots = connected_components(linked)
    info = sig.select("lh", "least", "n").join(roots.hint("merge"), F.col("lh") == F.col("node"), "left").where("n > 1 or node is not null").select(F.col("lh").alias("line_id"), F.coalesce("root", "lh").alias("root"), "least")
    classes = keep(info, "classes")
    gone = places(rows, classes).select("id", "row", F.when(F.col("home"), F.array_remove("at", F.array_min("at"))).otherwise(F.col("at")).alias("gone"))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.sort_array(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = keep(gone.where(F.size("gone") > 0), "gone")
    discard(rows, sig, linked, classes)
    own = F.struct(*[F.col(c) for c in docs.columns if c not in ("text", "n_lines", "removed")]).alias("_own")
    text = F.col("text").cast("string")
    parted = docs.select(own, text.alias("_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), row_hash(text).alias("_row"), F.split(text, "\n", -1).alias("_parts"))
    joined = parted.join(gone.hint("merge"), (F.col("_id") == F.col("gone_id")) & (F.col("_row") == F.col("gone_row")), "left")
    kept = F.array_join(F.filter("_parts", lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    cleaned = F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("_text"))
    done = joined.select("_own", cleaned.alias("_text"), F.coalesce(F.size("_parts"), F.lit(0)).cast("long").alias("_lines"), F.coalesce("gone", F.lit([]).cast("array<int>")).alias("_gone"))
    return done.select("_own.*", F.col("_text").alias("text"), F.col("_lines").alias("n_lines"), F.col("_gone").alias("removed"))
