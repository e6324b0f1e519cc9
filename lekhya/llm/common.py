"""Shared helpers: tables kept in the cluster's shared folder, and connected components."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.stored import discard, shared_dir
from lekhya.stored import stored as keep

__all__ = ["attach", "bucket_links", "connected_components", "differ_little", "discard", "keep", "mask64", "row_hash", "shared_dir"]

#: A table of so many keys, some 16 bytes each, is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A key of more rows than this is hot: its facts are broadcast, so that its rows stay where they are.
HOT = 512

#: So few edges are joined plainly: one task could hold them all.
FEW_EDGES = 100_000
#: Contraction rounds at most; edges fall geometrically, so twenty serve any table.
ROUNDS = 200
#: Masks that reorder 64-bit ids, one per contraction round.
_GOLDEN = 0x9E3779B97F4A7C15


def mask64(i: int) -> int:
    """A fixed signed 64-bit mask for round or band i."""
    x = (i + 1) * _GOLDEN & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def row_hash(text: Column) -> Column:
    """64 bits of a text: with the doc_id it tells rows apart whose ids are null or repeated; rows equal in both are one."""
    return F.xxhash64(text.cast("string"))


def attach(rows: DataFrame, facts: DataFrame, on: dict[str, str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with facts, one row for each key, of which n counts the key's rows; on names the key's columns in rows and facts.

    Keys of over HOT rows are few, at most one in HOT rows; up to BROADCAST_KEYS of them are
    broadcast, so no task meets all rows of a hot key. The others, and hot keys beyond that
    number, are joined by a shuffle.
    """
    same = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in on.items()])
    facts = keep(facts, "facts")
    hot = facts.where(F.col(n) > HOT)
    if not 0 < hot.count() <= BROADCAST_KEYS:
        return rows.join(facts, same, how)
    keys = F.broadcast(hot.select(*on.values()))
    return rows.join(F.broadcast(hot), same).unionByName(rows.join(keys, same, "left_anti").join(facts.where(F.col(n) <= HOT), same, how))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge table of longs.

    Contraction: each round sends a node to the least node within two hops (under a
    round-specific order, so chains shrink geometrically), jumps once more, relabels and
    deduplicates the edges, and stops when none is left. Minima are partially aggregated
    before each shuffle, and those of nodes with many edges are broadcast (attach), so a star
    with any number of leaves is no hot group. root is a node of the component; self-loops and
    nulls are dropped. No edge or label reaches the driver.
    """
    e = keep(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    for i in range(ROUNDS):
        size = e.count()
        if not size:
            break
        if i == ROUNDS - 1:
            raise RuntimeError(f"components are not done after {ROUNDS} rounds")
        m = F.lit(mask64(i))
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        near = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(m)).alias("x"), F.count("*").alias("d")).select(F.col("a").alias("n"), F.least("x", F.col("a").bitwiseXOR(m)).alias("x"), "d")
        met = attach(both, near, {"b": "n"}, "d") if size > FEW_EDGES else both.join(near, F.col("b") == F.col("n"))
        far = met.groupBy("a").agg(F.min("x").alias("x")).select("a", F.least("x", F.col("a").bitwiseXOR(m)).bitwiseXOR(m).alias("p"))
        old, far = e, keep(far, "parents")
        up = far.select(F.col("a").alias("u"), F.col("p").alias("g"))
        jumped = keep(far.join(up, F.col("p") == F.col("u"), "left").select("a", F.coalesce("g", "p").alias("p")), "jumped")
        ja = jumped.select(F.col("a").alias("ka"), F.col("p").alias("pa"))
        jb = jumped.select(F.col("a").alias("kb"), F.col("p").alias("pb"))
        e = e.join(ja, F.col("a") == F.col("ka")).join(jb, F.col("b") == F.col("kb"))
        e = keep(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "edges")
        former = labels
        if labels is None:
            labels = jumped.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(ja, F.col("root") == F.col("ka"), "left").select("node", F.coalesce("pa", "root").alias("root"))
        labels = keep(labels, "labels")
        discard(old, far, jumped, *([former] if former is not None else []))
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


#: Nodes of a bucket that is compared in full at once; nodes of one side of a block of pairs; rounds that thin fuller buckets, and the nodes that all others are compared with in each.
FULL, BLOCK, THINNINGS, HUBS = 16, 1024, 3, 8


def differ_little(a: str, b: str, similarity: float, lanes: int) -> Column:
    """Whether sets of sizes m and parity bits s0, s1, ... can have Jaccard similarity of at least similarity: no pair that has it is refused.

    An element in one of the sets alone flips one parity bit, so sets differ in no fewer elements than bits.
    """
    bits = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(lanes)])
    m, n = F.col(f"{a}.m"), F.col(f"{b}.m")
    return (F.least(m, n) >= similarity * F.greatest(m, n) - 1e-6) & (bits <= (m + n) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def bucket_links(members: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], full: int = FULL, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: verified edges that join what all similar pairs of nodes sharing a bucket join.

    members holds (key, node) once each and the columns of which near(x, y) makes a first test;
    verify keeps the similar pairs of a table (a, b), and writes them. Buckets of up to full
    nodes are compared in full. In a fuller one all nodes are compared with up to HUBS of
    its nodes, the least of each slice under an order of the key's own; those not joined to the
    least of all go to a bucket of their own, and so on until no full one is left, for THINNINGS
    rounds at most. Nodes of one component by then need no comparison among themselves. In every
    bucket that was fuller at first, each other pair with a node outside the least one's component
    is compared, in blocks of pairs that tasks share; only pairs that pass near become rows.
    """
    sized = keep(_sized(members), "members")
    big = sized.where(F.col("n") > full)
    left, found = sized, []
    for i in range(THINNINGS):
        small, large = left.where(F.col("n") <= full), left.where(F.col("n") > full)
        pairs = _within(small, near).union(_with_hubs(large, near))
        found.append(verify(keep(pairs.distinct(), "pairs")))
        edges = reduce(DataFrame.union, found)
        if large.isEmpty():
            if not i:  # there was no fuller bucket
                return edges
            break
        rooted = keep(_rooted(large, edges), "rooted")
        rest = rooted.where("root <> home").drop("root", "home", "n", "hub")
        left = keep(_sized(rest.withColumn("key", F.xxhash64("key", F.lit(i)))), "rest")
    pairs = _with_outsiders(keep(_rooted(big, edges), "rooted"), near, block)
    return edges.union(verify(keep(pairs.distinct(), "pairs")))


def _sized(members: DataFrame) -> DataFrame:
    """members of buckets of two nodes or more, with the bucket's size n and its hub, the least node under an order of the key's own."""
    turn = F.xxhash64("key")
    hub = F.min(F.col("node").bitwiseXOR(turn)).bitwiseXOR(turn).alias("hub")
    stats = members.groupBy("key").agg(hub, F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    return members.join(stats, F.col("key") == F.col("k")).drop("k")


def _ordered() -> list[Column]:
    return [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]


def _within(small: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """(a, b): all pairs of each bucket that pass near."""
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & near("x", "y")
    return small.alias("x").join(small.alias("y"), met).select(*_ordered())


def _with_hubs(large: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """(a, b): pairs that pass near of each node and up to HUBS nodes of its bucket, the least of each slice; the hub is one of them."""
    turn = F.xxhash64("key")
    piece = F.pmod(F.xxhash64("node", "key"), F.lit(HUBS))
    picked = large.groupBy("key", piece).agg(F.min(F.col("node").bitwiseXOR(turn)).bitwiseXOR(turn).alias("pick"))
    picked = picked.select(F.col("key").alias("k"), "pick")
    hubs = large.join(picked, (F.col("key") == F.col("k")) & (F.col("node") == F.col("pick"))).drop("k", "pick")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & near("x", "y")
    return large.alias("x").join(hubs.alias("y"), met).select(*_ordered())


def _with_outsiders(rooted: DataFrame, near: Callable[[str, str], Column], block: int) -> DataFrame:
    """(a, b): pairs that pass near of each node outside its hub's component and every node of its bucket in another component.

    Outsiders are cut into pieces of about block nodes, and so is the whole bucket: a task
    compares one piece with one other.
    """
    apart = rooted.where("root <> home").groupBy("key").agg(F.ceil(F.count("*") / block).alias("cuts")).withColumnRenamed("key", "k")
    mixed = rooted.join(apart, F.col("key") == F.col("k")).drop("k").withColumn("pieces", F.ceil(F.col("n") / block))
    mixed = keep(mixed, "mixed")

    def place(seed: int, n: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    own = mixed.where("root <> home").withColumn("u", place(1, "cuts")).withColumn("v", each("pieces"))
    every = mixed.withColumn("v", place(2, "pieces")).withColumn("u", each("cuts"))
    same = reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "u", "v")])
    once = (F.col("y.root") == F.col("y.home")) | (F.col("x.node") < F.col("y.node"))
    met = same & once & (F.col("x.root") != F.col("y.root")) & near("x", "y")
    return own.alias("x").join(every.hint("shuffle_hash").alias("y"), met).select(*_ordered())


def _rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with the component of each node, and as home that of its bucket's hub."""
    roots = connected_components(edges).withColumnsRenamed({"node": "_node", "root": "_root"})
    own = members.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "node")).drop("_node", "_root")
    homes = own.where("node = hub").select(F.col("key").alias("_key"), F.col("root").alias("home"))
    return own.join(homes, F.col("key") == F.col("_key")).drop("_key")
