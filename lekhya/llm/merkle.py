"""Merkle manifest of a dataset: digests built bottom-up, proofs pushed top-down.

A source's leaves are a tree of its own, and the trees' roots (subroots) are the nodes of one
more. Each level is a stored table of runs: a run holds the digests of up to FANOUT children,
and its own digest is the hash of them. Proofs come down the same tables: a child's proof is
its siblings followed by the proof of its parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.llm.common import discard, keep
from lekhya.operators.order import number_rows

FANOUT = 16
#: Characters of a digest in hexadecimal.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """- for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**given: Column) -> Column:
    """Digest of a row; given replaces columns."""
    return digest(F.concat(*[field(given.get(c, F.col(c))) for c in FIELDS]))


@dataclass
class Tree:
    """levels[k] has the runs of height k + 1: (tree, pos, n, digest, kids); single has the trees of one node: (tree, digest, tag)."""

    levels: list[DataFrame]
    single: DataFrame

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        tops = [level.where("n = 1").select("tree", "digest") for level in self.levels]
        out = self.single.select("tree", "digest")
        for t in tops:
            out = out.unionByName(t)
        return out


def grow(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """The trees over nodes(tree, pos, n, digest, tag): pos is a node's place among the n of its tree, tag what its child entry carries besides.

    Level by level, runs of fanout nodes are grouped by (tree, pos // fanout), so no group is
    larger; a level is a fanout-th of the one below. The number of levels follows from the
    largest n.
    """
    nodes = keep(nodes, "nodes")
    most = nodes.agg(F.max("n").alias("n")).first().n or 0
    single = keep(nodes.where("n = 1").select("tree", "digest", "tag"), "single")
    levels, below = [], nodes.where("n > 1")
    while most > 1:
        place = F.struct((F.col("pos") % fanout).alias("at"), "digest", *[c for c in ("tag",) if c in below.columns])
        runs = below.groupBy("tree", "n", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.sort_array(F.collect_list(place)).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
        runs = runs.select("tree", "pos", F.ceil(F.col("n") / fanout).alias("n"), digest(joined).alias("digest"), "kids")
        levels.append(keep(runs, "level"))
        below, most = levels[-1].where("n > 1").select("tree", "pos", "n", "digest"), -(-most // fanout)
    discard(nodes)
    return Tree(levels, single)


def push(tree: Tree, tops: DataFrame) -> DataFrame:
    """(tree, digest, tag, subroot, steps) of every node at the bottom: the steps of its proof, lowest first.

    tops holds (tree, subroot, steps), what each tree's root inherits. From the highest level
    down, each run is joined to its inherited steps by (tree, pos), one to one, and hands
    them to its children behind their siblings; a tree joins in at its own height.
    """
    own = tree.single.join(tops, "tree").select("tree", "digest", "tag", "subroot", "steps")
    above, former = None, None
    for k, level in reversed(list(enumerate(tree.levels))):
        start = level.where("n = 1").select("tree", "pos").join(tops, "tree").select("tree", "pos", "subroot", "steps")
        told = start if above is None else above.unionByName(start)
        met = level.select("tree", "pos", "kids", F.array_join(F.transform("kids", lambda x: x["digest"]), "").alias("run")).join(told, ["tree", "pos"])
        each = met.select("tree", "pos", "subroot", "steps", "run", F.explode("kids").alias("kid"))
        before = F.col("kid.at") * WIDTH
        around = F.struct(F.substring("run", F.lit(1), before).alias("left"), F.substring("run", before + WIDTH + 1, F.length("run")).alias("right"))
        steps = F.concat(F.array(around), "steps").cast(STEPS).alias("steps")
        if not k:
            return own.unionByName(each.select("tree", F.col("kid.digest").alias("digest"), F.col("kid.tag").alias("tag"), "subroot", steps))
        above = keep(each.select("tree", (F.col("pos") * FANOUT + F.col("kid.at")).alias("pos"), "subroot", steps), "proofs")
        if former is not None:
            discard(former)
        former = above
    return own


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof, level by level from the lowest, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf_digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(steps, leaf_digest, lambda x, s: digest(F.concat(s["left"], x, s["right"])))


@dataclass
class Manifest:
    """sources has the trees of leaves, top the tree of their subroots; root is null of an empty table."""

    sources: Tree
    top: Tree
    root: str | None


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of docs(doc_id, source, lang, n_chars, text); tampered is the digest of a changed row, null where it stays, kept beside the leaf.

    A row is a leaf, repeated rows too. Leaves of a source ascend by doc_id (null first; equal
    ids by digest); sources ascend bytewise, null first, and null is a source of its own.
    Places come from ranges of (source, doc_id, digest), so a source of any size is shared by
    many tasks. Null, empty and very long fields are hashed as they are; other columns, whatever
    their names, are not read. An empty table has no leaf and a null root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    other = (F.lit(None) if tampered is None else tampered).cast("string")
    rows = docs.select(*[F.col(c).alias(c) for c in FIELDS])
    rows = keep(rows.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf().alias("digest"), other.alias("other")), "leaves")
    placed = number_rows(rows, ["id", "digest"], ["tree"])
    sources = grow(placed.select("tree", F.col("row_no").alias("pos"), F.col("group_rows").alias("n"), "digest", F.struct("id", "other").alias("tag")))
    subroots = keep(sources.roots(), "subroots")
    ordered = number_rows(subroots, ["tree"])
    top = grow(ordered.select(F.lit("").alias("tree"), F.col("row_no").alias("pos"), F.col("group_rows").alias("n"), "digest", F.struct("tree").alias("tag")))
    root = top.roots().first()
    discard(rows, subroots)
    return Manifest(sources, top, root.digest if root else None)


def proofs(made: Manifest) -> DataFrame:
    """(doc_id, leaf, other, subroot, root, steps) of every row: its place in the manifest and the proof of it."""
    origin = made.top.single.select("tree").unionByName(made.top.levels[-1].select("tree") if made.top.levels else made.top.single.select("tree").limit(0))
    start = origin.select("tree", F.lit("").alias("subroot"), F.lit([]).cast(STEPS).alias("steps"))
    tops = keep(push(made.top, start).select(F.col("tag.tree").alias("tree"), F.col("digest").alias("subroot"), "steps"), "tops")
    rows = push(made.sources, tops)
    return rows.select(F.col("tag.id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("tag.other").alias("other"), "subroot", F.lit(made.root).cast("string").alias("root"), "steps")


def tampered_leaf(every: int = 5) -> Column:
    """Digest of a row with its text's A-Z in lower case, where every divides the CRC-32 of its doc_id's digits; null elsewhere, and of a null doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(hit, leaf(text=F.translate(F.col("text").cast("string"), CAPITALS, SMALL)))


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, checked against the row as tampered with.

    verified is whether the root folded from the tampered leaf (the original one where nothing was
    tampered with) and the original siblings equals the root. Repeated rows give repeated results.
    """
    rows = proofs(build(docs, tampered_leaf()))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
