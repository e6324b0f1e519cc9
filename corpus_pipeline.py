"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

The result cannot be stated in SQL (hashed models, fingerprints, minima), so ORACLE_SQL is None; tests compare the stages with brute force.

Each stage takes nulls in any column, blank and very long texts, repeated rows, rows of one or
no doc_id with different texts, empty tables, and columns beyond those of documents, which it
passes on whatever their names. A row is told apart by doc_id and text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.llm import decontaminate, line_dedup, mixing, quality, simhash_dedup
from lekhya.llm.common import keep, row_hash, shared_dir

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the importance sample; junk and toxic documents weigh far less than the cut. Without labels of both kinds all stay."""
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that near-duplicate an earlier line; those left with no line that is not blank go. n_chars is counted anew where it is there."""
    named = docs.select(F.struct(*docs.columns).alias("own"), "doc_id", "text")
    out = line_dedup.dedup(named)
    out = out.where((F.size("removed") == 0) | (F.btrim("text", F.lit(" \n\t\r")) != ""))
    made = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[made.get(c, F.col(f"own.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, similarity 0.8): that of the least doc_id. Of rows equal in doc_id and text one stays."""
    groups = keep(simhash_dedup.similar_components(docs), "groups")
    gone = keep(groups.where("not first").select(F.col("id").alias("_id"), F.col("row").alias("_row")).distinct(), "gone")
    own = docs.select(F.struct(*docs.columns).alias("_own"), F.col("doc_id").cast("long").alias("_doc"), row_hash(F.col("text")).alias("_hash"))
    same = lambda t: F.col("_doc").eqNullSafe(t["_id"]) & (F.col("_hash") == t["_row"])
    left = own.join(gone, same(gone), "left_anti")
    again = keep(groups.where("first").groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.count("*").alias("_n")).where("_n > 1"), "again")
    if not again.isEmpty():
        left = left.join(again, same(again), "left_anti").unionByName(left.join(again, same(again), "left_semi").dropDuplicates(["_doc", "_hash"]))
    return left.select("_own.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with taken: how many, repeats counted. A column taken of docs is replaced."""
    out = mixing.taken(docs, mixing.plan(docs)).where("taken > 0")
    return out.select(*[F.col(f"_own.`{c}`").alias(c) for c in docs.columns if c != "taken"], "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", deduplicate_lines),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
