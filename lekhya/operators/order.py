"""Global row numbers without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.stored import stored

#: A table of so many range counts is broadcast; a larger one, of very many groups, is joined by a shuffle.
BROADCAST_COUNTS = 1_000_000
#: Bits that monotonically_increasing_id gives to the place of a row in its partition.
PLACE_BITS = 33


def ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows stored in sorted ranges of the whole composite key order and their place in the input, with _range and _place, a row's place in its range."""
    by = [F.asc(k) for k in (*order, "_nth")]
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(dealt.drop("_nth").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    split = {"_range": F.shiftright("_at", PLACE_BITS), "_place": F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}
    return placed.withColumns(split).drop("_at")


def number_rows(rows: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """rows with row_no, from 0 in the order of keys (nulls first) within each group of by, and group_rows, the group's size.

    Rows are dealt to ranges of the whole composite key, group and place in the input included,
    at splitters that Spark samples: a group or a value of any number of rows is shared by many
    tasks. The sorted ranges are written once; a row's number is its place in its range, less
    that of its group's first row there, plus the group's rows in the ranges before. rows is
    read twice, to sample and to deal: store what is costly to make. Rows equal in by and keys
    are numbered in any order. An empty table stays empty.
    """
    placed = _started(ranged(rows, [*by, *keys]), by, F.count("*"))
    number = (F.col("_place") - F.col("_first") + F.col("_before")).cast("long")
    return placed.select(*rows.columns, number.alias("row_no"), F.col("_all").cast("long").alias("group_rows"))


def _started(placed: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """placed, of ranged, with _first: the place of a group's first row in its range, _before: the group's weight in the ranges before, _all: its whole weight."""
    counts = placed.groupBy(*by, "_range").agg(weight.alias("_n"), F.min("_place").alias("_first"))
    own = Window.partitionBy(*by) if by else Window.partitionBy()
    facts = counts.withColumns({"_before": F.sum("_n").over(own.orderBy("_range")) - F.col("_n"), "_all": F.sum("_n").over(own)}).drop("_n")
    facts = stored(facts.withColumnsRenamed({c: f"_{i}_by" for i, c in enumerate((*by, "_range"))}), "range-counts")
    if facts.count() <= BROADCAST_COUNTS:
        facts = F.broadcast(facts)
    same = reduce(Column.__and__, [placed[c].eqNullSafe(facts[f"_{i}_by"]) for i, c in enumerate((*by, "_range"))])
    return placed.join(facts, same).select(*[placed[c] for c in placed.columns], "_first", "_before", "_all")


def middles(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Of each group: c_low and c_high, the exact lower and upper middle value of each of columns, which are the same of an odd number; nulls do not count.

    Equal values are counted before they are shuffled. The counts are dealt to ranges of
    (group, column, value) and summed up, range by range, to the value at which half of the
    group is reached: no task holds the values of a group. A group without values has no row.
    """
    pair = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]
    values = rows.select(*by, F.explode(F.array(*pair)).alias("_x")).select(*by, "_x._c", "_x._v").where("_v is not null")
    counted = stored(values.groupBy(*by, "_c", "_v").agg(F.count("*").alias("_k")), "values")
    placed = _started(ranged(counted, [*by, "_c", "_v"]), [*by, "_c"], F.sum("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_c", "_range").orderBy("_v")) + F.col("_before")
    placed = placed.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_k") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    low, high = at(F.floor((F.col("_all") - 1) / 2)), at(F.floor(F.col("_all") / 2))
    found = placed.groupBy(*by, "_c").agg(low.alias("_low"), high.alias("_high"))
    own = [F.max(F.when(F.col("_c") == c, F.col(f"_{side}"))).alias(f"{c}_{side}") for c in columns for side in ("low", "high")]
    return found.groupBy(*by).agg(*own)


def with_middles(stats: DataFrame, found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """stats, one row a group, with the columns of found, of middles: rows of a group are brought together, null groups too."""
    both = stats.unionByName(found, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(c).alias(c) for c in both.columns if c not in by])
