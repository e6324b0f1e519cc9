"""Deterministic samples of errors across their severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.operators.order import number_rows
from lekhya.stored import stored

#: Stratum, least rate (exclusive for the first), largest rate, and rows drawn.
STRATA = {"low": 5, "medium": 10, "high": 10}
LOW, HIGH = 0.3, 1.0
TARGET = 25


def stratum(wer: str = "wer"):
    w = F.col(wer)
    return F.when(w < LOW, "low").when(w <= HIGH, "medium").otherwise("high")


def every_nth(numbered: DataFrame, draw) -> DataFrame:
    """Of rows numbered from 0 in groups of group_rows: all of a small group, else each step-th, draw of them; step = group_rows // draw, 1 at least."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("group_rows") / draw))
    picked = (F.col("group_rows") < draw) | ((F.col("row_no") % step == 0) & (F.floor(F.col("row_no") / step) < draw))
    return numbered.withColumn("step", F.when(F.col("group_rows") < draw, F.lit(1).cast("long")).otherwise(step)).where(picked)


def stratified(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors (wer > 0) by stratum, evenly spaced over each stratum's rates; ties by key. Rows are scored once, and their errors stored."""
    return _drawn(stored(scored.where("wer > 0"), "errors"), keys)


def _drawn(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    draw = F.when(F.col("stratum") == "low", STRATA["low"]).when(F.col("stratum") == "medium", STRATA["medium"]).otherwise(STRATA["high"])
    return every_nth(number_rows(errors.withColumn("stratum", stratum()), ["wer", *keys], ["stratum"]), draw)


def filled(scored: DataFrame, keys: Sequence[str], target: int = TARGET) -> DataFrame:
    """The stratified sample, filled up to target with evenly spaced errors not yet drawn, in the order low, medium, high, fill; at most target rows."""
    pool = stored(scored.where("wer > 0"), "errors")
    first = stored(_drawn(pool, keys), "drawn")
    missing = target - first.count()
    order = F.when(F.col("stratum") == "low", 0).when(F.col("stratum") == "medium", 1).when(F.col("stratum") == "high", 2).otherwise(3)
    if missing > 0:
        rest = pool.join(F.broadcast(first.select(*keys)), list(keys), "left_anti").withColumn("stratum", F.lit("fill"))
        first = first.unionByName(every_nth(number_rows(rest, ["wer", *keys], ["stratum"]), F.lit(missing)))
    return first.withColumn("stage", order).orderBy("stage", "wer", *keys).limit(target)


def metadata(scored: DataFrame, keys: Sequence[str], target: int = TARGET) -> DataFrame:
    """stratum, pool, step, sampled of each stratum and of the fill that had a pool."""
    sample = filled(scored, keys, target)
    return sample.groupBy("stratum").agg(F.first("group_rows").alias("pool"), F.first("step").alias("step"), F.count("*").alias("sampled"))
