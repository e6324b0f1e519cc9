"""Word error rates of (reference, hypothesis) pairs, and reports over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.functions import text, wer
from lekhya.functions.once import once
from lekhya.operators.order import middles, number_rows, with_middles
from lekhya.stored import stored

BINS = (0.0, 0.3, 0.5, 1.0, 2.0, 5.0)


#: Differing words of a side from which on a pair is long: shorter ones cost less in the JVM.
LONG = 64


def score(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", compose=text.nfc, normalize: bool = True, long_texts: bool = False) -> DataFrame:
    """pairs with ref_norm, hyp_norm, ref_words, hyp_words, edits and wer. Without normalize, texts are composed and no more, as in training.

    With long_texts, pairs that differ in over LONG words are scored by an Arrow function, whose
    cost hardly grows with the square of the length; results are the same.
    """
    form = (lambda c: text.normalize_for_wer(c, compose)) if normalize else compose
    out = once(pairs, ref_norm=form(F.col(reference)), hyp_norm=form(F.col(hypothesis)))
    out = once(out, _r=text.tokens(F.col("ref_norm")), _h=text.tokens(F.col("hyp_norm")))
    sizes = {"ref_words": F.size("_r"), "hyp_words": F.size("_h")}
    if long_texts:
        out = once(out, **sizes, _u=wer.unlike(F.col("_r"), F.col("_h"))).drop("_r", "_h")
        long = F.greatest(F.size("_u.r"), F.size("_u.h")) > LONG
        out = out.withColumn("_long", wer.long_edits(F.when(long, F.col("_u.r")), F.when(long, F.col("_u.h"))))
        out = once(out, edits=F.when(long, F.col("_long")).otherwise(wer.unlike_edits(F.col("_u")))).drop("_u", "_long")
    else:
        out = once(out, **sizes, edits=wer.word_edits(F.col("_r"), F.col("_h"))).drop("_r", "_h")
    return out.withColumn("wer", wer.wer(F.col("edits"), F.col("ref_words")))


def corpus(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro average per group: all edits over all reference words. Pairs with a blank reference do not count; 0 of none."""
    on = F.col("ref_words") > 0
    edits, words = F.sum(F.when(on, F.col("edits")).otherwise(0)), F.sum("ref_words")
    return scored.groupBy(*by).agg(F.count_if(on).alias("n"), edits.cast("long").alias("edits"), words.cast("long").alias("ref_words"), F.coalesce(edits / F.nullif(words, F.lit(0)), F.lit(0.0)).alias("wer"))


def model_table(runs: Sequence[tuple[str, str, DataFrame | None]]) -> DataFrame:
    """place, model, dataset, n, edits, ref_words, wer: one row of each run (model, dataset, scored pairs), in the order of runs. None stands for an optional dataset that is not there."""
    there = [(i, m, d, s) for i, (m, d, s) in enumerate(runs) if s is not None]
    rows = [s.select(F.lit(i).cast("long").alias("place"), F.lit(m).alias("model"), F.lit(d).alias("dataset"), "edits", "ref_words") for i, m, d, s in there]
    if not rows:
        raise ValueError("no dataset to report on")
    return corpus(reduce(DataFrame.unionByName, rows), ["place", "model", "dataset"])


def macro(scored: DataFrame, column: str = "wer", by: Sequence[str] = ()) -> DataFrame:
    """Mean and median of the utterances' rates, and the upper median: of an even number, the larger of the middle two."""
    rates = stored(scored.select(*by, F.col(column).alias("rate")), "rates")
    stats = rates.groupBy(*by).agg(F.count("*").alias("n"), F.avg("rate").alias("mean_wer"))
    found = with_middles(stats, middles(rates, ["rate"], by), by)
    return found.select(*by, "n", "mean_wer", ((F.col("rate_low") + F.col("rate_high")) / 2).alias("median_wer"), F.col("rate_high").alias("upper_median_wer"))


def bin_of(column: Column, bins: Sequence[float] = BINS) -> Column:
    out = F.lit(None).cast("int")
    for i, low in enumerate(bins):
        out = F.when(column >= low, i).otherwise(out)
    return out


def histogram(scored: DataFrame, column: str = "wer", bins: Sequence[float] = BINS) -> DataFrame:
    """Counts of half-open bins, empty ones shown; the last has no upper end."""
    spark = scored.sparkSession
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(bins, [*bins[1:], float("inf")], strict=True))], "bin int, low double, high double")
    counts = scored.groupBy(bin_of(F.col(column), bins).alias("b")).agg(F.count("*").alias("c"))
    return table.join(counts, F.col("bin") == F.col("b"), "left").select("bin", "low", "high", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def worst(scored: DataFrame, keys: Sequence[str], n: int = 20, width: int = 200) -> DataFrame:
    """The n utterances of the highest rate, hypotheses cut to width characters; ties by key."""
    return scored.orderBy(F.desc("wer"), *keys).limit(n).select(*keys, "wer", "ref_words", "hyp_words", F.substring("hyp_norm", 1, width).alias("hypothesis"))


def batches(rows: DataFrame, keys: Sequence[str], size: int = 8) -> DataFrame:
    """rows with batch: contiguous batches in the order of keys, numbered by a range partitioning's counts rather than one global sort."""
    return number_rows(rows, keys).withColumn("batch", F.floor(F.col("row_no") / size)).drop("row_no", "group_rows")


def head(rows: DataFrame, keys: Sequence[str], most: int | None) -> DataFrame:
    """The first `most` rows in the order of keys, all of them for None: an evaluation of part of a dataset."""
    return rows if most is None else rows.orderBy(*keys).limit(most)
