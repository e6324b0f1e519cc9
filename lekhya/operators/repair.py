"""Repair maps mined from substitutions, applied to hypotheses and evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import text, wer
from lekhya.functions.once import let, once
from lekhya.operators import scoring
from lekhya.operators.order import middles, with_middles
from lekhya.stored import stored

#: Entries of a map that is sent to every task as a literal; a larger one is joined.
LITERAL_ENTRIES = 10_000


def substitution_pairs(rows: DataFrame) -> DataFrame:
    """hyp, ref, n of the substitutions in word_errors: both sides there, different, and without Roman letters."""
    e = rows.select(F.explode("word_errors").alias("e")).where("e.type = 'substitution'").select(text.strip(F.col("e.hyp")).alias("hyp"), text.strip(F.col("e.ref")).alias("ref"))
    return e.where((F.col("hyp") != "") & (F.col("ref") != "") & (F.col("hyp") != F.col("ref")) & ~text.has_roman(F.concat("hyp", "ref"))).groupBy("hyp", "ref").agg(F.count("*").alias("n"))


def mine(pairs: DataFrame, least: int = 2) -> DataFrame:
    """hyp, ref: the most frequent reference of each hypothesis seen `least` times; equal counts by the smaller word."""
    best = F.row_number().over(Window.partitionBy("hyp").orderBy(F.desc("n"), "ref"))
    return pairs.where(F.col("n") >= least).withColumn("rank", best).where("rank = 1").select("hyp", "ref")


def merge(seed: DataFrame, mined: DataFrame) -> DataFrame:
    """hyp, ref, source: the seed map, overruled by the mined one."""
    s, m = seed.select(F.col("hyp").alias("hs"), F.col("ref").alias("rs")), mined.select(F.col("hyp").alias("hm"), F.col("ref").alias("rm"))
    both = s.join(m, F.col("hs") == F.col("hm"), "full_outer")
    return both.select(F.coalesce("hm", "hs").alias("hyp"), F.coalesce("rm", "rs").alias("ref"), F.when(F.col("hm").isNotNull(), "mined").otherwise("seed").alias("source"))


def as_literal(table: DataFrame) -> Column:
    """A map column of at most LITERAL_ENTRIES entries."""
    rows = table.select("hyp", "ref").limit(LITERAL_ENTRIES + 1).collect()
    if len(rows) > LITERAL_ENTRIES:
        raise ValueError("the map is too large for a literal: use apply_joined")
    return F.map_from_arrays(F.array(*[F.lit(r.hyp) for r in rows]).cast("array<string>"), F.array(*[F.lit(r.ref) for r in rows]).cast("array<string>"))


def _core(word: Column) -> Column:
    return text.strip_tail(word, lx.TAIL_MARKS)


def looped(words: Column) -> Column:
    """Whether some word occurs REPAIR_REPEATS times, so that loops are collapsed."""
    return text.repeats(words, lx.REPAIR_REPEATS)


def known(words: Column, table: Column) -> Column:
    """Whether the map has some word, less its final marks."""
    return F.exists(words, lambda w: F.try_element_at(table, _core(w)).isNotNull())


def _replaced(words: Column, table: Column) -> Column:
    mapped = lambda w: let(_core(w), lambda c: F.concat(F.coalesce(F.try_element_at(table, c), c), F.substring(w, F.length(c) + 1, F.length(w))))
    return F.array_join(F.transform(words, mapped), " ")


def _unlooped(hypothesis: Column) -> Column:
    return F.when(looped(text.tokens(hypothesis)), text.collapse_repeats(hypothesis)).otherwise(hypothesis)


def fix(hypothesis: Column, table: Column) -> Column:
    """Loops collapsed where some word occurs REPAIR_REPEATS times, then each word looked up less its final marks, which it keeps."""
    return _replaced(text.tokens(_unlooped(hypothesis)), table)


def fix_joined(rows: DataFrame, table: DataFrame, key: list[str], hypothesis: str = "hyp_norm") -> DataFrame:
    """rows with fixed, for maps of any size: words are exploded, joined to the map and put together again."""
    words = rows.select(*key, F.posexplode(text.tokens(_unlooped(F.col(hypothesis)))).alias("_i", "_w")).withColumn("_c", _core(F.col("_w")))
    met = words.join(table.select(F.col("hyp").alias("_hyp"), F.col("ref").alias("_ref")), F.col("_c") == F.col("_hyp"), "left")
    done = met.withColumn("_o", F.concat(F.coalesce("_ref", "_c"), F.substring("_w", F.length("_c") + 1, F.length("_w"))))
    joined = done.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_o"))), lambda s: s["_o"]), " ").alias("fixed"))
    return rows.join(joined, key, "left").withColumn("fixed", F.coalesce("fixed", F.lit("")))


def evaluate(pairs: DataFrame, table: Column, compose=text.nfc) -> DataFrame:
    """pairs with fixed, wer_before, wer_after and outcome."""
    scored = scoring.score(pairs, compose=compose).withColumnRenamed("wer", "wer_before")
    out = once(scored, _w=text.tokens(F.col("hyp_norm")))
    out = once(out, _loop=looped(F.col("_w")), _hit=known(F.col("_w"), table))
    words = F.when(F.col("_loop"), text.tokens(text.collapse_repeats(F.col("hyp_norm")))).otherwise(F.col("_w"))
    out = once(out, fixed=F.when(F.col("_loop") | F.col("_hit"), text.normalize_for_wer(_replaced(words, table), text.nfc_native)).otherwise(F.col("hyp_norm")))
    after = wer.wer(wer.word_edits(text.tokens(F.col("ref_norm")), text.tokens(F.col("fixed"))), F.col("ref_words"))
    after = F.when(F.col("fixed") == F.col("hyp_norm"), F.col("wer_before")).otherwise(after)
    return once(out.drop("_w", "_loop", "_hit"), wer_after=after).withColumn("outcome", wer.outcome(F.col("wer_before"), F.col("wer_after"), F.col("fixed") != F.col("hyp_norm")))


def _measured(evaluated: DataFrame) -> DataFrame:
    """One row: n, means, middle values (wer_before_low, ...) and numbers of outcomes."""
    rates = stored(evaluated.select("wer_before", "wer_after", "outcome"), "rates")
    kind = F.col("outcome")
    stats = rates.agg(
        F.count("*").alias("n"), F.avg("wer_before").alias("mean_before"), F.avg("wer_after").alias("mean_after"),
        F.count_if(kind == "improved").alias("improved"), F.count_if(kind.isin("unchanged", "unchanged_wer")).alias("unchanged"), F.count_if(kind == "regressed").alias("regressed"),
    )
    return with_middles(stats, middles(rates, ["wer_before", "wer_after"]))


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: means and medians before and after, and how many improved, stayed or got worse."""
    half = lambda c: ((F.col(f"{c}_low") + F.col(f"{c}_high")) / 2)
    medians = [half("wer_before").alias("median_before"), half("wer_after").alias("median_after")]
    return _measured(evaluated).select("n", "mean_before", "mean_after", *medians, "improved", "unchanged", "regressed")


def improved(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Utterances that the map made better: before, after, and both rates to 4 places."""
    rates = [F.round(c, 4).alias(c) for c in ("wer_before", "wer_after")]
    return evaluated.where("outcome = 'improved'").select(*keys, F.col("ref_norm").alias("reference"), F.col("hyp_norm").alias("before"), F.col("fixed").alias("after"), *rates)


def report(evaluated: DataFrame, table: DataFrame) -> DataFrame:
    """One row: the summary to 4 places, what the repair gained, and the entries of the map (hyp, ref, source) by source. Medians are upper ones, differences those of the exact values."""
    given = _measured(evaluated)
    renamed = {"n": "target_samples", "mean_before": "mean_b", "mean_after": "mean_a", "wer_before_high": "median_b", "wer_after_high": "median_a", "improved": "fixed_count", "unchanged": "unchanged_count", "regressed": "regressed_count"}
    made = given.withColumnsRenamed(renamed)
    entries = table.agg(F.count("*"), F.count_if(F.col("source") == "mined"), F.count_if(F.col("source") == "seed")).first()
    sizes = [F.lit(n).cast("long").alias(name) for n, name in zip(entries, ("map_entries", "mined_entries", "seed_entries"), strict=True)]
    pair = lambda kind: [F.round(f"{kind}_b", 4).alias(f"wer_before_{kind}"), F.round(f"{kind}_a", 4).alias(f"wer_after_{kind}"), F.round(F.col(f"{kind}_b") - F.col(f"{kind}_a"), 4).alias(f"improvement_{kind}")]
    return made.select("target_samples", *sizes, *pair("mean"), *pair("median"), "fixed_count", "unchanged_count", "regressed_count")
