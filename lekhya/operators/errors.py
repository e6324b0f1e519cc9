"""Kinds of transcript errors: classes, reasons, shares, examples, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import text, wer

#: What to do about each kind of error.
ADVICE = {
    "repetition_loop": "penalise repetition while decoding",
    "code_switching": "transliterate Roman output afterwards",
    "casual_colloquial": "add colloquial speech to the training data",
    "proper_nouns": "bias the decoder towards known names",
    "number_quantifier": "normalise numbers on both sides",
    "deletion_function_words": "rescore with a language model or a wider beam",
    "insertion_noise": "trim silence and noise before decoding",
    "other": "look for sub-patterns and add examples",
}


def align(scored: DataFrame) -> DataFrame:
    """scored with word_errors, of the normal forms. Spread over the cluster first, for small files arrive in few partitions."""
    return scored.withColumn("word_errors", wer.word_errors(text.tokens(F.col("ref_norm")), text.tokens(F.col("hyp_norm"))))


def _switched(e: Column) -> Column:
    native = lambda c: text.count_script(c) > 0
    return (native(e["ref"]) & text.has_roman(e["hyp"])) | (text.has_roman(e["ref"]) & native(e["hyp"]))


def error_kind(e: Column, casual: Sequence[str] = lx.CASUAL_MARKERS, function_words: Sequence[str] = lx.FUNCTION_WORDS, fillers: Sequence[str] = lx.INSERTED_FILLERS) -> Column:
    """The kind that one word error suggests, or null."""
    sub, gone, extra = (e["type"] == k for k in ("substitution", "deletion", "insertion"))
    dropped = gone & (e["ref"].isin(*function_words) | F.length(e["ref"]).between(1, 2))
    return (
        F.when(sub & _switched(e), "code_switching")
        .when(sub & (e["ref"].isin(*casual) | e["hyp"].isin(*casual)), "casual_colloquial")
        .when(sub & (text.is_title(e["ref"]) | text.is_title(e["hyp"])), "proper_nouns")
        .when(dropped, "deletion_function_words")
        .when(extra & F.lower(e["hyp"]).isin(*fillers), "insertion_noise")
    )


def category(reference: Column, hypothesis: Column, errors: Column, **lists: Sequence[str]) -> Column:
    """A loop, else a number in the reference, else the kind of the first error that suggests one, else other."""
    told = F.filter(F.transform(errors, lambda e: error_kind(e, **lists)), lambda k: k.isNotNull())
    return F.when(text.repeats(text.tokens(hypothesis), lx.CLASSIFY_REPEATS), "repetition_loop").when(text.has_digit(reference), "number_quantifier").otherwise(F.coalesce(F.get(told, F.lit(0)), F.lit("other")))


def reason(hypothesis: Column, errors: Column, kind: Column) -> Column:
    """A sentence on the error that put an utterance in its class."""
    loop = text.most_frequent(text.tokens(hypothesis))
    typed = lambda t: F.get(F.filter(errors, lambda e: e["type"] == t), F.lit(0))
    switch, any_error = F.get(F.filter(errors, _switched), F.lit(0)), F.get(errors, F.lit(0))
    pair = lambda lead, e: F.concat(F.lit(lead), F.lit(": ref='"), e["ref"], F.lit("' hyp='"), e["hyp"], F.lit("'"))
    loose = F.when(F.size(errors) > 0, pair("local confusion", any_error)).otherwise(F.lit("no word-level mismatch"))
    looped = F.concat(F.lit("loop: '"), loop["word"], F.lit("' "), loop["n"].cast("string"), F.lit(" of "), F.size(text.tokens(hypothesis)).cast("string"))
    return F.coalesce(
        F.when(kind == "repetition_loop", looped)
        .when(kind == "code_switching", pair("script switch", switch))
        .when(kind == "casual_colloquial", pair("informal form", typed("substitution")))
        .when(kind == "proper_nouns", pair("name", typed("substitution")))
        .when(kind == "number_quantifier", pair("number", any_error))
        .when(kind == "deletion_function_words", F.concat(F.lit("dropped: '"), typed("deletion")["ref"], F.lit("' at "), typed("deletion")["ref_pos"].cast("string")))
        .when(kind == "insertion_noise", F.concat(F.lit("inserted: '"), typed("insertion")["hyp"], F.lit("'"))),
        loose,
    )


def shares(classified: DataFrame) -> DataFrame:
    """category, n, share in percent; absent categories are not listed."""
    counts = classified.groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in lx.CATEGORIES]), F.col("category"))


def advice(classified: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent categories, equal counts in the listed order, with advice."""
    table = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    counts = classified.groupBy("category").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), _rank()).limit(top).withColumn("advice", F.try_element_at(table, F.col("category")))


def examples(classified: DataFrame, order: Sequence[str], most: int = 5) -> DataFrame:
    """The first `most` rows of each category, with their place."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    return classified.withColumn("place", place).where(F.col("place") <= most)
