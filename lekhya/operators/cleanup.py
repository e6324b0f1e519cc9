"""The cleanup pipeline: numbers on both sides, loanword tags, three word error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.functions import text, wer
from lekhya.functions.once import once
from lekhya.operators import loanwords, numbers

MARGIN = 0.001


def run(pairs: DataFrame, compose=text.nfc) -> DataFrame:
    """pairs(reference, hypothesis, ...) with the normal forms, conversions and tags of the hypothesis, and the rates, rounded to 4 places.

    wer_before compares words as spoken; wer_hyp_only has digits on one side only and mostly
    rises; wer_both has digits on both. Inputs are composed once; what is made of them stays composed.
    """
    out = once(pairs, ref=text.normalize_for_wer(F.col("reference"), compose), hyp=text.normalize_for_wer(F.col("hypothesis"), compose))
    out = once(out, _nr=numbers.normalise(F.col("ref")), _nh=numbers.normalise(F.col("hyp")))
    out = once(out, ref_digits=text.normalize_for_wer(F.col("_nr.text"), text.nfc_native), hyp_digits=text.normalize_for_wer(F.col("_nh.text"), text.nfc_native), conversions=F.col("_nh.conversions"))
    words = {f"_{c}": text.tokens(F.col(c)) for c in ("ref", "hyp", "ref_digits", "hyp_digits")}
    rate = lambda a, b: F.round(wer.wer(wer.word_edits(F.col(a), F.col(b)), F.size(a)), 4)
    out = once(out, tags=loanwords.tag(F.col("hyp_digits")), **words)
    out = once(out, wer_before=rate("_ref", "_hyp"), wer_hyp_only=rate("_ref", "_hyp_digits"), wer_both=rate("_ref_digits", "_hyp_digits")).drop("_nr", "_nh", *words)
    return out.withColumns({"delta_naive": F.round(F.col("wer_hyp_only") - F.col("wer_before"), 4), "delta_correct": F.round(F.col("wer_both") - F.col("wer_before"), 4)})


def outcomes(cleaned: DataFrame) -> DataFrame:
    """outcome, n of the rows in which a number was converted."""
    d = F.col("wer_both") - F.col("wer_before")
    kind = F.when(d < -MARGIN, "improved").when(d > MARGIN, "regressed").otherwise("unchanged")
    return cleaned.where(F.size(numbers.real(F.col("conversions"))) > 0).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def edge_cases(cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in which an idiom shielded a number word: what came in, what went out, and the shielded words in their order."""
    idioms = F.transform(F.filter("conversions", lambda c: c["is_idiom"]), lambda c: c["original"])
    return cleaned.withColumn("idioms", idioms).where(F.size("idioms") > 0).select(*keys, F.col("hyp").alias("raw"), F.col("hyp_digits").alias("digits"), "idioms")


def results(cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the result file, in its names."""
    tags = [F.col("tags.text").alias("final_tagged"), F.col("conversions").alias("number_conversions"), F.col("tags.words").alias("english_words_detected"), F.col("tags.n").cast("long").alias("english_count")]
    rates = ["wer_before", "wer_hyp_only", F.col("wer_both").alias("wer_both_normalised"), F.col("delta_naive").alias("wer_delta_naive"), F.col("delta_correct").alias("wer_delta_correct")]
    return cleaned.select(*keys, F.col("ref").alias("reference"), F.col("hyp").alias("raw_asr"), F.col("hyp_digits").alias("number_normalised"), *tags, *rates)
