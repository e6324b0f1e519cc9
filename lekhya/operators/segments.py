"""Timed segments: building them from transcripts, filtering, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import arrays, text
from lekhya.operators.order import middles, with_middles
from lekhya.stored import stored


def skip_reason(start: Column, end: Column, words: Column, samples: Column | None = None, script: str = "devanagari", fillers: Sequence[str] = lx.SEGMENT_FILLERS) -> Column:
    """The first rule that a segment breaks, null if it is kept. Both limits of duration are allowed."""
    span, body = end - start, text.strip(words)
    rules = (
        F.when(span < lx.MIN_SECONDS, "too_short")
        .when(span > lx.MAX_SECONDS, "too_long")
        .when(text.is_punctuation_only(body), "punctuation_only")
        .when(text.is_filler(body, fillers), "filler_word")
        .when(text.count_script(body, script) < lx.MIN_LETTERS, "insufficient_letters")
        .when(F.size(text.tokens(body)) / span < lx.MIN_WORDS_PER_SECOND, "sparse_wps")
    )
    return rules if samples is None else rules.when(~arrays.loud(samples), "near_silent")


def build(recordings: DataFrame, transcripts: DataFrame, script: str = "devanagari", rate: int = lx.SAMPLE_RATE) -> DataFrame:
    """Manifest rows, with their skip_reason, of recordings(recording_id, samples) and transcripts(recording_id, segments).

    A recording without a transcript has no row. duration is that of the samples, which the
    end of the recording may cut; the rules see end minus start.
    """
    seg = recordings.join(transcripts, "recording_id").select("recording_id", "samples", F.posexplode("segments").alias("segment_idx", "s"))
    seg = seg.select("recording_id", "segment_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"), text.normalize_text(F.col("s.text")).alias("text"), F.col("s.speaker_id").alias("speaker_id"), arrays.time_slice(F.col("samples"), F.col("s.start"), F.col("s.end"), rate).alias("samples"))
    return seg.withColumns({"duration": F.round(F.size("samples") / rate, 3), "skip_reason": skip_reason(F.col("start"), F.col("end"), F.col("text"), F.col("samples"), script)})


def reason_tally(marked: DataFrame) -> DataFrame:
    return marked.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def filter_stats(marked: DataFrame, duration: str = "duration") -> DataFrame:
    """One row: segments before and after, retention, hours and durations of what is kept."""
    on = F.col("skip_reason").isNull()
    rows = stored(marked.select(on.alias("on"), F.when(on, F.col(duration)).alias("kept")), "durations")
    stats = rows.agg(
        F.count("*").alias("n_before"), F.count("kept").alias("n_after"), F.count_if(~F.col("on")).alias("n_removed"),
        F.coalesce(100.0 * F.count("kept") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("retention_pct"), F.coalesce(F.sum("kept"), F.lit(0.0)).alias("kept_seconds"),
        F.min("kept").alias("min_seconds"), F.max("kept").alias("max_seconds"), F.avg("kept").alias("mean_seconds"),
    )
    found = with_middles(stats, middles(rows, ["kept"]))
    return found.select(*stats.columns, ((F.col("kept_low") + F.col("kept_high")) / 2).alias("median_seconds"))


def dataset_stats(rows: DataFrame, by: Sequence[str] = (), duration: str = "duration", words: str = "text") -> DataFrame:
    """Per group: rows, hours, durations, and the mean and least of the rows' words a second."""
    rate = F.size(text.tokens(F.col(words))) / F.nullif(F.col(duration), F.lit(0.0))
    rows = stored(rows.select(*by, F.col(duration).alias("seconds"), rate.alias("wps")), "durations")
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("n"), (F.sum("seconds") / 3600).alias("hours"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"),
        F.avg("seconds").alias("mean_seconds"), F.avg("wps").alias("mean_wps"), F.min("wps").alias("min_wps"),
    )
    found = with_middles(stats, middles(rows, ["seconds"], by), by)
    median = ((F.col("seconds_low") + F.col("seconds_high")) / 2).alias("median_seconds")
    return found.select(*by, "n", "hours", "min_seconds", "max_seconds", "mean_seconds", median, "mean_wps", "min_wps")
