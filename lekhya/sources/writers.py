"""Writers. All overwrite as a whole, through Spark's commit protocol; none leaves a partial result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import text
from lekhya.operators import cleanup, errors, numbers, repair
from lekhya.sources import audio


def manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def dataset(rows: DataFrame, path: str) -> None:
    """Parquet by split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def segment_audio(segments: DataFrame, path: str, rate: int = lx.SAMPLE_RATE, folder: str = "segments") -> None:
    """The kept segments of segments.build as WAVE files: rows (recording_id, segment_idx, audio_path, content) of Parquet, which Spark commits as a whole."""
    audio_rows(segments, rate, folder).write.mode("overwrite").parquet(path)


def audio_rows(segments: DataFrame, rate: int = lx.SAMPLE_RATE, folder: str = "segments") -> DataFrame:
    """(recording_id, segment_idx, audio_path, content) of the kept segments."""
    kept = segments.where("skip_reason is null")
    return kept.select("recording_id", "segment_idx", audio_path(folder), audio.to_wav(F.col("samples"), F.lit(rate)).alias("content"))


def audio_path(folder: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), audio.segment_name(F.col("recording_id"), F.col("segment_idx"))).alias("audio_path")


def manifest_rows(segments: DataFrame, folder: str = "segments") -> DataFrame:
    """Manifest rows of the kept segments of segments.build; their audio is that of audio_rows."""
    return segments.where("skip_reason is null").select(audio_path(folder), "text", "recording_id", "duration", "speaker_id", "segment_idx")


def wer_table(rows: DataFrame, path: str) -> None:
    """CSV of model, dataset and percent with two places."""
    rows.select(F.col("model").alias("Model"), F.col("dataset").alias("Dataset"), text.fixed(F.col("wer") * 100, 2).alias("WER (%)")).write.mode("overwrite").csv(path, header=True)


def error_samples(rows: DataFrame, path: str) -> None:
    rows.select("recording_id", "segment_idx", "reference", "hypothesis", text.fixed(F.col("wer"), 4).cast("double").alias("wer"), text.fixed(F.col("duration"), 2).cast("double").alias("duration"), "speaker_id", "word_errors").write.mode("overwrite").json(path)


def json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A table rendered on the driver: of a longer one the first `most` rows, in its order, and how many more there are."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    got = rows.limit(most + 1).collect()
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in got[:most]]
    if len(got) > most:
        lines += ["", f"{rows.count() - most} more rows: see the table."]
    return "\n".join([*lines, ""])


def fix_results(evaluated: DataFrame, table: DataFrame, keys: list[str], path: str) -> None:
    """JSON of a repair: the summary in one file, a line for each sample in others, for there may be any number."""
    rates = [F.round(c, 4).alias(c) for c in ("wer_before", "wer_after")]
    samples = evaluated.select(*keys, F.col("ref_norm").alias("reference"), F.col("hyp_norm").alias("hypothesis"), F.col("fixed").alias("fixed_hypothesis"), *rates, "outcome")
    json_rows(repair.report(evaluated, table), f"{path}/summary")
    json_rows(samples, f"{path}/per_sample")


def cleanup_results(cleaned: DataFrame, keys: list[str], path: str) -> None:
    json_rows(cleanup.results(cleaned, keys), path)


def cleanup_report(cleaned: DataFrame, keys: list[str], most: int = 1000) -> str:
    """Markdown of a cleanup: numbers written as digits, idioms left alone, loanwords, rates before and after, outcomes."""
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    listed = lambda c: F.array_join(F.transform(c, code), ", ")
    done = cleaned.withColumn("real", numbers.real(F.col("conversions"))).where(F.size("real") > 0)
    each = done.select(*keys, F.explode("real").alias("c")).select(*keys, code(F.col("c.original")).alias("said"), code(F.col("c.converted")).alias("written"), F.col("c.value").alias("value"))
    spared = cleanup.edge_cases(cleaned, keys).select(*keys, code(F.col("raw")).alias("input"), code(F.col("digits")).alias("output"), listed(F.col("idioms")).alias("idioms"))
    tagged = cleaned.where("tags.n > 0").select(*keys, code(F.col("hyp")).alias("raw"), code(F.col("tags.text")).alias("tagged"), listed(F.col("tags.words")).alias("words"))
    signed = lambda rate, delta: F.concat(text.fixed(F.col(rate), 4), F.lit(" ("), F.when(F.col(delta) >= 0, "+").otherwise(""), text.fixed(F.col(delta), 4), F.lit(")"))
    rates = done.select(*keys, text.fixed(F.col("wer_before"), 4).alias("before"), signed("wer_hyp_only", "delta_naive").alias("hypothesis only"), signed("wer_both", "delta_correct").alias("both sides"))
    parts = [("Numbers written as digits", each), ("Idioms left as they are", spared), ("Loanwords", tagged), ("Word error rates of rows with numbers", rates)]
    return "\n".join(["# Cleanup", "", *(markdown(rows.orderBy(*keys), title, most) for title, rows in parts), markdown(cleanup.outcomes(cleaned).orderBy("outcome"), "Outcomes", most)])


def taxonomy(classified: DataFrame, strata: DataFrame, keys: list[str], most: int = 1000) -> str:
    """Markdown of the kinds of errors: how samples were drawn, shares, up to five examples of each kind, advice on the most frequent three."""
    shares = errors.shares(classified).orderBy(F.desc("n"), "category").withColumn("share_pct", text.fixed(F.col("share_pct"), 1))
    shown = errors.examples(classified, ["wer", *keys]).withColumn("wer", text.fixed(F.col("wer"), 4))
    shown = shown.withColumn("why", errors.reason(F.col("hyp_norm"), F.col("word_errors"), F.col("category"))).orderBy("category", "place").select("category", *keys, F.col("ref_norm").alias("reference"), F.col("hyp_norm").alias("hypothesis"), "wer", "why")
    parts = [("Sampling", strata), ("Shares", shares), ("Examples", shown), ("What to do first", errors.advice(classified))]
    return "\n".join(["# Kinds of errors", "", *(markdown(rows, title, most) for title, rows in parts)])
