"""Readers of catalogues, transcripts, manifests, error samples and datasets, with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import text
from lekhya.functions.wer import ERROR
from lekhya.sources import audio

CATALOGUE = "user_id long, recording_id long, language string, duration double, rec_url_gcp string, transcription_url_gcp string, metadata_url_gcp string"
SEGMENTS = "array<struct<start:double,end:double,text:string,speaker_id:long>>"
MANIFEST = "audio_path string, text string, recording_id long, duration double, speaker_id long, segment_idx int"
SAMPLES = f"recording_id long, segment_idx int, reference string, hypothesis string, wer double, duration double, speaker_id long, word_errors array<{ERROR}>"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The recordings' sheet, as CSV with a header or Parquet."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(CATALOGUE).csv(path, header=True)


def transcripts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(recording_id, segments) of JSON files <recording_id>_*.json, an array of segments each.

    strict: a damaged file is an error. Otherwise it is a row with null segments and, in a third
    column error, the start of its text.
    """
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    number = F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("recording_id")
    if strict:
        return rows.select(number, F.from_json("value", SEGMENTS, {"mode": "FAILFAST"}).alias("segments"))
    got = rows.select(number, "value", F.from_json("value", SEGMENTS).alias("segments"))
    damage = F.when(F.col("segments").isNull(), F.concat(F.lit("no array of segments: "), F.substring("value", 1, 80)))
    return got.select("recording_id", "segments", damage.alias("error"))


def audio_listing(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, path, length) of <recording_id>_audio.wav files."""
    return _audio(spark, path).select("recording_id", "path", "length")


def _audio(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_audio.wav").load(path)
    return files.withColumn("recording_id", F.regexp_extract("path", r"(\d+)_audio\.wav$", 1).cast("long"))


def recordings(spark: SparkSession, path: str, rate: int = lx.SAMPLE_RATE) -> DataFrame:
    """(recording_id, samples, error) of <recording_id>_audio.wav files; a damaged one has null samples and a message."""
    return audio.decoded(_audio(spark, path).select("recording_id", "content"), ["recording_id"], rate)


def segment_audio(spark: SparkSession, path: str, rate: int = lx.SAMPLE_RATE) -> DataFrame:
    """(recording_id, segment_idx, audio_path, samples, error) of what writers.segment_audio wrote."""
    return audio.decoded(spark.read.parquet(path), ["recording_id", "segment_idx", "audio_path"], rate)


def _json_lines(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    """JSON lines; blank ones are skipped. strict: a damaged line is an error, else a row of nulls with the line in a last column error."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, error string").option("columnNameOfCorruptRecord", "error").json(path)


def manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Manifest rows as JSON lines; see _json_lines."""
    return _json_lines(spark, path, MANIFEST, strict)


def error_samples(spark: SparkSession, path: str | None, demo: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Error samples as JSON lines; see _json_lines. Without a path, the rows of demo."""
    if path is None:
        if demo is None:
            raise ValueError("neither a path nor demonstration rows")
        return demo
    return _json_lines(spark, path, SAMPLES, strict)


def dataset(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """A Parquet dataset; None where an optional one is not there. One that is there and cannot be read is an error in any case."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def text_column(df: DataFrame, names: Sequence[str] = lx.TEXT_COLUMNS) -> str:
    """The first of names that df has."""
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise KeyError(f"none of {list(names)} in {df.columns}")
    return found


def dataset_columns(rows: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Manifest rows in the shape of a speech dataset, with the columns also as they are."""
    audio = F.struct(F.col("audio_path").alias("path"), F.lit(lx.SAMPLE_RATE).alias("sampling_rate"))
    return rows.select(audio.alias("audio"), F.col("text").alias("sentence"), "recording_id", "duration", "speaker_id", "segment_idx", *also)


def choose_checkpoint(paths: DataFrame, column: str = "path") -> DataFrame:
    """The path ending in best, else that of the largest number after its last hyphen (none: -1)."""
    suffix = F.coalesce(F.expr(f"try_cast(substring_index(`{column}`, '-', -1) as int)"), F.lit(-1))
    rank = F.when(F.endswith(F.col(column), F.lit("/best")), F.lit((1 << 31) - 1)).otherwise(suffix)
    return paths.agg(F.max_by(column, F.struct(rank, F.col(column))).alias(column))


def assets(sheet: DataFrame, old: str = "", new: str = "") -> DataFrame:
    """(recording_id, kind, url): two rows a recording, urls with prefix old rewritten."""
    url = text.rewrite_prefix(F.col("url"), old, new) if old else F.col("url")
    kinds = sheet.select("recording_id", F.stack(F.lit(2), F.lit("audio"), F.col("rec_url_gcp"), F.lit("transcript"), F.col("transcription_url_gcp")).alias("kind", "url"))
    return kinds.select("recording_id", "kind", url.alias("url"))


def missing(wanted: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Assets that are not there yet, or are empty."""
    return wanted.join(there.where("length > 0").select(*keys), list(keys), "left_anti")


def tally(results: DataFrame, ok: Column | str = "ok") -> DataFrame:
    return results.groupBy(F.col(ok).alias("ok") if isinstance(ok, str) else ok.alias("ok")).agg(F.count("*").alias("n"))


def failures(results: DataFrame, keys: Sequence[str], ok: Column | str = "ok", most: int = 10) -> DataFrame:
    """The first `most` failures in the order of keys; tally has how many there are."""
    failed = results.where(~F.coalesce(F.col(ok) if isinstance(ok, str) else ok, F.lit(False)))
    return failed.orderBy(*keys).limit(most)
