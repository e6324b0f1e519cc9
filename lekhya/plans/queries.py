"""Registered queries of transcript analytics."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import arrays, text
from lekhya.operators import cleanup, errors, loanwords, numbers, repair, sampling, scoring, segments, split
from lekhya.plans import views
from lekhya.sources import audio, readers, writers
from lekhya.stored import shared_dir, stored

KEYS = ["conv_id", "turn"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(views.pair(spark, sf_dir), compose=text.nfc_native)


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query
def normalize_wer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalize_for_wer(F.col("text")).alias("norm"))


@query
def normalize_debug_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of spaces kept."""
    spaced = F.replace(F.col("text"), F.lit(" "), F.lit("  "))
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalize_for_wer(spaced, single=False).alias("norm"))


@query
def script_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    mine = views.hints(spark).select(F.col("id").cast("long").alias("id"), "text").unionByName(views.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))
    return mine.select("id", text.count_script(t).cast("long").alias("devanagari"), text.has_roman(t).alias("roman"), text.has_digit(t).alias("digit"), text.is_punctuation_only(t).alias("punctuation_only"), text.is_filler(t).alias("filler"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.seg(spark, sf_dir)
    return s.withColumn("skip_reason", segments.skip_reason(F.col("start"), F.col("end"), F.col("text"), script="latin"))


@query
def segment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("recording_id", "segment_idx", F.coalesce("skip_reason", F.lit("kept")).alias("reason"))


@query
def segment_reason_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.reason_tally(_marked(spark, sf_dir))


@query
def segment_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments.filter_stats(_marked(spark, sf_dir))
    return s.select("n_before", "n_after", "n_removed", *[F.round(c, 4).alias(c) for c in s.columns[3:]])


@query
def segment_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From recordings and transcripts, those without one left out, to segments and what becomes of each."""
    s = segments.build(views.recordings(spark, sf_dir), views.transcripts(spark, sf_dir), "latin", views.RATE)
    return s.select("recording_id", F.col("segment_idx").cast("long").alias("segment_idx"), "text", "duration", "speaker_id", F.coalesce("skip_reason", F.lit("kept")).alias("reason"))


@query
def rms_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.samples(spark, sf_dir)
    return s.select("vec_id", F.round(arrays.rms(F.col("samples")), 6).alias("rms"), arrays.loud(F.col("samples"), 0.1).alias("loud"))


@query
def sample_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of four samples a second, beyond the end for some."""
    s = views.samples(spark, sf_dir)
    cut = arrays.time_slice(F.col("samples"), (F.col("vec_id") % 5) * 0.75, (F.col("vec_id") % 5) * 0.75 + 2.0 + (F.col("vec_id") % 7) * 3, 4)
    return s.select("vec_id", F.size(cut).cast("long").alias("n"), F.round(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query
def label_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of turns: word lengths, padded to the longest turn of the conversation with -1, masked and unmasked again."""
    t = views.table(spark, sf_dir, "conversations").select(*KEYS, F.transform(views.words(F.col("text")), lambda w: F.length(w)).alias("ids"))
    t = t.withColumn("most", F.max(F.size("ids")).over(Window.partitionBy("conv_id")))
    masked = arrays.mask(arrays.pad(F.col("ids"), F.col("most"), -1), -1)
    show = lambda c: F.array_join(c.cast("array<string>"), ",")
    return t.select("conv_id", "turn", show(masked).alias("masked"), show(arrays.unmask(masked, -1)).alias("unmasked"))


@query
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_split(views.seg(spark, sf_dir)).select("recording_id", "segment_idx", "split")


@query
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments.dataset_stats(split.group_split(views.seg(spark, sf_dir)), ["split"])
    return s.select("split", "n", *[F.round(c, 5).alias(c) for c in s.columns[2:]])


@query
def utterance_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEYS, F.col("ref_words").cast("long").alias("ref_words"), F.col("hyp_words").cast("long").alias("hyp_words"), F.col("edits").cast("long").alias("edits"), F.round("wer", 6).alias("wer"))


@query
def corpus_wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.corpus(_scored(spark, sf_dir), ["role"]).select("role", "n", "edits", "ref_words", F.round("wer", 6).alias("wer"))


@query
def raw_wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of composed texts that are not normalised."""
    scored = scoring.score(views.pair(spark, sf_dir), compose=text.nfc_native, normalize=False)
    return scoring.corpus(scored, ["role"]).select("role", "n", "edits", "ref_words", F.round("wer", 6).alias("wer"))


@query
def wer_by_model_and_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models, one of which leaves out every word's last letter; two datasets, and one that is not there."""
    pairs = views.pair(spark, sf_dir)
    short = pairs.withColumn("hypothesis", F.regexp_replace("reference", r"\S(?= |$)", ""))
    scored = {m: scoring.score(p, compose=text.nfc_native) for m, p in (("misheard", pairs), ("short", short))}
    runs = [(m, d, None if d == "absent" else s.where(F.col("role") == d)) for m, s in scored.items() for d in ("user", "absent", "assistant")]
    return scoring.model_table(runs).select("place", "model", "dataset", "n", "edits", "ref_words", F.round("wer", 6).alias("wer"))


@query
def head_of_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 turns: evaluating part of a dataset is the feature."""
    return scoring.head(views.table(spark, sf_dir, "conversations"), KEYS, 50).select(*KEYS, "role")


@query
def document_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro average over whole documents, by source."""
    s = scoring.score(views.docpair(spark, sf_dir), compose=text.nfc_native, long_texts=True)
    return scoring.corpus(s, ["source"]).select("source", "n", "edits", "ref_words", F.round("wer", 6).alias("wer"))


@query
def wer_mean_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.macro(_scored(spark, sf_dir), by=["role"]).select("role", "n", *[F.round(c, 6).alias(c) for c in ("mean_wer", "median_wer", "upper_median_wer")])


@query
def wer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.histogram(_scored(spark, sf_dir)).select(F.col("bin").cast("long").alias("bin"), "low", "n")


@query
def worst_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = scoring.worst(_scored(spark, sf_dir), KEYS)
    return w.select(*KEYS, F.round("wer", 6).alias("wer"), "hypothesis")


@query
def head_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scoring.batches(views.table(spark, sf_dir, "conversations").select(*KEYS), KEYS)
    return t.groupBy("batch").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


@query
def repetition_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "conversations").select(*KEYS, text.tokens(F.col("text")).alias("w"))
    best = text.most_frequent(F.col("w"))
    return rows.select(*KEYS, text.most_repeats(F.col("w")).cast("long").alias("most"), (text.most_repeats(F.col("w")) >= lx.CLASSIFY_REPEATS).alias("loop"), best["word"].alias("word"))


@query
def collapse_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints, and turns whose third word is said six times over."""
    w = views.words(F.col("text"))
    said = F.concat(F.slice(w, 1, 2), F.array_repeat(F.coalesce(F.get(w, F.lit(2)), F.lit("om")), 6), F.slice(w, 4, 1 << 30))
    turns = views.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), F.array_join(said, " ").alias("text"))
    mine = views.hints(spark).select(F.col("id").cast("long").alias("id"), F.array_join(text.tokens(F.col("text")), " ").alias("text")).unionByName(turns)
    return mine.select("id", text.collapse_repeats(F.col("text")).alias("collapsed"))


@query
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(_scored(spark, sf_dir), KEYS).select(*KEYS, "stratum", F.round("wer", 6).alias("wer"))


@query
def filled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.filled(_scored(spark, sf_dir), KEYS, 60).select(*KEYS, "stratum")


@query
def sampling_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.metadata(_scored(spark, sf_dir), KEYS, 60)


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = errors.align(_scored(spark, sf_dir))
    kind = errors.category(F.col("ref_norm"), F.col("hyp_norm"), F.col("word_errors"), casual=["the", "of"], function_words=["and", "is", "it", "to"], fillers=["uh"])
    return rows.where("wer > 0").withColumn("category", kind)


@query
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = errors.align(_scored(spark, sf_dir)).select(*KEYS, F.posexplode("word_errors").alias("place", "e"))
    return e.select(*KEYS, "place", "e.type", "e.ref", "e.hyp", "e.ref_pos", "e.hyp_pos")


@query
def error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _aligned(spark, sf_dir)
    return a.select(*KEYS, "category", errors.reason(F.col("hyp_norm"), F.col("word_errors"), F.col("category")).alias("reason"))


@query
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.shares(_aligned(spark, sf_dir))


@query
def category_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.examples(_aligned(spark, sf_dir), ["wer", *KEYS]).select("category", "place", *KEYS)


@query
def category_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.advice(_aligned(spark, sf_dir))


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"casual": [*lx.CASUAL_MARKERS, "the", "of"], "function_words": [*lx.FUNCTION_WORDS, "and", "is", "it", "to"], "fillers": lx.INSERTED_FILLERS}
    rows = views.noted(spark, sf_dir).where("wer > 0")
    return rows.withColumn("category", errors.category(F.col("ref_norm"), F.col("hyp_norm"), F.col("word_errors"), **lists))


def _why() -> Column:
    return errors.reason(F.col("hyp_norm"), F.col("word_errors"), F.col("category")).alias("reason")


@query
def noted_error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and reason of turns whose errors are known by place, apart from the alignment."""
    return _noted(spark, sf_dir).select(*KEYS, "category", _why())


@query
def noted_category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.shares(_noted(spark, sf_dir)).select("category", "n", F.round("share_pct", 6).alias("share_pct"))


@query
def noted_category_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = errors.examples(_noted(spark, sf_dir), ["wer", *KEYS])
    return shown.select("category", F.col("place").cast("long").alias("place"), *KEYS, F.col("ref_norm").alias("reference"), F.col("hyp_norm").alias("hypothesis"), F.round("wer", 6).alias("wer"), _why())


@query
def noted_category_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.advice(_noted(spark, sf_dir))


@query
def block_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback rate: words of the longer side of each unequal span, a reference word."""
    return views.noted(spark, sf_dir).select(*KEYS, F.round("wer", 6).alias("wer"))


@query
def substitution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words of turns that were heard as others, and of literal substitutions; Roman letters keep some out."""
    return repair.substitution_pairs(views.misheard(spark, sf_dir))


@query
def repair_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.merge(views.seed(spark), repair.mine(repair.substitution_pairs(views.misheard(spark, sf_dir))))


def _repairs(spark: SparkSession) -> DataFrame:
    rows = [("thex", "the", "seed"), ("ofx", "of", "seed"), ("andx", "or", "mined"), ("isx", "is", "seed")]
    return spark.createDataFrame(rows, "hyp string, ref string, source string")


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.evaluate(views.pair(spark, sf_dir), repair.as_literal(_repairs(spark)), text.nfc_native)


@query
def apply_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undoes the x that misheard words end in, for short words."""
    e = _repaired(spark, sf_dir)
    return e.select(*KEYS, "fixed", F.round("wer_before", 6).alias("wer_before"), F.round("wer_after", 6).alias("wer_after"), "outcome")


@query
def repair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = repair.summary(_repaired(spark, sf_dir))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean_before", "mean_after", "median_before", "median_after")], "improved", "unchanged", "regressed")


@query
def improved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.improved(_repaired(spark, sf_dir), KEYS).select(*KEYS, "before", "after", "wer_before", "wer_after")


@query
def fix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(_repaired(spark, sf_dir), _repairs(spark))


@query
def normalise_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.spoken(spark, sf_dir).select(*KEYS, numbers.normalise(F.col("hypothesis"))["text"].alias("digits"))


@query
def number_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.spoken(spark, sf_dir).select(*KEYS, F.posexplode(numbers.normalise(F.col("hypothesis"))["conversions"]).alias("nth", "c"))
    return c.select(*KEYS, F.col("nth").cast("long").alias("nth"), "c.original", "c.converted", "c.value", "c.is_idiom", F.col("c.position").cast("long").alias("position"))


@query
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of three number words for each word of a turn: a unit or ten, a multiplier, a unit or ten, chosen by place and length."""
    units, times = [*lx.UNITS, *lx.TENS], [*lx.MULTIPLIERS]
    pick = lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), (at % len(names)).cast("int"))
    n, k = F.length("w"), F.col("conv_id")
    rows = views.table(spark, sf_dir, "conversations").select(*KEYS, F.posexplode(views.words(F.col("text"))).alias("i", "w"))
    said = rows.select(*KEYS, F.col("i").cast("long").alias("i"), F.array(pick(units, F.col("i") * 7 + n), pick(times, F.col("i") + k), pick(units, F.col("i") + n * 3)).alias("said"))
    return said.select(*KEYS, "i", F.array_join("said", " ").alias("words"), numbers.span_value(F.col("said")).alias("value"))


@query
def loanword_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loanwords.tag(F.col("hypothesis"))
    return views.spoken(spark, sf_dir).select(*KEYS, t["text"].alias("tagged"), t["n"].cast("long").alias("n"))


@query
def loanword_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loanwords.tag(F.col("reference"))
    return views.spoken(spark, sf_dir).select(*KEYS, F.array_join(t["words"], ",").alias("words"))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.run(views.spoken(spark, sf_dir), text.nfc_native)


@query
def cleanup_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select(*KEYS, F.col("tags.text").alias("tagged"), "wer_before", "wer_hyp_only", "wer_both", "delta_naive", "delta_correct")


@query
def cleanup_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cleanup.results(_cleaned(spark, sf_dir), KEYS)
    return r.select(*KEYS, "raw_asr", "number_normalised", "final_tagged", F.array_join("english_words_detected", ",").alias("english_words"), "english_count", "wer_before", "wer_hyp_only", "wer_both_normalised", "wer_delta_naive", "wer_delta_correct")


@query
def idiom_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cleanup.edge_cases(_cleaned(spark, sf_dir), KEYS)
    return e.select(*KEYS, "raw", "digits", F.array_join("idioms", ",").alias("idioms"))


@query
def number_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.outcomes(_cleaned(spark, sf_dir))


@query
def url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", text.rewrite_prefix(F.col("url"), "http://", "https://").alias("url"))


@query
def unpivot_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("recording_id"), F.col("url").alias("rec_url_gcp"), F.concat("url", F.lit(".json")).alias("transcription_url_gcp"))
    return readers.assets(sheet, "http://", "https://")


@query
def download_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.tally(views.table(spark, sf_dir, "pages"), F.startswith(F.col("url"), F.lit("https://")))


@query
def download_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    return readers.failures(pages, ["page_id"], F.startswith(F.col("url"), F.lit("https://")) & (F.col("page_id") % 3 > 0)).select("page_id", "url")


@query
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text begins with a title-case word, and how many of its words are such."""
    rows = views.table(spark, sf_dir, "documents").select("doc_id", views.words(F.col("text")).alias("w"))
    named = F.size(F.filter("w", text.is_title)).cast("long")
    return rows.select("doc_id", F.coalesce(text.is_title(F.get("w", F.lit(0))), F.lit(False)).alias("title"), named.alias("n_title"))


@query
def fixed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with two to four places: eighths and sixteenths, of which many are ties, and hundredths that binary numbers only come near."""
    n = F.col("n_chars")
    shown = {"eighths": text.fixed(n / 8.0, 2), "cents": text.fixed(n * 0.005, 2), "small": text.fixed(n / 160000.0, 4), "below": text.fixed(-n / 16.0, 3)}
    return views.table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in shown.items()])


@query
def segment_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept segments written as WAVE files and read back: size, checksum and number of samples of each."""
    made = segments.build(views.recordings(spark, sf_dir), views.transcripts(spark, sf_dir), "latin", views.RATE)
    files = stored(writers.audio_rows(made, views.RATE), "segment-audio")
    read = audio.decoded(files, ["recording_id", "segment_idx", "audio_path", "content"], views.RATE)
    size = F.octet_length("content").cast("long").alias("n_bytes")
    return read.select("recording_id", F.col("segment_idx").cast("long").alias("segment_idx"), "audio_path", size, F.sha2("content", 256).alias("sha256"), F.size("samples").cast("long").alias("n_samples"), "error")


def _file(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all machines share."""
    return f"{shared_dir(spark)}/lekhya/{name}-{uuid.uuid4().hex}"


@query
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the kept segments, written as JSON lines and read back."""
    made = segments.build(views.recordings(spark, sf_dir), views.transcripts(spark, sf_dir), "latin", views.RATE)
    path = _file(spark, "manifest")
    writers.manifest(writers.manifest_rows(made), path)
    return readers.manifest(spark, path).withColumn("segment_idx", F.col("segment_idx").cast("long"))


@query
def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in the shape of a speech dataset, written by split and read back; its text is found by the name of its column."""
    rows = split.group_split(views.seg(spark, sf_dir)).withColumn("audio_path", writers.audio_path("segments"))
    path = _file(spark, "dataset")
    writers.dataset(readers.dataset_columns(rows, ["split"]), path)
    got = readers.dataset(spark, path)
    return got.select("split", "recording_id", F.col("audio.path").alias("path"), F.col("audio.sampling_rate").cast("long").alias("rate"), F.length(readers.text_column(got)).cast("long").alias("n_chars"), "duration")


@query
def wer_table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by role, as two models, written as CSV in percent and read back."""
    scored = views.noted(spark, sf_dir).select(F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("model"), F.size("word_errors").alias("edits"), "ref_words")
    table = scoring.corpus(scored, ["model"]).withColumn("dataset", F.lit("turns"))
    path = _file(spark, "wer-table")
    writers.wer_table(table, path)
    return spark.read.csv(path, header=True).select("Model", "Dataset", F.col("WER (%)").alias("percent"))


@query
def error_sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their errors as error samples, written as JSON lines and read back."""
    rows = views.noted(spark, sf_dir).where("wer > 0")
    samples = rows.select(F.col("conv_id").alias("recording_id"), F.col("turn").cast("int").alias("segment_idx"), F.col("ref_norm").alias("reference"), F.col("hyp_norm").alias("hypothesis"), "wer", (F.length("ref_norm") / 16.0).alias("duration"), (F.col("conv_id") % 7).alias("speaker_id"), "word_errors")
    path = _file(spark, "error-samples")
    writers.error_samples(samples, path)
    got = readers.error_samples(spark, path)
    first = F.get("word_errors", F.lit(0))
    return got.select("recording_id", F.col("segment_idx").cast("long").alias("segment_idx"), "reference", "hypothesis", "wer", "duration", "speaker_id", F.size("word_errors").cast("long").alias("n_errors"), first["type"].alias("first_type"), first["ref"].alias("first_ref"), first["hyp"].alias("first_hyp"))


@query
def catalogue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a sheet of recordings, written as CSV and read back, to the assets that are to be fetched."""
    pages = views.table(spark, sf_dir, "pages")
    missing = F.lit(None).cast("string")
    sheet = pages.select((F.col("page_id") % 9).alias("user_id"), F.col("page_id").alias("recording_id"), F.lit("hi").alias("language"), (F.col("page_id") / 8.0).alias("duration"), F.col("url").alias("rec_url_gcp"), F.concat("url", F.lit(".json")).alias("transcription_url_gcp"), missing.alias("metadata_url_gcp"))
    path = _file(spark, "sheet")
    sheet.write.csv(path, header=True)
    read = readers.catalogue(spark, path)
    there = read.where("recording_id % 3 = 0").select("recording_id", F.lit("audio").alias("kind"), (F.col("duration") * 8).cast("long").alias("length"))
    return readers.missing(readers.assets(read, "http://", "https://"), there, ["recording_id", "kind"])


@query
def checkpoint_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of checkpoints numbered by documents."""
    paths = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("runs/checkpoint-"), F.when(F.col("doc_id") % 5 == 0, "draft").otherwise(F.col("doc_id").cast("string"))).alias("path"))
    return readers.choose_checkpoint(paths)
