"""Test views over the driver's tables, and literal rows in Devanagari."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import wer
from lekhya.functions.once import once

WORDS = r"[ \n\t\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task gets: a turn costs some milliseconds, so a task takes seconds, however large the table is.
ROWS_A_TASK = 2_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, dealt by keys to a task for ROWS_A_TASK of them, and no fewer than there are cores.

    How many partitions a file arrives in says nothing of their rows: a row group, of any number
    of rows, is read by one task, and splits that hold no row group's middle are empty.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // ROWS_A_TASK)), *keys)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORDS), lambda w: w != "")


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments from conversations."""
    c = table(spark, sf_dir, "conversations")
    out = c.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("segment_idx"), F.col("role").alias("speaker_id"), "text", (F.col("turn") * 31.0).alias("start"), (F.lit(0.5) + ((F.length("text") * 37) % 311) / 10.0).alias("duration"))
    return out.withColumn("end", F.col("start") + F.col("duration"))


def _pairs(rows: DataFrame, key: Column) -> DataFrame:
    ref = words(F.col("text"))

    def heard(w: Column, i: Column) -> Column:
        return (
            F.when(key % 10 == 0, F.array(w)).when(key % 10 == 9, F.array(F.concat(w, F.lit("x")), F.lit("uh"), F.lit("uh"))).when(i % 11 == 5, F.lit([]).cast("array<string>"))
            .when(i % (2 + key % 10) == 1, F.array(F.concat(w, F.lit("x")))).when(i % 13 == 6, F.array(w, F.lit("uh"))).otherwise(F.array(w))
        )

    out = once(once(rows, r=ref), h=F.flatten(F.transform("r", heard)))
    return out.withColumns({"reference": F.array_join("r", " "), "hypothesis": F.array_join("h", " ")}).drop("r", "h", "text")


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, reference, hypothesis): turns and a misheard copy of known errors."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    return _pairs(c, F.col("conv_id"))


def docpair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, reference, hypothesis) of documents."""
    return _pairs(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"), F.col("doc_id"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, samples): embeddings as audio."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"))


#: Samples a second of recordings().
RATE = 2


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, samples): embeddings as recordings of RATE samples a second; one in four is near silent."""
    faint = F.when(F.col("vec_id") % 4 == 1, 0.001).otherwise(1.0)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("recording_id"), F.transform("embedding", lambda x: x * faint).alias("samples"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, segments): conversations, a turn every four seconds; one in five has none."""
    start = F.col("turn") * 4.0
    s = table(spark, sf_dir, "conversations").where("conv_id % 5 <> 2").select("conv_id", F.struct(start.alias("start"), (start + 0.5 + ((F.length("text") * 37) % 311) / 10.0).alias("end"), "text", F.col("turn").alias("speaker_id")).alias("s"))
    return s.groupBy(F.col("conv_id").alias("recording_id")).agg(F.array_sort(F.collect_list("s")).alias("segments"))


#: Words that stand for the words of turns in spoken(): numbers, a fraction, parts of idioms, loanwords bare and inflected, marks, others.
SPOKEN = ["एक", "दो", "चौवन", "सौ", "हज़ार", "लाख", "साढ़े", "बार", "मिनट", "स्कूलों", "पच्चीस।", "(टॉपिक)", "वाले", "ग्यारह", "दस-बीस", "कम्प्यूटरिंग"]


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, reference, hypothesis): turns with three words in four of SPOKEN, chosen by place, conversation and length; of the hypothesis one in six is the next of the list."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", words(F.col("text")).alias("w"))
    known = F.array(*[F.lit(x) for x in SPOKEN])

    def said(w: Column, i: Column, shift: Column) -> Column:
        place = (i * i + F.col("conv_id") * 3 + F.length(w) + shift) % len(SPOKEN)
        return F.when((i * 5 + F.col("conv_id") + F.length(w)) % 4 == 0, w).otherwise(F.get(known, place.cast("int")))

    ref = F.transform("w", lambda w, i: said(w, i, F.lit(0)))
    hyp = F.transform("w", lambda w, i: said(w, i, ((i + F.col("conv_id")) % 6 == 0).cast("int")))
    return c.select("conv_id", "turn", F.array_join(ref, " ").alias("reference"), F.array_join(hyp, " ").alias("hypothesis"))


#: Short texts for script tests, fillers and loops: id, text.
HINTS = [
    (1, "हाँ।"), (2, "जी"), (3, " uh "), (4, "।।"), (5, ""), (6, "मुझे जॉब मिल गई है"), (7, "मेरे पास ५ किताबें हैं"), (8, "हाँ हाँ हाँ हाँ हाँ हाँ घर"),
    (9, "हाँ घर हाँ घर हाँ घर हाँ घर हाँ घर"), (10, "कल meeting है"), (11, "ठीक है।।. "), (12, "hello World"), (13, "Hello World"), (14, "नही\u00a0 वो  आया"), (15, "na na na na na na na na"), (16, "123 !"),
]


def hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HINTS, "id int, text string")


#: Words that stand for some words of the references of noted().
NOTED = ["है", "का", "यार", "मतलब", "घर", "मीटिंग", "को", "बात"]


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, ref_norm, hyp_norm, ref_words, word_errors, wer): turns of which it is known, word by word, what was misheard.

    Some words of NOTED stand in the reference, and a digit in one conversation of eleven. By
    place, conversation and length a word is switched to the other script, taken for a casual one,
    misspelt, left out, or followed by a filler; one conversation in thirteen ends in a loop.
    """
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", words(F.col("text")).alias("w"))
    k = F.col("conv_id")
    known = F.array(*[F.lit(x) for x in NOTED])

    def said(w: Column, i: Column) -> Column:
        other = F.when((i + k) % 7 == 3, F.get(known, ((i * i + F.length(w)) % len(NOTED)).cast("int"))).otherwise(w)
        return F.when((k % 11 == 3) & (i == 0), F.concat(w, F.lit("5"))).otherwise(other)

    def error(kind: str, ref: Column, hyp: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), ref.alias("ref"), hyp.alias("hyp"), at.cast("int").alias("ref_pos"), F.lit(None).cast("int").alias("hyp_pos"))

    def heard(w: Column, i: Column) -> Column:
        rule, turn = (i * 7 + k + F.length(w)) % 19, k % 4
        swapped = F.when(w.rlike("[\\u0900-\\u097F]"), "meeting").otherwise("मीटिंग")
        sub = lambda x: F.struct(F.array(x).alias("h"), F.array(error("substitution", w, x, i)).alias("e"))
        after = lambda x: F.struct(F.array(w, F.lit(x)).alias("h"), F.array(error("insertion", F.lit(""), F.lit(x), F.lit(None))).alias("e"))
        gone = F.struct(F.array().cast("array<string>").alias("h"), F.array(error("deletion", w, F.lit(""), i)).alias("e"))
        same = F.struct(F.array(w).alias("h"), F.filter(F.array(error("", w, w, i)), lambda e: F.lit(False)).alias("e"))
        return (
            F.when((rule == 0) & (turn == 0), sub(swapped)).when((rule == 1) & (turn == 1), sub(F.lit("यार"))).when((rule == 2) & (turn <= 2), sub(F.concat(w, F.lit("x"))))
            .when((rule == 3) & (turn >= 1), gone).when((rule == 4) & (turn >= 2), after("uh")).when((rule == 5) & (turn == 3), after("अच्छा")).otherwise(same)
        )

    out = once(once(c, r=F.transform("w", said)), p=F.transform("r", heard))
    loop = F.when(k % 13 == 6, 8).otherwise(0)
    extra = F.array_repeat(error("insertion", F.lit(""), F.lit("ना"), F.lit(None)), loop)
    out = once(out, h=F.concat(F.flatten(F.col("p.h")), F.array_repeat(F.lit("ना"), loop)), word_errors=F.concat(F.flatten(F.col("p.e")), extra), ref_words=F.size("r"))
    return out.select("conv_id", "turn", F.array_join("r", " ").alias("ref_norm"), F.array_join("h", " ").alias("hyp_norm"), "ref_words", "word_errors", wer.block_wer(F.col("word_errors"), F.col("ref_words")).alias("wer"))


#: Substitutions for the repair map: hyp, ref, times seen.
SUBSTITUTIONS = [("गर", "घर", 3), ("गर", "गार", 1), ("थादे", "ढाबे", 2), ("मेरे", "मेरा", 4), ("मेरे", "तेरे", 4), ("अते", "होते", 2), ("हैर", "है", 1), ("meeting", "मीटिंग", 5), ("वो", "वो", 9), ("", "कल", 3)]


def substitutions(spark: SparkSession) -> DataFrame:
    """word_errors rows, one of each time a substitution was seen."""
    rows = [(h, r) for h, r, n in SUBSTITUTIONS for _ in range(n)]
    df = spark.createDataFrame(rows, "hyp string, ref string")
    error = F.struct(F.lit("substitution").alias("type"), F.col("ref"), F.col("hyp"), F.lit(0).alias("ref_pos"), F.lit(0).alias("hyp_pos"))
    return df.select(F.array(error).alias("word_errors"))


def misheard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_errors rows: the words of spoken() that were heard as others, place by place, and the literal substitutions."""
    rows = spoken(spark, sf_dir).select(words(F.col("reference")).alias("r"), words(F.col("hypothesis")).alias("h"))
    both = F.zip_with("r", "h", lambda r, h: F.struct(F.lit("substitution").alias("type"), r.alias("ref"), h.alias("hyp"), F.lit(0).alias("ref_pos"), F.lit(0).alias("hyp_pos")))
    own = rows.select(F.filter(both, lambda e: e["ref"] != e["hyp"]).alias("word_errors"))
    return own.unionByName(substitutions(spark))


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(lx.REPAIR_SEED.items()), "hyp string, ref string")
