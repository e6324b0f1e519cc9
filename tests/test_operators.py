from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lekhya import lexicon as lx
from lekhya.functions import text, wer
from lekhya.operators import cleanup, errors, loanwords, numbers, order, repair, sampling, scoring, segments, split
from lekhya.plans import views
from lekhya.sources import readers, writers


def test_cleanup_of_sentences(spark):
    rows = [
        ("मीटिंग में पच्चीस लोग थे", "मीटिंग में पच्चीस लोग थे", "[EN]मीटिंग[/EN] में 25 लोग थे", 0.0, 0.2, 0.0),
        ("घर में एक बार आना", "घर में एक बार आना", "घर में एक बार आना", 0.0, 0.0, 0.0),
        ("दो हज़ार बीस", "दो हज़ार तीस", "2030", 0.3333, 1.0, 1.0),
    ]
    got = {r.reference: r for r in cleanup.run(spark.createDataFrame([x[:2] for x in rows], "reference string, hypothesis string")).collect()}
    for ref, _, tagged, before, half, both in rows:
        r = got[ref]
        assert (r.tags.text, r.wer_before, r.wer_hyp_only, r.wer_both) == (tagged, before, half, both)
    counts = cleanup.outcomes(cleanup.run(spark.createDataFrame([x[:2] for x in rows], "reference string, hypothesis string"))).collect()
    assert {r.outcome: r.n for r in counts} == {"unchanged": 1, "regressed": 1}


def test_numbers_that_64_bits_cannot_hold_stay_words(spark):
    said = " ".join(["एक"] + ["सौ"] * 12)
    assert spark.createDataFrame([(said,)], "t string").select(numbers.normalise(F.col("t"))["text"].alias("x")).first().x == said


def test_edits_of_many_distinct_words(spark):
    rng = random.Random(3)
    ref = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    hyp = ref[5:700] + ["x"] * 3 + ref[702:]
    df = spark.createDataFrame([(ref, hyp), (ref, ref[::-1]), ([], ["a"])], "r array<string>, h array<string>")
    got = [r.e for r in df.select(wer.word_edits(F.col("r"), F.col("h")).alias("e")).collect()]
    assert got[0] == 8 and got[1] >= 2990 and got[2] == 1
    text = spark.range(1).select(wer._spelled(F.sequence(F.lit(0), F.lit(70_000))).alias("c")).first().c
    assert len(text) == len(set(text)) == 70_001


def test_edits_of_very_long_texts(spark):
    """100,000 words with 40 edits: planted ones are 40 at most, and none fewer, as each changes a word that occurs once."""
    rng = random.Random(4)
    ref = [f"w{i}" for i in range(100_000)]
    at = rng.sample(range(0, 100_000, 50), 40)
    hyp = [w for i, w in enumerate(ref) for w in ([w + "x"] if i in at[:20] else [] if i in at[20:30] else [w, "uh"] if i in at[30:] else [w])]
    df = spark.createDataFrame([(" ".join(ref), " ".join(hyp)), ("a b", "a c"), ("", "a"), ("a", None)], "reference string, hypothesis string")
    began = time.time()
    assert [r.edits for r in scoring.score(df, long_texts=True).collect()] == [40, 1, 1, None] and time.time() - began < 30


def test_edits_of_long_texts_agree(spark, monkeypatch):
    """The Arrow function against the JVM, short pairs and long ones, few edits and many."""
    rng = random.Random(5)
    rows = []
    for n in (0, 1, 5, 30, 200, 700):
        for share in (0.01, 0.3, 0.9):
            ref = [f"w{rng.randrange(1 + n // rng.choice([2, 20]))}" for _ in range(n)]
            rows.append((" ".join(ref), " ".join(rng.choice([w, "x", "", w + " y"]) if rng.random() < share else w for w in ref)))
    df = spark.createDataFrame(rows, "reference string, hypothesis string")
    plain = [r.edits for r in scoring.score(df).collect()]
    monkeypatch.setattr(scoring, "LONG", 0)
    assert [r.edits for r in scoring.score(df, long_texts=True).collect()] == plain


def test_repeats(spark):
    df = spark.createDataFrame([("a b a c a d a e a".split(),), ("a a a a".split(),), ([],)], "w array<string>")
    assert [tuple(r) for r in df.select(text.repeats(F.col("w"), 5), text.repeats(F.col("w"), 4), text.repeats(F.col("w"), 1)).collect()] == [(True, True, True), (False, True, True), (False, False, False)]


@pytest.mark.parametrize(("said", "written"), [
    ("एक लाख पचास हज़ार, रुपए", "150000, रुपए"), ("शून्य", "शून्य"), ("सौ", "100"), ("दो तीन", "दो तीन"), ("पाँच छह", "11"), ("सवा एक लाख और दो", "सवा एक लाख और 2"),
    ("'तीन' सौ।", "300।"), ("13 लोग", "13 लोग"), ("", ""), ("एक बार पाँच लोग", "एक बार पाँच लोग"), ("नौ दो ग्यारह हो गया और फिर से वे पाँच आए", "नौ दो ग्यारह हो गया और फिर से वे 5 आए"), ("करोड़ दो हज़ार तीन", "10002003"),
])
def test_numbers(spark, said, written):
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(numbers.normalise(F.col("t"))["text"]).first()[0] == written


def test_tags_keep_marks(spark):
    df = spark.createDataFrame([("(मोबाइल) \"जॉब,\" स्कूलों नहीं mobile -टेस्ट-",)], "t string").select(loanwords.tag(F.col("t")).alias("r"))
    r = df.first().r
    assert r.text == "([EN]मोबाइल[/EN]) \"[EN]जॉब[/EN],\" [EN]स्कूलों[/EN] नहीं mobile -[EN]टेस्ट[/EN]-" and r.positions == [0, 1, 2, 5] and r.n == 4


def test_segments(spark):
    loud, quiet = [0.1] * 16_000 * 40, [0.0] * 16_000 * 40
    cases = [(0.0, 0.9, "ठीक है मैं", "too_short"), (0.0, 1.0, "ठीक है मैं", None), (0.0, 30.0, "ठीक है मैं " * 9, None), (0.0, 30.1, "ठीक", "too_long"), (0.0, 2.0, "।।", "punctuation_only"), (0.0, 2.0, "हाँ।", "filler_word"), (0.0, 2.0, "hello there now", "insufficient_letters"), (0.0, 9.0, "बिल्कुल ठीक", "sparse_wps")]
    rec = spark.createDataFrame([(1, loud), (2, quiet), (3, loud)], "recording_id long, samples array<float>")
    rows = [(1, [{"start": a, "end": b, "text": t, "speaker_id": None} for a, b, t, _ in cases]), (2, [{"start": 0.0, "end": 2.0, "text": "ठीक है मैं", "speaker_id": 5}])]
    tr = spark.createDataFrame(rows, f"recording_id long, segments {readers.SEGMENTS}")
    marked = segments.build(rec, tr)
    got = {(r.recording_id, r.segment_idx): r for r in marked.collect()}
    assert [got[1, i].skip_reason for i in range(len(cases))] == [w for *_, w in cases] and got[2, 0].skip_reason == "near_silent" and len(got) == 9
    assert got[1, 1].duration == 1.0
    stats = segments.filter_stats(marked).first()
    assert (stats.n_before, stats.n_after, stats.kept_seconds) == (9, 2, 31.0)
    assert segments.filter_stats(marked.limit(0)).first().retention_pct == 0.0
    assert {r.skip_reason: r.n for r in segments.reason_tally(marked).collect()}["too_short"] == 1


def test_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(i % 57, i) for i in range(500)], "recording_id long, x int")
    got = split.group_split(df).groupBy("recording_id").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r.s) == 1 for r in got) and sum(r.s == ["val"] for r in got) == 6
    assert split.group_split(df, fraction=0.0).where("split = 'val'").count() == 0 and split.group_split(df, fraction=1.0).where("split = 'train'").count() == 0
    old, split.FEW = split.FEW, 3
    try:
        assert {tuple(r) for r in split.group_split(df).collect()} == {(r.recording_id, r.x, r.split) for r in split.group_split(df).collect()}
        assert split.group_split(df).where("split = 'val'").select("recording_id").distinct().count() == 6
    finally:
        split.FEW = old


def test_row_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, 0.5, rng.random()]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, k int").repartition(5)
    got = {r.k: (r.row_no, r.group_rows) for r in order.number_rows(df, ["v", "k"], ["g"]).collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [(i, len(own)) for i in range(len(own))]


def test_no_range_holds_a_popular_value_alone(spark):
    """Nine rows in ten share one rate, and half of those a key: no range has over twice its share."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 20_000, 1, 8).selectExpr("if(id % 10 = 0, id / 20000, 1.0) as wer", "if(id % 2 = 0, 7, id) as k")
        sizes = [r["count"] for r in order.ranged(df, ["wer", "k"]).groupBy("_range").count().collect()]
        assert len(sizes) == 16 and max(sizes) <= 2 * 20_000 / 16
        assert sorted(r.row_no for r in order.number_rows(df, ["wer", "k"]).collect()) == list(range(20_000))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sampling_counts_of_a_known_run(spark):
    """Pools of 2, 343 and 40 errors give steps 1, 34 and 4 and draws 2, 10 and 10; three more fill 25."""
    rates = [0.0] + [0.1 + i / 100 for i in range(2)] + [0.3 + i * 0.7 / 342 for i in range(343)] + [1.1 + i / 10 for i in range(40)]
    df = spark.createDataFrame([(i, 0, float(w)) for i, w in enumerate(rates)], "conv_id long, turn long, wer double")
    got = {r.stratum: (r.pool, r.step, r.sampled) for r in sampling.metadata(df, ["conv_id", "turn"]).collect()}
    assert got == {"low": (2, 1, 2), "medium": (343, 34, 10), "high": (40, 4, 10), "fill": (363, 121, 3)}


def classified(spark, rows):
    schema = "reference string, hypothesis string"
    df = errors.align(scoring.score(spark.createDataFrame(rows, schema)))
    df = df.withColumn("category", errors.category(F.col("ref_norm"), F.col("hyp_norm"), F.col("word_errors")))
    return df.withColumn("why", errors.reason(F.col("hyp_norm"), F.col("word_errors"), F.col("category")))


def test_categories(spark):
    rows = [("घर", "हाँ " * 8, "repetition_loop"), ("मेरे 5 घर", "मेरे घर", "number_quantifier"), ("मीटिंग थी", "meeting थी", "code_switching"), ("मुझको दो", "मेको दो", "casual_colloquial"), ("X Ram गया", "X Shyam गया", "proper_nouns"), ("वह घर है", "वह घर", "deletion_function_words"), ("घर गया", "घर uh गया", "insertion_noise"), ("कमल खिला", "कलम खिला", "other"), ("बड़ा मकान देखा", "बड़ा देखा", "other")]
    got = classified(spark, [r[:2] for r in rows]).select("reference", "category", "why").collect()
    assert {r.reference: r.category for r in got} == {r[0]: r[2] for r in rows} and all(r.why for r in got)
    share = {r.category: r.share_pct for r in errors.shares(classified(spark, [r[:2] for r in rows])).collect()}
    assert share["other"] == pytest.approx(200 / 9) and sum(share.values()) == pytest.approx(100)
    assert [r.category for r in errors.advice(classified(spark, [r[:2] for r in rows])).collect()] == ["other", "repetition_loop", "code_switching"]


def test_repair(spark):
    pairs = repair.substitution_pairs(views.substitutions(spark))
    assert {r.hyp: r.ref for r in repair.mine(pairs).collect()} == {"गर": "घर", "थादे": "ढाबे", "मेरे": "तेरे", "अते": "होते"}
    merged = repair.merge(views.seed(spark), repair.mine(pairs))
    assert merged.count() == len(set(lx.REPAIR_SEED) | {"मेरे", "अते"})
    table = repair.as_literal(merged)
    rows = [("घर चलो", "गर चलो"), ("घर,", "गर,"), ("ना ना", "ना ना ना ना ना ना"), ("हर दिन", "है दिन"), ("है दिन", "हैर दिन"), ("", "गर"), ("क", "")]
    df = spark.createDataFrame(rows, "reference string, hypothesis string")
    got = {(r.reference, r.hypothesis): r for r in repair.evaluate(df, table).collect()}
    assert [got[k].outcome for k in rows] == ["improved", "improved", "improved", "unchanged", "regressed" if got[rows[4]].wer_after > got[rows[4]].wer_before else "unchanged_wer", "unchanged_wer", "unchanged"]
    assert got[rows[1]].fixed == "घर," and got[rows[2]].fixed == "ना"
    joined = repair.fix_joined(scoring.score(df).withColumn("k", F.monotonically_increasing_id()), merged, ["k"]).select("hypothesis", "fixed").collect()
    assert {r.hypothesis: r.fixed for r in joined}["गर,"] == "घर,"
    s = repair.summary(repair.evaluate(df, table)).first()
    assert s.n == 7 and s.improved == 3 and s.improved + s.unchanged + s.regressed == 7


def test_scoring(spark):
    rows = [("a b c d", "a x c d e", 0.5), ("", "a b", 0.0), ("a", "b c d", 3.0), ("a  b।", "a b", 0.0), ("a", "", 1.0)]
    df = scoring.score(spark.createDataFrame([(i, "r", *r[:2]) for i, r in enumerate(rows)], "k int, role string, reference string, hypothesis string"))
    assert [r.wer for r in df.orderBy("k").collect()] == [r[2] for r in rows]
    assert scoring.corpus(df).first().wer == pytest.approx(6 / 8) and scoring.corpus(df.limit(0)).first().wer == 0.0
    m = scoring.macro(df).first()
    assert (m.mean_wer, m.median_wer, m.upper_median_wer) == (pytest.approx(0.9), 0.5, 0.5)
    assert [r.n for r in scoring.histogram(df).orderBy("bin").collect()] == [2, 0, 1, 1, 1, 0]
    assert [r.k for r in scoring.worst(df, ["k"], 2).collect()] == [2, 4]
    assert {r.k: r.batch for r in scoring.batches(df.select("k"), ["k"], 2).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "17_transcription.json").write_text(json.dumps([{"start": 0.0, "end": 1.5, "text": "ठीक"}, {"start": 2, "end": 3, "text": "है", "speaker_id": 4}], ensure_ascii=False), encoding="utf-8")
    (folder / "17_audio.wav").write_bytes(b"RIFF")
    r = readers.transcripts(spark, f"{folder}/*.json").first()
    assert r.recording_id == 17 and r.segments[0].speaker_id is None and r.segments[1].speaker_id == 4
    assert readers.audio_listing(spark, str(folder)).select("recording_id", "length").first()[:] == (17, 4)
    rows = spark.createDataFrame([("p/1.wav", "क", 1, 1.5, None, 0)], readers.MANIFEST)
    writers.manifest(rows, str(tmp_path / "m"))
    assert readers.manifest(spark, str(tmp_path / "m")).collect() == rows.collect()
    assert readers.dataset_columns(rows).first().audio.sampling_rate == 16_000
    writers.wer_table(spark.createDataFrame([("tuned", "hi", 0.7329)], "model string, dataset string, wer double"), str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).first()[:] == ("tuned", "hi", "73.29")
    assert readers.dataset(spark, str(tmp_path / "none"), required=False) is None
    with pytest.raises(Exception):
        readers.dataset(spark, str(tmp_path / "none"))
    paths = spark.createDataFrame([("m/checkpoint-9",), ("m/checkpoint-10",), ("m/checkpoint-x",)], "path string")
    assert readers.choose_checkpoint(paths).first().path == "m/checkpoint-10"
    assert readers.choose_checkpoint(paths.union(spark.createDataFrame([("m/best",)], "path string"))).first().path == "m/best"
    assert readers.text_column(spark.createDataFrame([("a", "b")], "text string, transcription string")) == "transcription"
    with pytest.raises(KeyError):
        readers.text_column(paths)
    assert "| m/checkpoint-9 |" in writers.markdown(paths, "Paths")
    wanted = readers.assets(spark.createDataFrame([(1, "http://a", "http://b")], "recording_id long, rec_url_gcp string, transcription_url_gcp string"), "http:", "https:")
    assert sorted((r.kind, r.url) for r in wanted.collect()) == [("audio", "https://a"), ("transcript", "https://b")]
    there = spark.createDataFrame([(1, "audio", 4), (1, "transcript", 0)], "recording_id long, kind string, length long")
    assert [r.kind for r in readers.missing(wanted, there, ["recording_id", "kind"]).collect()] == ["transcript"]
    samples = spark.createDataFrame([(1, 2, "a", "b", 0.33333, 1.236, 7, [("substitution", "a", "b", 0, 0)])], readers.SAMPLES)
    writers.error_samples(samples, str(tmp_path / "e"))
    assert readers.error_samples(spark, str(tmp_path / "e")).first().wer == 0.3333


def test_streams_score_as_batches_do(spark, tmp_path):
    from lekhya.streaming.score import score_stream

    df = spark.createDataFrame([(1, "a b", "a c"), (2, "x", "x")], "k int, reference string, hypothesis string")
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    score_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.k: r.wer for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 0.5, 2: 0.0}


def test_text_module_is_native_but_for_one_function(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(text.normalize_for_wer(F.col("t"), text.nfc_native))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_segments_of_every_fate(spark, tmp_path):
    loud, faint = [0.1] * 40, [0.0001] * 40
    recordings = spark.createDataFrame([(1, loud), (2, faint), (3, loud)], "recording_id long, samples array<double>")
    said = [(0.0, 4.0, "one two  three four", 7), (4.0, 4.5, "one two three", 7), (30.0, 34.0, "after the end of it", 8), (1.0, 3.0, "...", 8)]
    segs = spark.createDataFrame([(1, said), (2, said[:1])], f"recording_id long, segments {readers.SEGMENTS}")
    got = {(r.recording_id, r.segment_idx): (r.skip_reason, r.duration, r.text) for r in segments.build(recordings, segs, "latin", 2).collect()}
    assert got[1, 0] == (None, 4.0, "one two three four")
    assert [got[k][0] for k in ((1, 1), (1, 2), (1, 3), (2, 0))] == ["too_short", "near_silent", "punctuation_only", "near_silent"]
    assert len(got) == 5  # the third recording has no transcript


def test_repair_report_and_files(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a b", "ax b"), (2, "c d", "c d"), (3, "ax b", "ax b"), (4, "q", "w")], "id int, reference string, hypothesis string")
    table = spark.createDataFrame([("ax", "a", "mined"), ("zz", "z", "seed")], "hyp string, ref string, source string")
    done = repair.evaluate(pairs, repair.as_literal(table))
    assert [tuple(r) for r in repair.improved(done, ["id"]).collect()] == [(1, "a b", "ax b", "a b", 0.5, 0.0)]
    got = repair.report(done, table).first().asDict()
    assert got == {
        "target_samples": 4, "map_entries": 2, "mined_entries": 1, "seed_entries": 1, "wer_before_mean": 0.375, "wer_after_mean": 0.375, "improvement_mean": 0.0,
        "wer_before_median": 0.5, "wer_after_median": 0.5, "improvement_median": 0.0, "fixed_count": 1, "unchanged_count": 2, "regressed_count": 1,
    }
    writers.fix_results(done, table, ["id"], str(tmp_path / "fix"))
    assert spark.read.json(str(tmp_path / "fix" / "summary")).first().fixed_count == 1
    assert {r.id: r.outcome for r in spark.read.json(str(tmp_path / "fix" / "per_sample")).collect()} == {1: "improved", 2: "unchanged", 3: "regressed", 4: "unchanged"}


def test_cleanup_results_and_report(spark, tmp_path):
    rows = [(1, "मीटिंग में पच्चीस लोग", "मीटिंग में पच्चीस लोग"), (2, "घर में एक बार आना", "घर में एक बार आना"), (3, "कल", "कल")]
    done = cleanup.run(spark.createDataFrame(rows, "id int, reference string, hypothesis string"))
    assert [(r.id, r.idioms) for r in cleanup.edge_cases(done, ["id"]).collect()] == [(2, ["एक"])]
    writers.cleanup_results(done, ["id"], str(tmp_path / "c"))
    first = spark.read.json(str(tmp_path / "c")).where("id = 1").first()
    assert (first.number_normalised, first.final_tagged, first.english_words_detected, first.wer_delta_naive) == ("मीटिंग में 25 लोग", "[EN]मीटिंग[/EN] में 25 लोग", ["मीटिंग"], 0.25)
    told = writers.cleanup_report(done, ["id"])
    for line in ("| 1 | `पच्चीस` | `25` | 25 |", "| 2 | `घर में एक बार आना` | `घर में एक बार आना` | `एक` |", "| 1 | 0.0000 | 0.2500 (+0.2500) | 0.0000 (+0.0000) |", "| unchanged | 1 |"):
        assert line in told.splitlines()
    assert "| 3 |" not in told


def test_taxonomy_report(spark):
    pairs = spark.createDataFrame([(i, "a b c d", "a b c x") for i in range(7)] + [(9, "p q r", "meeting q r")], "id int, reference string, hypothesis string")
    scored = errors.align(scoring.score(pairs))
    told = scored.withColumn("category", errors.category(F.col("ref_norm"), F.col("hyp_norm"), F.col("word_errors")))
    lines = writers.taxonomy(told, spark.createDataFrame([("low", 7)], "stratum string, pool int"), ["id"]).splitlines()
    assert "| low | 7 |" in lines and "| other | 8 | 100.0 |" in lines
    assert sum(x.startswith("| other | ") and "confusion" in x for x in lines) == 5
    assert any(x.startswith("| other | 8 | look for") for x in lines)


def test_tables_of_models_heads_and_failures(spark):
    pairs = spark.createDataFrame([(1, "a  b..", "a b"), (2, "c d", "c")], "id int, reference string, hypothesis string")
    normal, raw = scoring.score(pairs), scoring.score(pairs, normalize=False)
    got = scoring.model_table([("m", "y", normal), ("m", "absent", None), ("k", "y", raw)]).orderBy("place").collect()
    assert [(r.place, r.model, r.edits, r.ref_words) for r in got] == [(0, "m", 1, 4), (2, "k", 2, 4)]
    with pytest.raises(ValueError, match="no dataset"):
        scoring.model_table([("m", "y", None)])
    decomposed = spark.createDataFrame([("\u00e9", "e\u0301")], "reference string, hypothesis string")
    assert scoring.score(decomposed, normalize=False).first().wer == 0
    assert [r.id for r in scoring.head(pairs, ["id"], 1).collect()] == [1] and scoring.head(pairs, ["id"], None).count() == 2
    results = spark.createDataFrame([(i, None if i == 3 else i % 2 == 0) for i in range(40)], "id int, ok boolean")
    assert [r.id for r in readers.failures(results, ["id"]).collect()] == list(range(1, 20, 2))
    assert readers.error_samples(spark, None, pairs) is pairs
    shown = pairs.select(text.normalize_for_wer(F.col("reference"), single=False)).first()[0]
    assert shown == "a  b"


def test_rows_are_dealt_however_their_file_is_cut(spark, tmp_path):
    """A file of one row group is read by one task, into however many splits it is cut."""
    path = str(tmp_path / "turns")
    spark.range(9000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = views.spread(spark.read.parquet(path), "id")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 9000 and len(sizes) >= 4 and max(sizes) < 1.2 * views.ROWS_A_TASK


def test_numbers_in_sentences_are_worth_what_their_spans_are(spark):
    """Random spans of number words, beyond 64 bits too: the whole span is one conversion of span_value's value, or its words stand."""
    rng = random.Random(4)
    names = [*lx.UNITS, *lx.TENS, *[*lx.MULTIPLIERS] * 12]
    rows = [(" ".join(["घर", *rng.choices(names, k=rng.randint(1, 14))]),) for _ in range(300)] + [("घर " + "करोड़ " * 3,), ("घर शून्य",)]
    got = spark.createDataFrame(rows, "t string").select("t", numbers.span_value(F.slice(text.tokens(F.col("t")), 2, 99)).alias("v"), numbers.normalise(F.col("t")).alias("n")).collect()
    for r in got:
        words = r.t.split()[1:]
        if not any(c.is_idiom for c in r.n.conversions):
            assert [(c.original, c.value, c.position) for c in r.n.conversions] == ([(" ".join(words), r.v, 1)] if r.v is not None else [(w, None, 1 + i) for i, w in enumerate(words)])
            assert r.n.text == " ".join(["घर", str(r.v)] if r.v is not None else ["घर", *words])
    assert {r.v is None for r in got} == {True, False}


def test_idioms_are_looked_for_at_their_first_words_only(monkeypatch):
    class Counting:
        def __init__(self, pattern):
            self.pattern, self.read = pattern, 0

        def __getattr__(self, name):
            def call(text):
                self.read += len(text)
                return getattr(self.pattern, name)(text)

            return call

    seen = [Counting(getattr(numbers, n)) for n in ("_IDIOM", "_AHEAD") if hasattr(numbers, n)]
    for counting, n in zip(seen, ("_IDIOM", "_AHEAD"), strict=False):
        monkeypatch.setattr(numbers, n, counting)
    raw = ["घर"] * 5000 + ["दस-बीस"] + ["घर"] * 5000
    assert numbers._in_idiom(raw) == set(range(4997, 5003))
    assert sum(c.read for c in seen) < 100
    monkeypatch.undo()
    rng = random.Random(3)
    words = ["एक", "दो", "तीन", "चार", "नौ", "दस", "बीस", "बार", "ग्यारह", "एक-दो", "दस-बीस", "तीन-पाँच", "घर", "दस।"]
    for _ in range(2000):
        raw = rng.choices(words, k=rng.randint(0, 12))
        assert numbers._in_idiom(raw) == {i for i in range(len(raw)) if numbers._IDIOM.search(" ".join(raw[max(i - 2, 0) : i + 4]))}
