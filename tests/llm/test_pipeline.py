from __future__ import annotations

import os

import pytest

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages_keep_the_columns_and_only_shrink(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns + ["taken"] * (name == P.STAGES[-1][0])
        assert name == P.STAGES[-1][0] or out.dtypes == docs.dtypes
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        back = spark.read.parquet(path)
        assert 0 < back.count() <= docs.count() and back.join(docs, "doc_id", "left_anti").count() == 0
        docs = back


def test_copies_leave_one_document(spark, tmp_path):
    from tests.llm.test_quality import corpus

    rows, labels = corpus(600)
    good = [r for r in rows if r[0] % 5]
    copies = [(10_000 + i, *r[1:]) for i, r in enumerate(good[:40])] + [(20_000 + i, r[1].upper().replace(" ", "  "), *r[2:]) for i, r in enumerate(good[:40])]
    path = str(tmp_path)
    spark.createDataFrame(rows + copies, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, good[50][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = {r.doc_id for r in P.run(spark, path).collect()}
    assert not any(i >= 10_000 for i in kept) and good[50][0] not in kept
    assert len(kept & {r[0] for r in good}) >= 0.5 * len(good)


def test_a_short_document_beside_a_repeated_passage_keeps_its_own_lines(spark):
    passage = " ".join(f"license{i}" for i in range(60))
    own = [" ".join(f"own{d}word{i}" for i in range(20)) for d in range(3)]
    rows = [(d, f"{passage}\n{x}", "en", "s", 0) for d, x in enumerate(own)] + [(9, f"{passage}\n ", "en", "s", 0)]
    out = P.deduplicate_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {0: (rows[0][1], len(rows[0][1])), 1: (own[1], len(own[1])), 2: (own[2], len(own[2]))}


ODD = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, removed string, taken string, id string, row string, s string"


def odd_rows():
    """Repeated rows, rows of one or no id with different texts, nulls, blank and long texts."""
    t = [" ".join(f"w{d}x{i}" for i in range(30)) for d in range(8)]
    base = [(1, t[0]), (1, t[0]), (1, t[0]), (2, t[1]), (2, t[2]), (None, t[3]), (None, t[4]), (None, t[4]), (3, None), (4, ""), (5, " \n "), (6, t[5]), (7, t[5] + " tail"), (8, " ".join(t[6:] * 900))]
    return [(i, x, "en", "s" if i else None, len(x or ""), "own", "own", "own", "own", "own", "own") for i, x in base]


def shown(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_near_dedup_leaves_one_row_of_each_group(spark):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    out = P.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and {r.removed for r in out.collect()} == {"own"}
    rows = odd_rows()
    want = [rows[0], rows[3], rows[4], rows[5], rows[6], rows[8], rows[11], rows[13]]  # blank texts are one group, led by its least id
    assert shown(out) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in want)


def test_source_mix_keeps_the_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    out = P.source_mix(spark, docs, "")
    assert out.columns == [c for c in docs.columns if c != "taken"] + ["taken"]
    got = out.collect()
    words = [len((r[1] or "").split()) for r in odd_rows()]
    assert len(got) <= sum(w > 0 for w in words) and all(0 < r.taken <= 2 * len(r.text.split()) for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * sum(words)) <= 3 + 1


def test_lines_quality_and_decontamination_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, odd_rows()[11][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert shown(P.quality_classifier(spark, docs, str(tmp_path))) == shown(docs)
    lines = P.deduplicate_lines(spark, docs, "")
    assert lines.columns == docs.columns and lines.dtypes == docs.dtypes and {r.removed for r in lines.collect()} == {"own"}
    texts = [t for _, _, t in shown(lines)]
    for r in odd_rows():
        assert r[0] == 7 or (r[1] or "") in texts  # of 6 and 7, alike, one goes
    clean = P.decontamination(spark, docs, str(tmp_path))
    assert shown(clean) == [x for x in shown(docs) if x[1] not in (6, 7) or x[0]]


def test_empty_tables(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = no_docs
    for _, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and set(docs.columns) <= set(out.columns)
