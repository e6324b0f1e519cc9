from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from tests.llm.conftest import SCHEMA, lower, prose

from lekhya.llm import crc_resampling as cr
from lekhya.llm import textbytes as tb

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, share=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    count = lambda texts: [bucket(f) for t in texts for f in features(t)[1]]
    s, t = np.bincount(count([d[1] for d in docs]), minlength=10_000), np.bincount(count(target), minlength=10_000)
    s_sum, t_sum = float(s.sum()), float(t.sum())
    gain = [math.floor(1000 * math.log((b + 1.0) * (s_sum + 10_000) / ((a + 1.0) * (t_sum + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for i, text in docs:
        n, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(enough[: len(enough) * share // 100]):
        r[5] = k + 1
    return out


def check(spark, df, docs, target, share=5):
    got = cr.resample(df, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), share).collect()
    order = lambda r: str(r)
    want = sorted((tuple(r) for r in brute(docs, target, share)), key=order)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got), key=order) == want
    return got


def test_crcs_by_algebra_equal_those_of_strings():
    rng = random.Random(2)
    texts = ["", " ", "a", "Ab cd", "ünï 😀x-y_z 12", "z" * 70, prose(rng, 400), "q" * 5000 + " b", "".join(chr(rng.randint(1, 300)) for _ in range(900)), "x " * 50 + "y" * 64 + " " + "w" * 65]
    raw = np.frombuffer("".join(lower(t) for t in texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(lower(t).encode()) for t in texts])])
    got = list(cr.feature_crcs(raw, offsets))
    for r, text in enumerate(texts):
        words = WORD.findall(lower(text))
        for n, (crc, first) in enumerate(got, 1):
            assert crc[first[r] : first[r + 1]].tolist() == [zlib.crc32(" ".join(words[i : i + n]).encode()) for i in range(len(words) - n + 1)]


def test_shifts_are_products_of_matrices():
    crc, length = np.array([1, 0xFFFFFFFF, 77, 0], np.uint32), np.array([0, 5, 1 << 20, 9])
    for c, n, s in zip(crc, length, cr.shifted(crc, length), strict=True):
        x = int(c)
        for _ in range(int(n) if n < 100 else 0):
            x = int(cr.BYTE[x & 255]) ^ x >> 8
        if n < 100:
            assert s == x
    whole = zlib.crc32(b"a" + b"b" * (1 << 20))
    assert cr.shifted(np.array([zlib.crc32(b"a")], np.uint32), np.array([1 << 20]))[0] ^ zlib.crc32(b"b" * (1 << 20)) == whole


def test_rows_of_every_kind(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = check(spark, odd_docs, docs, [docs[3][1], docs[9][1], None, ""], 20)
    assert sum(r.rank is not None for r in got) > 5


def test_ties_and_repeated_rows(spark):
    docs = [(i, "a b c d " * 6) for i in range(60)] + [(5, "a b c d " * 6)] * 30 + [(7, "a b c d " * 7), (7, "short")]
    check(spark, spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], SCHEMA).repartition(3), docs, ["a b", "c"], 50)


def test_the_sample_leans_to_the_target(spark):
    rng = random.Random(8)
    own = [prose(rng, 1) + "q" for _ in range(40)]
    docs = [(i, prose(rng, 40) if i % 10 else " ".join(rng.choice(own) for _ in range(40))) for i in range(400)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], SCHEMA)
    target = " ".join(rng.choice(own) for _ in range(8000))
    got = cr.resample(df, spark.createDataFrame([(1, target)], "item_id long, text string"), 10).where("rank is not null").collect()
    assert len(got) == 40 and sum(r.doc_id % 10 == 0 for r in got) >= 38


def test_empty_tables(spark, no_docs):
    target = spark.createDataFrame([], "item_id long, text string")
    assert cr.resample(no_docs, target).collect() == []
    assert check(spark, spark.createDataFrame([(1, "a", None, None, 1)], SCHEMA), [(1, "a")], [])[0].rank is None


def test_pieces_do_not_change_results(spark, monkeypatch):
    rng = random.Random(4)
    raw, offsets = tb.utf8(__import__("pyarrow").array([prose(rng, 30) for _ in range(20)]))
    whole = [crc for crc, _ in cr.feature_crcs(raw, offsets)]
    parts = [[crc for crc, _ in cr.feature_crcs(raw[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])] for i in range(20)]
    assert all(np.concatenate([p[n] for p in parts]).tolist() == whole[n].tolist() for n in range(3))


@pytest.mark.parametrize("share", [1, 100])
def test_share_of_documents_with_enough_words(spark, share):
    docs = [(i, "w" + str(i % 7) + " x" * (18 + i % 4)) for i in range(90)]
    got = check(spark, spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], SCHEMA), docs, ["x x x"], share)
    enough = sum(len(t.split()) >= 20 for _, t in docs)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, enough * share // 100 + 1))
