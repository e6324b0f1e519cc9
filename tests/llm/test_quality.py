from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lekhya.llm import quality as Q
from tests.llm.conftest import SCHEMA, prose


def corpus(n=900):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        t, bad = prose(rng, rng.randint(20, 300)), i % 5 == 0
        if bad:
            w = t.split()
            t = " ".join(x + "$$$" for x in w) if i % 2 else " ".join(x if k % 12 else rng.choice(["idiot", "moron", "scum"]) for k, x in enumerate(w))
        rows.append((i, t, "en", "s", len(t)))
        if rng.random() < 0.5:
            labels.append((i, int(not bad or not i % 2), int(bad and not i % 2)))
    return rows, labels


def test_selection_drops_bad_texts_and_keeps_good_ones(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("log_weight", F.lit(1)).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in Q.sampled(docs, lab).collect()}
    bad = {i for i in range(900) if i % 5 == 0}
    good = set(range(900)) - bad
    assert len(kept & bad) <= 0.05 * len(bad) and len(kept & good) >= 0.97 * len(good)
    assert {r.doc_id for r in Q.select(docs, lab).collect()} == kept
    assert Q.select(docs, lab).columns == docs.columns


def test_labels_of_one_kind_and_none(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.select(odd_docs, none).count() == odd_docs.count()
    assert Q.sampled(no_docs, none).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert Q.select(odd_docs, some).count() == odd_docs.count()
    bad = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert Q.select(odd_docs, bad).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=5000), np.full(3000, 0.5), rng.normal(size=10) * 1e6])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    order = np.sort(x)[::-1]
    for k in (1, 7, 2000, 4000, len(x)):
        assert Q.kth_largest(df, "v", k, bins=64, few=50) == order[k - 1]


def test_features_stop_at_rows():
    raw = np.frombuffer("One two!!three  the the the the the".encode() + b"x", np.uint8)
    (tok, first), (pairs, pfirst) = Q.features(raw, np.array([0, 9, 9, len(raw)]))
    assert list(np.diff(first)) == [3, 0, 6] and list(np.diff(pfirst)) == [2, 0, 5]
    assert len(set(pairs[2:])) < 5 and len(set(tok)) == 6


def brute_force(rows, labels):
    """(log weight, sampling key) of each id and k, in plain Python from words and their hashes."""
    import math
    import re
    from collections import Counter

    from lekhya.llm import textbytes as tb

    token = re.compile(r"[A-Za-z0-9_\x80-\U0010ffff]+|[^A-Za-z0-9_\x80-\U0010ffff\x20\x09-\x0D]+")
    word = lambda w: int(tb.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
    mask, shift = (1 << 64) - 1, 64 - Q.BUCKET_BITS
    feats, known = {}, {}
    for i, t, *_ in rows:
        ws = [w.lower() for w in token.findall(t)]
        h = [known.setdefault(w, word(w)) for w in ws]
        pairs = [int(tb.mix(np.array([h[k] * 31 + h[k + 1] & mask], np.uint64))[0]) for k in range(len(h) - 1)]
        for k in range(len(h) - 3):
            if ws[k] == ws[k + 1] == ws[k + 2] == ws[k + 3]:
                pairs[k] = int(Q._REPEATED)
        feats[i] = [[x >> shift for x in h], [x >> shift for x in pairs]]
    good = {i for i, q, t in labels if q == 1 and t == 0}
    weight = dict.fromkeys(feats, 0.0)
    for part in (0, 1):
        raw, own = Counter(), Counter()
        for i, f in feats.items():
            raw.update(set(f[part]))
            own.update(set(f[part]) if i in good else ())
        order, n = sorted(raw, key=lambda b: own[b] / raw[b]), 0
        for middle in order:
            n += raw[middle]
            if n >= sum(raw.values()) / 2:
                break
        rate = max(own[middle] / raw[middle], sum(own.values()) / sum(raw.values()) / 2)
        ratio = {}
        for b, r in raw.items():
            e, t = r * rate, own[b]
            g2 = 2 * ((t * math.log(t / e) if t else 0) - (t - e))
            ratio[b] = math.log((t + Q.SHRINK) / (e + Q.SHRINK)) if g2 >= Q.EVIDENCE else 0.0
        for i, f in feats.items():
            weight[i] += sum(ratio[b] for b in f[part])
    return {i: w / math.sqrt(max(1, sum(map(len, feats[i])))) for i, w in weight.items()}


def test_ratios_weights_and_sample_against_plain_python(spark):
    rows, labels = corpus(500)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_force(rows, labels)
    model, weights = Q.train(docs, lab, share=0.4)
    got = {r.doc_id: r for r in weights.collect()}
    assert all(abs(got[i].log_weight - want[i]) < 1e-6 for i in want)
    noise = dict(zip(want, Q.gumbel(np.array(list(want))), strict=True))
    key = {i: want[i] / Q.TEMPERATURE + noise[i] for i in want}
    top = set(sorted(key, key=lambda i: -key[i])[:200])
    assert {r.doc_id for r in Q.sampled(docs, lab, share=0.4).collect()} == top


def test_noise_is_gumbel():
    g = Q.gumbel(np.arange(200_000))
    assert abs(g.mean() - 0.5772) < 0.01 and abs(g.var() - np.pi**2 / 6) < 0.02
