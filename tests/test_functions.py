from __future__ import annotations

import random
import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from lekhya.functions import arrays, blocks, text, wer


def column(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


def test_normal_forms(spark):
    rows = ["  a  b\t c ", "ठीक है।।.. ", "a..b. .", "", "é", "।", "a  b", None]
    assert column(spark, rows[:5], text.normalize_text) == ["a b\t c", "ठीक है।।..", "a..b. .", "", "é"]
    assert column(spark, rows, text.normalize_for_wer) == ["a b\t c", "ठीक है", "a।b", "", "é", "", "a  b", None]
    once = column(spark, rows, text.normalize_for_wer)
    assert column(spark, once, text.normalize_for_wer) == once


def test_native_composition_covers_devanagari(spark):
    rows = [chr(c) + "x" for c in range(0x0900, 0x0980)] + [unicodedata.normalize("NFD", chr(c)) for c in range(0x0900, 0x0980)]
    assert column(spark, rows, text.nfc_native) == [unicodedata.normalize("NFC", r) for r in rows]


def test_predicates(spark):
    rows = ["", "।।", "हाँ।", " uh ", "ab1", "५", "हाँ हाँ", "é", "नही वो"]
    assert column(spark, rows, text.is_punctuation_only) == [True, True, False, False, False, False, False, False, False]
    assert column(spark, rows, text.is_filler) == [False, False, True, True, False, False, False, False, False]
    assert column(spark, rows, text.has_digit) == [False, False, False, False, True, True, False, False, False]
    assert column(spark, rows, text.count_script) == [0, 2, 4, 0, 0, 1, 6, 0, 5]
    assert column(spark, rows, lambda c: F.size(text.tokens(c))) == [0, 1, 1, 1, 1, 1, 2, 1, 2]


def test_title_case_agrees_with_python(spark):
    rng = random.Random(1)
    rows = ["", "A", "a", "Ab Cd", "AB", "aB", "A1b", "A1B", "Éa", "घर", "Don't", "X-Y", "1"] + ["".join(rng.choice("aB1 é-É") for _ in range(rng.randint(0, 6))) for _ in range(200)]
    assert column(spark, rows, text.is_title) == [r.istitle() for r in rows]


def test_repeats(spark):
    rows = ["हाँ हाँ हाँ हाँ हाँ हाँ घर", "a b a b a", "x x x x", "x x x x x y y y y y y", "", "aa a a a a a"]
    assert column(spark, rows, text.collapse_repeats) == ["हाँ घर", "a b a b a", "x x x x", "x y", "", "aa a"]
    assert column(spark, rows, lambda c: text.most_repeats(text.tokens(c))) == [6, 3, 4, 6, 0, 5]
    assert column(spark, rows, lambda c: text.most_frequent(text.tokens(c))["word"]) == ["हाँ", "a", "x", "y", None, "a"]


def levenshtein(r, h):
    row = list(range(len(h) + 1))
    for i, a in enumerate(r, 1):
        row, last = [i], row
        for j, b in enumerate(h, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (a != b)))
    return row[-1]


def test_word_edits(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))], [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))]) for _ in range(150)]
    pairs += [(x, list(x)) for x, _ in pairs[:10]] + [([str(i) for i in range(3000)], [str(i) for i in range(1, 3000)]), (["a"] * 300, ["a", "b"] * 150)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r array<string>, h array<string>").repartition(3)
    got = {r.i: r for r in df.select("i", wer.word_edits(F.col("r"), F.col("h")).alias("n")).collect()}
    for i, (r, h) in enumerate(pairs):
        if len(r) <= 300:
            assert got[i].n == levenshtein(r, h)


def by_definition(r, h):
    """The errors, by looking for the longest block in plain loops."""
    popular = {w for w in h if len(h) >= 200 and h.count(w) > len(h) // 100 + 1}
    blocks = []

    def look(a, b, c, d):
        best = (0, a, c)
        for i in range(a, b):
            for j in range(c, d):
                k = 0
                while i + k < b and j + k < d and r[i + k] == h[j + k] and h[j + k] not in popular:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        while i > a and j > c and r[i - 1] == h[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < b and j + k < d and r[i + k] == h[j + k]:
            k += 1
        if k:
            look(a, i, c, j)
            blocks.append((i, j, k))
            look(i + k, b, j + k, d)

    look(0, len(r), 0, len(h))
    out, a, c = [], 0, 0
    for i, j, k in [*blocks, (len(r), len(h), 0)]:
        for t in range(max(i - a, j - c)):
            x, y = (a + t if a + t < i else None), (c + t if c + t < j else None)
            out.append(("insertion" if x is None else "deletion" if y is None else "substitution", "" if x is None else r[x], "" if y is None else h[y], x, y))
        a, c = i + k, j + k
    return out


def test_alignment_follows_its_definition(spark):
    """Random pairs, equal and empty sides, popular words of long hypotheses, nulls; all in one batch and in small ones."""
    rng = random.Random(12)
    some = lambda letters, n: [rng.choice(letters) for _ in range(n)]
    pairs = [(some("abcdefgh", rng.randint(0, 40)), some("abcdefgh", rng.randint(0, 40))) for _ in range(120)]
    pairs += [(some("ab", rng.randint(0, 30)), some("ab", rng.randint(0, 30))) for _ in range(60)] + [([], []), (["a"], []), ([], ["b"]), (["a b"], ["a", "b"]), (["é"], ["é"])]
    for _ in range(8):  # popular words, alone in a window too
        base = [w for i in range(110) for w in ("the", "of" if i % 3 else f"w{i}")]
        pairs.append((base, [w for w in base if rng.random() > 0.1] + some(["the", "x"], rng.randint(0, 9))))
        pairs.append((some(["the", "of", "q"], 60), some(["the", "of", "z"], rng.choice([199, 200, 230]))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate([*pairs, (None, ["a"]), (["a"], None)])], "i int, r array<string>, h array<string>")
    for parts in (1, 7):
        got = {x.i: x.e for x in df.repartition(parts).select("i", wer.word_errors("r", "h").alias("e")).collect()}
        assert got[len(pairs)] is None and got[len(pairs) + 1] is None
        for i, (r, h) in enumerate(pairs):
            assert [tuple(e) for e in got[i]] == by_definition(r, h), (r, h)
    rate = df.where("size(r) > 0").select("i", wer.block_wer(wer.word_errors("r", "h"), F.size("r")).alias("b"), (wer.word_edits(F.col("r"), F.col("h")) / F.size("r")).alias("w")).collect()
    assert all(x.b >= x.w for x in rate if x.b is not None) and any(x.b > x.w for x in rate if x.b is not None)


def test_alignment_of_many_matches_goes_in_pieces(monkeypatch):
    rng = random.Random(13)
    pairs = [([rng.choice("abc") for _ in range(50)], [rng.choice("abc") for _ in range(50)]) for _ in range(20)]
    monkeypatch.setattr(blocks, "MATCHES", 1000)
    got = blocks.errors(pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])).to_pylist()
    assert [[tuple(e.values()) for e in g] for g in got] == [by_definition(*p) for p in pairs]


def test_samples(spark):
    df = spark.createDataFrame([(0, [0.5, -0.5, 0.5, -0.5], 0.25, 0.75), (1, [], 0.0, 1.0), (2, [0.001] * 4, 0.5, 9.0)], "i int, s array<float>, a double, b double")
    got = df.orderBy("i").select(arrays.rms(F.col("s")).alias("r"), arrays.loud(F.col("s")).alias("l"), F.size(arrays.time_slice(F.col("s"), F.col("a"), F.col("b"), 4)).alias("n")).collect()
    assert [(r.r is None or round(r.r, 4), r.l, r.n) for r in got] == [(0.5, True, 2), (True, False, 0), (0.001, False, 2)]
    ids = spark.createDataFrame([([5, 6, 7, 8, 9],)], "v array<int>")
    padded = arrays.pad(F.col("v"), F.lit(7), 0)
    masked = arrays.mask(padded, 0)
    assert ids.select(masked).first()[0] == [-100, -100, -100, -100, 9, -100, -100] and ids.select(arrays.unmask(masked, 0)).first()[0] == [0, 0, 0, 0, 9, 0, 0]


def test_words_stripped(spark):
    assert column(spark, ["लोगों", "घरें", "तो", "किताबियों", "लड़कों"], text.strip_inflection) == ["लोग", "घरें", "तो", "किताब", "लड़क"]
    assert column(spark, ["एक्चुली", "घर", "स्टेशन"], text.borrowed_score) == [2, 0, 1]
    assert column(spark, ["http://a", "xhttp://a"], lambda c: text.rewrite_prefix(c, "http:", "https:")) == ["https://a", "xhttp://a"]


def test_alignment_takes_memory_of_a_piece_not_of_the_batch():
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(60)]
    refs = [rng.choices(vocabulary, k=84) for _ in range(6000)]
    hyps = [[w + "x" if rng.random() < 0.2 else w for w in r if rng.random() > 0.08] for r in refs]
    kind = pa.list_(pa.string())
    whole = pa.array(refs, kind), pa.array(hyps, kind)
    tracemalloc.start()
    got = blocks.errors(*whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    assert got.slice(5000, 50).to_pylist() == blocks.errors(pa.array(refs[5000:5050], kind), pa.array(hyps[5000:5050], kind)).to_pylist()
