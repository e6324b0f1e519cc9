from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import SCHEMA, prose

from lekhya.llm import repetition

WORD = re.compile("[^\x20\x09-\x0d]+")
LIMITS = repetition.Limits()


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out |= {"n_lines": len(lines), "n_dup_lines": len(again), "dup_line_chars": sum(len("".join(WORD.findall(x))) for x in again)}

    def windows(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        return grams, Counter(grams)

    def inside(n):
        grams, count = windows(n)
        return {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}

    out["n_repeat_words"] = len(inside(3))
    for n, _ in LIMITS.top:
        out[f"top_{n}gram_chars"] = max((len("".join(g)) * c for g, c in windows(n)[1].items() if c > 1), default=0)
    for n, _ in LIMITS.duplicated:
        out[f"dup_{n}gram_chars"] = sum(len(words[j]) for j in inside(n))
    return out


def verdict(m):
    failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    chars = max(m["word_chars"], 1)
    broken = [n for n, on in (("symbols", m["n_symbols"] > 0.1 * max(m["n_words"], 1)), ("duplicate_lines", m["n_dup_lines"] > 0.3 * max(m["n_lines"], 1)), ("duplicate_line_chars", m["dup_line_chars"] > 0.2 * chars)) if on]
    broken += [f"top_{n}gram" for n, most in LIMITS.top if m[f"top_{n}gram_chars"] > most * chars]
    broken += [f"dup_{n}gram" for n, most in LIMITS.duplicated if m[f"dup_{n}gram_chars"] > most * chars]
    return failed, broken


def check(df, docs):
    got = repetition.judge(df).collect()
    show = lambda r: str(sorted(r.items()))
    want = []
    for i, text in docs:
        m = brute(text)
        failed, broken = verdict(m)
        want.append(m | {"doc_id": i, "base_failed": failed, "broken": broken, "kept": not failed and not broken})
    assert sorted((r.asDict() for r in got), key=show) == sorted(want, key=show)
    return got


def test_rows_of_every_kind(odd_docs):
    check(odd_docs.where("doc_id is null or doc_id <> 107"), [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id != 107])


def test_a_very_long_text(spark):
    rng = random.Random(6)
    text = "\n".join(prose(rng, 12) for _ in range(3000))
    m = repetition.measures(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), LIMITS)
    words = text.split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    assert m["n_repeat_words"][0] == len({j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)})
    assert m["word_chars"][0] == sum(map(len, words)) and m["n_lines"][0] == 3000


def test_repeats_of_every_length(spark):
    """Small alphabets repeat everywhere; lines repeat with their white space or not at all; windows never cross rows."""
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "😀 ", "c\r\n"]) for _ in range(rng.choice([0, 3, 40, 400])))) for i in range(120)]
    docs += [(200 + k, (prose(rng, k) + " ") * 3) for k in range(1, 14)] + [(300, "same words here\n" * 30), (301, "x\n\n \nx\nx \n x"), (302, "a a a a a a"), (303, "a b"), (304, "a b")]
    check(spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], SCHEMA).repartition(3), docs)


def test_prose_is_kept_and_boilerplate_is_not(spark):
    rng = random.Random(10)
    line = prose(rng, 12)
    docs = [(1, prose(rng, 300)), (2, "\n".join([line] * 10 + [prose(rng, 60)])), (3, prose(rng, 20)), (4, " ".join([prose(rng, 9)] * 20)), (5, prose(rng, 200) + " # $ % & " * 30)]
    got = {r.doc_id: r for r in check(spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], SCHEMA), docs)}
    assert [got[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert "duplicate_lines" in got[2].broken and got[3].base_failed and "dup_5gram" in got[4].broken and got[5].broken[0] == "symbols"


def test_an_empty_table(no_docs):
    assert repetition.judge(no_docs).collect() == []


@pytest.mark.parametrize("limit", [1 << 6, 1 << 20])
def test_pieces_do_not_change_results(spark, monkeypatch, limit):
    rng = random.Random(11)
    docs = [(i, prose(rng, 80) + "\n" + "again and again " * (i % 5)) for i in range(30)]
    whole = repetition.tb.pieces
    monkeypatch.setattr(repetition.tb, "pieces", lambda offsets: whole(offsets, limit))
    text = "".join(t for _, t in docs).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in docs])])
    parts = []
    for i, j in repetition.tb.pieces(offsets):
        m = repetition.measures(np.frombuffer(text, np.uint8)[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], LIMITS)
        parts += [{k: int(v[r]) for k, v in m.items()} for r in range(j - i)]
    assert parts == [brute(t) for _, t in docs]
