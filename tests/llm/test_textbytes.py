from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from lekhya.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_xxh64_agrees_with_the_library():
    rng = random.Random(1)
    data = rng.randbytes(60_000)
    starts = np.array([rng.randrange(50_000) for _ in range(2000)])
    ends = starts + np.array([rng.choice([0, 1, 3, 4, 7, 8, 9, 15, 31, 32, 33, 63, 64, 100, 255, 256, 257, 900]) for _ in starts])
    got = tb.xxh64(np.frombuffer(data, np.uint8), starts, ends)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends, strict=True)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t |", max_size=12)), max_size=8))
def test_words_of_rows(texts):
    raw, offsets = tb.utf8(pa.array(texts, pa.string()))
    starts, ends, first = tb.spans(raw, offsets)
    data = raw.tobytes()
    got = [[data[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    own, s, e = tb.joined(raw, offsets, starts, ends)
    for i, t in enumerate(texts):
        if first[i + 1] > first[i]:
            assert own[s[first[i]] : e[first[i + 1] - 1]].tobytes().decode() == " ".join(WORD.findall(t))


def test_pieces_cover_rows_and_leave_long_ones_whole():
    offsets = np.array([0, 3, 3, 50, 51, 52])
    assert list(tb.pieces(offsets, 4)) == [(0, 2), (2, 3), (3, 5)]


def test_bit_majority_over_many_rows():
    rng = np.random.default_rng(0)
    first = np.concatenate([[0], np.cumsum([0, 1, 5, 70_000, 3, 0, 64_000])])
    h = rng.integers(0, 1 << 63, first[-1], np.uint64)
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        counts = [(h[a:b] >> np.uint64(i) & np.uint64(1)).sum() for i in range(64)]
        want.append(sum(1 << i for i, c in enumerate(counts) if 2 * c > b - a))
    assert [int(x) for x in tb.bit_majority(h, first)] == want
