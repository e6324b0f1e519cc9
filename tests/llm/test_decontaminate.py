from __future__ import annotations

import random
from collections import Counter

from lekhya.llm import decontaminate as D
from tests.llm.conftest import SCHEMA, lower, prose
from tests.llm.test_textbytes import WORD


def brute(docs, items, s=0.8):
    """Best weighted Jaccard similarity over all windows of an item's size."""
    out = {}
    for i, t in docs:
        w = WORD.findall(lower(t))
        for j, u in items:
            v = WORD.findall(lower(u))
            if not v or not w:
                continue
            k = min(5, len(v))
            bag = lambda x, k=k: Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))
            b, best = bag(v), 0.0
            for a in range(max(1, len(w) - len(v) + 1)):
                c = bag(w[a : a + len(v)])
                both = (b & c).total()
                best = max(best, both / (b.total() + c.total() - both)) if c else best
            if best >= s:
                out[i, j] = best
    return out


def test_matches_are_those_of_all_windows(spark, odd_docs):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 4, 5, 12, 30, 30, 44, 60, 25))] + [(50, None), (51, ""), (52, "uno dos"), (53, "uno  DOS")]
    docs = []
    for i in range(40):
        w = prose(rng, rng.randint(0, 120)).split()
        item = items[i % 9][1].split()
        if i % 3 == 0:
            w[5:5] = item
        elif i % 3 == 1 and len(item) > 20:  # altered at an end: still alike
            w += item[: -rng.randint(1, 3)]
        docs.append((i, " \n".join(w).upper() if i % 2 else " ".join(w)))
    docs += [(90, None), (91, ""), (92, items[6][1]), (93, " ".join(items[7][1].split()[:56])), (94, "and uno dos tres")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.matches(df, bench).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = {r.doc_id for r in D.decontaminate(df, bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}
    assert D.matches(odd_docs, bench.limit(0)).count() == 0
    assert D.decontaminate(odd_docs, bench.where("item_id between 3 and 8")).count() == odd_docs.count()
    assert D.matches(df.limit(0), bench).count() == 0


def test_the_index_finds_all_within_the_radius():
    rng = random.Random(4)
    items = D.Items(5)
    import numpy as np

    items.fps = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    items.sizes = [7 + i % 2 for i in range(300)]
    probes = []
    for x in items.fps[:100]:
        y = int(x)
        for i in rng.sample(range(64), rng.randint(0, 26)):
            y ^= 1 << i
        probes.append(y)
    for size in (7, 8):
        got = items.near(np.array(probes, np.uint64), size)
        for y, found in zip(probes, got, strict=True):
            assert set(found) == {i for i, x in enumerate(items.fps) if items.sizes[i] == size and (int(x) ^ y).bit_count() <= D.RADIUS}
