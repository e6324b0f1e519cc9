from __future__ import annotations

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lekhya.llm import simhash_dedup as S
from lekhya.llm.common import bucket_links, connected_components, keep
from tests.llm.conftest import SCHEMA, lower, prose
from tests.llm.test_textbytes import WORD


def fingerprint(text, k=3):
    w = WORD.findall(lower(text))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def components(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_contract_on_odd_rows(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = S.near_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    fps = {r.text: fingerprint(r.text) for r in rows}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, f"{fps[r.text]:016x}") for r in rows)
    own = {}
    for r in rows:
        if r.doc_id is not None:
            own[r.doc_id] = fps[r.text]
    want = components(sorted(own), lambda a, b: (own[a] ^ own[b]).bit_count() <= 2)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.component_id for r in got if r.doc_id in (103, 104, 105)} == {103}


def test_full_buckets_are_linked_exactly(spark):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 400:  # a ball of three bits: some of its members are alone within two
        x = center
        for i in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << i
        fps.add(x)
    signed = [S._signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(S.links(df)).collect()}
    want = components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    for a, b in itertools.combinations(sorted(fps), 2):
        x, y = roots.get(S._signed(a), S._signed(a)), roots.get(S._signed(b), S._signed(b))
        assert (x == y) == (want[a] == want[b])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(-5, -9), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(500)}) == 1 and len(set(got.values())) == 3
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_components_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        w = prose(rng, rng.randint(40, 160)).split()
        texts.append(" ".join(w))
        for share in (0, 0.005, 0.01, 0.02, 0.08):
            texts.append(" ".join("new" + x if rng.random() < share else x for x in w))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.id: r.component for r in S.similar_components(docs).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    want = components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got)
    assert all(want[i] == want[got[i]] for i in got)  # nothing is linked that is not similar


def test_near_copies_in_full_mixed_buckets_meet(spark):
    rng = random.Random(4)
    passage = prose(rng, 134).split()
    texts = []
    for _ in range(150):  # 0.5 to 0.6 to one another for the shared passage; each with a copy at over 0.8
        w = passage + prose(rng, 45).split()
        texts += [" ".join(w), " ".join(w[:150] + prose(rng, 3).split() + w[153:])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.id: r.component for r in S.similar_components(docs).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(set(want.values())) == 150 and sum(got[i] == want[i] for i in got) >= len(got) - 1


def test_empty(no_docs):
    assert S.near_duplicates(no_docs).count() == 0
    assert S.similar_components(no_docs).where(F.col("id") > 0).count() == 0


def test_tails_of_a_hub_component_meet(spark):
    """One bucket: 25 similar nodes, and 12 more each similar to one of them that is no hub's pick; all are one component."""
    nodes = list(range(1, 38))
    similar = {(a, b) for a in range(1, 26) for b in range(a + 1, 26)} | {(25 - k, 26 + k) for k in range(12)}
    table = spark.createDataFrame(sorted(similar), "p long, q long")
    members = spark.createDataFrame([(7, n) for n in nodes], "key long, node long")
    verify = lambda e: keep(e.join(table, (e.a == table.p) & (e.b == table.q)).select("a", "b"), "verified")
    edges = bucket_links(members, lambda x, y: F.lit(True), verify)
    assert {(r.a, r.b) for r in edges.collect()} <= similar
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert len(roots) == 37 and len(set(roots.values())) == 1


@pytest.mark.parametrize("seed", range(3))
def test_buckets_of_any_shape_keep_their_components(spark, seed):
    """Random graphs within full buckets, chains, stars and cliques: links join what all similar pairs of a bucket join."""
    rng = random.Random(seed)
    members, similar, n = [], set(), 0
    for key in range(12):
        own = list(range(n, n + rng.choice([2, 16, 17, 40, 90])))
        n = own[-1] + 1
        members += [(key, v) for v in own]
        shape = key % 4
        if shape == 0:
            similar |= set(zip(own, own[1:]))
        elif shape == 1:
            similar |= {(own[0], v) for v in own[1:]}
        elif shape == 2:
            similar |= {(u, v) for u in own for v in own if u < v and rng.random() < 1.5 / len(own)}
        else:
            half = own[: len(own) // 2]
            similar |= {(u, v) for u in half for v in half if u < v} | {(rng.choice(half), v) for v in own[len(half) :]}
    similar = {(min(p), max(p)) for p in similar if p[0] != p[1]}
    table = keep(spark.createDataFrame(sorted(similar), "p long, q long"), "table")
    verify = lambda e: keep(e.join(table, (e.a == table.p) & (e.b == table.q)).select("a", "b"), "verified")
    edges = bucket_links(spark.createDataFrame(members, "key long, node long"), lambda x, y: F.lit(True), verify)
    root = {v: v for v in range(n)}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in similar:
        root[find(a)] = find(b)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    pairs = lambda of: {frozenset(v for v in range(n) if of(v) == of(u)) for u in range(n)}
    assert pairs(find) == pairs(lambda v: got.get(v, v))
