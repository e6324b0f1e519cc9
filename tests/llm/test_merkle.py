from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from tests.llm.conftest import SCHEMA, lower

from lekhya.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold_up(digests):
    """(root, proofs): proofs[i] lists the (left, right) of node i from the bottom up."""
    if len(digests) == 1:
        return digests[0], [[]]
    runs = [digests[i : i + 16] for i in range(0, len(digests), 16)]
    root, above = fold_up([sha("".join(r)) for r in runs])
    return root, [[("".join(r[:j]), "".join(r[j + 1 :])), *above[i]] for i, r in enumerate(runs) for j in range(len(r))]


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r, told(r[0], r[3], r[2], r[4], r[1])))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = fold_up([d for _, d in sources[s]])
    root, above = fold_up([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (r, d), own in zip(sources[s], trees[s][1], strict=True):
            steps = own + above[k]
            x = told(r[0], r[3], r[2], r[4], lower(r[1]) if r[1] is not None else None) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else d
            for a, b in steps:
                x = sha(a + x + b)
            out.append((r[0], d, trees[s][0], root, sha("".join(a + b for a, b in steps)), x, x == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(df, rows):
    order = lambda r: str(r)
    got = [tuple(r[c] for c in COLUMNS) for r in merkle.audit(df).collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)
    return got


def test_rows_of_every_kind(odd_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd_docs.collect()]
    check(odd_docs, rows)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 0, 257], [2] * 20, [300, 40, 1]])
def test_trees_of_many_heights(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(1000 * k + i, "Some Text" if rng.random() < 0.5 else "text", None, None if k == 2 else f"s{k}é", i) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(3), rows)
    if len(rows) > 100:
        assert {r[-1] for r in got} == {True, False}


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(7, "Same", "en", "s", 4)] * 40 + [(None, "Same", "en", "s", 4)] * 3
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows)


def test_an_empty_table_has_no_rows(no_docs):
    assert merkle.audit(no_docs).collect() == [] and merkle.build(no_docs).root is None


def test_a_changed_row_changes_the_root(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(50)]
    roots = {merkle.build(spark.createDataFrame(rows[:i] + [(i, "changed", "en", "s", 2)] + rows[i + 1 :], SCHEMA)).root for i in (0, 17, 49)}
    assert len(roots | {merkle.build(spark.createDataFrame(rows, SCHEMA)).root}) == 4
