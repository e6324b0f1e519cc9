from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, to see that a table's own columns do not clash with them.
CLASHING = ("id", "fp", "key", "lh", "root", "node", "a", "b", "t", "row", "size", "range", "target")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n):
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    near = base[40].split()
    near[10] = "changed"
    rows = [(i, t) for i, t in enumerate(base)] + [(100, base[3]), (101, base[3].upper()), (102, " ".join(near)), (103, None), (104, ""), (105, " \n\t "), (106, "word"), (107, prose(rng, 60_000)), (None, base[5]), (None, None), (8, base[8]), (108, "Ünïcödé ß 😀 " * 9), (109, "x" * 70_000)]
    rows = [(i, t, "en" if t else None, rng.choice(["s1", "s2", "Z", None]), len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, df.n_chars * 0)
    return df.repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
