"""Splits that keep groups whole."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of which the order by hash is settled in one place; more are first narrowed down by prefix.
FEW = 10_000


def group_split(rows: DataFrame, key: str = "recording_id", fraction: float = 0.1, salt: str = "") -> DataFrame:
    """rows with split: 'val' for the fraction of groups (rounded up) of the least md5 of salt and key, else 'train'.

    A group is on one side only. The cut is found by counting hash prefixes, so no task sorts
    all groups; a null key is a group of its own, of the md5 of the salt alone.
    """
    mark = F.md5(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    groups = rows.select(mark.alias("h")).distinct()
    total = groups.count()
    want, prefix, last = math.ceil(fraction * total - 1e-9), "", "g" if fraction > 0 else ""
    if 0 < want < total:
        rest, size = groups, total
        while size > FEW and len(prefix) < 32:
            counts = rest.groupBy(F.substring("h", 1, len(prefix) + 3).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
            for r in counts:
                if r.n >= want:
                    break
                want -= r.n
            prefix, size = r.p, r.n
            rest = groups.where(F.startswith("h", F.lit(prefix)))
        last = sorted(r.h for r in rest.collect())[want - 1]
    elif not want:
        last = ""
    return rows.withColumn("split", F.when(mark <= last, "val").otherwise("train"))
