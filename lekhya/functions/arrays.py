"""Functions of sample arrays and label arrays, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekhya import lexicon as lx


def time_slice(samples: Column, start: Column, end: Column, rate: int = lx.SAMPLE_RATE) -> Column:
    """Samples from start to end seconds, cut at the ends of the array."""
    first = (start * rate).cast("int")
    return F.slice(samples, first + 1, F.greatest(F.lit(0), (end * rate).cast("int") - first))


def rms(samples: Column) -> Column:
    """Root mean square; null of no samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples)))


def loud(samples: Column, least: float = lx.MIN_RMS) -> Column:
    return F.coalesce(rms(samples) >= least, F.lit(False))


def pad(values: Column, size: Column, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(size - F.size(values), F.lit(0))))


def mask(values: Column, filler: int, lead: int = 4, ignore: int = -100) -> Column:
    """Labels with the filler and the first `lead` places ignored."""
    return F.transform(values, lambda x, i: F.when((x == filler) | (i < lead), F.lit(ignore)).otherwise(x))


def unmask(values: Column, filler: int, ignore: int = -100) -> Column:
    return F.transform(values, lambda x: F.when(x == ignore, F.lit(filler)).otherwise(x))
