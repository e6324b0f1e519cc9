"""Scoring of transcripts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lekhya.functions import text
from lekhya.operators import scoring


def score_stream(pairs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each arriving pair, scored, to Parquet at out; runs until the source's present files are read. Stateless, so it scales as the batch form does."""
    return scoring.score(pairs, compose=text.nfc_native).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
