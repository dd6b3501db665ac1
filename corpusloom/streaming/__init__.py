"""Streaming forms of operators (an extension: the batch forms are the operators' own)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import hygiene


def new_texts(stream: DataFrame, text_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose text hasn't come within the delay; the state is bounded by the watermark."""
    keyed = stream.withColumn("sha256", F.sha2(F.col(text_col).cast("binary"), 256))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["sha256"])


def hygiene_counts(stream: DataFrame, text_col: str, time_col: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Findings of each check per window."""
    c = hygiene.counts(F.col(text_col))
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window)).agg(*[F.sum(v).alias(k) for k, v in c.items()], F.count("*").alias("texts"))
