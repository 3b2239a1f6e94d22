"""The column pipeline over streams: an extension, batch users don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.resolve import normalized


def normalized_stream(texts: DataFrame) -> DataFrame:
    """normalized() of a stream of (doc_id, text): stateless, so any sink and trigger will do."""
    return normalized(texts)


def decision_counts(decided: DataFrame, time: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of decisions in tumbling windows of a stream (time, decision); rows later than `late` are dropped by the watermark, which also bounds the state."""
    at = F.col(time).cast("timestamp")
    return decided.withColumn("_t", at).withWatermark("_t", late).groupBy(F.window("_t", size).alias("w"), "decision").agg(F.count("*").alias("n")).select("w.start", "w.end", "decision", "n")
