"""Extension: the cleaning loop as a stream. New JSON lines are gated, deduplicated by fingerprint and appended.

The watermark bounds what deduplication remembers; a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators.quality import POLICIES, gate

SCHEMA = "text string, label int, source string, loaded_at timestamp"


def clean_stream(spark: SparkSession, path: str, policy: str = "clean_500k", late: str = "1 day") -> DataFrame:
    raw = spark.readStream.schema(SCHEMA).json(path).withWatermark("loaded_at", late)
    kept = gate(raw, POLICIES[policy]).where("reject_reason is null").withColumn("fp", fingerprint(F.col("clean_text")))
    return kept.dropDuplicatesWithinWatermark(["fp"])


def counts_stream(spark: SparkSession, path: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records by window of arrival and source."""
    raw = spark.readStream.schema(SCHEMA).json(path).withWatermark("loaded_at", late)
    return raw.groupBy(F.window("loaded_at", window), "source").count()
