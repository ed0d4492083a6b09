"""Queries by name, with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread


TEXTS = ("documents", "train", "test", "val")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored predictions with a label and a probability: label, p, pred and what they are grouped by."""
    d = table(spark, sf_dir, "raw_predictions").where("label is not null and ai_probability is not null")
    return d.select("prediction_id", "row_id", "split", "source", "label", F.col("ai_probability").alias("p"), (F.col("ai_probability") >= 0.5).cast("int").alias("pred"), "words")


SCORES = "scores as (select prediction_id, row_id, split, source, label, ai_probability as p, cast(ai_probability >= 0.5 as int) as pred, words from raw_predictions where label is not null and ai_probability is not null)"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql
