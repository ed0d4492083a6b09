"""Counts and comparisons of n-grams, sentences, characters and lengths by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, words


def docfreq_by_class(df: DataFrame, items: Column, label: str = "label") -> DataFrame:
    """(item, n0, n1): texts of each class that have the item. ``items`` is an array column, repeats ignored."""
    each = df.where(F.col(label).isin(0, 1)).select(F.col(label).alias("l"), F.explode(F.array_distinct(items)).alias("item"))
    return each.groupBy("item").agg(F.count(F.when(F.col("l") == 0, 1)).alias("n0"), F.count(F.when(F.col("l") == 1, 1)).alias("n1"))


def ngram_diff(df: DataFrame, n: int, least: int, k: int | None = 30, text_col: str = "text", label: str = "label") -> DataFrame:
    """(item, n0, n1, pct0, pct1, diff): n-grams in more than ``least`` texts, with their shares of the smaller
    class's texts, by largest difference; ties by the item. The smaller class's size is what both are
    divided by."""
    sizes = df.where(F.col(label).isin(0, 1) & F.col(text_col).isNotNull()).agg(F.least(F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))).alias("m"))
    d = docfreq_by_class(df.where(F.col(text_col).isNotNull()), ngrams(words(F.lower(text_col)), n), label).where(F.col("n0") + F.col("n1") > least).crossJoin(F.broadcast(sizes))
    out = d.select("item", "n0", "n1", F.round(100.0 * F.col("n0") / F.col("m"), 6).alias("pct0"), F.round(100.0 * F.col("n1") / F.col("m"), 6).alias("pct1"))
    out = out.withColumn("diff", F.round(F.abs(F.col("pct1") - F.col("pct0")), 6)).orderBy(F.desc("diff"), "item")
    return out.limit(k) if k else out


def prevalence(df: DataFrame, tests: dict[str, Column], label: str = "label") -> DataFrame:
    """(test, label, n, hits, pct): for each class the texts for which each test holds; null counts as no. One
    pass over the texts, whatever the number of tests."""
    aggs = [F.count("*").alias("n")] + [F.count(F.when(c, 1)).alias(f"t{i}") for i, c in enumerate(tests.values())]
    wide = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(*aggs)
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("test"), F.col(f"t{i}").alias("hits")) for i, k in enumerate(tests))))
    return wide.select("label", "n", long.alias("x")).select("x.test", "label", "n", "x.hits", F.round(100.0 * F.col("x.hits") / F.col("n"), 6).alias("pct"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n): how often each value occurs, null too."""
    return df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
