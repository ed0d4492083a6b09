"""Evaluation and calibration of two-class scores: columns label (0/1), p (probability of 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    c = lambda l, p: F.count(F.when((F.col(label) == l) & (F.col(pred) == p), 1))
    return df.groupBy(*by).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))


def with_f1(counts: DataFrame) -> DataFrame:
    """Counts with accuracy, macro F1 over both classes, and precision, recall and F1 of class 1; a class
    without predictions or records has 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = _ratio(2.0 * tp, 2 * tp + fp + fn), _ratio(2.0 * tn, 2 * tn + fp + fn)
    n = tp + fp + fn + tn
    return counts.withColumns({"n": n, "accuracy": F.round(_ratio(1.0 * (tp + tn), n), 6), "precision": F.round(_ratio(1.0 * tp, tp + fp), 6), "recall": F.round(_ratio(1.0 * tp, tp + fn), 6), "f1": F.round(f1, 6), "macro_f1": F.round((f1 + f0) / 2, 6)})


def present_macro_f1(counts: DataFrame) -> DataFrame:
    """Macro F1 over the classes that occur among records or predictions of the slice."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    has1, has0 = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    f1, f0 = _ratio(2.0 * tp, 2 * tp + fp + fn), _ratio(2.0 * tn, 2 * tn + fp + fn)
    return counts.withColumn("macro_f1", F.round((f1 + f0) / (has1 + has0), 6))


def at_thresholds(df: DataFrame, thresholds: list[float], label: str = "label", p: str = "p") -> DataFrame:
    """(threshold, tp, fp, fn, tn): counts at each threshold, from one pass over counts by score: each row's
    number of thresholds reached is what is grouped by, not a copy of the rows for each threshold."""
    ts = sorted(thresholds)
    arr = F.array(*(F.lit(float(t)) for t in ts))
    reached = F.size(F.filter(arr, lambda t: F.col(p) >= t))
    by = df.groupBy(reached.alias("k"), F.col(label).alias("l")).agg(F.count("*").alias("c"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "i int, threshold double")
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).cast("bigint")
    pos = F.col("k") >= F.col("i")
    return F.broadcast(grid).crossJoin(by).groupBy("threshold").agg(s((F.col("l") == 1) & pos).alias("tp"), s((F.col("l") == 0) & pos).alias("fp"), s((F.col("l") == 1) & ~pos).alias("fn"), s((F.col("l") == 0) & ~pos).alias("tn"))


def calibrate(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """(threshold, macro_f1): of 0.01 .. 0.99 the first threshold with the best macro F1."""
    return with_f1(at_thresholds(df, [i / 100 for i in range(1, 100)], label, p)).select("threshold", "macro_f1").orderBy(F.desc("macro_f1"), "threshold").limit(1)


def running(g: DataFrame, by: str, sums: dict[str, str], falling: bool = False, parts: int = 512) -> DataFrame:
    """g with running sums (name: column) in the order of the numbers ``by``, which are different. Nothing sorts all
    rows: ranges between approximate quantiles are summed, what comes before a range is its offset, and only a
    range's rows are sorted."""
    cuts = [float(c) for c in dict.fromkeys(g.approxQuantile(by, [i / parts for i in range(1, parts)], 0.0005))] if parts > 1 else []
    d = g.withColumn("_part", F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: c < F.col(by))))
    order = F.desc if falling else F.asc
    before = Window.orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    offsets = d.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items())).select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_in_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(offsets), "_part")
    return d.select(*g.columns, *((F.col(f"_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums))


def score_counts(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """(p, pos, neg, cum_pos, cum_neg): by falling score."""
    g = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(label)).cast("bigint").alias("pos"), F.sum(1 - F.col(label)).cast("bigint").alias("neg"))
    return running(g, "p", {"cum_pos": "pos", "cum_neg": "neg"}, falling=True)


def roc_auc(df: DataFrame, label: str = "label", p: str = "p", empty_value: float = 0.5) -> DataFrame:
    """(auc): ties count half; empty_value where a class is missing."""
    s = score_counts(df, label, p)
    a = s.agg(F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / F.lit(2.0))).alias("x"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return a.select(F.round(F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("x") / (F.col("np").cast("double") * F.col("nn"))).otherwise(F.lit(empty_value)), 6).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """(ap): precision at each score, weighted by the recall gained there."""
    s = score_counts(df, label, p)
    a = s.agg(F.sum(F.col("pos") * (F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg")))).alias("x"), F.sum("pos").alias("n"))
    return a.select(F.round(F.coalesce(F.col("x") / F.col("n"), F.lit(0.0)), 6).alias("ap"))
