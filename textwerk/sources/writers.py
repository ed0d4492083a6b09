"""Sinks: split tables, reports, lists, appended checkpoints, thresholds."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, split_col: str = "split", form: str = "parquet") -> None:
    """One folder for each split."""
    df.write.mode("overwrite").partitionBy(split_col).format(form).option("header", True).option("escape", '"').save(path)


def write_report(report: dict[str, DataFrame], path: str, title: str = "Report") -> dict:
    """Small result tables as one JSON file and one Markdown file beside it; what was written is returned."""
    data = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in report.items()}
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str))
    lines = [f"# {title}"]
    for name, rows in data.items():
        lines += ["", f"## {name}", ""]
        if rows:
            cols = list(rows[0])
            lines += ["| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)] + ["| " + " | ".join(str(r[c]) for c in cols) + " |" for r in rows]
    Path(path).with_suffix(".md").write_text("\n".join(lines) + "\n")
    return data


def write_list(df: DataFrame, col: str, path: str) -> None:
    """One item a line."""
    df.select(F.col(col).cast("string")).write.mode("overwrite").text(path)


def append_new(df: DataFrame, path: str, key: str = "text") -> DataFrame:
    """Appends the rows whose key isn't in the JSON lines at path yet, and returns them: an interrupted run
    goes on where it ended."""
    spark: SparkSession = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):  # wherever the path is
        df = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti")
    df = df.dropDuplicates([key]).persist()
    df.write.mode("append").json(path)
    return df


def write_threshold(value: float, path: str) -> None:
    Path(path).write_text(f"{value:.4f}")


def read_threshold(path: str, fallback: float = 0.5) -> float:
    try:
        return float(Path(path).read_text().strip())
    except (OSError, ValueError):
        return fallback
