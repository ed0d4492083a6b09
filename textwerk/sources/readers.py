"""Readers for ragged text files, JSON lines, HTML and encodings; parquet comes with Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_ws, word_count


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A CSV file with a header; all columns are strings, quoted fields may hold line breaks and doubled quotes."""
    df = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"', inferSchema=False)
    return df.select(*columns) if columns else df


def read_ragged(spark: SparkSession, path: str, sep: str, n_cols: int) -> DataFrame:
    """Lines without a header, columns _0.. by position; lines with more fields are skipped, shorter ones filled
    with nulls, empty ones left out. n_cols: fields of the first line."""
    parts = F.split("value", "[" + sep + "]", -1)
    lines = spark.read.text(path).where("trim(value) <> ''").select(parts.alias("p")).where(F.size("p") <= n_cols)
    return lines.select(*(F.get("p", F.lit(i)).alias(f"_{i}") for i in range(n_cols)))


def label_from_text(value: Column) -> Column:
    """human / ai and digits as 0 / 1; all else is null."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("human", "0"), 0).when(v.isin("ai", "1", "machine"), 1)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, source): one object a line; blank lines and rows without a usable label are skipped."""
    df = spark.read.schema("text string, label string, source string").json(path)
    return df.select(F.coalesce("text", F.lit("")).alias("text"), label_from_text(F.col("label")).alias("label"), F.coalesce("source", F.lit("unknown")).alias("source")).where("label is not null")


def read_text_file(spark: SparkSession, path: str) -> DataFrame:
    """(value): each file whole, in one row."""
    return spark.read.text(path, wholetext=True)


def read_with_fallback(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Lines of a file in the first encoding that leaves no replacement character; in the last one otherwise."""
    for e in encodings[:-1]:
        df = spark.read.option("encoding", e).csv(path, sep="\x01", quote="").toDF("value")
        if df.where(F.col("value").contains("�")).isEmpty():
            return df
    return spark.read.option("encoding", encodings[-1]).csv(path, sep="\x01", quote="").toDF("value")


def autodetect_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of the names that df has, letter case ignored."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"none of {candidates} among {df.columns}")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_paragraphs(pages: DataFrame, id_col: str, html_col: str, least: int = 30) -> DataFrame:
    """(id, pos, text): paragraphs of at least ``least`` words, without tags and citations, named entities
    resolved; those with more than two bars are tables and are left out."""
    blocks = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), 1)).alias("pos", "t"))
    t = F.regexp_replace(F.regexp_replace("t", "<[^>]+>", ""), r"\[[0-9]+\]", "")
    for a, b in _ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    d = blocks.withColumn("text", normalize_ws(t)).drop("t")
    return d.where((F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))) <= 2).where(word_count(F.col("text")) >= least)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where it is read in fewer: a small file of one row group would
    keep all work on its texts in one task. Larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def transform_all(spark: SparkSession, paths: list[str], transform, suffix: str, form: str = "parquet") -> list[str]:
    """Each file through the same transform, written beside it with the suffix; the new paths are returned."""
    out = []
    for path in paths:
        stem, dot, ext = path.rpartition(".")
        to = f"{stem}{suffix}.{ext}" if dot and "/" not in ext else f"{path}{suffix}"
        transform(spark.read.format(form).option("header", True).load(path)).write.mode("overwrite").format(form).option("header", True).save(to)
        out.append(to)
    return out


def audit_directories(root: str, needed: dict[str, tuple[str, ...]]) -> list[dict]:
    """For each folder of root, which kinds of files (name: any of these patterns) it has, and a message of those it
    lacks. A look at a local folder of models, on the driver."""
    from pathlib import Path

    rows = []
    for d in sorted(p for p in Path(root).iterdir() if p.is_dir()) if Path(root).is_dir() else []:
        has = {k: any(next(d.glob(g), None) is not None for g in globs) for k, globs in needed.items()}
        rows.append({"name": d.name, **has, "missing": ", ".join(k for k, ok in has.items() if not ok)})
    return rows
