"""The operators' queries with their production parameters, over the whole tables of a directory.

SQL is given (oracle.py) where a result can be said in it; the others' tests hold them against brute force on
small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from . import copies, items, looks, mixing, near, oracle, pii, prose, residue, spans, splits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _evals(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {s: _table(spark, d, s) for s in ("test", "val")}


#: Public vocabulary that p9 counts tokens with.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return prose.quality(_table(spark, d, "train")).withColumn("distance", F.round("distance", 6)).withColumn("contributions", F.to_json(F.transform_values("contributions", lambda _, v: F.round(v, 6))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "p1_found": lambda s, d: residue.found(t(s, d, "train")),
        "p1_kept": lambda s, d: residue.without_residue(t(s, d, "train")),
        "p2_found": lambda s, d: looks.found(t(s, d, "train")),
        "p2_consistent": lambda s, d: looks.consistent(t(s, d, "train")).withColumnRenamed("row", "row_id"),
        "p2_decisions": lambda s, d: looks.decisions(t(s, d, "train")),
        "p3_found": lambda s, d: prose.found(t(s, d, "train")),
        "p3_quality": _quality,
        "p4_found": lambda s, d: splits.found(t(s, d, "train"), _evals(s, d)),
        "p4_report": lambda s, d: splits.report(t(s, d, "train"), _evals(s, d)),
        "p5_found": lambda s, d: copies.copies_found(t(s, d, "train")),
        "p5_collapsed": lambda s, d: copies.collapsed(t(s, d, "train")),
        "p6_found": lambda s, d: near.found(t(s, d, "train")),
        "p6_groups": lambda s, d: near.groups(t(s, d, "train")),
        "p7_found": lambda s, d: spans.found(t(s, d, "train")),
        "p7_coverage": lambda s, d: spans.coverage(t(s, d, "train")),
        "p8_found": lambda s, d: items.leaked(t(s, d, "documents"), t(s, d, "external_eval")),
        "p9_mix": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets"), tokenizer=TOKENIZER)[0],
        "p9_shares": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets"), tokenizer=TOKENIZER)[1],
        "p10_found": lambda s, d: pii.items(t(s, d, "documents")),
        "p10_masked": lambda s, d: pii.masked(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
