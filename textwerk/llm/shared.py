"""Cutting the lineage through the folder that all executors share, and joins by the size of one side."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of ids is broadcast up to this length (16 MB of ids), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir. Where that is unset, a session on this machine alone, as
    in tests, gets a temporary folder; on a cluster, whose executors would not see it, that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df persisted in memory, on disk where that is short; recomputed where an executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def released(*dfs: DataFrame) -> None:
    """Frees what kept() holds, once all that was made from it is cut off or kept itself."""
    for df in dfs:
        df.unpersist()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast where it is counted to have at most so many (short) rows, as it is otherwise."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def restricted(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose ``row`` is (left_semi) or isn't (left_anti) among ids (row), which are distinct. The ids
    are counted first: a short list goes to df where it lies, so that its texts aren't shuffled."""
    ids = kept(ids)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "row", how)
