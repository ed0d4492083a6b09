"""Problem 6: groups of texts that differ by small edits.

Prefix filter over the exact runs of words (prefix.py), then verification of each candidate pair on all of its
runs: every pair at the threshold is found, also in large groups of near copies, whose shared wording many
texts have. Signatures of minimum hashes with deletion variants, which stood here before, had to leave out runs
of many texts to stay small, and lost the pairs that share mainly those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_batches
from .copies import same_texts
from .forms import batch_runs, distinct
from .groups import components
from .prefix import SPLIT, paired, prefixes, run_counts
from .shared import kept, released, restricted


def similar_pairs(texts: DataFrame, threshold: float = 0.6, n: int = 3, split: int = SPLIT) -> DataFrame:
    """(a, b, similarity), a < b: pairs of rows of texts (row BIGINT unique, text STRING) whose texts have at
    least the given similarity of runs of n words. Pass one row for each different text."""
    keys = prefixes(texts, run_counts(texts, n), threshold, n).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    # Runs that one text alone has pair nothing: most go before the join, which finds the rest in place.
    keys = kept(keys.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1"))
    keys.count()  # made here once; the stages of the join, side by side, would each make it
    pairs = kept(paired(keys, keys, threshold, True, split))
    pairs.count()
    released(keys)
    return verified(pairs, texts, threshold, n)


def run_sets(texts: DataFrame, n: int) -> DataFrame:
    """(row, size, runs): the different runs of n words of each text, as sorted 64-bit hashes in bytes."""

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            doc, h = distinct(*batch_runs(b.column(1), n))
            size = np.bincount(doc, minlength=b.num_rows)
            ends = np.r_[0, np.cumsum(size)]
            return {"row": b.column(0), "size": size, "runs": [h[a:z].tobytes() for a, z in zip(ends, ends[1:])]}

        return fn

    return map_batches(texts.select("row", "text"), make, "row bigint, size int, runs binary")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Of the pairs (a, b) of rows of texts, those similar enough, with their exact similarity. Each text's runs
    are made once; pairs whose numbers of runs are too far apart are left out before the runs are sent."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = kept(run_sets(restricted(texts, ids), n))
    sets.count()  # made here once; stages that run side by side would each make them
    sized = pairs.join(sets.select(F.col("row").alias("a"), F.col("size").alias("na")), "a").join(sets.select(F.col("row").alias("b"), F.col("size").alias("nb")), "b")
    near = sized.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b")
    both = near.join(sets.select(F.col("row").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("row").alias("b"), F.col("runs").alias("rb")), "b").select("a", "b", "ra", "rb")

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            sim = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(p) and len(q):
                    common = np.count_nonzero(p.take(p.searchsorted(q), mode="clip") == q)
                    sim[i] = common / (len(p) + len(q) - common)
            ok = pa.array(sim >= threshold)
            return {"a": b.column(0).filter(ok), "b": b.column(1).filter(ok), "similarity": sim[sim >= threshold]}

        return fn

    return map_batches(both, make, "a bigint, b bigint, similarity double")


def near_duplicates(df: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.6, n: int = 3, **how) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of first rows of groups of same texts, and (row, first)
    for every row with a text. Ids are BIGINT and unique; null and blank texts are in neither."""
    members = same_texts(df, id_col, text_col).select("row", "first")
    texts = df.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text"))
    texts = restricted(texts, members.where("row > first").select("row"), "left_anti")
    return similar_pairs(texts, threshold, n, **how), members


def found(df: DataFrame, **how) -> DataFrame:
    """p6_found: (row_id_a, row_id_b), smaller first: all records of the one text with all of the other."""
    pairs, members = near_duplicates(df, **how)
    a, b = (members.select(F.col("row").alias(f"row_{c}"), F.col("first").alias(c)) for c in "ab")
    rows = pairs.join(a, "a").join(b, "b")
    return rows.select(F.least("row_a", "row_b").alias("row_id_a"), F.greatest("row_a", "row_b").alias("row_id_b"))


def groups(df: DataFrame, **how) -> DataFrame:
    """(row_id, group_id, n_links): one row for each record with a text; group_id is the smallest row_id of
    its group, which is joined by links of enough similarity and by same texts; n_links counts the different
    other texts that the record's text is similar enough to."""
    pairs, members = near_duplicates(df, **how)
    pairs = kept(pairs.select("a", "b"))
    top = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").count()
    out = members.join(top.withColumnRenamed("node", "first"), "first", "left").join(links, "first", "left")
    return out.select(F.col("row").alias("row_id"), F.coalesce("component", "first").alias("group_id"), F.coalesce("count", F.lit(0)).cast("bigint").alias("n_links"))
