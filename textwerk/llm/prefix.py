"""Pairs of texts that can be similar enough, by a prefix filter that loses none.

The different runs of a text are put into one order for all texts, rare ones first. Two texts of a and b runs
and a similarity of at least t share at least o = t / (1 + t) (a + b) of them, and at least t a and t b. After
the k-th run that they share, in this order, o - k shared ones remain, so it stands at places i and j (from 0)
with min(a - i, b - j) > o - k: the first a - ceil(t a) + k runs of the one and the first b - ceil(t b) + k of
the other share at least k runs at such places, or all o where that is less, whatever the edits are and
whatever the order is. Only pairs that do are candidates; k is SHARED.

The order is by the counts of a fixed number of BUCKETS that the runs are hashed into, then by hash: a run
that many texts have stands late, one that shares its bucket with such a run too, which costs time and no pair.
Runs that more than ``split`` texts have are joined in blocks of texts against blocks of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, pieces
from .forms import batch_runs, distinct

#: Bits of a run's hash that choose its bucket.
BUCKETS = 20
#: How many runs the prefixes of two texts must share: each adds one run to a prefix, and fewer pairs share more.
SHARED = 3
SPLIT = 1000


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def run_counts(texts: DataFrame, n: int) -> np.ndarray:
    """How many runs of n words fall into each bucket. Each task reports its sums, but for those of 1."""

    def run(batches):
        c = np.zeros(1 << BUCKETS, dtype=np.int64)
        for batch in batches:
            for b in pieces(batch):
                _, h = batch_runs(b.column(0), n)
                c += np.bincount(_bucket(h), minlength=len(c))
        at = np.flatnonzero(c > 1)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array(c[some])], names=["b", "c"])

    sums = texts.select("text").mapInArrow(run, "b int, c bigint").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << BUCKETS, dtype=np.int64)
    out[sums.column("b").to_numpy()] = sums.column("c").to_numpy()
    return out


def prefixes(texts: DataFrame, counts: np.ndarray, threshold: float, n: int) -> DataFrame:
    """(h, row, size, place): the runs of n words in each text's prefix, with the number of its different runs and
    the place of this one among them."""
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def make():
        order = sent.value

        def fn(b: pa.RecordBatch) -> dict | None:
            doc, h = distinct(*batch_runs(b.column(1), n))
            if not len(h):
                return None
            by = np.lexsort((h, order[_bucket(h)], doc))
            doc, h = doc[by], h[by]
            size = np.bincount(doc, minlength=b.num_rows)
            place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            size = size[doc]
            keep = place < size - np.ceil(threshold * size - 1e-6) + SHARED
            return {"h": h[keep].view(np.int64), "row": b.column(0).to_numpy(zero_copy_only=False)[doc[keep]], "size": size[keep], "place": place[keep]}

        return fn

    return map_batches(texts.select("row", "text"), make, "h bigint, row bigint, size int, place int")


def paired(x: DataFrame, y: DataFrame, threshold: float, ordered: bool, split: int) -> DataFrame:
    """(a, b): the different pairs of a row of x and one of y whose prefixes share enough runs to be similar
    enough; with ``ordered`` only those with a < b. Columns as from prefixes(), and ``n``, how many rows at
    most either side has of the run."""
    need = threshold / (1 + threshold) * (F.col("x.size") + F.col("y.size")) - 1e-6

    def join(x, y, *keys):
        x, y = x.alias("x"), y.alias("y")
        near = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) > need - SHARED
        near &= F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size") - 1e-6
        for k in ("h", *keys):
            near &= F.col(f"x.{k}") == F.col(f"y.{k}")
        if ordered:
            near &= F.col("x.row") < F.col("y.row")
        return x.join(y, near).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"), F.least(F.lit(SHARED), F.ceil(need)).cast("int").alias("need"))

    def blocks(df, own, other):
        k = F.ceil(F.col("n") / split)
        return df.where(F.col("n") > split).withColumns({own: F.pmod(F.xxhash64("row"), k), other: F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1))})

    few = join(x.where(F.col("n") <= split), y.where(F.col("n") <= split))
    both = few.unionByName(join(blocks(x, "p", "q"), blocks(y, "q", "p"), "p", "q"))
    return both.groupBy("a", "b", "need").count().where("count >= need").select("a", "b")
