"""Exact duplicates, leakage between splits, and near duplicates by runs of three words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, words

#: Bits of a run's hash that choose the bucket it is counted in.
BUCKETS = 20
#: How many runs the prefixes of two texts must share: each adds one run to a prefix, and fewer pairs share more.
SHARED = 3
#: Runs that more texts of a side have are joined in blocks of texts against blocks of texts.
SPLIT = 1000
#: A list of ids is broadcast up to this length, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each group of equal keys. Rows with a null key are left out."""
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    first = d.groupBy(*keys).agg(F.min(order).alias("_first"))
    return d.join(first.select(F.col("_first")), F.col(order) == F.col("_first"), "left_semi")


def cross_class(df: DataFrame, key: str, label: str, drop_from: tuple[int, ...] | None = None) -> DataFrame:
    """df without the rows whose key stands in more than one class: from all classes, or from those given."""
    mixed = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo < _hi").select(F.col(key).alias("_k"))
    if drop_from is None:
        return df.join(mixed, F.col(key) == F.col("_k"), "left_anti")
    return df.join(mixed, (F.col(key) == F.col("_k")) & F.col(label).isin(*drop_from), "left_anti")


def overlap_matrix(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """(split_a, split_b, n_shared, n_b, pct_of_b): distinct keys shared by each two splits, a before b by name.
    One pass: a row for each key with the set of its splits, of which there are few."""
    every = None
    for name, df in splits.items():
        one = df.where(F.col(key).isNotNull()).select(F.lit(name).alias("s"), F.col(key).alias("k"))
        every = one if every is None else every.unionByName(one)
    sets = every.groupBy("k").agg(F.collect_set("s").alias("ss"))
    pairs = sets.select(F.explode("ss").alias("split_b"), "ss").select("split_b", F.explode("ss").alias("split_a"))
    n = pairs.groupBy("split_a", "split_b").count()
    size = n.where("split_a = split_b").select("split_b", F.col("count").alias("n_b"))
    names = sorted(splits)
    grid = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    base = every.sparkSession.createDataFrame(grid, "split_a string, split_b string")
    out = base.join(n, ["split_a", "split_b"], "left").join(size, "split_b", "left")
    return out.select("split_a", "split_b", F.coalesce("count", F.lit(0)).alias("n_shared"), F.coalesce("n_b", F.lit(0)).alias("n_b"), F.round(F.coalesce(100.0 * F.coalesce("count", F.lit(0)) / F.col("n_b"), F.lit(0.0)), 6).alias("pct_of_b"))


def decontaminate(evals: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """The evaluation rows whose key no training row has; rows with a null key stay."""
    return evals.join(train.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def shared_share(evals: DataFrame, train: DataFrame, key: str, warn: float) -> DataFrame:
    """(n, n_shared, pct, warned): evaluation rows whose key a training row has."""
    seen = train.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    n = evals.join(seen, F.col(key) == F.col("_k"), "left").agg(F.count("*").alias("n"), F.count("_hit").alias("n_shared"))
    pct = F.round(F.when(F.col("n") > 0, 100.0 * F.col("n_shared") / F.col("n")).otherwise(0.0), 6)
    return n.select("n", "n_shared", pct.alias("pct")).withColumn("warned", F.col("pct") > warn)


def trigram_hashes(text: Column) -> Column:
    """Hashes of 64 bits of the different runs of three lower-case words; a shorter text is one run."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array_distinct(each))

    return bound(words(F.lower(text)), runs)


def _lists(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches whose last column lists hashes, of about ``most`` hashes: the part, the lengths, the hashes."""

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if b.num_rows > 1 and len(b.column(b.num_columns - 1).flatten()) > most:
            yield from parts(b.slice(0, b.num_rows // 2))
            yield from parts(b.slice(b.num_rows // 2))
        elif b.num_rows:
            yield b

    for batch in batches:
        for b in parts(batch):
            g = b.column(b.num_columns - 1)
            yield b, g.value_lengths().to_numpy(zero_copy_only=False), g.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _run_counts(sets: DataFrame) -> np.ndarray:
    """How many runs fall into each bucket, 12 MB at most whatever the input. Each task reports its sums, but for those of 1."""

    def run(batches):
        c = np.zeros(1 << BUCKETS, dtype=np.int64)
        for _, _, h in _lists(batches):
            c += np.bincount(_bucket(h), minlength=len(c))
        at = np.flatnonzero(c > 1)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array(c[some])], names=["b", "c"])

    sums = sets.select("g").mapInArrow(run, "b int, c bigint").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << BUCKETS, dtype=np.int64)
    out[sums.column("b").to_numpy()] = sums.column("c").to_numpy()
    return out


def _prefixes(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """(h, side, id, size, place): the runs in each text's prefix, the number of its runs and the place of this one among them."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        order = sent.value
        for b, size, h in _lists(batches):
            doc = np.repeat(np.arange(len(size)), size)
            by = np.lexsort((h, order[_bucket(h)], doc))
            place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]  # doc is in order before and after
            h, size = h[by], size[doc]
            keep = place < size - np.ceil(threshold * size - 1e-6) + SHARED
            at = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(size[keep].astype(np.int32)), pa.array(place[keep].astype(np.int32))], names=["h", "side", "id", "size", "place"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("side", "id", "g").mapInArrow(run, f"h bigint, side int, id {kind}, size int, place int")


def _candidates(keys: DataFrame, threshold: float, split: int) -> DataFrame:
    """(eval_id, train_id): the different pairs whose prefixes share enough runs. Columns as from _prefixes(), and
    ``n``, how many rows at most either side has of the run."""
    need = threshold / (1 + threshold) * (F.col("x.size") + F.col("y.size")) - 1e-6

    def join(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
        near = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) > need - SHARED
        near &= F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size") - 1e-6
        for k in ("h", *on):
            near &= F.col(f"x.{k}") == F.col(f"y.{k}")
        return x.alias("x").join(y.alias("y"), near).select(F.col("x.id").alias("eval_id"), F.col("y.id").alias("train_id"), F.least(F.lit(SHARED), F.ceil(need)).cast("int").alias("need"))

    def blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        k = F.ceil(F.col("n") / split)
        return df.withColumns({own: F.pmod(F.xxhash64("id"), k), other: F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1))})

    x, y = keys.where("side = 0"), keys.where("side = 1")
    few, many = F.col("n") <= split, F.col("n") > split
    both = join(x.where(few), y.where(few)).unionByName(join(blocks(x.where(many), "p", "q"), blocks(y.where(many), "q", "p"), "p", "q"))
    return both.groupBy("eval_id", "train_id", "need").count().where("count >= need").select("eval_id", "train_id")


def near_jaccard(evals: DataFrame, train: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, split: int = SPLIT) -> DataFrame:
    """(eval_id, train_id, jaccard) with a Jaccard of three-word runs above the threshold. Ids are unique on either side.

    Exact prefix filtering: the runs of a text are put into one order for all texts, those of buckets with few
    runs first. Two texts of a and b runs above the threshold t share at least o = t / (1 + t) (a + b) of them, so
    the first SHARED that they share stand at places i and j with min(a - i, b - j) > o - SHARED, and among the
    first a - ceil(t a) + SHARED and b - ceil(t b) + SHARED, whatever the order is. Only prefixes are shuffled,
    runs that one side alone has go before the join, and candidates are verified on whole sets of hashes.
    """
    kept = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    texts = {side: df.where(F.col(text_col).isNotNull()).select(F.lit(side).alias("side"), F.col(id_col).alias("id"), F.col(text_col).alias("text")) for side, df in enumerate((evals, train))}
    sets = lambda df: df.select(*(c for c in df.columns if c != "text"), trigram_hashes(F.col("text")).alias("g"))
    every = sets(texts[0].unionByName(texts[1]))
    spark = evals.sparkSession
    keys = _prefixes(every, _run_counts(every), threshold).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h")
    n = {side: F.count(F.when(F.col("side") == side, 1)).over(Window.partitionBy("h")) for side in (0, 1)}
    keys = kept(keys.withColumns({"n0": n[0], "n1": n[1]}).where("n0 > 0 and n1 > 0").select("h", "side", "id", "size", "place", F.greatest("n0", "n1").alias("n")))
    keys.count()  # made here once; the stages of the join, side by side, would each make it
    pairs = kept(_candidates(keys, threshold, split))
    pairs.count()
    keys.unpersist()

    def verifiable(side: int, name: str, g: str) -> DataFrame:
        ids = kept(pairs.select(F.col(name).alias("id")).distinct())
        some = texts[side].join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
        return sets(some).select(F.col("id").alias(name), F.col("g").alias(g))

    full = pairs.join(verifiable(0, "eval_id", "ga"), "eval_id").join(verifiable(1, "train_id", "gb"), "train_id")
    both = F.size(F.array_intersect("ga", "gb")).cast("double")
    return full.withColumn("j", both / (F.size("ga") + F.size("gb") - both)).where(F.col("j") > threshold).select("eval_id", "train_id", F.round("j", 6).alias("jaccard"))
