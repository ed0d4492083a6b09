"""Problem 5, and the classes of same texts that the other operators start from.

Recursive radix partitioning on canonical bytes. The canonical bytes of a text are the first HEAD bytes
of its same-text key and then the 128-bit digest of the whole key, so that any two different keys differ
within HEAD + 16 bytes and no long text is shuffled. Buckets are prefixes of these bytes. A bucket with
more than ``bucket_rows`` rows is split by further bytes until each fits; one that cannot be split, as
all its rows are copies of one text, is dealt out by row id, its parts counted apart and their counters
added. Each bucket is then counted in a trie with counters at its terminals. The head keeps buckets of
equal beginnings together; below it the digest's bytes are spread evenly, so the recursion always ends.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .forms import batch_keys
from .shared import BROADCAST_IDS, cut, kept, released

HEAD = 32
#: Depths of the recursion in bytes. The first two bytes of the head, more of it, then into the digest.
DEPTHS = (3, 8, 16, HEAD, HEAD + 2, HEAD + 4)


def canonical(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(row, key BINARY, keep...): the canonical bytes of each text that has a letter or digit. Null and
    blank texts, and texts of punctuation alone, have no row here."""
    kinds = dict(df.dtypes)
    src = df.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"), *(F.col(k).alias(f"k_{k}") for k in keep)).where(F.col("text").isNotNull())

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            keys, at = [], []
            for i, k in enumerate(batch_keys(b.column(1))):
                if k is not None:
                    k = k.encode("utf-8", "surrogatepass")
                    keys.append(k[:HEAD].ljust(HEAD, b"\0") + xxhash.xxh3_128_digest(k))
                    at.append(i)
            took = b.take(pa.array(at, type=pa.int64()))
            return {"row": took.column(0), "key": pa.array(keys, type=pa.binary())} | {k: took.column(2 + i) for i, k in enumerate(keep)}

        return fn

    schema = f"row {kinds[id_col]}, key binary" + "".join(f", `{k}` {kinds[k]}" for k in keep)
    return map_batches(src, make, schema)


def radix_buckets(keys: DataFrame, bucket_rows: int) -> DataFrame:
    """keys with ``bucket`` (the shortest prefix of ``key`` at one of DEPTHS with at most bucket_rows rows,
    else the longest) and ``parts`` (how many parts of about bucket_rows rows the bucket is dealt out in if it has
    more rows at the longest depth, which are copies of one text; else 0). Only the rows of oversized buckets take part in the next split; the
    oversized prefixes of a depth are fewer than rows / bucket_rows."""
    part, out, depth = keys, keys, F.lit(0)
    for i, d in enumerate(DEPTHS):
        prefix = F.substring("key", 1, d)
        over = kept(part.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("rows")).where(F.col("rows") > bucket_rows))
        n = over.count()
        small = F.broadcast(over) if n <= BROADCAST_IDS else over
        if i:
            out = out.withColumn("depth", depth)
        if not n:
            return out.withColumn("parts", F.lit(0).cast("bigint")).withColumn("bucket", F.expr(f"substring(key, 1, if(depth > 0, depth, {d}))") if i else prefix).drop("depth")
        out = out.join(small.select(F.col("prefix").alias("p"), F.col("rows").alias("is_over")), prefix == F.col("p"), "left")
        if not i:
            out = out.withColumn("depth", F.lit(0))
        out = out.withColumn("depth", F.when((F.col("depth") == 0) & F.col("is_over").isNull(), d).otherwise(F.col("depth"))).drop("p", "parts")
        out = out.withColumnRenamed("is_over", "parts")
        depth = F.col("depth")
        part = part.join(small, prefix == F.col("prefix"), "left_semi")
    parts = F.when(F.col("depth") == 0, F.ceil(F.col("parts") / bucket_rows)).otherwise(0).cast("bigint")
    return out.withColumn("parts", parts).withColumn("bucket", F.expr(f"substring(key, 1, if(depth > 0, depth, {DEPTHS[-1]}))")).drop("depth")


class Trie:
    """Keys of one bucket. A node is a dict from the next bytes to a node, or holds up to ``burst`` rests of
    keys until it is split; the rest's entry is the terminal: [smallest row, rows]."""

    def __init__(self, burst: int = 64):
        self.burst, self.root = burst, [{}, None]  # [rests, children by byte]

    def add(self, key: bytes, row: int) -> list:
        node, at = self.root, 0
        while node[1] is not None:
            node = node[1].setdefault(key[at], [{}, None])
            at += 1
        rest = key[at:]
        end = node[0].get(rest)
        if end is None:
            end = node[0][rest] = [row, 0]
            if len(node[0]) > self.burst and len(rest) > 1:
                children: dict = {}
                for r, e in node[0].items():
                    children.setdefault(r[0], [{}, None])[0][r[1:]] = e
                node[0], node[1] = {}, children
        if row < end[0]:
            end[0] = row
        end[1] += 1
        return end


def count_in_tries(buckets: DataFrame) -> DataFrame:
    """(row, key, grp, part, first, copies): each row with the smallest row and the number of rows of its
    key and group in its bucket. ``part`` is -1, or which part of a hot bucket these figures are of."""

    def run(batches):
        bucket, rows, keys, grps, part = None, [], [], [], -1

        def ended():
            trie = Trie()
            ends = [trie.add(k + b"\1" + g, r) for k, g, r in zip(keys, grps, rows)]
            cols = (rows, keys, grps, [part] * len(rows), [e[0] for e in ends], [e[1] for e in ends])
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=["row", "key", "grp", "part", "first", "copies"])

        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            for bk, p, k, g, r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (bk, p) != bucket:
                    if rows:
                        yield ended()
                    bucket, part, rows, keys, grps = (bk, p), p, [], [], []
                rows.append(r)
                keys.append(k)
                grps.append(g)
        if rows:
            yield ended()

    src = buckets.select("bucket", "part", "key", "grp", "row")
    return src.mapInArrow(run, "row bigint, key binary, grp binary, part bigint, first bigint, copies bigint")


def same_texts(df: DataFrame, id_col: str = "row_id", text_col: str = "text", by: str | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """(row, first, copies) for each row with a letter or digit in its text: the smallest row of its group of
    same texts, and the number of rows of the group. The result is cut off from how it was made.

    by: a column in which the rows of a group must agree too; null agrees with null. Ids are BIGINT and
    unique. Null, blank and punctuation-only texts are left out. An empty table gives an empty result. A
    group of copies of any size is dealt out over tasks in parts of about bucket_rows rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = canonical(df, id_col, text_col, *([by] if by else []))
    grp: Column = F.coalesce(F.encode(F.concat(F.lit("="), F.col(by).cast("string")), "utf-8"), F.encode(F.lit(""), "utf-8")) if by else F.encode(F.lit(""), "utf-8")
    keys = kept(keys.select(F.col("row").cast("bigint"), "key", grp.alias("grp")))
    part = F.when(F.col("parts") > 0, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(F.lit(-1)).cast("bigint")
    buckets = radix_buckets(keys, bucket_rows).withColumn("part", part)
    counted = kept(count_in_tries(buckets.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part")))
    if counted.where("part >= 0").isEmpty():
        out = cut(counted.select("row", "first", "copies"))
        released(keys, counted)
        return out
    hot = counted.where("part >= 0")
    sums = hot.where("row = first").dropDuplicates(["key", "grp", "part"]).groupBy("key", "grp").agg(F.min("first").alias("f"), F.sum("copies").alias("c"))
    fixed = hot.join(sums, ["key", "grp"]).select("row", F.col("f").alias("first"), F.col("c").alias("copies"))
    out = cut(counted.where("part < 0").select("row", "first", "copies").unionByName(fixed))
    released(keys, counted)
    return out


def copies_found(df: DataFrame, id_col: str = "row_id", text_col: str = "text", label_col: str = "label", **how) -> DataFrame:
    """p5_found: (first_row_id, row_id) for each record but the first of a group of same texts with the same
    label. Null labels agree with one another."""
    return same_texts(df, id_col, text_col, label_col, **how).where("row > first").select(F.col("first").alias("first_row_id"), F.col("row").alias("row_id"))


def collapsed(df: DataFrame, id_col: str = "row_id", text_col: str = "text", label_col: str = "label", **how) -> DataFrame:
    """One record for each group of same texts with the same label, the one with the smallest id, as stored,
    and ``n_copies``, the number of its records. A text of signs alone has no letters to be the same in: its record
    stays, as one of a kind. Records with a null or blank text are left out."""
    groups = same_texts(df, id_col, text_col, label_col, **how).select(F.col("row").alias("_row"), F.col("first").alias("_first"), F.col("copies").alias("n_copies"))
    out = df.where(F.col(text_col).rlike(r"\S")).join(groups, F.col(id_col) == F.col("_row"), "left").where("_row is null or _row = _first")
    return out.withColumn("n_copies", F.coalesce("n_copies", F.lit(1)).cast("bigint")).drop("_row", "_first")
