"""Problem 9: mixing sources to target weights.

Hash-threshold histograms. The tokens of each source are summed by hash bucket, the nested budget thresholds
of the source are found in these sums, only the boundary bucket is refined by further bits of the hash, and
the documents are chosen by a filter on their hash; nothing is sorted, and a larger budget's choice contains
a smaller one's. A source whose share asks for more than its tokens is taken whole as often as fits, and in
part once more, never more often than its max_repeats.

The budget is the largest at which every source that has documents reaches its share, unless a smaller or
larger one is given; with a larger one, sources whose max_repeats bind stay below their share.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .shared import cut, kept, small

BITS, LEVELS = 10, 6
#: Splits a text into pieces before merges, as public byte-level tokenizers do.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens, h): the size of each text in tokens and the 60-bit hash it is chosen by. Null and
    blank texts have no row. tokenizer: path of a public vocabulary of byte-level ranks; the driver reads it (a
    few MB at most, which is checked) and sends it to the tasks."""
    if os.path.getsize(tokenizer) > 32 << 20:
        raise ValueError(f"{tokenizer} is no vocabulary of byte-level ranks")
    with open(tokenizer, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        code = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def fn(b: pa.RecordBatch) -> dict:
            n = [len(code.encode_ordinary(t.encode("utf-8", "replace").decode())) for t in b.column(2).to_pylist()]
            return {"doc_id": b.column(0), "source": b.column(1), "tokens": n}

        return fn

    src = df.where(F.col(text_col).rlike(r"\S")).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col))
    return map_batches(src, make, "doc_id bigint, source string, tokens bigint").withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id")), 64 - BITS * LEVELS))


def quotas(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """(source, share, max_repeats, total, quota): tokens that each source with a target is to contribute. A
    source given twice counts with its first row in order of share; null or non-positive shares ask nothing."""
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").cast("double").alias("share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    s = t.join(sizes.groupBy("source").agg(F.sum("tokens").alias("total")), "source", "left").fillna(0, ["total"])
    cap = F.col("total") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    if budget is None:
        least = s.where("total > 0 and max_repeats > 0").agg(F.min(cap / F.col("share")).alias("budget"))
        s = s.crossJoin(F.broadcast(least))  # one row
    else:
        s = s.withColumn("budget", F.lit(float(budget)))
    return s.withColumn("quota", F.floor(F.least(F.coalesce(F.col("budget"), F.lit(0.0)) * F.col("share") + 1e-6, cap)).cast("bigint")).drop("budget")


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, whole, bound): how often each source is taken whole, and the hash below which a document is
    taken once more. Each level sums the tokens of the boundary bucket alone, by BITS further bits; what is
    kept is a row for a source."""
    state = wanted.where("total > 0").select("source", F.floor(F.col("quota") / F.col("total")).cast("int").alias("whole"), (F.col("quota") % F.col("total")).alias("rest"), F.lit(0).cast("bigint").alias("lead"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = sizes.join(small(state.select("source", "lead")), "source").where(F.shiftright("h", shift + BITS) == F.col("lead"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("n"))
        # At most 2^BITS rows for a source: buckets in order, as nested sums.
        hist = sums.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("hist"))
        walk = "aggregate(hist, struct(rest as rest, cast(null as bigint) as lead), (s, x) -> if(s.lead is null, if(x.n <= s.rest, struct(s.rest - x.n as rest, s.lead as lead), struct(s.rest as rest, x.b as lead)), s))"
        state = state.join(hist, "source", "left").withColumn("w", F.expr(walk))
        past = F.shiftleft(F.col("lead") + 1, BITS)  # every bucket fits: the bound is behind them all
        state = cut(state.select("source", "whole", F.coalesce("w.rest", "rest").alias("rest"), F.coalesce("w.lead", past).alias("lead")))
    return state.select("source", "whole", F.col("lead").alias("bound"), "rest")


def mix(df: DataFrame, targets: DataFrame, budget: float | None = None, *, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(chosen, report). chosen: (doc_id, source, tokens, repeats) of the documents that are in the mixture at
    all. report: (source, target_share, max_repeats, source_tokens, mixed_tokens, actual_share), one row for each
    target, sources without documents too. Documents without a target, with a null source or without a text
    are in neither. The targets are few, one for a source; the report is as many rows."""
    sizes = kept(token_counts(df, tokenizer=tokenizer).where("source is not null"))
    wanted = cut(quotas(sizes, targets, budget))
    bounds = thresholds(sizes, wanted).select("source", "whole", "bound")
    repeats = F.col("whole") + (F.col("h") < F.col("bound")).cast("int")
    chosen = sizes.join(small(bounds), "source").select("doc_id", "source", "tokens", repeats.alias("repeats")).where("repeats > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed"))
    total = got.agg(F.sum("mixed").alias("all"))
    report = wanted.join(got, "source", "left").fillna(0, ["mixed"]).crossJoin(F.broadcast(total))
    report = report.select("source", F.col("share").alias("target_share"), "max_repeats", F.col("total").alias("source_tokens"), F.col("mixed").alias("mixed_tokens"), F.coalesce(F.round(F.col("mixed") / F.col("all"), 6), F.lit(0.0)).alias("actual_share"))
    return chosen, report
