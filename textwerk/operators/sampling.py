"""Deterministic samples, balanced and length-matched sets, and splits.

The order of chance is the MD5 of id and seed: alike on every cluster and at every size. Ranks are within
strata, and made by bucket of that order, so that a stratum may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


#: Buckets of the order of chance, by the first three hexadecimal digits.
_DIGITS = 3


def ranked(df: DataFrame, strata: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """df with ``rn``, the place of each row in the order of chance within its stratum (all rows, if there is none).

    Nothing sorts a whole stratum: rows are counted by stratum and bucket of the order, the counts before each
    bucket are its offset, and only the rows of a bucket, a 4096th of a stratum, are ranked among themselves."""
    d = df.withColumn("_o", hash_order(id_col, seed)).withColumn("_b", F.substring("_o", 1, _DIGITS))
    keys = [F.col(s) for s in strata]
    counts = d.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)), F.col("_b").alias("_ob"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    same = F.col("_b") == F.col("_ob")
    for i, s in enumerate(strata):
        same &= F.col(s).eqNullSafe(F.col(f"_s{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o", id_col))
    d = d.withColumn("_within", within).join(offsets, same)
    return d.withColumn("rn", F.col("_before") + F.col("_within")).drop("_o", "_b", "_ob", "_before", "_within", *(f"_s{i}" for i in range(len(strata))))


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Index of the bin (lo, hi] a value is in; null outside, so also at the lowest edge."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((value > lo) & (value <= hi), i).otherwise(out)
    return out


def match_by_bin(df: DataFrame, bin_col: str, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """As many rows of either class in each bin as the smaller class has there; bins without one vanish."""
    d = df.where(F.col(bin_col).isNotNull() & F.col(label).isin(0, 1))
    counts = d.groupBy(bin_col).agg(F.count(F.when(F.col(label) == 0, 1)).alias("c0"), F.count(F.when(F.col(label) == 1, 1)).alias("c1"))
    keep = counts.select(F.col(bin_col).alias("_b"), F.least("c0", "c1").alias("_m")).where("_m > 0")
    return ranked(d, [bin_col, label], id_col, seed).join(F.broadcast(keep), F.col(bin_col) == F.col("_b")).where("rn <= _m").drop("rn", "_b", "_m")


def balance_min(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest has."""
    d = df.where(F.col(label).isNotNull())
    least = d.groupBy(label).count().agg(F.min("count").alias("_m"))
    return ranked(d, [label], id_col, seed).crossJoin(F.broadcast(least)).where("rn <= _m").drop("rn", "_m")


def split_by_rank(df: DataFrame, strata: list[str], id_col: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """df with ``split``: of each stratum ceil(fraction n) rows held out, of which half, rounded up, are test and
    the rest val; all others are train."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n")) if strata else df.agg(F.count("*").alias("_n"))
    d = ranked(df, strata, id_col, seed)
    on = None
    for s in strata:
        c = d[s].eqNullSafe(sizes[s])
        on = c if on is None else on & c
    d = d.join(F.broadcast(sizes), on).select(*[d[c] for c in d.columns], sizes["_n"]) if strata else d.crossJoin(F.broadcast(sizes))
    held = F.ceil(F.lit(fraction) * F.col("_n"))
    test = F.ceil(F.lit(0.5) * held)
    return d.withColumn("split", F.when(F.col("rn") <= test, "test").when(F.col("rn") <= held, "val").otherwise("train")).drop("rn", "_n")


SPLITS = (("train", 0.70), ("val", 0.10), ("external_val", 0.10), ("test", 0.05), ("final_holdout", 0.05))


def greedy_group_split(groups: DataFrame, strata: list[str], splits=SPLITS, block: int = 100_000) -> DataFrame:
    """(group_id, strata..., n, split): whole groups (group_id, strata..., n) dealt to splits, each to the one that
    lacks most rows of its truncated target; ties go to the split named first. The groups of a stratum are dealt
    in the order of chance, in blocks of about ``block`` groups, each with targets of its own, so that a stratum
    of any size is dealt by many tasks; up to that size it is one block."""
    import pandas as pd

    sizes = groups.groupBy(*(F.col(s).alias(f"_s{i}") for i, s in enumerate(strata))).agg(F.ceil(F.count("*") / F.lit(block)).alias("_k"))
    same = F.lit(True)
    for i, s in enumerate(strata):
        same &= F.col(s).eqNullSafe(F.col(f"_s{i}"))
    g = groups.join(sizes, same).drop(*(f"_s{i}" for i in range(len(strata))))
    g = g.withColumn("_o", hash_order("group_id")).withColumn("_k", F.pmod(F.xxhash64("group_id"), "_k"))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_o", "group_id"])
        lack = [int(rows["n"].sum() * share + 1e-9) for _, share in splits]
        to = []
        for n in rows["n"]:
            at = lack.index(max(lack))
            lack[at] -= n
            to.append(splits[at][0])
        return rows.assign(split=to)[["group_id", *strata, "n", "split"]]

    kinds = dict(groups.dtypes)
    schema = f"group_id {kinds['group_id']}, " + ", ".join(f"`{s}` {kinds[s]}" for s in strata) + f", n {kinds['n']}, split string"
    return g.groupBy(*strata, "_k").applyInPandas(deal, schema)


def _topped_up(d: DataFrame, kept, n, id_col: str, by: list[str]) -> DataFrame:
    """Rows of d where ``kept``, and of the others, in the order of chance within ``by``, as many as are lacking
    to ``n``; none where there are fewer others than that."""
    d = d.withColumn("_kept", kept).withColumn("_n", n)
    keys = [F.col(s) for s in by]
    short = d.groupBy(*keys).agg((F.max("_n") - F.count(F.when(F.col("_kept"), 1))).alias("_lack"), F.count(F.when(~F.col("_kept"), 1)).alias("_left"))
    if by:
        short = short.select(*(F.col(s).alias(f"_t{i}") for i, s in enumerate(by)), "_lack", "_left")
        on = None
        for i, s in enumerate(by):
            c = F.col(s).eqNullSafe(F.col(f"_t{i}"))
            on = c if on is None else on & c
        d = d.join(F.broadcast(short), on) if len(by) == 1 else d.join(short, on)
    else:
        d = d.crossJoin(F.broadcast(short))  # one row
    d = ranked(d, [*by, "_kept"], id_col)
    return d.where(F.col("_kept") | ((F.col("rn") <= F.col("_lack")) & (F.col("_left") >= F.col("_lack")))).drop("_kept", "_n", "_lack", "_left", "rn", *(f"_t{i}" for i in range(len(by))))


def quantile_sample(df: DataFrame, value: str, label: str, id_col: str, n: int, n_bins: int = 10) -> DataFrame:
    """n rows of each of the classes 0 and 1 of like distribution of ``value``: the quantiles of class 0 make n_bins
    bins [lo, hi) (its greatest value is in none), of each of which n // n_bins rows of either class are taken,
    or all there are; what is lacking is taken from the class's other rows, if they are enough."""
    d = df.where(F.col(value).isNotNull() & F.col(label).isin(0, 1))
    edges = d.where(F.col(label) == 0).agg(F.percentile(value, F.array(*(F.lit(i / n_bins) for i in range(n_bins + 1)))).alias("_e"))
    d = d.crossJoin(F.broadcast(edges))  # one row
    # The bin is the last one that begins at or below the value, and ends above it.
    bins = F.filter(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: (F.col(value) >= F.get("_e", i)) & (F.col(value) < F.get("_e", i + 1)))
    d = ranked(d.withColumn("_bin", F.get(bins, F.lit(0))).drop("_e"), [label, "_bin"], id_col)
    kept = F.col("_bin").isNotNull() & (F.col("_rank") <= n // n_bins)
    return _topped_up(d.withColumnRenamed("rn", "_rank"), kept, F.lit(n), id_col, [label]).drop("_rank")


def stratified_equal(df: DataFrame, group: str, id_col: str, n: int) -> DataFrame:
    """n rows in equal parts of all groups: n // (number of groups) of each, or all it has; what is lacking to n is
    taken from the rows left over of all groups, if they are enough. Rows of no group are left out."""
    d = df.where(F.col(group).isNotNull())
    number = d.agg(F.countDistinct(group).alias("_g"))
    d = ranked(d, [group], id_col).withColumnRenamed("rn", "_rank").crossJoin(F.broadcast(number))  # one row
    return _topped_up(d, F.col("_rank") <= F.floor(F.lit(n) / F.col("_g")), F.lit(n), id_col, []).drop("_rank", "_g")


def paragraphs_of_rows(df: DataFrame, group: str, order: str, text: str, least: int = 3, most: int = 5) -> DataFrame:
    """(group, first, n, text): every least to most consecutive rows of a group joined by a space; the fewer than
    ``least`` rows at a group's end stay single. Lengths are drawn by chance of the group and the place: each
    least + most rows are cut in two at a place in between, so no row waits for the one before."""
    d = df.where(F.col(group).isNotNull() & F.col(text).isNotNull())
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    span = least + most
    block = F.floor(F.col("_i") / span).cast("int")
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(group).cast("string"), block.cast("string"))), 1, 6), 16, 10).cast("int")
    cut = F.lit(least) + chance % (most - least + 1)
    begin = block * span + F.when(F.col("_i") % span < cut, 0).otherwise(cut)
    end = F.least(F.when(F.col("_i") % span < cut, block * span + cut).otherwise((block + 1) * span), F.col("_n"))
    d = d.withColumn("_p", F.when(end - begin >= least, begin).otherwise(F.col("_i")))
    g = d.groupBy(group, "_p").agg(F.array_sort(F.collect_list(F.struct("_i", F.col(order).alias("o"), F.col(text).alias("t")))).alias("_r"))
    return g.select(F.col(group), F.col("_r")[0]["o"].alias("first"), F.size("_r").alias("n"), F.array_join(F.transform("_r", lambda x: x["t"]), " ").alias("text"))


def suite(df: DataFrame, sources: dict[str, int], id_col: str, per_source: int, source: str = "source") -> DataFrame:
    """(id, source, label, part): up to per_source rows of each named source with its label, half of each source, rounded up, as
    external_val and the rest as final_holdout."""
    label = F.create_map(*(F.lit(x) for kv in sources.items() for x in kv))[F.col(source)]
    d = ranked(df.where(F.col(source).isin(*sources)), [source], id_col).where(F.col("rn") <= per_source)
    sizes = d.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("_n"))
    part = F.when(F.col("rn") <= F.ceil(F.col("_n") / 2), "external_val").otherwise("final_holdout")
    return d.join(F.broadcast(sizes), F.col(source) == F.col("_s")).select(id_col, source, label.alias("label"), part.alias("part"))


def budget_schedule(backends: DataFrame, k: int) -> DataFrame:
    """(step, backend): which of the backends (backend, done, budget) the next k items go to, each to the one with the
    fewest so far; ties go to the name, and a backend with a full budget takes none."""
    each = backends.where("budget > done").select("backend", F.explode(F.sequence(F.col("done"), F.col("budget") - 1)).alias("level"))
    return each.withColumn("step", F.row_number().over(Window.orderBy("level", "backend"))).where(F.col("step") <= k).select("step", "backend")


def smoke(train: DataFrame, test: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, part): n training rows and a quarter as many test rows, ten at least, or all there are."""
    some = lambda d, m, part: ranked(d, [], id_col).where(F.col("rn") <= m).select(id_col, F.lit(part).alias("part"))
    return some(train, n, "train").unionByName(some(test, max(10, n // 4), "test"))
