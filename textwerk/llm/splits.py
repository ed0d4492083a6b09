"""Problem 4: same or near-same records across splits.

Aho-Corasick automata over sharded normalised evaluation passages scan the training texts. A normalised text
is its words; the passages of an evaluation record are all its runs of three words, the unit that similarity
counts. A match is a passage that the training text has too: the different passages matched give the pair's
similarity, and the merged intervals that they cover give the coverage of the evaluation record. What the
automaton matches is exact, so nothing else decides a pair.

A shard holds some evaluation texts and scans the training texts that can match one of them: those that the
prefix filter (prefix.py) sends there, which loses no pair at the threshold, whatever the length of the texts
and however many training texts share a passage. An evaluation text with many candidates is in several
shards. Same texts are collapsed before and expanded after.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_batches
from .copies import same_texts
from .forms import words
from .prefix import SPLIT, paired, prefixes, run_counts
from .shared import cut, kept, restricted

def candidates(train: DataFrame, evals: DataFrame, threshold: float, n: int, split: int = SPLIT) -> DataFrame:
    """(t, e): training and evaluation texts whose prefixes share enough runs of n words."""
    counts = run_counts(train.select("text").unionByName(evals.select("text")), n)
    both = prefixes(train, counts, threshold, n).withColumn("side", F.lit(0)).unionByName(prefixes(evals, counts, threshold, n).withColumn("side", F.lit(1)))
    w = Window.partitionBy("h")  # spilled where a run is of many texts; counts alone, of rows of 24 bytes
    both = both.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h").withColumns({"n_train": F.sum(1 - F.col("side")).over(w), "n_eval": F.sum("side").over(w)})
    both = kept(both.where((F.col("n_train") > 0) & (F.col("n_eval") > 0)).withColumn("n", F.greatest("n_train", "n_eval")).drop("n_train", "n_eval"))
    both.count()  # made here once; the stages of the join, side by side, would each make it
    return paired(both.where("side = 0"), both.where("side = 1"), threshold, False, split).select(F.col("a").alias("t"), F.col("b").alias("e"))


#: A word is four letters, each of an alphabet of its own, so that no match begins or ends within a word and no node of
#: an automaton has many children. The first word, which no evaluation text has, is all words outside of them.
LETTERS = tuple([chr(0x4E00 + 64 * i + k) for k in range(64)] for i in range(4))
OTHER = "".join(a[0] for a in LETTERS)
#: How many pairs of one evaluation text a shard takes at most, about.
SHARD_PAIRS = 2000


def symbol(word: str, symbols: dict[str, str]) -> str:
    """The letters of a word, given to it when it is first met."""
    s = symbols.get(word)
    if s is None:
        k = len(symbols) + 1
        s = symbols[word] = LETTERS[0][k >> 18] + LETTERS[1][k >> 12 & 63] + LETTERS[2][k >> 6 & 63] + LETTERS[3][k & 63]
    return s


def scan(pairs: list[tuple[int, int]], train: dict[int, str], evals: dict[int, str], threshold: float, n: int) -> list[tuple]:
    """(t, e, coverage, similarity) of the pairs (t, e) that are similar enough: one automaton of all passages of
    the evaluation texts, which each training text is led through once. Texts of fewer than n words have no
    passage: they are similar to the same text only."""
    symbols: dict[str, str] = {}
    auto = ahocorasick.Automaton()
    owners: dict[str, dict[int, list[int]]] = {}  # passage -> evaluation text -> where it begins there
    length, different = {}, {}
    for e, text in evals.items():
        ws = [symbol(w, symbols) for w in words(text)]
        length[e] = len(ws)
        mine = set()
        for a in range(len(ws) - n + 1):
            p = "".join(ws[a : a + n])
            mine.add(p)
            owners.setdefault(p, {}).setdefault(e, []).append(a)
        different[e] = len(mine)
    if not owners:
        return []
    for p in owners:
        auto.add_word(p, p)
    auto.make_automaton()
    asked: dict[int, set] = {}
    for t, e in pairs:
        asked.setdefault(t, set()).add(e)
    out = []
    for t, want in asked.items():
        ws = words(train[t])
        matched = {p for _, p in auto.iter("".join([symbols.get(w, OTHER) for w in ws]))}
        total = len(set(zip(*(ws[i:] for i in range(n)))))
        count: dict[int, int] = {}
        for p in matched:
            have = owners[p]
            for e in have if len(have) < len(want) else want:
                if e in have and e in want:
                    count[e] = count.get(e, 0) + 1
        for e, c in count.items():
            if (sim := c / (total + different[e] - c)) >= threshold:
                got = upto = 0
                for a in sorted(a for p in matched if e in owners[p] for a in owners[p][e]):
                    got += a + n - max(a, upto)
                    upto = a + n
                out.append((t, e, got / length[e], sim))
    return out


def covered(pairs: DataFrame, threshold: float, n: int) -> DataFrame:
    """Of pairs (t, e, tt, te: their texts), sorted by e: (t, e, coverage, similarity) of those that are similar
    enough. Each batch of pairs is a shard."""

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            ts, es, tts, tes = (c.to_pylist() for c in b.columns)
            hits = scan(list(zip(ts, es)), dict(zip(ts, tts)), dict(zip(es, tes)), threshold, n)
            return dict(zip(("t", "e", "coverage", "similarity"), zip(*hits))) if hits else {}

        return fn

    return map_batches(pairs.select("t", "e", "tt", "te"), make, "t bigint, e bigint, coverage double, similarity double")


def overlaps(train: DataFrame, evals: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.6, n: int = 3) -> DataFrame:
    """(train_row, eval_row, coverage, similarity): records of the two tables with the same text (coverage 1) or
    at least the given similarity of runs of n words. Ids are BIGINT, unique over both tables together. Null
    and blank texts are in no pair; an empty table gives an empty result."""
    pick = lambda df, side: df.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text"), F.lit(side).alias("side"))
    both = pick(train, 0).unionByName(pick(evals, 1))
    members = cut(same_texts(both, "row", "text").select("row", "first").join(both.select("row", "side"), "row"))
    # One training and one evaluation record stands for each text: the smallest of its side.
    sides = cut(members.groupBy("first").agg(F.min(F.when(F.col("side") == 0, F.col("row"))).alias("t"), F.min(F.when(F.col("side") == 1, F.col("row"))).alias("e")))
    rest = members.join(sides, "first").where((F.col("row") != F.coalesce("t", F.lit(-1))) & (F.col("row") != F.coalesce("e", F.lit(-1)))).select("row")
    firsts = restricted(both, rest, "left_anti")
    tt, ee = firsts.where("side = 0").select("row", "text"), firsts.where("side = 1").select("row", "text")
    same = sides.where("t is not null and e is not null").select("t", "e", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("similarity"))
    pairs = cut(candidates(tt, ee, threshold, n).join(same, ["t", "e"], "left_anti"))
    te = restricted(ee, pairs.select(F.col("e").alias("row")).distinct()).select(F.col("row").alias("e"), F.col("text").alias("te"))
    ts = restricted(tt, pairs.select(F.col("t").alias("row")).distinct()).select(F.col("row").alias("t"), F.col("text").alias("tt"))
    # An evaluation text of many pairs is dealt out, so that no task gets them all.
    deal = pairs.groupBy("e").agg(F.ceil(F.count("*") / SHARD_PAIRS).alias("shards"))
    full = pairs.join(te.join(deal, "e"), "e").join(ts, "t").withColumn("shard", F.pmod(F.xxhash64("t"), "shards"))
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = covered(full.repartition(parts, "e", "shard").sortWithinPartitions("e"), threshold, n)
    hits = same.unionByName(near)
    a = members.where("side = 0").join(sides.select("first", "t"), "first").select(F.col("row").alias("train_row"), "t")
    b = members.where("side = 1").join(sides.select("first", "e"), "first").select(F.col("row").alias("eval_row"), "e")
    return hits.join(a, "t").join(b, "e").select("train_row", "eval_row", F.round("coverage", 6).alias("coverage"), F.round("similarity", 6).alias("similarity"))


def found(train: DataFrame, splits: dict[str, DataFrame], **how) -> DataFrame:
    """p4_found: (train_row_id, eval_row_id, split) of all overlaps with the named evaluation splits."""
    evals = None
    for name, df in splits.items():
        one = df.select("row_id", "text", F.lit(name).alias("split"))
        evals = one if evals is None else evals.unionByName(one)
    hits = overlaps(train, evals, **how).select(F.col("train_row").alias("train_row_id"), F.col("eval_row").alias("eval_row_id"))
    return hits.join(evals.select(F.col("row_id").alias("eval_row_id"), "split"), "eval_row_id").select("train_row_id", "eval_row_id", "split")


def report(train: DataFrame, splits: dict[str, DataFrame], **how) -> DataFrame:
    """(split, source, n_records, n_leaked, n_pairs): for each split and source (null too) the records with a
    text, how many of them overlap with a training record, and the pairs."""
    evals = None
    for name, df in splits.items():
        one = df.where(F.col("text").rlike(r"\S")).select(F.col("row_id").alias("eval_row_id"), F.lit(name).alias("split"), "source")
        evals = one if evals is None else evals.unionByName(one)
    n = found(train, splits, **how).groupBy("eval_row_id").agg(F.count("*").alias("pairs"))
    rows = evals.join(n, "eval_row_id", "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("pairs").alias("n_leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("n_pairs"))
