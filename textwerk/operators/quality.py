"""Quality gates: one policy for each cleaner, one expression for all of them.

A gate gives the cleaned text or, where it rejects, null; ``reject_reason`` says which test failed first.
Null and blank texts are rejected as blank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import abstracted, discard_reason, ngrams, normalize_ws, sentences, trimmed, truncate_chars, truncate_words, word_count, words


@dataclass(frozen=True)
class Policy:
    rules: tuple
    min_words: int
    max_digits: float
    bad_phrases: tuple = ()
    max_chars: int | None = None
    max_words: int | None = None
    need_umlaut: bool = False
    need_german: bool = False
    max_english: int | None = None
    late_rules: tuple = ()


POLICIES = {
    "clean_v1": Policy(R.MARKERS + R.URLS, 20, 0.30, max_chars=1024, need_german=True),
    "clean_fixed": Policy(R.ARTIFACTS + R.URLS, 30, 0.25, R.BAD_PHRASES, max_words=300, need_umlaut=True),
    "clean_500k": Policy(R.ARTIFACTS + R.URLS, 10, 0.25, R.BAD_PHRASES),
    "clean_500k_strict": Policy(R.TEMPLATES + R.URLS, 10, 0.25, R.BAD_PHRASES_STRICT),
    "validate_paragraph": Policy(R.MARKDOWN, 30, 1.0, R.BAD_PHRASES_PARAGRAPH, need_umlaut=True, max_english=2, late_rules=((r"\d+\.\s*Plenarsitzung", "", False), R.ARTIFACTS[1])),
}


def gate(df: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """df with ``clean_text`` and ``reject_reason``; the first failed test wins, in the order blank, words,
    digits, phrase, english, language. Rows are kept; extra columns too."""
    t = normalize_ws(R.apply_rules(F.col(text_col), policy.rules))
    t = truncate_words(t, policy.max_words) if policy.max_words else t
    d = df.withColumn("_t", t)
    c = F.col("_t")
    enough = word_count(c) >= policy.min_words
    d = d.withColumn("_n", enough)
    if policy.max_chars:
        d = d.withColumn("_t", truncate_chars(c, policy.max_chars))
    low = F.lower(c)
    digits = F.length(F.regexp_replace(c, "[^0-9]", "")) > policy.max_digits * F.length(c)
    bad = F.lit(False)
    for p in policy.bad_phrases:
        bad = bad | low.contains(p)
    english = sum((low.contains(m).cast("int") for m in R.ENGLISH_MARKERS), F.lit(0))
    umlaut = c.rlike("[äöüÄÖÜß]")
    reason: Column = F.when(c.isNull() | (c == ""), "blank")
    if not policy.late_rules:
        reason = reason.when(~F.col("_n"), "words")
    reason = reason.when(digits, "digits").when(bad, "phrase")
    if policy.max_english is not None:
        reason = reason.when(english > policy.max_english, "english")
    if policy.need_umlaut:
        reason = reason.when(~umlaut, "language")
    if policy.need_german:
        common = F.arrays_overlap(words(low), F.array(*(F.lit(w) for w in R.STOPWORDS)))
        reason = reason.when(~umlaut & ~common, "language")
    out = c
    if policy.late_rules:
        out = F.trim(R.apply_rules(c, policy.late_rules))
        reason = reason.when(word_count(out) < policy.min_words, "words")
    return d.withColumn("reject_reason", reason).withColumn("clean_text", F.when(F.col("reject_reason").isNull(), out)).drop("_t", "_n")


def _sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    each = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(sentences(F.col(text_col))).alias("pos", "x"))
    return each.select("id", "pos", trimmed(F.col("x")).alias("s")).where("s <> ''")


def _joined(df: DataFrame, id_col: str, text_col: str, kept: DataFrame) -> DataFrame:
    """(id, text): the kept sentences (id, pos, s) in order; an empty text where none is left, or where it was null."""
    g = kept.groupBy(F.col("id").alias("_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ").alias("_clean"))
    return df.select(F.col(id_col)).join(g, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("_clean", F.lit("")).alias("text"))


def discard_combined(df: DataFrame, blacklist: DataFrame, id_col: str, text_col: str = "text", prefix: tuple = ()) -> DataFrame:
    """(id, text): sentences without list heads and marks, triggers, and those whose abstract form is in the blacklist
    (template). With a ``prefix`` rule, a sentence is judged with and without its prefix, goes where nothing is left
    without it, and stays without it."""
    s = _sentences(df, id_col, text_col).withColumn("bare", F.trim(R.apply_rules(F.col("s"), prefix)) if prefix else F.col("s"))
    ok = discard_reason(F.col("s")).isNull() & (F.col("bare") != "") & ~R.any_match(F.col("bare"), R.TRIGGERS)
    s = s.where(ok).withColumns({"a": abstracted(F.col("s")), "b": abstracted(F.col("bare"))})
    bad = blacklist.select(F.col("template").alias("_t")).distinct()
    s = s.join(bad, F.col("a") == F.col("_t"), "left_anti")
    s = s.join(bad, F.col("b") == F.col("_t"), "left_anti") if prefix else s
    return _joined(df, id_col, text_col, s.select("id", "pos", F.col("bare").alias("s")))


def discard_ngrams(df: DataFrame, blacklist: DataFrame, id_col: str, text_col: str = "text", most: int = 4) -> DataFrame:
    """(id, text): sentences without any of the n-grams of the blacklist (item), of up to ``most`` words."""
    s = _sentences(df, id_col, text_col)
    grams = s.select("id", "pos", words(F.lower("s")).alias("w")).select("id", "pos", F.explode(F.array_distinct(F.flatten(F.array(*(ngrams(F.col("w"), n) for n in range(1, most + 1)))))).alias("item"))
    hit = grams.join(blacklist.select("item").distinct(), "item", "left_semi").select("id", "pos").distinct()
    return _joined(df, id_col, text_col, s.join(hit, ["id", "pos"], "left_anti"))
