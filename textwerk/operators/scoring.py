"""From probabilities to decisions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks, preprocess


def decide_by_machine(p: Column, t: float) -> Column:
    """1 iff the probability of machine text reaches t."""
    return (p >= t).cast("int")


def decide_by_human(p: Column, t: Column | float) -> Column:
    """Human iff the probability of human text reaches t: the other rule, which differs between t and 1 - t."""
    return F.when(1 - p >= t, "Human").otherwise("AI")


def verdict_bands(p: Column, t: float) -> Column:
    """Label and confidence in words."""
    ai = F.when(p >= 0.90, "KI-generiert (sehr hohe Konfidenz)").when(p >= 0.75, "KI-generiert (hohe Konfidenz)").otherwise("KI-generiert (mittlere Konfidenz)")
    human = F.when(p <= 0.10, "Menschlich verfasst (sehr hohe Konfidenz)").when(p <= 0.25, "Menschlich verfasst (hohe Konfidenz)").otherwise("Menschlich verfasst (mittlere Konfidenz) — grenzwertig")
    return F.when(p >= t, ai).when(p < t, human)


def mean_over_chunks(df: DataFrame, id_col: str, p: str) -> DataFrame:
    """(id, p, n_chunks): a text's probability is the mean of its chunks'."""
    return df.groupBy(id_col).agg(F.round(F.avg(p), 6).alias("p"), F.count(p).alias("n_chunks"))


def majority(df: DataFrame, key: str, decision: str) -> DataFrame:
    """(key, ai_votes, human_votes, verdict): null decisions are errors and don't vote; a tie is Human."""
    v = df.groupBy(key).agg(F.count(F.when(F.col(decision) == "AI", 1)).alias("ai_votes"), F.count(F.when(F.col(decision) == "Human", 1)).alias("human_votes"))
    return v.withColumn("verdict", F.when(F.col("ai_votes") > F.col("human_votes"), "AI").otherwise("Human"))


#: A scorer: texts to an array of shape (n, 2), the probabilities of human and machine.
Scorer = Callable[[list[str]], np.ndarray]


def proba(text: Column, scorer: Scorer) -> Column:
    """The machine probability of each text by a scorer, which gets whole Arrow batches; null as an empty text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(scorer(texts.fillna("").tolist()), dtype=float)[:, 1]) if len(texts) else pd.Series([], dtype=float)

    return score(text)


def score_batch(df: DataFrame, scorer: Scorer, text_col: str = "text", t: float = 0.5) -> DataFrame:
    """df with ai_probability (4 places, half to even), predicted_label and verdict; texts whole, as they are."""
    d = df.withColumn("_p", proba(F.col(text_col), scorer))
    return d.withColumns({"ai_probability": F.bround("_p", 4), "predicted_label": decide_by_machine(F.col("_p"), t), "verdict": F.when(F.col("_p") >= t, "AI").otherwise("Human")}).drop("_p")


def score_single(df: DataFrame, scorer: Scorer, id_col: str, text_col: str = "text", t: float = 0.5, size: int = 256, step: int = 128) -> DataFrame:
    """(id, n_chunks, ai_prob, human_prob, label, confidence, verdict): each text preprocessed, cut into chunks,
    its probability the mean of theirs. A null text is an empty one."""
    each = df.select(F.col(id_col), F.posexplode(chunks(F.coalesce(preprocess(F.col(text_col)), F.lit("")), size, step)).alias("pos", "chunk"))
    p = F.col("_p")
    d = each.withColumn("_s", proba(F.col("chunk"), scorer)).groupBy(id_col).agg(F.count("*").alias("n_chunks"), F.avg("_s").alias("_p"))
    label = decide_by_machine(p, t)
    short = lambda v: F.bround(F.round(v, 9), 4)  # noqa: E731 - what differs in the last bits alone is a tie
    return d.select(id_col, "n_chunks", short(p).alias("ai_prob"), short(1 - p).alias("human_prob"), label.alias("label"), short(F.when(label == 1, p).otherwise(1 - p)).alias("confidence"), verdict_bands(p, t).alias("verdict"))


def predict_all(df: DataFrame, models: dict[str, tuple[Scorer, float]], id_col: str, text_col: str = "text") -> DataFrame:
    """(id, model, ai_prob, verdict, error): each text by each model of a registry (scorer, threshold of human
    probability). A model that fails gives rows with its error and no verdict, and the others theirs."""

    def one(name: str, scorer: Scorer, t: float) -> DataFrame:
        @F.pandas_udf("ai_prob double, error string")
        def score(texts: pd.Series) -> pd.DataFrame:
            try:
                return pd.DataFrame({"ai_prob": np.asarray(scorer(texts.fillna("").tolist()), dtype=float)[:, 1], "error": None})
            except Exception as e:  # noqa: BLE001 - whatever a model raises is its answer
                return pd.DataFrame({"ai_prob": [None] * len(texts), "error": [f"{type(e).__name__}: {e}"] * len(texts)}).astype({"ai_prob": float})

        x = df.select(F.col(id_col), score(F.col(text_col)).alias("x"))
        p = F.when(F.col("x.error").isNull(), F.col("x.ai_prob"))
        return x.select(id_col, F.lit(name).alias("model"), p.alias("ai_prob"), F.when(p.isNotNull(), decide_by_human(p, t)).alias("verdict"), F.col("x.error").alias("error"))

    out = None
    for name, (scorer, t) in models.items():
        d = one(name, scorer, t)
        out = d if out is None else out.unionByName(d)
    return out


def long_word_scorer(least: int = 7) -> Scorer:
    """A scorer without a model: the share of words of at least so many letters counts as machine."""

    def score(texts: list[str]) -> np.ndarray:
        p = np.array([sum(len(w) >= least for w in ws) / len(ws) if (ws := t.split(" ")) and t else 0.0 for t in texts])
        return np.column_stack([1 - p, p])

    return score


def token_attributions(df: DataFrame, id_col: str, token: str, value: str, k: int = 8) -> DataFrame:
    """(id, token, value, rank): the values of a text's tokens, blanks around them cut off, added up by token, and
    the k of the largest amount; ties by token. Blank tokens are left out."""
    from pyspark.sql import Window

    d = df.withColumn("_t", F.trim(F.col(token))).where("_t <> ''").groupBy(F.col(id_col), F.col("_t").alias("token")).agg(F.sum(value).alias("value"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.abs("value")), "token"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k)
