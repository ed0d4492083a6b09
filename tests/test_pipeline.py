"""Discarding, sampling, scoring and explanation on small tables with nulls, ties and empty input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwerk.functions import text as T
from textwerk.operators import features, metrics, quality, sampling, scoring
from textwerk.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ranked_is_the_order_of_chance(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None) for i in range(500)], "id long, s string")
    got = {r.id: r.rn for r in sampling.ranked(df, ["s"], "id").collect()}
    all_ = {r.id: r.rn for r in sampling.ranked(df, [], "id").collect()}
    import hashlib

    order = sorted(range(500), key=lambda i: hashlib.md5(f"{i}42".encode()).hexdigest())
    assert [all_[i] for i in order] == list(range(1, 501))
    for v in ("a", "b", None):
        mine = [i for i in order if ("ab"[i % 2] if i % 7 else None) == v]
        assert [got[i] for i in mine] == list(range(1, len(mine) + 1))
    assert sampling.ranked(df.where("false"), ["s"], "id").count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(float(i % 97) * (-1) ** i + i / 1000, i) for i in range(400)], "v double, n long")
    want, total = {}, 0
    for v, n in sorted((r.v, r.n) for r in df.collect()):
        total += n
        want[v] = total
    assert {r.v: r.up for r in metrics.running(df, "v", {"up": "n"}, parts=16).collect()} == want
    assert metrics.running(df.where("false"), "v", {"up": "n"}).count() == 0


@pytest.mark.parametrize("block", [100_000, 20])
def test_greedy_group_split(spark, block):
    g = spark.createDataFrame([(f"g{i}", "d" if i % 3 else None, i % 2, 1 + i % 5) for i in range(300)], "group_id string, domain string, label int, n long")
    out = sampling.greedy_group_split(g, ["domain", "label"], block=block).collect()
    assert len(out) == 300 == len({r.group_id for r in out})
    train = sum(r.n for r in out if r.split == "train") / sum(r.n for r in out)
    assert abs(train - 0.7) < 0.1 and {r.domain for r in out} == {"d", None}


def test_samples_of_empty_and_short_tables(spark):
    df = spark.createDataFrame([(i, i % 2, i % 9, "s" if i % 4 else None) for i in range(30)], "id long, label int, v int, src string")
    assert sampling.quantile_sample(df, "v", "label", "id", 10).groupBy("label").count().collect().__len__() == 2
    # More than there is is topped up by none.
    assert sampling.stratified_equal(df, "src", "id", 1000).count() == df.where("src is not null").count()
    assert sampling.stratified_equal(df, "src", "id", 5).count() == 5
    for d in (sampling.quantile_sample(df.where("false"), "v", "label", "id", 10), sampling.stratified_equal(df.where("false"), "src", "id", 5), sampling.paragraphs_of_rows(df.where("false"), "src", "id", "src"), sampling.suite(df.where("false"), {"s": 0}, "id", 5, "src"), sampling.smoke(df.where("false"), df.where("false"), "id", 5)):
        assert d.count() == 0


def test_paragraphs_of_rows(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(61)] + [(99, None, "x"), (100, "a", None)], "id long, g string, t string")
    out = sampling.paragraphs_of_rows(df, "g", "id", "t").collect()
    assert sum(r.n for r in out) == 61 and {r.n for r in out} <= {1, 3, 4, 5}
    assert " ".join(r.text for r in sorted((r for r in out if r.g == "a"), key=lambda r: r.first)) == " ".join(f"t{i}" for i in range(0, 61, 2))


def test_budget_schedule(spark):
    b = spark.createDataFrame([("x", 0, 2), ("y", 1, 9), ("z", 5, 5)], "backend string, done int, budget int")
    assert [r.backend for r in sampling.budget_schedule(b, 6).orderBy("step").collect()] == ["x", "x", "y", "y", "y", "y"]


def test_discards(spark):
    df = spark.createDataFrame([(1, "Hallo: Der Plan ist gut. Er ist schlecht! 1."), (2, None), (3, ""), (4, "Er ist schlecht!")], "id long, text string")
    bad = spark.createDataFrame([("Er ist schlecht!",)], "template string")
    assert rows(quality.discard_combined(df, bad, "id")) == [(1, "Hallo: Der Plan ist gut."), (2, ""), (3, ""), (4, "")]
    from textwerk.functions.rules import COLON_PREFIX

    assert rows(quality.discard_combined(df, bad, "id", prefix=COLON_PREFIX))[0] == (1, "Der Plan ist gut.")
    grams = spark.createDataFrame([("ist gut.",), ("a",)], "item string")
    assert rows(quality.discard_ngrams(df, grams, "id")) == [(1, "Er ist schlecht! 1."), (2, ""), (3, ""), (4, "Er ist schlecht!")]


def test_scoring(spark):
    df = spark.createDataFrame([(1, "kurz und langesWort"), (2, None), (3, "langesWort " * 40)], "id long, text string")
    one = scoring.long_word_scorer()
    assert rows(scoring.score_batch(df, one).select("id", "ai_probability", "predicted_label", "verdict")) == [(1, 0.3333, 0, "Human"), (2, 0.0, 0, "Human"), (3, 0.9756, 1, "AI")]
    s = {r.id: r for r in scoring.score_single(df, one, "id", size=20, step=10).collect()}
    assert s[3].n_chunks == 3 and s[3].ai_prob == 1.0 and s[2].n_chunks == 1 and s[2].label == 0

    def broken(texts):
        raise ValueError("no")

    out = scoring.predict_all(df, {"a": (one, 0.5), "b": (broken, 0.5)}, "id")
    assert rows(out.where("model = 'b'").select("id", "verdict", "error"))[0] == (1, None, "ValueError: no")
    votes = {r.id: r for r in scoring.majority(out, "id", "verdict").collect()}
    assert votes[3].verdict == "AI" and votes[1].ai_votes == 0
    assert scoring.score_batch(df.where("false"), one).count() == 0


def test_explanations(spark):
    c = spark.createDataFrame([(x, float(v)) for x, v in (("a", 3), ("b", -2), ("c", 3), ("d", 0))], "feature string, coef double")
    assert [(r.side, r.feature) for r in features.top_coefs(c, 2).orderBy("side", "rank").collect()] == [("AI", "a"), ("AI", "c"), ("Human", "b"), ("Human", "d")]
    assert rows(features.linear_shap(spark.createDataFrame([(1.0,), (3.0,)], "x double"), {"x": 2.0})) == [("x", 2.0)]
    t = spark.createDataFrame([(1, " a", 0.5), (1, "a ", 0.25), (1, "b", -2.0), (1, " ", 9.0)], "id long, token string, value double")
    assert rows(scoring.token_attributions(t, "id", "token", "value")) == [(1, "a", 0.75, 2), (1, "b", -2.0, 1)]
    df = spark.createDataFrame([(i % 2, ("gut " if i % 2 else "schlecht ") + "Prüfung läuft") for i in range(40)] + [(None, "x"), (1, None)], "label int, text string")
    w = {r.feature: r.coef for r in features.word_coefs(df).collect()}
    assert w["gut"] > 0 > w["schlecht"] and "prüfung" in w


def test_humanized_is_repeatable(spark):
    text = "Der erste Satz steht hier. Der zweite Satz folgt darauf. Der dritte Satz beendet alles."
    out = {T.humanized(text, k) for k in range(60)}
    assert text in out and len(out) > 10 and all(abs(len(x) - len(text)) < 25 for x in out) and T.humanized("a b", 1) == "a b"
    df = spark.createDataFrame([(i, text if i else None) for i in range(20)], "id long, text string").select("id", T.humanize(F.col("text"), F.col("id")).alias("t"))
    assert rows(df)[1:] == rows(df.repartition(3))[1:] and df.where("t is null").count() == 1


def test_tokens_with_umlauts(spark):
    df = spark.createDataFrame([("Die Prüfung heißt Öl_1, x!",), (None,)], "t string")
    assert [r[0] for r in df.select(features.tokens(F.col("t"))).collect()] == [["die", "prüfung", "heißt", "öl_1"], None]
    assert df.select(T.listed_tokens(F.col("t"))).first()[0] == ["die", "prüfung", "heißt"]


def test_files(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text("x,y\n1,2\n")
    out = readers.transform_all(spark, [str(a)], lambda d: d.withColumn("z", F.lit("q")), "_new", "csv")
    assert out == [str(tmp_path / "a_new.csv")] and rows(readers.read_csv(spark, out[0])) == [("1", "2", "q")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "vocab.txt").write_text("")
    assert [r for r in readers.audit_directories(str(tmp_path), {"vocab": ("vocab*",), "weights": ("*.bin",)}) if r["name"] == "m"] == [{"name": "m", "vocab": True, "weights": False, "missing": "weights"}]
    assert readers.audit_directories(str(tmp_path / "none"), {}) == []
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "text string, n int")
    writers.append_new(df, path)
    writers.append_new(df.union(spark.createDataFrame([("c", 3)], "text string, n int")), path)
    assert sorted(r.text for r in spark.read.json(path).collect()) == ["a", "b", "c"]
    assert readers.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
