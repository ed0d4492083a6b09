import math

import pytest
from pyspark.sql import functions as F

from textwerk.operators import dedup, features, metrics, mining, quality, sampling, scoring


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (20, 21, 30, 31, 150, 151)], "v int")
    edges = [*range(20, 160, 10), math.inf]
    assert [r.b for r in df.select("v", sampling.right_closed_bin(F.col("v"), edges).alias("b")).orderBy("v").collect()] == [None, 0, 0, 1, 12, 13]


def test_keep_first_ties_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, None, 1), (1, "a", 0)], "id long, k string, _x int")
    assert {r.id for r in dedup.keep_first(df, ["k"], "id").collect()} == {1, 3}
    assert dedup.keep_first(df.where("false"), ["k"], "id").count() == 0


def test_cross_class(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, None, 1)], "id long, k string, label int")
    assert {r.id for r in dedup.cross_class(df, "k", "label").collect()} == {3, 4}
    assert {r.id for r in dedup.cross_class(df, "k", "label", (1,)).collect()} == {1, 3, 4}


def test_near_jaccard_against_brute_force(spark):
    base = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn".split()
    texts = [" ".join(base), " ".join(base[:-1] + ["ende"]), " ".join(base[::-1]), "kurz", "", None, " ".join(base + ["mehr"])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)}

    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a is not None and b is not None and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > 0.8}
    assert {(r.eval_id, r.train_id) for r in dedup.near_jaccard(df, df, "id", "t").collect()} == want


def shuffled_rows(spark):
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_near_jaccard_shuffles_prefixes_only(spark):
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, t string")
    before = shuffled_rows(spark)
    assert dedup.near_jaccard(df, df.limit(3), "id", "t").count() == 3
    assert shuffled_rows(spark) - before < 200 * 98 / 2  # all runs of all texts were shuffled twice


def test_near_jaccard_of_runs_that_many_texts_have(spark):
    stem = [f"w{k}" for k in range(40)]
    texts = [" ".join(stem[: 20 + i % 21] + [f"e{i % 7}"] * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    share = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(grams[:30]) for j, b in enumerate(grams)}
    got = dedup.near_jaccard(df.where("id < 30"), df, "id", "t", split=4).collect()
    assert {(r.eval_id, r.train_id): r.jaccard for r in got} == {k: round(v, 6) for k, v in share.items() if v > 0.8} and len(got) > 100


def test_greedy_split(spark):
    df = spark.createDataFrame([("a", "d", 0, 6), ("b", "d", 0, 3), ("c", "d", 0, 1)], "group_id string, domain string, label int, n long")
    out = sampling.greedy_group_split(df, ["domain", "label"])
    assert out.agg(F.sum("n")).first()[0] == 10 and {r.split for r in out.collect()} <= {"train", "val", "external_val", "test", "final_holdout"}


def test_balanced_and_split(spark):
    df = spark.range(100).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    assert rows(sampling.balance_min(df, "label", "id").groupBy("label").count()) == [(0, 34), (1, 34)]
    got = dict(rows(sampling.split_by_rank(df, ["label"], "id").groupBy("split").count()))
    assert got["test"] + got["val"] + got["train"] == 100 and got["test"] >= got["val"]


def test_metrics(spark):
    y, p = [1, 0, 1, 0, 1, 1, 0], [0.9, 0.8, 0.8, 0.1, 0.5, 0.05, 0.5]
    df = spark.createDataFrame(list(zip(y, p)), "label int, p double")
    pairs = [(a, b) for i, a in enumerate(p) if y[i] for j, b in enumerate(p) if not y[j]]
    want = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert metrics.roc_auc(df).first().auc == pytest.approx(want, abs=1e-6)
    assert metrics.roc_auc(df.where("label = 1"), empty_value=0.0).first().auc == 0.0
    at = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in metrics.at_thresholds(df, [0.5, 0.1]).collect()}
    assert at[0.5] == (3, 2, 1, 1) and at[0.1] == (3, 3, 1, 0)
    assert metrics.calibrate(df).first().threshold in [i / 100 for i in range(1, 100)]


def test_decisions(spark):
    df = spark.createDataFrame([(0.18,), (0.90,)], "p double")
    got = [(r.v, r.r) for r in df.select(scoring.verdict_bands(F.col("p"), 0.18).alias("v"), scoring.decide_by_human(F.col("p"), 0.18).alias("r")).collect()]
    assert got == [("KI-generiert (mittlere Konfidenz)", "Human"), ("KI-generiert (sehr hohe Konfidenz)", "AI")]
    votes = spark.createDataFrame([("t", "AI")] * 4 + [("t", "Human")] * 4 + [("t", None)], "k string, v string")
    assert scoring.majority(votes, "k", "v").first().verdict == "Human"


def test_gates(spark):
    good = "Die schöne Straße führt durch den alten Wald und über den kleinen Fluss, " * 4
    df = spark.createDataFrame([(1, good), (2, None), (3, ""), (4, "zu kurz"), (5, "1234567 " * 40), (6, good + "als sprachmodell kann ich")], "id int, text string")
    got = {r.id: r.reject_reason for r in quality.gate(df, quality.POLICIES["clean_fixed"]).collect()}
    assert got == {1: None, 2: "blank", 3: "blank", 4: "words", 5: "digits", 6: "phrase"}


def test_prevalence_and_ngrams_on_empty_tables(spark):
    df = spark.createDataFrame([], "id long, text string, label int")
    assert mining.ngram_diff(df, 2, 1).count() == 0
    assert mining.prevalence(df, {"x": F.col("text").contains("x")}).count() == 0


def test_tfidf_has_unit_length(spark):
    df = spark.createDataFrame([(1, "aa bb cc aa"), (2, "aa bb dd"), (3, None)], "id long, text string")
    n = features.tfidf(df, "id", "text").groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert {r.id for r in n} == {1, 2} and all(abs(r.s - 1) < 1e-4 for r in n)


def test_logistic_baseline_learns(spark):
    train = spark.createDataFrame([("gut schön fein", 1), ("schlecht übel mies", 0)] * 20, "text string, label int")
    out = features.logistic_baseline(train, train)
    assert out.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int"))).first()[0] == 1.0
