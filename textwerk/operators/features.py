"""TF-IDF in long form, embeddings, rank correlation, and a logistic-regression baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, word_tokens
from .metrics import running


def tokens(text: Column) -> Column:
    """Lower-case runs of at least two letters, digits or underscores."""
    return word_tokens(F.lower(text), 2)


def tfidf(df: DataFrame, id_col: str, text_col: str, max_n: int = 2, min_df: int = 2, max_features: int = 50_000) -> DataFrame:
    """(id, term, weight): sublinear term frequency, smoothed inverse document frequency, unit length. Terms in
    at least min_df texts; of those the max_features most frequent in the corpus, ties by term."""
    d = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    grams = d.select("id", F.explode(F.flatten(F.array(*(ngrams(F.col("w"), n) for n in range(1, max_n + 1))))).alias("term"))
    tf = grams.groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = d.agg(F.count("*").alias("n_docs"))
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)
    x = tf.join(F.broadcast(terms), "term").crossJoin(F.broadcast(n))  # max_features rows, and one
    raw = (1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    x = x.select("id", "term", raw.alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))  # a text's own terms
    return x.withColumn("norm", norm).select("id", "term", F.round(F.col("raw") / F.col("norm"), 6).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalized(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def max_topic_cosine(df: DataFrame, topics: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """df with ``max_cosine`` to any of the topic vectors (topic: ARRAY), a stated set of a few rows."""
    few = topics.agg(F.collect_list(l2_normalized(F.col("topic"))).alias("_topics"))
    best = F.array_max(F.transform("_topics", lambda t: dot(l2_normalized(F.col(vec_col)), t)))
    return df.crossJoin(F.broadcast(few)).withColumn("max_cosine", F.round(best, 6)).drop("_topics")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho): correlation of average ranks; 0 where fewer than three pairs or no spread. Ranks are made on
    the different values and their counts."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str, name: str) -> DataFrame:
        g = d.groupBy(F.col(c).alias(f"_{name}")).agg(F.count("*").alias("k"))
        g = running(g, f"_{name}", {"upto": "k"})
        return g.select(f"_{name}", (F.col("upto") - (F.col("k") - 1) / F.lit(2.0)).alias(name))

    j = d.join(ranks(a, "ra"), F.col(a) == F.col("_ra")).join(ranks(b, "rb"), F.col(b) == F.col("_rb"))
    out = j.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("r"))
    return out.select("n", F.round(F.when((F.col("n") < 3) | F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.col("r")), 6).alias("rho"))


def logistic_baseline(train: DataFrame, test: DataFrame, text_col: str = "text", label: str = "label", n_features: int = 1 << 16) -> DataFrame:
    """test with ``p``: class-balanced logistic regression (L2, C = 1) on hashed TF-IDF of one and two words."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    def prep(d: DataFrame) -> DataFrame:
        w = tokens(F.coalesce(F.col(text_col), F.lit("")))
        return d.withColumn("_w", F.concat(w, ngrams(w, 2)))

    t = prep(train.where(F.col(label).isin(0, 1)))
    sizes = {r[0]: r[1] for r in t.groupBy(label).count().collect()}
    n = sum(sizes.values())
    t = t.withColumn("_weight", F.when(F.col(label) == 1, n / (2 * max(1, sizes.get(1, 0)))).otherwise(n / (2 * max(1, sizes.get(0, 0)))))
    model = Pipeline(stages=[HashingTF(inputCol="_w", outputCol="_tf", numFeatures=n_features), IDF(inputCol="_tf", outputCol="_idf", minDocFreq=2), Normalizer(inputCol="_idf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_weight", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=60)]).fit(t)
    return model.transform(prep(test)).withColumn("p", vector_to_array("probability")[1]).drop("_w", "_tf", "_idf", "_x", "rawPrediction", "probability", "prediction")


def top_coefs(coefs: DataFrame, n: int = 25) -> DataFrame:
    """(side, rank, feature, coef): of (feature, coef) the n largest (AI) and the n smallest (Human); ties by feature."""
    ai = coefs.orderBy(F.desc("coef"), "feature").limit(n).withColumns({"side": F.lit("AI"), "rank": F.row_number().over(Window.orderBy(F.desc("coef"), "feature"))})
    human = coefs.orderBy("coef", "feature").limit(n).withColumns({"side": F.lit("Human"), "rank": F.row_number().over(Window.orderBy("coef", "feature"))})
    return ai.unionByName(human).select("side", "rank", "feature", "coef")


def word_coefs(df: DataFrame, text_col: str = "text", label: str = "label", max_features: int = 5000) -> DataFrame:
    """(feature, coef): logistic regression (L2, C = 1) on TF-IDF of the max_features most frequent words."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    d = df.where(F.col(label).isin(0, 1) & F.col(text_col).isNotNull()).select(F.col(label).alias("label"), tokens(F.col(text_col)).alias("w"))
    stages = [CountVectorizer(inputCol="w", outputCol="tf", vocabSize=max_features, minDF=2), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / max(1, d.count()), elasticNetParam=0.0, standardization=False, maxIter=60)]
    model = Pipeline(stages=stages).fit(d)
    rows = zip(model.stages[0].vocabulary, (float(c) for c in model.stages[-1].coefficients))
    return df.sparkSession.createDataFrame(list(rows), "feature string, coef double")  # max_features rows


def linear_shap(df: DataFrame, coefs: dict[str, float]) -> DataFrame:
    """(feature, mean_abs): mean amount of each feature's part in a linear score, coef * (value - mean)."""
    means = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in coefs))
    d = df.crossJoin(F.broadcast(means))  # one row
    wide = d.agg(*(F.avg(F.abs(F.lit(w) * (F.col(c) - F.col(f"_m_{c}")))).alias(c) for c, w in coefs.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("mean_abs")) for c in coefs))).alias("x")).select("x.*")
