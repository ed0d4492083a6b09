"""Queries over scores, decisions, metrics, features and embeddings, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, metrics, scoring
from .registry import SCORES, Registry, docs, scores, table

q = Registry()
W = f"with {SCORES}"
CM = "count(case when label = 1 and pred = 1 then 1 end) as tp, count(case when label = 0 and pred = 1 then 1 end) as fp, count(case when label = 1 and pred = 0 then 1 end) as fn, count(case when label = 0 and pred = 0 then 1 end) as tn"
_r = lambda a, b: f"case when {b} > 0 then {a} * 1.0 / ({b}) else 0.0 end"
F1, F0 = _r("2 * tp", "2 * tp + fp + fn"), _r("2 * tn", "2 * tn + fp + fn")

q.add("confusion", lambda s, d: metrics.confusion_counts(scores(s, d), ["split"]), f"{W} select split, {CM} from scores group by split")
q.add("classification_report", lambda s, d: metrics.with_f1(metrics.confusion_counts(scores(s, d), ["split"])), f"{W}, c as (select split, {CM} from scores group by split) select split, tp, fp, fn, tn, tp + fp + fn + tn as n, round({_r('(tp + tn)', 'tp + fp + fn + tn')}, 6) as accuracy, round({_r('tp', 'tp + fp')}, 6) as precision, round({_r('tp', 'tp + fn')}, 6) as recall, round({F1}, 6) as f1, round(({F1} + {F0}) / 2, 6) as macro_f1 from c")
q.add("per_domain_macro_f1", lambda s, d: metrics.present_macro_f1(metrics.confusion_counts(scores(s, d), ["source"])).select("source", "macro_f1"), f"{W}, c as (select source, {CM} from scores group by source) select source, round(({F1} + {F0}) / ((tp + fp + fn > 0)::int + (tn + fp + fn > 0)::int), 6) as macro_f1 from c")
q.add("per_generator_recall", lambda s, d: scores(s, d).where("label = 1").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == 1).cast("int")), 6).alias("recall")), f"{W} select source, count(*) as n, round(avg(case when pred = 1 then 1.0 else 0.0 end), 6) as recall from scores where label = 1 group by source")
q.add("generator_recall_spread", lambda s, d: scores(s, d).where("label = 1").groupBy("source").agg(F.avg((F.col("pred") == 1).cast("int")).alias("r")).agg(F.round(F.max("r") - F.min("r"), 6).alias("spread")).withColumn("flagged", F.col("spread") > 0.15), f"{W}, g as (select avg(case when pred = 1 then 1.0 else 0.0 end) as r from scores where label = 1 group by source) select round(max(r) - min(r), 6) as spread, round(max(r) - min(r), 6) > 0.15 as flagged from g")
q.add("per_source_recall", lambda s, d: scores(s, d).where("label = 0").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == 0).cast("int")), 6).alias("recall")), f"{W} select source, count(*) as n, round(avg(case when pred = 0 then 1.0 else 0.0 end), 6) as recall from scores where label = 0 group by source")
q.add("conf_hist20", lambda s, d: s.range(20).select(F.col("id").cast("int").alias("bin")).join(scores(s, d).groupBy(F.least(F.floor(F.col("p") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n")), "bin", "left").na.fill(0, ["n"]), f"{W} select cast(b as int) as bin, count(p) as n from range(20) t(b) left join scores on least(floor(p * 20), 19) = b group by b")
q.add("frac_extreme", lambda s, d: scores(s, d).agg(F.round(F.avg(((F.col("p") < 0.05) | (F.col("p") > 0.95)).cast("int")), 6).alias("frac_extreme"), F.round(F.avg((((F.col("p") < 0.05) | (F.col("p") > 0.95)) & (F.col("pred") != F.col("label"))).cast("int")), 6).alias("frac_confident_wrong")), f"{W} select round(avg(case when p < 0.05 or p > 0.95 then 1.0 else 0.0 end), 6) as frac_extreme, round(avg(case when (p < 0.05 or p > 0.95) and pred <> label then 1.0 else 0.0 end), 6) as frac_confident_wrong from scores")
_EDGES = [0, 500, 650, 800, 950, 1100, 1300, 1500, 1750, 10**7]


def _with_text(s, d):
    ev = table(s, d, "test").unionByName(table(s, d, "val")).select("row_id", "text")
    return scores(s, d).join(ev, "row_id")


_B = "case " + " ".join(f"when length(text) > {a} and length(text) <= {b} then {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " end"


def _acc_by_len(s, d):
    from ..operators.sampling import right_closed_bin

    return _with_text(s, d).groupBy(right_closed_bin(F.length("text"), _EDGES).alias("bucket"), "label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy"))


q.add("acc_by_len_bucket", _acc_by_len, f"{W}, t as (select row_id, text from test union all select row_id, text from val) select cast({_B} as int) as bucket, label, count(*) as n, round(avg(case when pred = label then 1.0 else 0.0 end), 6) as accuracy from scores join t using (row_id) group by 1, 2")
_WB = "case when words >= 20 and words < 40 then '20-40' when words >= 40 and words < 80 then '40-80' when words >= 80 and words < 120 then '80-120' when words >= 120 and words <= 200 then '120-200' else 'Other' end"
q.add("acc_by_word_bin", lambda s, d: s.createDataFrame([(x,) for x in ("20-40", "40-80", "80-120", "120-200", "Other")], "bin string").join(scores(s, d).groupBy(F.expr(_WB).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy")), "bin", "left").na.fill(0, ["n"]).na.fill(0.0, ["accuracy"]), f"{W} select b.bin, count(p) as n, coalesce(round(avg(case when pred = label then 1.0 when p is not null then 0.0 end), 6), 0.0) as accuracy from (values ('20-40'), ('40-80'), ('80-120'), ('120-200'), ('Other')) b(bin) left join scores on {_WB} = b.bin group by b.bin")
q.add("acc_by_source", lambda s, d: scores(s, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy")), f"{W} select source, count(*) as n, round(avg(case when pred = label then 1.0 else 0.0 end), 6) as accuracy from scores group by source")
q.add("group_accuracy", lambda s, d: scores(s, d).groupBy("split").agg(F.count("*").alias("samples"), F.sum((F.col("pred") == F.col("label")).cast("int")).alias("correct")).withColumn("pct", F.round(100.0 * F.col("correct") / F.col("samples"), 6)), f"{W} select split, count(*) as samples, count(case when pred = label then 1 end) as correct, round(100.0 * count(case when pred = label then 1 end) / count(*), 6) as pct from scores group by split")
q.add("cross_check", lambda s, d: metrics.with_f1(metrics.confusion_counts(scores(s, d), ["split"])).agg(F.round(F.max(F.when(F.col("split") == "test", F.col("macro_f1"))) - F.max(F.when(F.col("split") == "val", F.col("macro_f1"))), 5).alias("gap")).withColumn("warned", F.abs("gap") > 0.03), f"{W}, c as (select split, {CM} from scores group by split), f as (select split, round(({F1} + {F0}) / 2, 6) as m from c) select round(max(case when split = 'test' then m end) - max(case when split = 'val' then m end), 5) as gap, abs(round(max(case when split = 'test' then m end) - max(case when split = 'val' then m end), 5)) > 0.03 as warned from f")
_CUM = f"{W}, g as (select p, sum(label) as pos, sum(1 - label) as neg from scores group by p), c as (select *, sum(pos) over (order by p desc) as cp, sum(neg) over (order by p desc) as cn from g)"
q.add("roc_auc", lambda s, d: metrics.roc_auc(scores(s, d)), f"{_CUM} select round(sum(neg::double * (cp - pos / 2.0)) / (sum(pos)::double * sum(neg)), 6) as auc from c")
q.add("avg_precision", lambda s, d: metrics.average_precision(scores(s, d)), f"{_CUM} select round(sum(pos * cp::double / (cp + cn)) / sum(pos), 6) as ap from c")
q.add("brier", lambda s, d: scores(s, d).agg(F.round(F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))), 6).alias("brier")), f"{W} select round(avg((p - label) * (p - label)), 6) as brier from scores")


def _ece(s, d):
    c = scores(s, d).withColumn("conf", F.greatest("p", 1 - F.col("p")))
    b = c.groupBy((F.ceil(F.round(F.col("conf") * 10, 9)) - 1).alias("b")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg((F.col("pred") == F.col("label")).cast("int")).alias("a"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("ece"))


q.add("ece10", _ece, f"{W}, c as (select *, greatest(p, 1 - p) as conf from scores), b as (select ceil(round(conf * 10, 9)) - 1 as b, count(*) as n, avg(conf) as c, avg(case when pred = label then 1.0 else 0.0 end) as a from c group by 1) select round(sum(n * abs(a - c)) / sum(n), 6) as ece from b")
_AT = "with {s}, t as (select i / 100.0::double as threshold from range({a}, {b}) r(i)), c as (select threshold, count(case when label = 1 and p >= threshold then 1 end) as tp, count(case when label = 0 and p >= threshold then 1 end) as fp, count(case when label = 1 and p < threshold then 1 end) as fn, count(case when label = 0 and p < threshold then 1 end) as tn from scores, t group by threshold)"
q.add("calibrate_threshold", lambda s, d: metrics.calibrate(scores(s, d)), _AT.format(s=SCORES, a=1, b=100) + f" select threshold, round(({F1} + {F0}) / 2, 6) as macro_f1 from c order by macro_f1 desc, threshold limit 1")
q.add("metrics_at_thresholds", lambda s, d: metrics.with_f1(metrics.at_thresholds(scores(s, d), [0.5, 0.1])).select("threshold", "accuracy", "precision", "recall", "f1", (F.col("tp") + F.col("fp")).alias("predicted_ai"), (F.col("tp") + F.col("fn")).alias("actual_ai")), _AT.format(s=SCORES, a=1, b=100) + f" select threshold, round({_r('(tp + tn)', 'tp + fp + fn + tn')}, 6) as accuracy, round({_r('tp', 'tp + fp')}, 6) as precision, round({_r('tp', 'tp + fn')}, 6) as recall, round({F1}, 6) as f1, tp + fp as predicted_ai, tp + fn as actual_ai from c where threshold in (0.5, 0.1)")
q.add("transfer_matrix", lambda s, d: scores(s, d).groupBy("source").pivot("split", ["test", "val"]).agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6)).select("source", "test", "val"), f"{W} select source, round(avg(case when split = 'test' then (pred = label)::int end), 6) as test, round(avg(case when split = 'val' then (pred = label)::int end), 6) as val from scores group by source")
q.add("best_model", lambda s, d: scores(s, d).where("source is not null").groupBy("source").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy")).orderBy(F.desc("accuracy"), "source").limit(1), f"{W} select source, round(avg((pred = label)::int), 6) as accuracy from scores where source is not null group by source order by accuracy desc, source limit 1")
q.add("prob_histogram_by_class", lambda s, d: scores(s, d).groupBy("label", F.least(F.floor(F.col("p") * 30), F.lit(29)).cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("density", F.round(F.col("n") * 30.0 / F.sum("n").over(metrics.Window.partitionBy("label")), 6)), f"{W}, b as (select label, cast(least(floor(p * 30), 29) as int) as bin, count(*) as n from scores group by 1, 2) select label, bin, n, round(n * 30.0 / sum(n) over (partition by label), 6) as density from b")
q.add("prob_stats", lambda s, d: scores(s, d).groupBy("split").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_pop("p"), 6).alias("std"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum("pred").alias("n1")), f"{W} select split, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std, min(p) as lo, max(p) as hi, cast(sum(pred) as bigint) as n1 from scores group by split")
q.add("collapse_check", lambda s, d: scores(s, d).groupBy("split").agg(F.countDistinct("pred").alias("n_classes"), F.round(F.avg("pred"), 6).alias("share1")).withColumn("collapsed", (F.col("n_classes") == 1) | (F.col("share1") > 0.98) | (F.col("share1") < 0.02)), f"{W} select split, count(distinct pred) as n_classes, round(avg(pred), 6) as share1, count(distinct pred) = 1 or avg(pred) > 0.98 or avg(pred) < 0.02 as collapsed from scores group by split")

# Decisions.
q.add("verdict_bands", lambda s, d: table(s, d, "raw_predictions").select("prediction_id", scoring.verdict_bands(F.col("ai_probability"), 0.18).alias("verdict")), "select prediction_id, case when ai_probability >= 0.18 then case when ai_probability >= 0.90 then 'KI-generiert (sehr hohe Konfidenz)' when ai_probability >= 0.75 then 'KI-generiert (hohe Konfidenz)' else 'KI-generiert (mittlere Konfidenz)' end when ai_probability < 0.18 then case when ai_probability <= 0.10 then 'Menschlich verfasst (sehr hohe Konfidenz)' when ai_probability <= 0.25 then 'Menschlich verfasst (hohe Konfidenz)' else 'Menschlich verfasst (mittlere Konfidenz) — grenzwertig' end end as verdict from raw_predictions")
q.add("rest_decision", lambda s, d: scores(s, d).select("prediction_id", scoring.decide_by_human(F.col("p"), 0.18).alias("verdict"), F.round(F.greatest("p", 1 - F.col("p")), 6).alias("confidence")), f"{W} select prediction_id, case when 1 - p >= 0.18 then 'Human' else 'AI' end as verdict, round(greatest(p, 1 - p), 6) as confidence from scores")
q.add("batch_summary", lambda s, d: scores(s, d).agg(F.sum(1 - F.col("pred")).alias("n_human"), F.sum("pred").alias("n_ai"), F.round(100 * F.avg("pred"), 6).alias("pct_ai")), f"{W} select cast(sum(1 - pred) as bigint) as n_human, cast(sum(pred) as bigint) as n_ai, round(100 * avg(pred), 6) as pct_ai from scores")
q.add("majority_vote", lambda s, d: scoring.majority(table(s, d, "raw_predictions").withColumn("v", F.when(F.col("ai_probability") >= 0.5, "AI").when(F.col("ai_probability") < 0.5, "Human")), "row_id", "v"), "select row_id, count(case when ai_probability >= 0.5 then 1 end) as ai_votes, count(case when ai_probability < 0.5 then 1 end) as human_votes, case when count(case when ai_probability >= 0.5 then 1 end) > count(case when ai_probability < 0.5 then 1 end) then 'AI' else 'Human' end as verdict from raw_predictions group by row_id")

# Features.
_TOK = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_]{2,})', 1)"
q.add(
    "tfidf",
    lambda s, d: features.tfidf(docs(s, d), "doc_id", "text"),
    f"with d as (select doc_id as id, {_TOK} as w from documents where text is not null), g as (select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d), tf as (select id, term, count(*) as tf from g group by 1, 2), t as (select term, count(*) as df, sum(tf) as cf from tf group by 1 having count(*) >= 2 order by cf desc, term limit 50000), x as (select id, term, (1 + ln(tf)) * (ln((1.0::double + (select count(*) from d)) / (1 + df)) + 1) as raw from tf join t using (term)), n as (select id, sqrt(sum(raw * raw)) as norm from x group by id) select id, term, round(raw / norm, 6) as weight from x join n using (id)",
)
q.add("spearman", lambda s, d: features.spearman(scores(s, d), "p", "words"), f"{W}, s2 as (select p, words from scores where words is not null), r as (select rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as ra, rank() over (order by words) + (count(*) over (partition by words) - 1) / 2.0 as rb from s2) select count(*) as n, round(corr(ra, rb), 6) as rho from r")
q.add("cls_embedding", lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(features.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2")), "select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 4) as norm2 from embeddings")


def _topics(s, d):
    e = table(s, d, "embeddings")
    return features.max_topic_cosine(e, e.where("vec_id < 11").select(F.col("embedding").alias("topic"))).select("vec_id", F.round("max_cosine", 4).alias("max_cosine"))


q.add("embedding_topic_filter", _topics, "select a.vec_id, round(max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 4) as max_cosine from embeddings a, embeddings b where b.vec_id < 11 group by a.vec_id")
q.add("train_log_rollup", lambda s, d: table(s, d, "events").groupBy(F.when(F.col("event_id") <= 3000, 1).when(F.col("event_id") <= 6000, 2).otherwise(3).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("mean_loss"), F.count("*").alias("n")), "select case when event_id <= 3000 then 1 when event_id <= 6000 then 2 else 3 end as epoch, round(avg(value), 6) as mean_loss, count(*) as n from events group by 1")
q.add("logreg", lambda s, d: features.logistic_baseline(table(s, d, "train"), table(s, d, "test")).select("row_id", F.round("p", 6).alias("p")))
