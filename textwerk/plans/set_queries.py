"""Queries over duplicates, mining, sampling, splits and joins, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import dedup, mining, sampling
from .registry import Registry, docs, table
from .text_queries import SENTS, WORDS, WS

q = Registry()
FP = f"md5(trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')))"
ORDER = "md5(concat(cast({0} as varchar), '42')), {0}"
LOWER_WORDS = WORDS.replace("(text", "(lower(text)")


def _fp(df):
    return df.withColumn("fp", T.fingerprint(F.col("text")))


def _labelled(s, d):
    return docs(s, d).where("text is not null and label is not null")


# Duplicates and leakage.
q.add("dedup_exact_text", lambda s, d: dedup.keep_first(table(s, d, "train"), ["text"], "row_id").select("row_id"), "select min(row_id) as row_id from train where text is not null group by text")
q.add("dedup_fingerprint", lambda s, d: dedup.keep_first(_fp(table(s, d, "train")), ["fp"], "row_id").select("row_id", "fp"), f"select min(row_id) as row_id, fp from (select row_id, {FP} as fp from train where text is not null) group by fp")
q.add(
    "dup_report",
    lambda s, d: table(s, d, "train").where("text is not null").groupBy("text").count().agg(F.sum("count").alias("n"), F.count("*").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("n_in_groups")),
    "select cast(sum(c) as bigint) as n, count(*) as n_unique, cast(coalesce(sum(case when c > 1 then c end), 0) as bigint) as n_in_groups from (select count(*) as c from train where text is not null group by text)",
)
q.add("cross_class_dedup_both", lambda s, d: dedup.cross_class(_fp(table(s, d, "train").where("text is not null and label is not null")), "fp", "label").select("row_id"), f"with t as (select row_id, label, {FP} as fp from train where text is not null and label is not null) select row_id from t where fp not in (select fp from t group by fp having count(distinct label) > 1)")
q.add("cross_class_dedup_ai_only", lambda s, d: dedup.cross_class(_fp(table(s, d, "train").where("text is not null and label is not null")), "fp", "label", (1,)).select("row_id"), f"with t as (select row_id, label, {FP} as fp from train where text is not null and label is not null) select row_id from t where label = 0 or fp not in (select fp from t group by fp having count(distinct label) > 1)")
_THREE = f"t as (select 'train' as s, {FP} as k from train where text is not null union all select 'test', {FP} from test where text is not null union all select 'val', {FP} from val where text is not null), u as (select distinct s, k from t)"
q.add(
    "split_overlap_matrix",
    lambda s, d: dedup.overlap_matrix({n: _fp(table(s, d, n)) for n in ("train", "test", "val")}, "fp"),
    f"with {_THREE} select a.s as split_a, b.s as split_b, (select count(*) from u x join u y on x.k = y.k where x.s = a.s and y.s = b.s) as n_shared, (select count(*) from u where s = b.s) as n_b, round(100.0 * (select count(*) from u x join u y on x.k = y.k where x.s = a.s and y.s = b.s) / (select count(*) from u where s = b.s), 6) as pct_of_b from (values ('test'), ('train'), ('val')) a(s), (values ('test'), ('train'), ('val')) b(s) where a.s < b.s",
)
q.add("split_decontaminate", lambda s, d: dedup.decontaminate(_fp(table(s, d, "test").unionByName(table(s, d, "val"))), _fp(table(s, d, "train")), "fp").select("row_id"), f"select row_id from (from test union all by name from val) where text is null or {FP} not in (select {FP} from train where text is not null)")
_P8 = f"array_to_string(list_slice({LOWER_WORDS}, 1, 8), ' ')"
q.add("near_dup_prefix8", lambda s, d: dedup.shared_share(*(table(s, d, n).where("text is not null").select(T.word_prefix(F.col("text")).alias("k")) for n in ("test", "train")), "k", 5.0), f"with a as (select {_P8} in (select {_P8} from train where text is not null) as hit from test where text is not null) select count(*) as n, count(case when hit then 1 end) as n_shared, round(100.0 * count(case when hit then 1 end) / count(*), 6) as pct, 100.0 * count(case when hit then 1 end) / count(*) > 5 as warned from a")
q.add("near_dup_prefix50", lambda s, d: table(s, d, "test").where("text is not null").select(F.substring("text", 1, 50).alias("prefix")).intersect(table(s, d, "train").where("text is not null").select(F.substring("text", 1, 50).alias("prefix"))), "select substr(text, 1, 50) as prefix from test where text is not null intersect select substr(text, 1, 50) from train where text is not null")
_G = f"list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) end)"
q.add(
    "near_dup_jaccard3",
    lambda s, d: dedup.near_jaccard(table(s, d, "val").unionByName(table(s, d, "test")), table(s, d, "train"), "row_id", "text"),
    f"with a as (select row_id, {_G} as g from (select row_id, {LOWER_WORDS} as w from (select row_id, text from val union all select row_id, text from test) where text is not null)), b as (select row_id, {_G} as g from (select row_id, {LOWER_WORDS} as w from train where text is not null)), x as (select row_id, len(g) as n, unnest(g) as t from a), y as (select row_id, len(g) as n, unnest(g) as t from b), p as (select x.row_id as eval_id, y.row_id as train_id, count(*) as c, any_value(x.n) as na, any_value(y.n) as nb from x join y on x.t = y.t group by 1, 2) select eval_id, train_id, round(c::double / (na + nb - c), 6) as jaccard from p where c::double / (na + nb - c) > 0.8",
)
_GROUP_SQL = "case when id is null then 'unknown' when contains(id, '_seg') then string_split(id, '_seg')[1] when contains(id, '__') then string_split(id, '__')[1] when regexp_matches(id, '^gesetz_[a-zA-Z0-9]+_[0-9]+$') then regexp_extract(id, '^(gesetz_[a-zA-Z0-9]+)_[0-9]+$', 1) when regexp_matches(id, '^eupdcorp_[0-9]+_[0-9]+$') then regexp_extract(id, '^(eupdcorp_[0-9]+)_[0-9]+$', 1) when regexp_matches(id, '^[0-9]+_[^_]+_[0-9]+$') then regexp_extract(id, '^([0-9]+_[^_]+)_[0-9]+$', 1) else id end"
q.add(
    "group_leakage",
    lambda s, d: table(s, d, "train").select(F.lit("train").alias("s"), "id").union(table(s, d, "test").select(F.lit("test"), "id")).union(table(s, d, "val").select(F.lit("val"), "id")).groupBy(T.group_of_id(F.col("id")).alias("group_id")).agg(F.countDistinct("s").alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1"),
    f"select {_GROUP_SQL} as group_id, count(distinct s) as n_splits, count(*) as n from (select 'train' as s, id from train union all select 'test', id from test union all select 'val', id from val) group by 1 having count(distinct s) > 1",
)

# Aggregation and mining.
for _c in ("label", "source", "domain", "meta"):
    q.add(f"value_counts_{_c}", lambda s, d, c=_c: mining.value_counts(table(s, d, "train"), c), f"select cast({_c} as varchar) as value, count(*) as n from train group by {_c}")
q.add("group_first_count", lambda s, d: table(s, d, "train").groupBy(T.group_of_id(F.col("id")).alias("group_id")).agg(F.min_by("domain", "row_id").alias("domain"), F.min_by("label", "row_id").alias("label"), F.count("label").alias("n")), f"select {_GROUP_SQL} as group_id, arg_min_null(domain, row_id) as domain, arg_min_null(label, row_id) as label, count(label) as n from train group by 1")
EDGES = [20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150, float("inf")]
EDGES_V5 = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 200, 10000]
_bin_sql = lambda v, e: "case " + " ".join(f"when {v} > {a} and {v} <= {b if b != float('inf') else chr(39) + 'inf' + chr(39) + '::double'} then {i}" for i, (a, b) in enumerate(zip(e, e[1:]))) + " end"
_WC = f"len({WORDS})"


def _binned(s, d, edges):
    return _labelled(s, d).withColumn("bin", sampling.right_closed_bin(T.word_count(F.col("text")), edges))


q.add("pivot_bin_label", lambda s, d: _binned(s, d, EDGES).groupBy("bin").pivot("label", [0, 1]).agg(F.count(F.lit(1))).na.fill(0).select("bin", F.col("0").alias("n0"), F.col("1").alias("n1")), f"select cast({_bin_sql(_WC, EDGES)} as int) as bin, count(case when label = 0 then 1 end) as n0, count(case when label = 1 then 1 end) as n1 from documents where text is not null and label is not null group by 1")
q.add("ws_audit", lambda s, d: mining.prevalence(_labelled(s, d), {"newline": F.col("text").contains("\n"), "tab": F.col("text").contains("\t"), "double_space": F.col("text").contains("  ")}), "with l as (select * from documents where text is not null and label is not null) select test, label, count(*) as n, count(case when hit then 1 end) as hits, round(100.0 * count(case when hit then 1 end) / count(*), 6) as pct from (select 'newline' as test, label, contains(text, chr(10)) as hit from l union all select 'tab', label, contains(text, chr(9)) from l union all select 'double_space', label, contains(text, '  ') from l) group by 1, 2")
q.add("char_presence", lambda s, d: mining.prevalence(_labelled(s, d), {c: F.col("text").contains(c) for c in R.SPECIAL_CHARS}), f"select c as test, label, count(*) as n, count(case when contains(text, c) then 1 end) as hits, round(100.0 * count(case when contains(text, c) then 1 end) / count(*), 6) as pct from documents, (select unnest([{', '.join(R.quoted(c) for c in R.SPECIAL_CHARS)}]) as c) where text is not null and label is not null group by 1, 2")
q.add("char_prevalence_diff", lambda s, d: mining.prevalence(_labelled(s, d), {c: F.col("text").contains(c) for c in R.SPECIAL_CHARS}).groupBy("test").agg(F.round(F.abs(F.max(F.when(F.col("label") == 0, F.col("pct"))) - F.max(F.when(F.col("label") == 1, F.col("pct")))), 4).alias("diff")), f"with p as (select c as test, label, round(100.0 * count(case when contains(text, c) then 1 end) / count(*), 6) as pct from documents, (select unnest([{', '.join(R.quoted(c) for c in R.SPECIAL_CHARS)}]) as c) where text is not null and label is not null group by 1, 2) select test, round(abs(max(case when label = 0 then pct end) - max(case when label = 1 then pct end)), 4) as diff from p group by test")
q.add("lexical_shortcuts", lambda s, d: mining.prevalence(_labelled(s, d), {n: F.col("text").rlike(R.portable(p)) for n, p in R.SHORTCUTS}).withColumn("flagged", F.col("pct") > 10), "with l as (select * from documents where text is not null and label is not null) select test, label, count(*) as n, count(case when hit then 1 end) as hits, round(100.0 * count(case when hit then 1 end) / count(*), 6) as pct, 100.0 * count(case when hit then 1 end) / count(*) > 10 as flagged from (" + " union all ".join(f"select '{n}' as test, label, regexp_matches(text, {R.quoted(R.portable(p))}) as hit from l" for n, p in R.SHORTCUTS) + ") group by 1, 2")


def _ngram_sql(n: int, least: int, tail: str) -> str:
    return f"with l as (select doc_id, label, {LOWER_WORDS} as w from documents where text is not null and label in (0, 1)), m as (select least(count(case when label = 0 then 1 end), count(case when label = 1 then 1 end)) as m from l), g as (select label, unnest(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')))) as item from l), c as (select item, count(case when label = 0 then 1 end) as n0, count(case when label = 1 then 1 end) as n1 from g group by item having count(*) > {least}), p as (select item, n0, n1, round(100.0 * n0 / m, 6) as pct0, round(100.0 * n1 / m, 6) as pct1 from c, m), f as (select *, round(abs(pct1 - pct0), 6) as diff from p) select item, n0, n1, pct0, pct1, diff from f {tail}"


for _n in (1, 2):
    q.add(f"ngram_docfreq_diff_{_n}", lambda s, d, n=_n: mining.ngram_diff(_labelled(s, d), n, 5), _ngram_sql(_n, 5, "order by diff desc, item limit 30"))
for _n in (1, 2, 3, 4):
    q.add(f"bad_ngrams_{_n}", lambda s, d, n=_n: mining.ngram_diff(_labelled(s, d), n, 1, None).where("pct1 > 1.5 and pct0 < 0.1"), _ngram_sql(_n, 1, "where pct1 > 1.5 and pct0 < 0.1"))
_S = f"with s as (select regexp_replace(unnest({SENTS}), '^{WS}+|{WS}+$', '', 'g') as sentence from train where text is not null and label = 1)"


def _sents(s, d):
    return table(s, d, "train").where("text is not null and label = 1").select(F.explode(T.sentences(F.col("text"))).alias("x")).select(T.trimmed(F.col("x")).alias("sentence")).where("sentence <> ''")


q.add("sentence_freq", lambda s, d: _sents(s, d).groupBy("sentence").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sentence").limit(50), f"{_S} select sentence, count(*) as n from s where sentence <> '' group by 1 order by n desc, sentence limit 50")
q.add("template_freq", lambda s, d: _sents(s, d).groupBy(F.regexp_replace(R.apply_rules(F.col("sentence"), R.ABSTRACT), "[0-9]+", "0").alias("template")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template").limit(50), f"{_S} select regexp_replace({R.rules_sql('sentence', R.ABSTRACT)}, '[0-9]+', '0', 'g') as template, count(*) as n from s where sentence <> '' group by 1 order by n desc, template limit 50")
q.add("bad_templates", lambda s, d: _sents(s, d).groupBy(R.apply_rules(F.col("sentence"), R.ABSTRACT).alias("template")).agg(F.count("*").alias("n")).where("n > 3"), f"{_S} select {R.rules_sql('sentence', R.ABSTRACT)} as template, count(*) as n from s where sentence <> '' group by 1 having count(*) > 3")
q.add("length_stats", lambda s, d: _labelled(s, d).select("label", T.word_count(F.col("text")).alias("w")).groupBy("label").agg(F.round(F.avg("w"), 6).alias("mean"), F.percentile("w", F.lit(0.5)).alias("median"), F.round(F.stddev_samp("w"), 6).alias("std"), F.min("w").alias("lo"), F.max("w").alias("hi")), f"select label, round(avg(w), 6) as mean, quantile_cont(w, 0.5) as median, round(stddev_samp(w), 6) as std, min(w) as lo, max(w) as hi from (select label, cast({_WC} as int) as w from documents where text is not null and label is not null) group by label")
q.add("token_len_profile", lambda s, d: docs(s, d).where("text is not null").select(T.word_count(F.col("text")).alias("w")).agg(F.round(F.avg("w"), 6).alias("mean"), F.round(F.percentile("w", F.lit(0.95)), 6).alias("p95"), F.round(F.avg((F.col("w") > 256).cast("int")), 6).alias("over")), f"select round(avg(w), 6) as mean, round(quantile_cont(w, 0.95), 6) as p95, round(avg(case when w > 256 then 1.0 else 0.0 end), 6) as over from (select cast({_WC} as int) as w from documents where text is not null)")
q.add("split_report", lambda s, d: table(s, d, "train").select(F.lit("train").alias("split"), "label", "text").union(table(s, d, "test").select(F.lit("test"), "label", "text")).union(table(s, d, "val").select(F.lit("val"), "label", "text")).groupBy("split", "label").agg(F.count("*").alias("n"), F.round(F.avg(T.word_count(F.col("text"))), 6).alias("mean_words")), f"select split, label, count(*) as n, round(avg({_WC}), 6) as mean_words from (select 'train' as split, label, text from train union all select 'test', label, text from test union all select 'val', label, text from val) group by 1, 2")
q.add("split_report_rollup", lambda s, d: docs(s, d).rollup("source", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")), "select source, label, count(*) as n, cast(grouping(source, label) as int) as level from documents group by rollup(source, label)")
q.add("sample_per_group", lambda s, d: sampling.ranked(docs(s, d).where("source is not null"), ["source"], "doc_id").where("rn <= 5").select("source", "doc_id"), f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by {ORDER.format('doc_id')}) as rn from documents where source is not null) where rn <= 5")

# Sampling and splits.
q.add("sample_n", lambda s, d: docs(s, d).orderBy(sampling.hash_order("doc_id"), "doc_id").limit(100).select("doc_id"), f"select doc_id from documents order by {ORDER.format('doc_id')} limit 100")
q.add("shuffle", lambda s, d: docs(s, d).select("doc_id", sampling.hash_order("doc_id").alias("place")).orderBy("place", "doc_id"), "select doc_id, md5(concat(cast(doc_id as varchar), '42')) as place from documents")


def _match_sql(edges) -> str:
    return f"with b as (select doc_id, label, cast({_bin_sql(_WC, edges)} as int) as bin from documents where text is not null and label in (0, 1)), c as (select bin, least(count(case when label = 0 then 1 end), count(case when label = 1 then 1 end)) as m from b where bin is not null group by bin), r as (select *, row_number() over (partition by bin, label order by {ORDER.format('doc_id')}) as rn from b where bin is not null) select r.doc_id, r.label, r.bin from r join c on r.bin = c.bin where rn <= m"


q.add("length_match_10w", lambda s, d: sampling.match_by_bin(_binned(s, d, EDGES), "bin", "label", "doc_id").select("doc_id", "label", "bin"), _match_sql(EDGES))
q.add("length_match_v5", lambda s, d: sampling.match_by_bin(_binned(s, d, EDGES_V5), "bin", "label", "doc_id").select("doc_id", "label", "bin"), _match_sql(EDGES_V5))
q.add("balance_min_class", lambda s, d: sampling.balance_min(docs(s, d), "label", "doc_id").select("doc_id", "label"), f"with r as (select doc_id, label, row_number() over (partition by label order by {ORDER.format('doc_id')}) as rn from documents where label is not null) select doc_id, label from r where rn <= (select min(c) from (select count(*) as c from documents where label is not null group by label))")
_SPLIT = "case when rn <= ceil(0.5 * ceil(0.2 * n)) then 'test' when rn <= ceil(0.2 * n) then 'val' else 'train' end as split"
q.add("split_stratified", lambda s, d: sampling.split_by_rank(docs(s, d), ["label"], "doc_id").select("doc_id", "label", "split"), f"select doc_id, label, {_SPLIT} from (select doc_id, label, row_number() over (partition by label order by {ORDER.format('doc_id')}) as rn, count(*) over (partition by label) as n from documents)")
q.add("split_80_10_10", lambda s, d: sampling.split_by_rank(docs(s, d).where("label is not null"), ["label"], "doc_id").select("doc_id", "label", "split"), f"select doc_id, label, {_SPLIT} from (select doc_id, label, row_number() over (partition by label order by {ORDER.format('doc_id')}) as rn, count(*) over (partition by label) as n from documents where label is not null)")
q.add("split_int_slices", lambda s, d: sampling.ranked(docs(s, d).where("label is not null"), ["label"], "doc_id").withColumn("n", F.count("*").over(sampling.Window.partitionBy("label"))).select("doc_id", F.when(F.col("rn") <= F.floor(F.col("n") * 0.8), "train").when(F.col("rn") <= F.floor(F.col("n") * 0.8) + F.floor(F.col("n") * 0.1), "val").otherwise("test").alias("split")), f"select doc_id, case when rn <= floor(n * 0.8) then 'train' when rn <= floor(n * 0.8) + floor(n * 0.1) then 'val' else 'test' end as split from (select doc_id, row_number() over (partition by label order by {ORDER.format('doc_id')}) as rn, count(*) over (partition by label) as n from documents where label is not null)")
q.add("split_group_greedy", lambda s, d: sampling.greedy_group_split(table(s, d, "train").where("id is not null").groupBy(T.group_of_id(F.col("id")).alias("group_id")).agg(F.min_by("domain", "row_id").alias("domain"), F.min_by("label", "row_id").alias("label"), F.count("*").alias("n")).where("domain is not null and label is not null"), ["domain", "label"]))
q.add("assemble_union", lambda s, d: table(s, d, "external_eval").unionByName(table(s, d, "test"), allowMissingColumns=True).select("item_id", "row_id", "source", "label"), "select item_id, cast(null as bigint) as row_id, source, label from external_eval union all select null, row_id, source, label from test")
q.add("leave_one_source_out", lambda s, d: docs(s, d).where("source like 'ai_%' or label = 0").select("doc_id", F.when(F.col("source") == "ai_elbe", "test").when(F.col("label") == 0, "both").otherwise("train").alias("part")), "select doc_id, case when source = 'ai_elbe' then 'test' when label = 0 then 'both' else 'train' end as part from documents where source like 'ai_%' or label = 0")
q.add("src_csv_range", lambda s, d: docs(s, d).where("doc_id >= 100 and doc_id < 400").select("doc_id"), "select doc_id from documents where doc_id >= 100 and doc_id < 400")
q.add("src_nrows", lambda s, d: docs(s, d).orderBy("doc_id").limit(10).select("doc_id"), "select doc_id from documents order by doc_id limit 10")

# Joins and set operations.
q.add("join_left_group", lambda s, d: docs(s, d).join(F.broadcast(table(s, d, "mix_targets")), "source", "left").select("doc_id", "source", "target_share"), "select doc_id, documents.source, target_share from documents left join mix_targets on documents.source = mix_targets.source")
q.add("map_lookup", lambda s, d: docs(s, d).select("doc_id", F.element_at(F.create_map(F.lit(0), F.lit("human"), F.lit(1), F.lit("machine")), F.col("label")).alias("class")), "select doc_id, case label when 0 then 'human' when 1 then 'machine' end as class from documents")
q.add("semi_join", lambda s, d: docs(s, d).join(F.broadcast(table(s, d, "mix_targets")), "source", "left_semi").select("doc_id"), "select doc_id from documents where source in (select source from mix_targets)")
q.add("anti_join", lambda s, d: docs(s, d).join(F.broadcast(table(s, d, "mix_targets")), "source", "left_anti").select("doc_id"), "select doc_id from documents where source is null or source not in (select source from mix_targets)")
q.add("set_intersect", lambda s, d: table(s, d, "train").select("source").intersect(table(s, d, "test").select("source")), "select source from train intersect select source from test")
q.add("set_union", lambda s, d: table(s, d, "train").select("source").union(table(s, d, "test").select("source")).distinct(), "select source from train union select source from test")
q.add("set_except", lambda s, d: table(s, d, "train").select("source").exceptAll(table(s, d, "test").select("source")).distinct(), "select distinct source from (select source from train except all select source from test)")
q.add("union_all", lambda s, d: table(s, d, "test").select("row_id").unionByName(table(s, d, "val").select("row_id")), "select row_id from test union all select row_id from val")
q.add("top_k", lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(20), "select doc_id, cast(length(text) as int) as n from documents where text is not null order by n desc, doc_id limit 20")
