"""Queries over discarding, sampling, scoring and explanation, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import features, mining, quality, sampling, scoring
from .registry import Registry, docs, scores, table
from .set_queries import ORDER, _labelled, _ngram_sql
from .text_queries import SENTS, WORDS, WS

q = Registry()

# Discarding sentences.
_TRIM = f"regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')"
_SENT = f"s as (select row_id, pos, {_TRIM} as s from (select row_id, generate_subscripts(x, 1) as pos, unnest(x) as x from (select row_id, {SENTS} as x from test where text is not null)))"
_OK = f"s <> '' and not regexp_matches(s, {R.quoted('(?i)' + R.portable(R.LIST_HEADER))}) and not regexp_matches(s, '{R.LIST_MARK}') and not {R.any_match_sql('s', R.TRIGGERS)}"
_BAD = f"bad as (select {R.rules_sql('s', R.ABSTRACT)} as template from (select {_TRIM} as s from (select unnest({SENTS}) as x from train where text is not null and label = 1)) where s <> '' group by 1 having count(*) > 1)"
_REST = "select test.row_id, coalesce(t, '') as text from test left join (select row_id, string_agg({0}, ' ' order by pos) as t from k group by row_id) k on test.row_id = k.row_id"


def _templates(s, d):
    each = table(s, d, "train").where("text is not null and label = 1").select(F.explode(T.sentences(F.col("text"))).alias("x")).select(T.trimmed(F.col("x")).alias("s")).where("s <> ''")
    return each.groupBy(T.abstracted(F.col("s")).alias("template")).agg(F.count("*").alias("n")).where("n > 1")


q.add("combined_discard_v1", lambda s, d: quality.discard_combined(table(s, d, "test"), _templates(s, d), "row_id"), f"with {_SENT}, {_BAD}, k as (select * from s where {_OK} and {R.rules_sql('s', R.ABSTRACT)} not in (select template from bad)) {_REST.format('s')}")
for _v, _prefix in ((2, R.COLON_PREFIX), (3, R.COLON_PREFIX_ANY)):
    q.add(
        f"combined_discard_v{_v}",
        lambda s, d, p=_prefix: quality.discard_combined(table(s, d, "test"), _templates(s, d), "row_id", prefix=p),
        f"with {_SENT}, b as (select *, trim({R.rules_sql('s', _prefix)}) as bare from s), {_BAD}, k as (select * from b where {_OK} and bare <> '' and not {R.any_match_sql('bare', R.TRIGGERS)} and {R.rules_sql('s', R.ABSTRACT)} not in (select template from bad) and {R.rules_sql('bare', R.ABSTRACT)} not in (select template from bad)) {_REST.format('bare')}",
    )


def _bad_ngrams(s, d):
    out = None
    for n in (1, 2, 3, 4):
        one = mining.ngram_diff(_labelled(s, d), n, 1, None).where("pct1 > 1.5 and pct0 < 0.1").select("item")
        out = one if out is None else out.unionByName(one)
    return out


_LW = "list_filter(string_split_regex(lower(s), '" + WS + "+'), lambda x: x <> '')"
_GRAMS = "list_concat(" + ", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))" for n in (1, 2, 3, 4)) + ")"
q.add("ngram_discard", lambda s, d: quality.discard_ngrams(table(s, d, "test"), _bad_ngrams(s, d), "row_id"), f"with {_SENT}, bad as ({' union all '.join('select item from (' + _ngram_sql(n, 1, 'where pct1 > 1.5 and pct0 < 0.1') + ')' for n in (1, 2, 3, 4))}), g as (select row_id, pos, unnest({_GRAMS}) as item from (select row_id, pos, {_LW} as w from s)), h as (select distinct row_id, pos from g where item in (select item from bad)), k as (select * from s where s <> '' and (row_id, pos) not in (select row_id, pos from h)) {_REST.format('s')}")

# Sampling.
_O = ORDER.format("doc_id")
q.add(
    "length_quantile_sample",
    lambda s, d: sampling.quantile_sample(_labelled(s, d).select("doc_id", "label", T.word_count(F.col("text")).alias("wc")), "wc", "label", "doc_id", 200).select("doc_id", "label"),
    f"with w as (select doc_id, label, cast(len({WORDS}) as int) as wc from documents where text is not null and label in (0, 1)), e as (select quantile_cont(wc, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as e from w where label = 0), b as (select w.*, (select min(i) from range(1, 11) r(i) where wc >= e.e[i] and wc < e.e[i + 1]) as bin from w, e), r as (select *, row_number() over (partition by label, bin order by {_O}) as rk from b), k as (select *, bin is not null and rk <= 20 as kept from r), t as (select *, 200 - count(case when kept then 1 end) over (partition by label) as lack, count(case when not kept then 1 end) over (partition by label) as rest, row_number() over (partition by label, kept order by {_O}) as rn from k) select doc_id, label from t where kept or (rn <= lack and rest >= lack)",
)
q.add(
    "stratified_equal",
    lambda s, d: sampling.stratified_equal(docs(s, d), "source", "doc_id", 500).select("doc_id", "source"),
    f"with r as (select doc_id, source, row_number() over (partition by source order by {_O}) as rk, (select count(distinct source) from documents) as g from documents where source is not null), k as (select *, rk <= floor(500.0 / g) as kept from r), t as (select *, 500 - count(case when kept then 1 end) over () as lack, count(case when not kept then 1 end) over () as rest, row_number() over (partition by kept order by {_O}) as rn from k) select doc_id, source from t where kept or (rn <= lack and rest >= lack)",
)
_CUT = "3 + cast('0x' || substr(md5(concat(source, ':', cast(i // 8 as varchar))), 1, 6) as bigint) % 3"
q.add(
    "group_paragraphs_random",
    lambda s, d: sampling.paragraphs_of_rows(docs(s, d), "source", "doc_id", "text"),
    f"with d as (select source, doc_id, text, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents where source is not null and text is not null), c as (select *, {_CUT} as cut from d), b as (select *, (i // 8) * 8 + case when i % 8 < cut then 0 else cut end as a, least(case when i % 8 < cut then (i // 8) * 8 + cut else (i // 8 + 1) * 8 end, n) as z from c), p as (select *, case when z - a >= 3 then a else i end as p from b) select source, min(doc_id) as first, cast(count(*) as int) as n, string_agg(text, ' ' order by i) as text from p group by source, p",
)
def _suite_names(s, d):
    return sorted(r[0] for r in docs(s, d).where("source is not null").select("source").distinct().collect())  # a row for a source


q.add("suite_assembly", lambda s, d: sampling.suite(docs(s, d), {n: int(n.startswith("ai_")) for n in _suite_names(s, d)}, "doc_id", 50).select("doc_id", "source", "label", "part"), f"with r as (select doc_id, source, case when starts_with(source, 'ai_') then 1 else 0 end as label, row_number() over (partition by source order by {_O}) as rn from documents where source is not null), n as (select *, count(*) over (partition by source) as n from r where rn <= 50) select doc_id, source, label, case when rn <= ceil(n / 2.0) then 'external_val' else 'final_holdout' end as part from n")
q.add("budget_scheduler", lambda s, d: sampling.budget_schedule(docs(s, d).where("label = 1 and source is not null").groupBy(F.col("source").alias("backend")).agg(F.count("*").alias("done")).withColumn("budget", F.col("done") + 40), 100), "with b as (select source as backend, count(*) as done, count(*) + 40 as budget from documents where label = 1 and source is not null group by source), l as (select backend, unnest(range(done, budget)) as level from b) select cast(row_number() over (order by level, backend) as int) as step, backend from l qualify row_number() over (order by level, backend) <= 100")
_RO = ORDER.format("row_id")
q.add("smoke_subsample", lambda s, d: sampling.smoke(table(s, d, "train"), table(s, d, "test"), "row_id", 100), f"select row_id, 'train' as part from (select row_id, row_number() over (order by {_RO}) as rn from train) where rn <= 100 union all select row_id, 'test' from (select row_id, row_number() over (order by {_RO}) as rn from test) where rn <= 25")

# Scoring texts.
_SCORER = scoring.long_word_scorer()
_p_sql = lambda x: f"case when {x} = '' then 0.0 else len(list_filter(string_split({x}, ' '), lambda w: length(w) >= 7))::double / len(string_split({x}, ' ')) end"
q.add("score_batch", lambda s, d: scoring.score_batch(table(s, d, "test"), _SCORER).select("row_id", "ai_probability", "predicted_label", "verdict"), f"with p as (select row_id, {_p_sql('coalesce(text, ' + chr(39) * 2 + ')')} as p from test) select row_id, round_even(p, 4) as ai_probability, cast(p >= 0.5 as int) as predicted_label, case when p >= 0.5 then 'AI' else 'Human' end as verdict from p")
_PRE = f"coalesce(trim(regexp_replace({R.rules_sql('text', R.MARKERS + R.URLS)}, '{WS}+', ' ', 'g')), '')"
_BANDS = "case when p >= 0.5 then case when p >= 0.90 then 'KI-generiert (sehr hohe Konfidenz)' when p >= 0.75 then 'KI-generiert (hohe Konfidenz)' else 'KI-generiert (mittlere Konfidenz)' end else case when p <= 0.10 then 'Menschlich verfasst (sehr hohe Konfidenz)' when p <= 0.25 then 'Menschlich verfasst (hohe Konfidenz)' else 'Menschlich verfasst (mittlere Konfidenz) — grenzwertig' end end"
q.add(
    "score_single",
    lambda s, d: scoring.score_single(table(s, d, "test"), _SCORER, "row_id", size=32, step=16),
    f"with a as (select row_id, {_PRE} as t0 from test), b as (select row_id, case when length(t0) > 1024 then regexp_replace(substr(t0, 1, 1024), '(?s) [^ ]*$', '') else t0 end as text from a), w as (select row_id, text, {WORDS} as w from b), c as (select row_id, text, list_filter(list_transform(range(0, 1 + greatest(0, cast(ceil((len(w) - 32) / 16.0) as bigint))), lambda i: list_slice(w, i * 16 + 1, i * 16 + 32)), lambda x: len(x) >= 10) as c from w), f as (select row_id, unnest(case when len(c) > 0 then list_transform(c, lambda x: array_to_string(x, ' ')) else [text] end) as x from c), p as (select row_id, count(*) as n_chunks, avg({_p_sql('x')}) as p from f group by row_id) select row_id, n_chunks, round_even(round(p, 9), 4) as ai_prob, round_even(round(1 - p, 9), 4) as human_prob, cast(p >= 0.5 as int) as label, round_even(round(case when p >= 0.5 then p else 1 - p end, 9), 4) as confidence, {_BANDS} as verdict from p",
)


def _broken(texts):
    raise ValueError("no model")


_MODELS = {"a": (_SCORER, 0.18), "b": (scoring.long_word_scorer(5), 0.5), "c": (_broken, 0.5)}
q.add("predict_all", lambda s, d: scoring.predict_all(table(s, d, "test"), _MODELS, "row_id").select("row_id", "model", F.bround("ai_prob", 4).alias("ai_prob"), "verdict", "error"), f"with t as (select row_id, coalesce(text, '') as x from test), m as (select row_id, 'a' as model, {_p_sql('x')} as p, 0.18 as h from t union all select row_id, 'b', {_p_sql('x').replace('>= 7', '>= 5')}, 0.5 from t) select row_id, model, round_even(p, 4) as ai_prob, case when 1 - p >= h then 'Human' else 'AI' end as verdict, cast(null as varchar) as error from m union all select row_id, 'c', null, null, 'ValueError: no model' from t")

# Words and explanations.
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: regexp_matches(x, '{T.LISTED_TOKEN}'))"
q.add("token_regex_topk", lambda s, d: docs(s, d).where("text is not null").select(F.explode(T.listed_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50), f"select token, count(*) as n from (select unnest({_TOKENS}) as token from documents where text is not null) group by token order by n desc, token limit 50")


def _wrong(s, d):
    texts = table(s, d, "test").unionByName(table(s, d, "val")).select("row_id", "text")
    return scores(s, d).join(texts, "row_id").where("pred <> label").select(F.when(F.col("pred") == 1, "FP").otherwise("FN").alias("side"), "text")


q.add("top_misclassified_words", lambda s, d: _wrong(s, d).select("side", F.explode(T.listed_tokens(F.col("text"))).alias("word")).groupBy("side", "word").agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(sampling.Window.partitionBy("side").orderBy(F.desc("n"), "word"))).where("rn <= 10"), f"with t as (select row_id, text from test union all select row_id, text from val), x as (select case when ai_probability >= 0.5 then 'FP' else 'FN' end as side, text from raw_predictions join t using (row_id) where label is not null and ai_probability is not null and (ai_probability >= 0.5) <> (label = 1)), w as (select side, unnest({_TOKENS}) as word from x), c as (select side, word, count(*) as n from w group by 1, 2) select side, word, n, cast(row_number() over (partition by side order by n desc, word) as int) as rn from c qualify row_number() over (partition by side order by n desc, word) <= 10")
_CHARS = r"^[^\p{L}\p{N}_�]+|[^\p{L}\p{N}_�]+$"
q.add("replacement_char_words", lambda s, d: table(s, d, "train").where(F.col("text").contains("�")).select(F.explode(T.words(F.col("text"))).alias("x")).where(F.col("x").contains("�")).groupBy(F.regexp_replace(F.lower("x"), _CHARS, "").alias("w")).agg(F.count("*").alias("n")), f"select regexp_replace(lower(x), '{_CHARS}', '', 'g') as w, count(*) as n from (select unnest({WORDS}) as x from train where text is not null) where contains(x, '�') group by 1")
q.add("top_coefs", lambda s, d: features.top_coefs(features.word_coefs(table(s, d, "train"))).select("side", "rank", "feature", F.round("coef", 6).alias("coef")))
_COEFS = {"wc": 0.02, "digits": 3.0, "mean_word": 0.5}
q.add("shap_global", lambda s, d: features.linear_shap(docs(s, d).where("text <> ''").select(T.word_count(F.col("text")).alias("wc"), T.digit_ratio(F.col("text")).alias("digits"), (F.length("text") / F.greatest(T.word_count(F.col("text")), F.lit(1))).alias("mean_word")), _COEFS), f"with f as (select cast(len({WORDS}) as int) as wc, length(regexp_replace(text, '[^0-9]', '', 'g'))::double / length(text) as digits, length(text)::double / greatest(len({WORDS}), 1) as mean_word from documents where text <> ''), m as (select avg(wc) as a, avg(digits) as b, avg(mean_word) as c from f) select 'wc' as feature, round(avg(abs(0.02 * (wc - a))), 6) as mean_abs from f, m union all select 'digits', round(avg(abs(3.0 * (digits - b))), 6) from f, m union all select 'mean_word', round(avg(abs(0.5 * (mean_word - c))), 6) from f, m")
q.add("token_aggregation", lambda s, d: scoring.token_attributions(docs(s, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "token")).withColumn("value", ((F.col("pos") % 7) - 3) / F.lit(8.0)), "doc_id", "token", "value"), "with x as (select doc_id, generate_subscripts(t, 1) - 1 as pos, unnest(t) as token from (select doc_id, string_split(text, ' ') as t from documents where text is not null)), a as (select doc_id, trim(token) as token, sum((pos % 7 - 3) / 8.0::double) as value from x where trim(token) <> '' group by 1, 2) select doc_id, token, value, cast(row_number() over (partition by doc_id order by abs(value) desc, token) as int) as rank from a qualify row_number() over (partition by doc_id order by abs(value) desc, token) <= 8")
q.add("humanize_text", lambda s, d: docs(s, d).where("text is not null").select("doc_id", T.humanize(F.col("text"), F.col("doc_id")).alias("text")))
