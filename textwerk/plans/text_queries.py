"""Queries over text functions, rule sets and gates, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import quality
from .registry import Registry, docs, table

q = Registry()
WS = R.WS
NORM = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
WORDS = f"list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '')"
SENTS = f"string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(31), 'g'), chr(31))"


def _scalar(name: str, make, sql: str) -> None:
    """A function of a document's text, over all documents with one."""
    q.add(name, lambda s, d: docs(s, d).where("text is not null").select("doc_id", make().alias("v")), f"select doc_id, {sql} as v from documents where text is not null")


_scalar("normalize_ws", lambda: T.normalize_ws(F.col("text")), NORM)
_scalar("fingerprint", lambda: T.fingerprint(F.col("text")), f"md5(trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')))")
_scalar("word_count", lambda: T.word_count(F.col("text")), f"cast(len({WORDS}) as int)")
for _name, _rules in (("replace_domain_markers", R.MARKERS), ("strip_artifacts", R.ARTIFACTS), ("strip_templates_ci", R.TEMPLATES), ("regex_phrase_removal", R.PHRASES), ("strip_urls", R.URLS), ("strip_social", R.SOCIAL), ("strip_markdown", R.MARKDOWN), ("colon_prefix_strip", R.COLON_PREFIX), ("colon_prefix_strip_any", R.COLON_PREFIX_ANY), ("abstract_sentence", R.ABSTRACT)):
    _scalar(_name, lambda r=_rules: F.trim(R.apply_rules(F.col("text"), r)), f"trim({R.rules_sql('text', _rules)})")
_scalar("truncate_chars", lambda: T.truncate_chars(F.col("text")), "case when length(text) > 1024 then regexp_replace(substr(text, 1, 1024), '(?s) [^ ]*$', '') else text end")
_scalar("truncate_words", lambda: T.truncate_words(F.col("text"), 100), f"array_to_string(list_slice({WORDS}, 1, 100), ' ')")
_scalar("word_prefix8", lambda: T.word_prefix(F.col("text")), f"array_to_string(list_slice({WORDS.replace('(text', '(lower(text)')}, 1, 8), ' ')")
_scalar("char_prefix50", lambda: F.substring(F.lower("text"), 1, 50), "substr(lower(text), 1, 50)")
_scalar("digit_ratio", lambda: F.round(T.digit_ratio(F.col("text")), 6), "round(length(regexp_replace(text, '[^0-9]', '', 'g'))::double / nullif(length(text), 0), 6)")
_scalar("first_k_sentences", lambda: F.when(T.word_count(F.array_join(F.slice(T.sentences(F.col("text")), 1, 3), " ")) < 20, F.substring("text", 1, 300)).otherwise(F.array_join(F.slice(T.sentences(F.col("text")), 1, 3), " ")), f"case when len(list_filter(string_split_regex(array_to_string(list_slice({SENTS}, 1, 3), ' '), '{WS}+'), lambda x: x <> '')) < 20 then substr(text, 1, 300) else array_to_string(list_slice({SENTS}, 1, 3), ' ') end")
_scalar("trigram_set", lambda: F.size(T.trigram_set(F.col("text"))), f"(with w as (select {WORDS.replace('(text', '(lower(text)')} as w) select cast(case when len(w) < 3 then 1 else len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) end as int) from w)")
_scalar("sentence_discard", lambda: T.discard_sentences(F.col("text")), f"array_to_string(list_filter(list_transform({SENTS}, lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '' and not regexp_matches(x, {R.quoted('(?i)' + R.portable(R.LIST_HEADER))}) and not regexp_matches(x, '{R.LIST_MARK}') and not {R.any_match_sql('x', R.TRIGGERS)}), ' ')")

q.add(
    "split_sentences",
    lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")),
    f"select doc_id, cast(generate_subscripts(x, 1) - 1 as int) as pos, unnest(x) as sentence from (select doc_id, {SENTS} as x from documents where text is not null)",
)
q.add(
    "group_every_k",
    lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.posexplode(T.groups_of(T.sentences(F.col("text")), 3)).alias("pos", "paragraph")),
    f"select doc_id, cast((pos - 1) // 3 as int) as pos, string_agg(sentence, ' ' order by pos) as paragraph from (select doc_id, generate_subscripts(x, 1) as pos, unnest(x) as sentence from (select doc_id, {SENTS} as x from documents where text is not null)) group by doc_id, (pos - 1) // 3",
)
q.add(
    "word_ngrams",
    lambda s, d: docs(s, d).where("text is not null").select("doc_id", T.words(F.lower("text")).alias("w")).select("doc_id", *(F.size(F.array_distinct(T.ngrams(F.col("w"), n))).alias(f"n{n}") for n in (1, 2, 3, 4))),
    f"with w as (select doc_id, {WORDS.replace('(text', '(lower(text)')} as w from documents where text is not null) select doc_id, " + ", ".join(f"cast(len(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')))) as int) as n{n}" for n in (1, 2, 3, 4)) + " from w",
)
q.add(
    "sliding_chunks",
    lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.posexplode(T.chunks(F.col("text"), 64, 32)).alias("pos", "chunk")),
    f"with w as (select doc_id, text, {WORDS} as w from documents where text is not null), c as (select doc_id, text, list_filter(list_transform(range(0, 1 + greatest(0, cast(ceil((len(w) - 64) / 32.0) as bigint))), lambda i: list_slice(w, i * 32 + 1, i * 32 + 64)), lambda x: len(x) >= 10) as c from w), f as (select doc_id, case when len(c) > 0 then list_transform(c, lambda x: array_to_string(x, ' ')) else [text] end as c from c) select doc_id, cast(generate_subscripts(c, 1) - 1 as int) as pos, unnest(c) as chunk from f",
)
q.add(
    "discard_trace",
    lambda s, d: docs(s, d).where("text is not null").select(F.explode(T.sentences(F.col("text"))).alias("x")).select(F.coalesce(T.discard_reason(T.trimmed(F.col("x"))), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    f"with s as (select regexp_replace(unnest({SENTS}), '^{WS}+|{WS}+$', '', 'g') as x from documents where text is not null) select case when x = '' then 'empty' when regexp_matches(x, {R.quoted('(?i)' + R.portable(R.LIST_HEADER))}) then 'list_header' when regexp_matches(x, '{R.LIST_MARK}') then 'list_mark' when {R.any_match_sql('x', R.TRIGGERS)} then 'template' else 'kept' end as reason, count(*) as n from s group by 1",
)
q.add(
    "template_share",
    lambda s, d: docs(s, d).where("text is not null").select("label", F.explode(T.sentences(F.col("text"))).alias("x")).groupBy("label").agg(F.count("*").alias("n"), F.round(100.0 * F.avg(T.discard_reason(T.trimmed(F.col("x"))).isNotNull().cast("int")), 6).alias("pct")),
    f"with s as (select label, regexp_replace(unnest({SENTS}), '^{WS}+|{WS}+$', '', 'g') as x from documents where text is not null) select label, count(*) as n, round(100.0 * avg(case when x = '' or regexp_matches(x, {R.quoted('(?i)' + R.portable(R.LIST_HEADER))}) or regexp_matches(x, '{R.LIST_MARK}') or {R.any_match_sql('x', R.TRIGGERS)} then 1.0 else 0.0 end), 6) as pct from s group by label",
)
q.add(
    "extract_group",
    lambda s, d: table(s, d, "train").select("row_id", T.group_of_id(F.col("id")).alias("group_id")),
    "select row_id, case when id is null then 'unknown' when contains(id, '_seg') then string_split(id, '_seg')[1] when contains(id, '__') then string_split(id, '__')[1] when regexp_matches(id, '^gesetz_[a-zA-Z0-9]+_[0-9]+$') then regexp_extract(id, '^(gesetz_[a-zA-Z0-9]+)_[0-9]+$', 1) when regexp_matches(id, '^eupdcorp_[0-9]+_[0-9]+$') then regexp_extract(id, '^(eupdcorp_[0-9]+)_[0-9]+$', 1) when regexp_matches(id, '^[0-9]+_[^_]+_[0-9]+$') then regexp_extract(id, '^([0-9]+_[^_]+)_[0-9]+$', 1) else id end as group_id from train",
)


def _gate_sql(p: quality.Policy, view: str = "documents") -> str:
    """The gate of a policy, step by step as common table expressions."""
    t = f"trim(regexp_replace({R.rules_sql('text', p.rules)}, '{WS}+', ' ', 'g'))"
    w = lambda c: f"list_filter(string_split_regex({c}, '{WS}+'), lambda x: x <> '')"
    a = f"select doc_id, {t} as t0 from {view}"
    b = f"select doc_id, {f'''array_to_string(list_slice({w('t0')}, 1, {p.max_words}), ' ')''' if p.max_words else 't0'} as t1 from a"
    c = f"select doc_id, len({w('t1')}) >= {p.min_words} as enough, {f'''case when length(t1) > {p.max_chars} then regexp_replace(substr(t1, 1, {p.max_chars}), '(?s) [^ ]*$', '') else t1 end''' if p.max_chars else 't1'} as t from b"
    late = f"trim({R.rules_sql('t', p.late_rules)})" if p.late_rules else "t"
    r = ["when t is null or t = '' then 'blank'"]
    if not p.late_rules:
        r.append("when not enough then 'words'")
    r.append(f"when length(regexp_replace(t, '[^0-9]', '', 'g')) > {p.max_digits} * length(t) then 'digits'")
    if p.bad_phrases:
        r.append("when " + " or ".join(f"contains(lower(t), {R.quoted(x)})" for x in p.bad_phrases) + " then 'phrase'")
    if p.max_english is not None:
        r.append("when " + " + ".join(f"contains(lower(t), {R.quoted(x)})::int" for x in R.ENGLISH_MARKERS) + f" > {p.max_english} then 'english'")
    if p.need_umlaut:
        r.append("when not regexp_matches(t, '[äöüÄÖÜß]') then 'language'")
    if p.need_german:
        r.append(f"when not regexp_matches(t, '[äöüÄÖÜß]') and not list_has_any({w('lower(t)')}, [{', '.join(map(R.quoted, R.STOPWORDS))}]) then 'language'")
    if p.late_rules:
        r.append(f"when len({w(late)}) < {p.min_words} then 'words'")
    return f"with a as ({a}), b as ({b}), c as ({c}), r as (select doc_id, {late} as out, case {' '.join(r)} end as reject_reason from c) select doc_id, reject_reason, case when reject_reason is null then out end as clean_text from r"


for _name, _policy in quality.POLICIES.items():
    q.add(_name, lambda s, d, p=_policy: quality.gate(docs(s, d), p).select("doc_id", "reject_reason", "clean_text"), _gate_sql(_policy))
q.add(
    "template_substring_exclusion",
    lambda s, d: docs(s, d).where(F.col("text").isNotNull() & ~R.any_match(F.col("text"), R.SUBSTRINGS)).select("doc_id"),
    f"select doc_id from documents where text is not null and not {R.any_match_sql('text', R.SUBSTRINGS)}",
)
q.add("min_words_filter", lambda s, d: docs(s, d).where(T.word_count(F.col("text")) >= 10).select("doc_id"), f"select doc_id from documents where len({WORDS}) >= 10")
q.add("dropna_subset", lambda s, d: table(s, d, "train").dropna(subset=["text", "label"]).select("row_id"), "select row_id from train where text is not null and label is not null")
q.add(
    "label_normalize",
    lambda s, d: table(s, d, "raw_predictions").select("prediction_id", F.when(F.col("label").isin(0, 1), F.col("label")).alias("y"), F.coalesce(F.when(F.col("label") == 0, "human").when(F.col("label") == 1, "ai"), F.lit("skipped")).alias("name")),
    "select prediction_id, case when label in (0, 1) then label end as y, case label when 0 then 'human' when 1 then 'ai' else 'skipped' end as name from raw_predictions",
)
