"""SQL of the same result for the operators whose result SQL can say: by pairs, windows and joins that grow as the
square of the rows, so for small tables. Written from the shared terms, not from the operators' plans."""

from __future__ import annotations

from .forms import IGNORABLES, JOINER, LOOK_ALIKES, SPACES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Look-alikes of one letter, full-width forms and spaces, letter for letter; what is left over on the left is dropped.
_PAIRS = [(a, b) for a, b in LOOK_ALIKES.items() if len(b) == 1] + [(chr(0xFEE0 + c), chr(c)) for c in range(0x21, 0x7F)] + [(c, " ") for c in SPACES]
_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
_PICT = "[☀-➿\U0001f000-\U0001faff]"


def consistent(t: str) -> str:
    """SQL of the consistent form of the expression t."""
    t = f"translate({t}, {_q(''.join(a for a, _ in _PAIRS) + IGNORABLES)}, {_q(''.join(b for _, b in _PAIRS))})"
    for a, b in _LIGATURES:
        t = f"replace({t}, '{a}', '{b}')"
    for _ in range(2):  # a joiner between two pictographs stays; neighbours overlap
        t = f"regexp_replace({t}, '({_PICT}){JOINER}({_PICT})', '\\1\ue000\\2', 'g')"
    return f"nfc_normalize(replace(replace({t}, '{JOINER}', ''), '\ue000', '{JOINER}'))"


_FIELD = r"\p{L}[\p{L}\p{N}_-]{1,30}"
_letters = lambda t: f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _texts(name: str, tables: dict[str, str], *more: str) -> str:
    """CTEs: ``name`` with row_id, split, text, form, key (null where there is no letter) and the runs g of three words."""
    extra = "".join(f", {m}" for m in more)
    union = " union all ".join(f"select row_id, '{split}' as split, text{extra} from {t}" for t, split in tables.items())
    parts = f"string_split(regexp_replace(replace(low, chr(10), chr(10) || chr(10)), '(^|[\\n\\r;|])([\\s;|]*)({_FIELD}[ \\t]*:)(\\s)', '\\1\\2' || chr(29) || '\\3\\4', 'g'), chr(29))"
    fields = f"case when len(p) > 2 and {_letters('p[1]')} = '' and len(list_distinct(list_transform(p[2:], lambda x: regexp_extract(x, '^{_FIELD}')))) > 1 then array_to_string(list_sort(list_transform(p[2:], lambda x: {_letters('x')})), chr(31)) else {_letters('low')} end"
    runs = "list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end)"
    return (
        f"{name}_a as ({union}), {name}_b as (select *, {consistent('text')} as form from {name}_a where text is not null and text <> ''), {name}_c as (select *, lower(form) as low from {name}_b), "
        f"{name}_d as (select *, {parts} as p, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+') as w from {name}_c), {name} as (select row_id, split{extra}, text, form, w, nullif({fields}, '') as key, {runs} as g from {name}_d)"
    )


def _similar(a: str, b: str) -> str:
    """CTE ``sim`` (ra, rb): rows of a and b of a similarity of at least 0.6."""
    return f"xa as (select row_id, len(g) as n, unnest(g) as r from {a}), xb as (select row_id, len(g) as n, unnest(g) as r from {b}), sim as (select xa.row_id as ra, xb.row_id as rb from xa join xb on xa.r = xb.r group by xa.row_id, xb.row_id having count(*) >= 0.6 * (any_value(xa.n) + any_value(xb.n) - count(*)))"


def oracle_sql() -> dict[str, str]:
    train = _texts("t", {"train": "train"})
    evals = _texts("e", {"test": "test", "val": "val"})
    labelled = _texts("t", {"train": "train"}, "label")
    found4 = f"with {train}, {evals}, {_similar('t', 'e')}, f as (select ra, rb from sim union select t.row_id, e.row_id from t join e on t.key = e.key), p4 as (select ra as train_row_id, rb as eval_row_id, split from f join e on e.row_id = rb)"
    words = lambda t: f"regexp_extract_all(lower({consistent(t)}), '[\\p{{L}}\\p{{N}}]+')"
    twelve = lambda w: f"list_transform(range(1, len({w}) - 10), lambda i: array_to_string({w}[i:i+11], ' '))"
    return {
        "p2_found": f"with c as (select row_id, text, source, {consistent('text')} as ct, {consistent('source')} as cs from train where source is not null and regexp_matches(text, '\\S')) select a.row_id as row_id_a, b.row_id as row_id_b from c a join c b on a.ct = b.ct and a.cs = b.cs and a.row_id < b.row_id where a.text <> b.text or a.source <> b.source",
        "p2_consistent": f"select row_id, {consistent('text')} as text, {consistent('source')} as source from train",
        "p4_found": f"{found4} select * from p4",
        "p4_report": f"{found4}, s as (select 'test' as split, row_id, source from test where regexp_matches(text, '\\S') union all select 'val', row_id, source from val where regexp_matches(text, '\\S')), n as (select eval_row_id, count(*) as n from p4 group by 1) select split, source, count(*) as n_records, count(n) as n_leaked, cast(coalesce(sum(n), 0) as bigint) as n_pairs from s left join n on row_id = eval_row_id group by 1, 2",
        "p5_found": f"with {labelled}, f as (select row_id, min(row_id) over (partition by key, label) as first_row_id from t where key is not null) select first_row_id, row_id from f where row_id > first_row_id",
        "p6_found": f"with {train}, {_similar('t', 't')} select ra as row_id_a, rb as row_id_b from sim join t a on a.row_id = ra join t b on b.row_id = rb where ra < rb and a.key <> b.key",
        "p7_found": "with w as (select row_id, unnest(list_transform(range(1, length(text) - 158), lambda i: md5(substr(text, i, 160)))) as h from train where length(text) >= 160 and regexp_matches(text, '\\S')), s as (select h from w group by h having count(distinct row_id) > 1) select distinct row_id from w where h in (select h from s)",
        "p8_found": f"with d as (select doc_id, unnest({twelve('w')}) as r from (select doc_id, {words('text')} as w from documents where text is not null)), i as (select item_id, unnest({twelve('w')}) as r from (select item_id, {words('text')} as w from external_eval where text is not null)) select distinct doc_id, item_id from d join i on d.r = i.r",
    }
