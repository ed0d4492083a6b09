"""The operators against brute force on a small corpus with nulls, blanks, repeats, ties and very long texts."""

import random

import pytest
from pyspark.sql import functions as F

from textwerk.llm.queries import TOKENIZER as TOK
from textwerk.llm import copies, forms, groups, items, looks, mixing, near, pii, prose, residue, spans, splits

WORDS = [f"{a}{b}" for a in "wald stein fluss berg tal dorf markt brücken".split() for b in "weg hof rat plan amt bau netz ziel".split()]


def corpus(n=160, seed=5):
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(30, 60))) for _ in range(n)]
    for i in range(0, n, 4):  # near copies
        w = texts[i].split()
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    for i in range(0, n, 5):  # the same in another form
        texts.append("  ".join(texts[i].upper().split(" ")) + "!")
    for i in range(0, n, 6):  # looks the same
        texts.append(texts[i].replace("a", "а", 1).replace("e", "e​", 1))
    for i in range(0, n, 9):  # a stretch of another one
        texts.append(" ".join(r.choice(WORDS) for _ in range(20)) + texts[i][:170] + " ".join(r.choice(WORDS) for _ in range(9)))
    texts += [texts[0], texts[0], None, "", "   ", "...", "a", "a b", " ".join(WORDS * 400)]
    return [(i, t, i % 2 if i % 11 else None, f"s{i % 3}" if i % 13 else None, None) for i, t in enumerate(texts)]


SCHEMA = "row_id long, text string, label int, source string, meta string"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("first", F.lit("x")).withColumn("h", F.lit(0)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return set(map(tuple, df.collect()))


def similar(a, b, t):
    x, y = ({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := forms.words(v)) else set() for v in (a, b))
    return bool(x and y) and len(x & y) >= t * len(x | y)


@pytest.mark.parametrize("bucket_rows", [100_000, 3])
def test_copies(df, rows, empty, bucket_rows):
    key = {r[0]: (forms.same_text_key(r[1]), r[2]) for r in rows}
    want = {(min(j for j in key if key[j] == key[i]), i) for i in key if key[i][0]}
    want = {(a, b) for a, b in want if a != b}
    assert got(copies.copies_found(df, bucket_rows=bucket_rows)) == want
    one = copies.collapsed(df).select("row_id", "n_copies").collect()
    signs = sum(bool(t and t.strip() and not key[i][0]) for i, t, *_ in rows)  # each stays
    assert len(one) == len({k for k in key.values() if k[0]}) + signs and sum(r.n_copies for r in one) == sum(k[0] is not None for k in key.values()) + signs
    assert copies.copies_found(empty).count() == 0


def test_near(df, rows, empty):
    k = {i: forms.same_text_key(t) for i, t, *_ in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and k[a[0]] and k[b[0]] and k[a[0]] != k[b[0]] and similar(a[1], b[1], 0.6)}
    found = got(near.found(df))
    assert found <= want and len(found) >= 0.99 * len(want) > 20
    g = {r.row_id: r for r in near.groups(df).collect()}
    assert set(g) == {i for i in k if k[i]} and all(g[a].group_id == g[b].group_id for a, b in found)
    assert near.found(empty).count() == 0


@pytest.mark.parametrize("split", [1000, 40])
def test_near_in_a_large_group_of_near_copies(spark, split):
    r = random.Random(3)
    base = [r.choice(WORDS) + str(i) for i in range(60)]
    data = []
    for i in range(240):  # more copies than make the shared wording common
        w = list(base)
        for k in r.sample(range(60), r.randint(2, 4)):
            w[k] = f"neu{r.randrange(10**9)}"
        data.append((i, " ".join(w), 0, "s", None))
    want = {(i, j) for i, x, *_ in data for j, y, *_ in data if i < j and similar(x, y, 0.6)}
    df = spark.createDataFrame(data, SCHEMA)
    assert got(near.found(df, split=split)) == want and len(want) > 1000
    links = {r.row_id: r.n_links for r in near.groups(df, split=split).collect()}
    assert links == {i: sum(i in p for p in want) for i in range(240)}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60)], "a long, b long")
    c = dict(got(groups.components(e)))
    assert all(c[i] == 1 for i in range(1, 41)) and c[52] == c[51] == 50


@pytest.mark.parametrize("pairwise", [24, 1])
def test_spans(df, rows, empty, pairwise):
    texts = {i: t for i, t, *_ in rows if t and t.strip()}
    wins: dict = {}
    for i, t in texts.items():
        for j in range(len(t) - 159):
            wins.setdefault(t[j : j + 160], set()).add(i)
    want = {i for v in wins.values() if len(v) > 1 for i in v}
    assert {r.row_id for r in spans.found(df, pairwise=pairwise).collect()} == want
    if pairwise > 1:
        cover = {r.row_id: r.shared_chars for r in spans.coverage(df).collect()}
        for i, t in texts.items():
            at = {p for j in range(len(t) - 159) if len(wins[t[j : j + 160]]) > 1 for p in range(j, j + 160)}
            assert cover[i] == len(at)
        assert spans.found(empty).count() == 0


def test_spans_that_begin_in_a_repeated_string():
    """Every window emits its smallest run's place, so that equal windows meet around it."""
    for period in range(5, 96, 5):
        r = random.Random(period)
        some = lambda k: "".join(r.choice("abcdefghijklmnop ") for _ in range(k))
        for _ in range(10):
            text = (some(period) * 80)[:400] + some(200)
            h, at = spans.minhashes([text], 160, 60)[1:]
            places = set(at.tolist())
            grams = spans.gram_hashes(spans.np.frombuffer(text.encode("utf-32-le"), dtype="uint32"), 60)
            for a in range(len(text) - 159):
                w = grams[a : a + 101].tolist()
                assert a + 100 - w[::-1].index(min(w)) in places


def test_looks(df, rows, empty):
    c = {i: (forms.consistent_form(t), forms.consistent_form(s)) for i, t, _, s, _ in rows if t and t.strip() and s is not None}
    raw = {i: (t, s) for i, t, _, s, _ in rows}
    want = {(a, b) for a in c for b in c if a < b and c[a] == c[b] and raw[a] != raw[b]}
    assert got(looks.found(df)) == want
    assert dict(got(looks.consistent(df).select("row", "text")))[0] == rows[0][1]
    assert looks.found(empty).count() == 0


def test_splits(spark, rows, empty):
    tr = spark.createDataFrame(rows[:140], SCHEMA)
    ev = spark.createDataFrame([(i + 10_000, *r) for i, *r in rows[100:]], SCHEMA)
    k = {i: forms.same_text_key(t) for i, t, *_ in rows}
    want = {(a[0], b[0] + 10_000, "val") for a in rows[:140] for b in rows[100:] if k[a[0]] and k[b[0]] and (k[a[0]] == k[b[0]] or similar(a[1], b[1], 0.6))}
    found = got(splits.found(tr, {"val": ev}))
    assert found <= want and len(found) >= 0.99 * len(want) > 20
    assert splits.found(tr, {"val": empty}).count() == 0
    rep = splits.report(tr, {"val": ev}).agg(F.sum("n_pairs")).first()[0]
    assert rep == len(found)


def test_splits_many_edited_copies_of_one_passage(spark):
    r = random.Random(4)
    base = [r.choice(WORDS) + str(i) for i in range(60)]
    tr = []
    for i in range(300):
        w = list(base)
        for k in r.sample(range(60), 4):
            w[k] = f"neu{r.randrange(10**9)}"
        tr.append((i, " ".join(w), 0, "s", None))
    ev = [(1000, " ".join(base), 0, "s", None)]
    want = {(i, 1000, "val") for i, t, *_ in tr if similar(t, ev[0][1], 0.6)}
    assert got(splits.found(spark.createDataFrame(tr, SCHEMA), {"val": spark.createDataFrame(ev, SCHEMA)})) == want and len(want) > 250


def test_splits_short_texts_without_a_long_run_in_common(spark):
    tr, ev = [], []
    for i, (n, changed, dropped) in enumerate([(14, {6}, ()), (17, {8}, ()), (26, (), {8, 17}), (29, (), {5, 6, 17, 18})]):
        w = [f"wort{i}{chr(97 + k)}" for k in range(n)]
        ev.append((1000 + i, " ".join(w), 0, "s", None))
        tr.append((i, " ".join("neu" if k in changed else x for k, x in enumerate(w) if k not in dropped), 0, "s", None))
    want = {(i, 1000 + i, "val") for i in range(4)}
    assert all(similar(tr[i][1], ev[i][1], 0.6) for i in range(4))
    assert got(splits.found(spark.createDataFrame(tr, SCHEMA), {"val": spark.createDataFrame(ev, SCHEMA)})) == want


def test_items(spark, df, rows, empty):
    some = spark.createDataFrame([(1, rows[0][1][:200]), (2, rows[3][1]), (3, "zu kurz"), (4, None)], "item_id long, text string")
    docs = df.withColumnRenamed("row_id", "doc_id")
    want = set()
    for i, t, *_ in rows:
        w = forms.words(t)
        for item, u in ((1, rows[0][1][:200]), (2, rows[3][1])):
            v = forms.words(u)
            if any(w[j : j + 12] == v[m : m + 12] for m in range(len(v) - 11) for j in range(len(w) - 11)):
                want.add((i, item))
    assert got(items.leaked(docs, some)) == want == got(items.leaked(docs, some, block_chars=1))
    assert items.leaked(docs, some.where("false")).count() == 0


def test_residue_and_boilerplate(spark, empty):
    note = "Bitte aktivieren Sie JavaScript"
    data = [(i, f"Der Rat tagt heute zum Thema {i}.\n{note}", 0, "host", None) for i in range(50)]
    data += [(100, note, 0, "other", None), (101, "Guter Text.", 0, "other", "${generator}"), (102, "Guter Text.", 0, "other", "unknown"), (103, None, 0, None, "{{x}}"), (104, "Am {{datum}} war es.", 0, "host", None)]
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.row_id for r in residue.found(df).collect()} == {100, 101, 104}
    assert residue.without_residue(df).count() == len(data) - 3 and residue.found(empty).count() == 0


def test_residue_where_recurrent_lines_are_all_of_a_record(spark):
    page, note = "404 Not Found\nBitte wenden Sie sich an den Betreiber.", "Bitte aktivieren Sie JavaScript"
    data = [(i, page, 0, "host", None) for i in range(30)] + [(100 + i, note, 0, "host", None) for i in range(30)]
    data += [(200 + i, f"Der Rat tagt heute zum Thema {chr(97 + i % 26)}{chr(97 + i // 26)}.\n{note}", 0, "host", None) for i in range(40)]
    assert {r.row_id for r in residue.found(spark.createDataFrame(data, SCHEMA)).collect()} == {*range(30), *range(100, 130)}


def test_residue_counts_the_lines_of_all_records(spark):
    page, foot = "404 Not Found", "Alle Angaben sind ohne Gewähr."
    data = [(i, f"{page}\n{foot}" if i < 2 else f"{page}\nVorgang {i}", 0, "host", None) for i in range(40)]
    data += [(100 + i, f"Der Rat tagt heute zum Thema {i}.\n{foot}", 0, "host", None) for i in range(60)]
    # Boilerplate is all of records 0 and 1: two of the pages have the footer, but 62 of the host's 100 records.
    assert {r.row_id for r in residue.found(spark.createDataFrame(data, SCHEMA)).collect()} == {0, 1}


def test_residue_seeks_evidence_in_what_remains(spark):
    note = "Bitte aktivieren Sie JavaScript"
    data = [(i, f"Der Rat tagt heute zum Thema {i}.\n{note}", 0, "host", None) for i in range(50)]
    data += [(100, f"500 Server Error\n{note}", 0, "host", None), (101, f"Am {{{{datum}}}} war es.\n{note}", 0, "host", None), (102, "İ" * 40 + " 404 not found", 0, "host", None)]
    assert {r.row_id for r in residue.found(spark.createDataFrame(data, SCHEMA)).collect()} == {100, 101, 102}


def test_prose(spark, empty):
    base = [(i, f"Die Stadt {w} prüft den neuen Plan, weil der Rat nicht mehr warten will und das {w} fehlt.", 0, "s", None) for i, w in enumerate(WORDS * 4)]
    junk = [(1000, "\n".join(f"{w}\t{i}\t–" for i, w in enumerate(WORDS[:12])), 0, "s", None), (1001, "~%|$ ##|^ ?%-%$0_&m1&?#_1b#", 0, "s", None), (1002, "!!!", 0, "s", None), (1003, None, 0, "s", None), (1004, " ", 0, "s", None)]
    # As many spelt-out texts as would make a language of their own, a text of fields, and a table in one.
    spelt = [(2000 + i, " ".join(t[:60]), 0, "s", None) for i, t, *_ in base[:220]]
    fields = [(3000, " ".join(t for _, t, *_ in base[:60]), 0, "s", None), (3001, f"Ort: Au | Thema: Plan | Datum: 3. Mai 2001 | Text: {base[0][1]}", 0, "s", None), (3002, "Ort: Au\nText: " + " ; ".join(f"{w} {i} – {w[:3]}" for i, w in enumerate(WORDS[:30])), 0, "s", None)]
    assert {r.row_id for r in prose.found(spark.createDataFrame(base + junk + spelt + fields[1:], SCHEMA)).collect()} == {1000, 1001, 1002, 3002, *(r[0] for r in spelt)}
    q = {r.row_id: r for r in prose.quality(spark.createDataFrame(base[:9] + fields, SCHEMA)).collect()}
    assert len(q) == 12 and q[3000].plain_words == sum(len(t.split()) for _, t, *_ in base[:60]) and q[0].plain_line_end_share == 1 and q[3002].plain_line_end_share == 0
    assert abs(sum(q[0].contributions.values()) - q[0].distance) < 1e-6
    assert prose.found(empty).count() == 0


def test_mixing(spark):
    docs = spark.createDataFrame([(i, f"Wort {i} " * (1 + i % 7), f"s{i % 3}" if i % 10 else None) for i in range(300)] + [(999, None, "s0")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s0", 0.5, 3), ("s1", 0.3, 1), ("s9", 0.2, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs, targets, tokenizer=TOK)
    rep = {r.source: r for r in report.collect()}
    assert rep["s9"].mixed_tokens == 0 and abs(rep["s0"].mixed_tokens / rep["s1"].mixed_tokens - 5 / 3) < 0.05
    assert chosen.agg(F.max("repeats")).first()[0] <= 3 and {r.source for r in chosen.select("source").distinct().collect()} == {"s0", "s1"}
    small = {r.doc_id: r.repeats for r in mixing.mix(docs, targets, budget=300, tokenizer=TOK)[0].collect()}
    large = {r.doc_id: r.repeats for r in mixing.mix(docs, targets, budget=600, tokenizer=TOK)[0].collect()}
    assert all(large.get(d, 0) >= n for d, n in small.items())
    assert mixing.mix(docs.where("false"), targets, tokenizer=TOK)[0].count() == 0


def test_pii_items_and_masks(spark):
    df = spark.createDataFrame([(1, "Frau Ahlersen, Tel.: 089 99998 509. Frau Ahlersen."), (2, None), (3, "")], "doc_id long, text string")
    assert got(pii.items(df)) == {(1, "name", "Ahlersen"), (1, "phone", "089 99998 509")}
    assert [r.text for r in pii.masked(df).orderBy("doc_id").collect()] == ["Frau [NAME], Tel.: [PHONE]. Frau [NAME].", None, ""]
