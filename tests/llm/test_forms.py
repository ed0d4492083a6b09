import random

import numpy as np
import pytest

from textwerk.llm import forms, looks, mixing, pii, prose, residue, spans, splits
from textwerk.llm.copies import Trie
from textwerk.llm.items import WuManber


def test_consistent_form():
    cf = forms.consistent_form
    assert cf("Ｓｔｒａße ﬁn​d Вoden über x") == "Straße find Boden über x"
    assert cf("ä a ae ß ss\tA\n B") == "ä a ae ß ss\tA\n B"
    assert cf("\U0001f469‍\U0001f467 a‍b") == "\U0001f469‍\U0001f467 ab" and cf("") == ""


def test_same_text_key():
    k = forms.same_text_key
    assert k("Ort: A | Text: b c") == k("TEXT:  B, c\nort: a") and k("Ort: A | Text: b") != k("Ort: A | Text: c")
    assert k("Das Haus, gut.") == k("das\nHAUS gut") and k("Haus") != k("Hauß")
    assert k(None) is None and k("") is None and k(" .,- ") is None


def test_runs_agree_however_made():
    texts = ["x y z w", "", None, "a", "a b", "a b c", "a b a b a b a", "q " * 500]
    doc, h = forms.distinct(*forms.batch_runs(forms.pa.array(texts), 3))
    for i, t in enumerate(texts):
        assert np.array_equal(h[doc == i], forms.shingles(t, 3))


def test_trie_counts_and_bursts():
    keys = [bytes([i % 7, j % 5, k]) + b"\0" * 5 for i in range(7) for j in range(5) for k in range(40)] * 3
    t = Trie(burst=4)
    ends = [t.add(k, r) for r, k in enumerate(keys)]
    assert all(e[1] == 3 and e[0] == keys.index(k) for k, e in zip(keys, ends))


def test_edit_automaton():
    t = looks.Trie([("Straße", 3), ("über", 9), ("Boden", 1), ("finden", 2)])
    assert [t.lookup(x) for x in ("Straβe", "über", "Вod​en", "ﬁnden", "β", "Baden")] == ["Straße", "über", "Boden", "finden", None, None]
    # The cheapest spelling wins over a more frequent one; the bound ends what MAYBE letters may cost; many odd letters stay quick.
    t = looks.Trie([("kaut", 1), ("haut", 99), ("Kelvin", 2), ("a" * 40, 1)])
    assert t.lookup("каut") == "kaut" and t.lookup("\u212aelvin") == "Kelvin" and t.lookup("а" * 40) == "a" * 40 and t.lookup("xτττττ") is None
    assert forms.consistent_form("\u212a\u212b ёό") == "K\u00c5 \u00eb\u00f3" and looks._is_odd("\u212b") and not looks._is_odd("Öl")


def test_wu_manber_against_brute_force():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(rng.choice(list("abcd"), 14))) for i in range(30)] + [(99, "zu kurz"), (98, None)]
    w = WuManber(items, 6)
    for _ in range(200):
        ws = list(rng.choice(list("abcd"), 40))
        text = " ".join(ws)
        want = {i for i, t in items if t for j in range(9) if len(t.split()) > 5 and j + 6 <= 14 and f" {' '.join(t.split()[j : j + 6])} " in f" {text} "}
        assert w.search(ws) == want


def test_window_minima_and_grams():
    h = np.random.default_rng(2).integers(0, 1000, 500).astype(np.uint64)
    assert np.array_equal(spans._window_min(h, 37), [h[i : i + 37].min() for i in range(len(h) - 36)])
    a = np.array([ord(c) for c in "abcabcabx"])
    g = spans.gram_hashes(a, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4


def test_symbols_are_prefix_free():
    seen: dict = {}
    s = [splits.symbol(str(i), seen) for i in range(20000)]
    assert len(set(s)) == len(s) and splits.OTHER not in s and all(len(x) == 4 and all(c in set(a) for c, a in zip(x, splits.LETTERS)) for x in s)


def test_scan_gives_exact_similarity_and_coverage():
    r = random.Random(7)
    text = lambda k: " ".join(r.choice("abc") for _ in range(k))
    train, evals = {i: text(r.randint(0, 30)) for i in range(40)}, {100 + i: text(r.randint(0, 30)) for i in range(25)}
    pairs = [(t, e) for t in train for e in evals if (t + e) % 3]
    runs = lambda t: {tuple(w[i : i + 3]) for w in [t.split()] for i in range(len(w) - 2)}
    want = {}
    for t, e in pairs:
        x, y = runs(train[t]), runs(evals[e])
        if x & y and len(x & y) >= 0.2 * len(x | y):
            w = evals[e].split()
            want[t, e] = (len({p for i in range(len(w) - 2) if tuple(w[i : i + 3]) in x for p in (i, i + 1, i + 2)}) / len(w), len(x & y) / len(x | y))
    assert {(t, e): (c, s) for t, e, c, s in splits.scan(pairs, train, evals, 0.2, 3)} == want and len(want) > 20


@pytest.mark.parametrize(
    "text, hit",
    [
        ("Sehr geehrte {{ anrede }}, danke.", True), ("Am XX.XX.20XX war es so.", True), ("Bitte ________ eintragen", True), ("[bitte Name nachtragen]", True), ("Hallo <Absender> dort", True),
        ("Access Denied!", True), ("Diese Anwendung benötigt JavaScript", True), ("Lorem ipsum dolor sit amet elit", True), ("TODO: Ort nachtragen", True), ("%(name)s", True),
        ("Als Lorem ipsum bezeichnet man Fülltext.", False), ("In der Menge {5, 33} fehlt eine Zahl [sic].", False), ("Am [DATUM] sprach [PERSON]. <b>Wort</b>", False), ("Er sah nur noch den Fehler 404.", False), ("Die Meldung „Zugriff verweigert“ kam oft.", False), ("", False),
    ],
)
def test_residue_evidence(text, hit):
    assert bool(residue.evidence(forms.consistent_form(text), residue.automaton())) == hit


@pytest.mark.parametrize(
    "text, want",
    [
        ("Tel.: +49 (0)30 23125957, abends", [("phone", "+49 (0)30 23125957")]),
        ("Rufen Sie 089 99998 509 an", [("phone", "089 99998 509")]),
        ("E-Mail: a.b (at) post-tal.test oder <c_d@x.example.org>.", [("email", "a.b (at) post-tal.test"), ("email", "c_d@x.example.org")]),
        ("IdNr. 96 573 891 823 liegt vor. Personalausweis Nr. LY02F93L8", [("id", "96 573 891 823"), ("id", "LY02F93L8")]),
        ("Wohnhaft Am Mühlbach 11 b in Au. Die Bundesstraße 427 ist zu.", [("address", "Am Mühlbach 11 b")]),
        ("Im Haus Lauenallee 105a, 12345 X", [("address", "Lauenallee 105a")]),
        ("Frau Dr. Ahlersen bündelt. Die Ahlersen GmbH auch, im Ahlersen-Saal.", [("name", "Ahlersen")]),
        ("Unterzeichner: Plothötter, Lennart. gez. Nils Gerst", [("name", "Plothötter, Lennart"), ("name", "Nils Gerst")]),
        ("Oda Kelmwold erklärte, es sei so. Die Stadt Morau erklärte nichts.", [("name", "Oda Kelmwold")]),
        ("Frau Dr. Anna Maria Luise Berta Klein kam.", [("name", "Anna Maria Luise Berta Klein")]),
        ("Mein Name ist Heinrich Wohlgemuth. Herr Udo von der Marwitz geht.", [("name", "Heinrich Wohlgemuth"), ("name", "Udo von der Marwitz")]),
        ("Steuer-ID: 00000000000, Personalausweis Nr. AAAAAAAA1", []),
        ("Vorgangsnummer 01316705980 betrifft das Konto @fogo vom 11.07.2025", []),
        ("", []),
    ],
)
def test_pii(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.spans(text, pii.automaton())] == want


def test_prose_statistics():
    lang, plain, s = prose.statistics(["Die Stadt prüft den Plan, weil der Rat nicht mehr warten will. Wir sehen das auch so.", "The council reviews the plan near the bridge and the archive supports it", "xxqz wvkr trpl"], True)
    v = dict(zip(prose.STATS, s[0]))
    assert lang.tolist() == [0, 1, -1] and s.shape == (3, len(prose.STATS)) and set(prose.SPREAD) == set(prose.STATS) and v["common"] > 0.3 and v["heads"] == 0
    p = dict(zip(prose.PLAIN, plain[0]))
    assert p["words"] == 17 and p["line_end_share"] == 1 and plain[1][3] == 0 and abs(p["mean_word"] - 66 / 17) < 0.5
    assert abs(prose.chi_square_point(0.95, 20) - 31.41) < 0.05


def test_mixing_pattern_is_known():
    assert mixing.BITS * mixing.LEVELS == 60


@pytest.mark.parametrize(
    "text, kind",
    [
        ("The requested URL was not found on this server.", "error"), ("Error establishing a database connection", "error"), ("500 Server Error", "error"), ("HTTP 418: Fehler", "error"),
        ("JavaScript muss in Ihrem Browser aktiviert sein.", "script"), ("Please switch on scripts in your browser to continue", "script"), ("Hier Text einfügen", "filler"), ("Dies ist nur ein Blindtext.", "filler"),
        ("Die gesuchte Seite ist leider nicht mehr verfügbar.", "error"), ("Diese Website ist wegen Wartungsarbeiten nicht erreichbar", "error"), ("Wir %%Beispiel 1%% den Plan", "placeholder"),
        ("Wer die Seite von Au aufruft, sieht nur noch den Fehler 404, obwohl der Plan längst verschoben wurde.", None), ("Der Kurs zu JavaScript in Au begleitet das Gutachten und kostet 177 Euro.", None),
        ("Beim Ausfall des Servers in Au war die Strategie 38 Stunden nicht verfügbar.", None), ("Wer Skripte für den Dienst schreibt, braucht in Au rund 38 Platzhalter und die Reform.", None),
        ("Der Stadt fehlen 500 Dienste und 404 Seiten.", None), ("Die Inflation stieg um 3 % und die Quote um 4 %.", None), ("Er sagte: „Bitte aktivieren Sie JavaScript“.", None), ("Der Zugriff auf das Geld wurde der Stadt verweigert, weil der Rat es so wollte.", None),
    ],
)
def test_evidence(text, kind):
    assert [k for k, _ in residue.evidence(text, residue.automaton())][:1] == ([kind] if kind else [])


def test_batches_agree_with_single_texts():
    texts = ["Die Stadt prüft §3, den PLAN_B!", None, "", "  ", "...", "Ort: A\nText: B c", "İstanbul ΣΑΣ ß", "a b", "Vоden ﬁn\u200bd", "Ä_ö 12½ x² ٣", "zu: kurz", "x" * 5000 + " y z"]
    col = forms.pa.array(texts)
    assert forms.batch_keys(col) == [forms.same_text_key(t) for t in texts]
    h, ends = forms.batch_words(col)
    assert [h[a:b].tolist() for a, b in zip(ends, ends[1:])] == [forms.word_hashes(forms.words(t)).tolist() for t in texts]
    doc, runs = forms.distinct(*forms.batch_runs(col, 3))
    assert [sorted(runs[doc == i].tolist()) for i in range(len(texts))] == [forms.shingles(t).tolist() for t in texts]
    assert forms.batch_words(forms.pa.array([], type="string"))[1].tolist() == [0]
