"""Problem 10: personal information inside free text.

Anchor expansion. One Aho-Corasick automaton finds the cues: at-signs and their written-out forms, number
prefixes and phone words, labels of identity numbers, street words and address labels, titles, signature
words and verbs of saying. Around each anchor a deterministic local parser expands to the item's bounds and
validates it: the digits of a number, the shape of an identifier, the parts of an address, the words of a
name. Where items overlap, the earlier kind of ``KINDS`` wins. Texts are read as stored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches

KINDS = ("email", "id", "phone", "address", "name")
#: What stands in a text in place of an item.
PLACEHOLDERS = {"email": "[EMAIL]", "id": "[ID]", "phone": "[PHONE]", "address": "[ADDRESS]", "name": "[NAME]"}

# The anchors of each parser, in lower case.
ANCHORS = {
    "email": ("@", "(at)", "[at]", "{at}", "(ät)", " at ", "\uff20"),
    "phone": ("+", "00", "tel", "mobil", "fax", "handy", "nummer ist", "rufen sie", "erreichbar", "ruf ", "anruf", "durchwahl", "phone", "(0", " 0"),
    "tax": ("steuer-id", "steuerid", "steuerliche id", "idnr", "id-nr", "identifikationsnummer", "steuernummer", "steuer-nr", "tin:"),
    "card": ("ausweis", "reisepass", "pass-nr", "passnummer", "passport"),
    "pension": ("sv-nr", "sv-nummer", "versicherungsnummer", "rentenversicherung", "rvnr", "vsnr"),
    "street": ("straße", "strasse", "str.", "allee ", "gasse ", "weg ", "platz ", "damm ", "stieg ", "ring ", "ufer ", "chaussee ", "pfad ", "steig ", "promenade "),
    "label": ("wohnhaft", "anschrift", "adresse", "im haus ", "wohnt ", "wohne ", "address"),
    "title": ("herr ", "herrn ", "frau ", "dr. ", "prof. ", "professor ", "professorin ", "mr. ", "mrs. ", "ms. ", "herr\u00a0", "frau\u00a0", "dr.\u00a0"),
    "signed": ("gez.", "unterzeichner", "name:", "vertreten durch", "eingereicht von", "gr\u00fc\u00dfen", "gr\u00fcssen", "gezeichnet", "unterschrift", "ansprechpartner", "verfasser", "autor:", "autorin:", "kontakt:", "regards", "signed", "name ist ", "heiße ", "my name is "),
    "said": ("erkl\u00e4rte", "sagte", "betonte", "fragte", "antwortete", "meinte", "berichtete", "forderte", "erg\u00e4nzte,", "erl\u00e4uterte"),
}
# Words in capitals that begin sentences or are offices, and are no names.
NO_NAMES = frozenset(
    "der die das den dem des ein eine einen einem einer eines und oder aber wir ich sie er es man am an auf aus bei bis durch f\u00fcr gegen im in mit nach ohne seit \u00fcber um unter von vor zu zum zur zwischen als auch da daher dabei dann dass denn dennoch deshalb doch hier ob sobald so statt trotz trotzdem warum was weder weil wenn wer wie wo allerdings andererseits au\u00dferdem gleichwohl immerhin inzwischen mittlerweile schlie\u00dflich \u00fcberdies vielmehr zugleich rund laut meine mein ihre ihr unsere viele etliche einige manche zahlreiche fast alle \u00e4ltere junge "
    "the a an of and our every near pr\u00e4sident pr\u00e4sidentin kollege kollegin minister ministerin kanzler kanzlerin bundeskanzler bundeskanzlerin abgeordneter abgeordnete vorsitzender vorsitzende b\u00fcrgermeister b\u00fcrgermeisterin staatssekret\u00e4r staatssekret\u00e4rin direktor direktorin richter richterin stadt gemeinde kreis land damen herren".split()
)
FIRMS = re.compile(r"[ \u00a0]?(?:GmbH|AG|KG|SE|UG|OHG|eG|e\.\s?V\.|Stiftung|Verlag|& Co)|-(?:Saal|Halle|Haus|Allee|Stra\u00dfe|Str\.|Platz|Weg|Gasse|Schule|Stiftung|Ring|Br\u00fccke|Park|Ufer|Preis)")
SPACE = "[ \\t\u00a0\u2007\u202f]"
_word = "(?:[A-Z\u00c4\u00d6\u00dc][a-z\u00e4\u00f6\u00fc\u00df\u00e9\u00e8\u00e1\u00ef\u00f4\u0131\u015f\u011f\u00e7]+(?:-[A-Z\u00c4\u00d6\u00dc][a-z\u00e4\u00f6\u00fc\u00df\u00e9]+)*|[A-Z\u00c4\u00d6\u00dc]{2,}\u00df?[A-Z\u00c4\u00d6\u00dc]*(?:-[A-Z\u00c4\u00d6\u00dc]+)*)(?![\\w])"
_name = re.compile(f"{_word}(?:{SPACE}(?:(?:von|van|de|zu|der|den|vom|zum){SPACE}){{0,2}}{_word})*")
_turned = re.compile(f"({_word}),{SPACE}?({_word}(?:{SPACE}{_word})?)")
_one = re.compile(_word)
_titles = re.compile(f"(?:(?:Herrn?|HERRN?|Frau|FRAU|Dr\\.|DR\\.|Prof\\.|Professor(?:in)?|Mrs?\\.|Ms\\.|med\\.|jur\\.|phil\\.|h\\.{SPACE}?c\\.|Dipl\\.-Ing\\.){SPACE}+)+")
_mail = re.compile(r"[\w.%+'-]{1,64}(?:@|\uff20|[ \u00a0]?[(\[{](?:at|AT|\u00e4t)[)\]}][ \u00a0]?|[ \u00a0](?:at|AT)[ \u00a0])[\w-]+(?:(?:\.|[ \u00a0]?[(\[](?:dot|punkt)[)\]][ \u00a0]?)[\w-]+)*\.[A-Za-z]{2,24}(?![\w-])", re.A | re.I)
_phone = re.compile(r"(?<![\w/.,\uff20@-])(?:\+\d|00[1-9]|\(0\d|\(\+\d|0[1-9])[\d()/\u00a0\u2007\u202f .\u2013-]*\d")
_tax = re.compile(r"[^\d\n]{0,24}?(\d{2}[ \u00a0]?\d{3}[ \u00a0]?\d{3}[ \u00a0]?\d{3}|\d{2,3}[/ ]\d{3,4}[/ ]\d{4,5}|\d{10,13})(?![\d/])")
_card = re.compile(r"[^\n]{0,40}?(?<![A-Za-z0-9])([A-Z0-9]{9,10})(?![A-Za-z0-9])")
_pension = re.compile(r"[^\d\n]{0,24}?(\d{2}[ \u00a0]?\d{6}[ \u00a0]?[A-Z][ \u00a0]?\d{3})(?!\d)")
_house = f"\\d{{1,4}}(?:{SPACE}?[a-z](?![\\w]))?(?:{SPACE}?[-\u2013/]{SPACE}?\\d{{1,4}}(?:{SPACE}?[a-z](?![\\w]))?)?(?![\\d.,]\\d|\\w)"
_up = "[A-Z\u00c4\u00d6\u00dc]"
_street = re.compile(
    f"(?:Stra(?:\u00dfe|sse){SPACE}(?:des|der){SPACE}(?:{_up}[\\w\u00e4\u00f6\u00fc\u00df-]*{SPACE}?){{1,3}}"
    f"|(?:{_up}[\\w\u00e4\u00f6\u00fc\u00df-]*{SPACE}){{0,2}}{_up}[\\w\u00e4\u00f6\u00fc\u00df-]*?(?:stra\u00dfe|strasse|str\\.|allee|gasse|weg|platz|damm|stieg|ring|ufer|chaussee|pfad|steig|promenade){SPACE}"
    f"|(?:{_up}[\\w\u00e4\u00f6\u00fc\u00df-]*{SPACE}){{0,2}}{_up}[\\w\u00e4\u00f6\u00fc\u00df]*(?:{SPACE}|-)(?:Stra\u00dfe|Strasse|Str\\.|Allee|Gasse|Weg|Platz|Damm|Stieg|Ring|Ufer|Chaussee|Pfad|Steig|Promenade){SPACE})"
    f"({_house})"
)
_labelled = re.compile(f"[:,]?{SPACE}*(?:in{SPACE}der{SPACE}|in{SPACE})?((?:{_up}|[a-z\u00e4\u00f6\u00fc])[\\w\u00e4\u00f6\u00fc\u00df.-]*(?:{SPACE}[\\w\u00e4\u00f6\u00fc\u00df.-]+){{0,3}}?{SPACE}{_house})")
_roads = re.compile("(?:Bundes|Land|Landes|Kreis|Staats|Gemeinde|Europa|Schnell)(?:stra\u00dfe|strasse|str\\.)|Autobahn|Feldweg$")
_date = re.compile(r"\d\d\.\d\d\.(?:\d{4}|\d\d)(?!\d)")
_no_vowels = re.compile("[CFGHJKLMNPRTVWXYZ0-9]+")
_before = re.compile(r"(?:vorgang|vorgangs|akten|z\u00e4hler|konto|kunden|rechnungs|auftrags|referenz|seriennummer|az\.|drucksache)[\w.-]*[ \u00a0]?(?:nr\.|nummer)?[: #]*$", re.I)


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, cues in ANCHORS.items():
        for c in cues:
            auto.add_word(c, (auto.get(c, ()) or ()) + ((kind, len(c)),))
    auto.make_automaton()
    return auto


def _low(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _trim_name(text: str, a: int, b: int, least: int) -> tuple[int, int] | None:
    """The words of a name from a to b: up to the first that is none. least: how many there must be."""
    words = []
    for m in _one.finditer(text, a, b):
        if m.group().lower() in NO_NAMES:
            break
        words.append(m.span())
    if len(words) < least or not words:
        return None
    return None if FIRMS.match(text, words[-1][1]) else (words[0][0], words[-1][1])


def _phone_end(s: str) -> int:
    """Where a phone number ends in s, which begins with one and has its signs only: groups are taken as long
    as the number is not longer than numbers are (12 digits with the leading zero, 15 with a country)."""
    most = 12 if re.match(r"\(?0[1-9]", s) else 15
    n = end = 0
    for m in re.finditer(r"\d+", s):
        gap = s[end : m.start()]
        if n and (n + len(m.group()) > most or len(gap) > 3 or (n >= 10 and gap.strip(" \u00a0") == "" and n + len(m.group()) > 12 and most == 12)):
            break
        n += len(m.group())
        end = m.end()
    return end if n >= 8 else 0


def spans(text: str, auto: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the items of a text, in order, without overlaps."""
    low = _low(text)
    raw: dict[str, set[tuple[int, int]]] = {k: set() for k in KINDS}
    done_phone = done_name = -1
    for end, hits in auto.iter(low):
        for kind, n in hits:
            a, z = end - n + 1, end + 1
            if kind == "email":
                x = a
                while x > 0 and a - x < 66 and (text[x - 1].isalnum() or text[x - 1] in ".%+'-_ \u00a0" and not (text[x - 1] in " \u00a0" and x < a)):
                    x -= 1
                m = _mail.search(text, x, z + 120)
                if m and m.start() <= a < m.end():
                    s = m.start()
                    while text[s] in ".-'%+":
                        s += 1
                    raw["email"].add((s, m.end()))
            elif kind == "phone":
                x = max(0, a - 2)
                if x < done_phone:
                    x = max(x, done_phone)
                m = _phone.search(text, x, z + 60)
                if m and m.start() <= z + 36 and (cut := _phone_end(m.group())):
                    if not _date.match(m.group()) and not _before.search(low[max(0, m.start() - 32) : m.start()]):
                        raw["phone"].add((m.start(), m.start() + cut))
                        done_phone = m.start() + cut
            elif kind in ("tax", "card", "pension"):
                m = {"tax": _tax, "card": _card, "pension": _pension}[kind].match(text, z)
                if m and (kind != "card" or ((re.search(r"\d", m.group(1)) or _no_vowels.fullmatch(m.group(1))) and not re.search(r"[.!?]\s", text[z : m.start(1)].replace("Nr.", "Nr")))):
                    if len(set(re.sub(r"\W", "", m.group(1))[:-1])) > 1:  # one sign over and over is a blank, no number
                        raw["id"].add(m.span(1))
            elif kind == "street":
                x = max(text.rfind("\n", 0, a) + 1, a - 60)
                for m in _street.finditer(text, x, min(len(text), z + 80)):
                    s, word = m.start(), m.group()
                    while (first := re.match(f"({_up}[\\w\u00e4\u00f6\u00fc\u00df-]*){SPACE}", text[s : m.end()])) and (first.group(1).lower() in NO_NAMES or first.group(1) in ("Haus", "Anschrift", "Wohnhaft", "Adresse")) and s + len(first.group()) < m.start(1):
                        s += len(first.group())
                    if not _roads.search(word.rsplit(" ", 1)[0]) and m.start(1) > s:
                        raw["address"].add((s, m.end()))
            elif kind == "label":
                m = _labelled.match(text, z)
                if m and not _roads.search(m.group(1)):
                    raw["address"].add(m.span(1))
            elif kind == "title":
                if a and low[a - 1].isalnum():
                    continue
                m = _titles.match(text, a)
                if m and (w := _name.match(text, m.end())) and (s := _trim_name(text, w.start(), w.end(), 1)):
                    raw["name"].add(s)
            elif kind == "signed":
                x = z
                if low.startswith("ansprechpartner", a):
                    m = re.compile(r"[^.!?\n]{0,110}?\b(?:ist|sind|:)[ \u00a0]").match(text, z)
                    x = m.end() if m else -1
                if x < 0:
                    continue
                m = re.compile("[in]{0,3}[:,]?\\s{0,3}").match(text, x)
                x = m.end()
                t = _titles.match(text, x)
                x = t.end() if t else x
                if m := _turned.match(text, x):
                    if m.group(1).lower() not in NO_NAMES and (last := _trim_name(text, m.start(2), m.end(2), 1)):
                        raw["name"].add((m.start(), last[1]))
                elif (w := _name.match(text, x)) and (s := _trim_name(text, w.start(), w.end(), 2)) and s[0] == w.start():
                    raw["name"].add(s)
            elif kind == "said" and a > 3 and text[a - 1] in " \u00a0" and a > done_name:
                m = re.compile(f"(?:^|[.!?\u2026:;)\\]\u201c\"|\\n]\\s*|\\d\\s+|[\\w.-]\\.[A-Za-z]+\\s+|[A-Z0-9]{{9}}\\s+)({_word}(?:{SPACE}{_word}){{1,2}}){SPACE}$").search(text[max(0, a - 70) : a])
                if m:
                    off = max(0, a - 70)
                    s, e = off + m.start(1), off + m.end(1)
                    if not any(w.lower() in NO_NAMES for w in m.group(1).split()):
                        raw["name"].add((s, e))
                        done_name = a
    taken: list[tuple[int, int, str]] = []
    covered = bytearray(len(text))
    for kind in KINDS:
        for a, b in sorted(raw[kind], key=lambda s: (s[0] - s[1], s[0])):  # longer first
            if not any(covered[a:b]):
                taken.append((a, b, kind))
                covered[a:b] = b"\1" * (b - a)
    return sorted(taken)


def items(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """p10_found: (doc_id, kind, pii_text): each different item of a document once, exactly as stored. Null and
    blank texts have none."""

    def make():
        auto = automaton()

        def fn(b: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": [], "kind": [], "pii_text": []}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, item in dict.fromkeys((k, text[a:z]) for a, z, k in spans(text, auto)):
                    out["doc_id"].append(doc)
                    out["kind"].append(kind)
                    out["pii_text"].append(item)
            return out

        return fn

    src = df.select(F.col(id_col).cast("bigint"), F.col(text_col)).where(F.col(text_col).isNotNull())
    return map_batches(src, make, "doc_id bigint, kind string, pii_text string")


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_items): every document, its items replaced by placeholders; all else is as stored. A null
    text stays null."""

    def make():
        auto = automaton()

        def fn(b: pa.RecordBatch) -> dict:
            texts, ns = [], []
            for text in b.column(1).to_pylist():
                at = spans(text, auto) if text else []
                for a, z, kind in reversed(at):
                    text = text[:a] + PLACEHOLDERS[kind] + text[z:]
                texts.append(text)
                ns.append(len(at))
            return {"doc_id": b.column(0), "text": texts, "n_items": ns}

        return fn

    return map_batches(df.select(F.col(id_col).cast("bigint"), F.col(text_col)), make, "doc_id bigint, text string, n_items int")
