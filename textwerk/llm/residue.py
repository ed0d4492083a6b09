"""Problem 1: template residue, filler, error pages and notices that scripts are required.

The normalised lines of all records are counted by host (``source``); lines that recur in more than a share
``recurrent`` of a host's records are its boilerplate (a footer, a notice the host puts under every page) and are
subtracted; a record is excluded if what remains of it holds evidence, or if nothing remains, as boilerplate was
all of it. What is subtracted only matters where a record holds what may be evidence: those alone keep their text.

Evidence is sought in the consistent form of the text, letter case ignored: one Aho-Corasick automaton over
wordings of error pages, notices and fillers and over stems that such sentences need, patterns of what a short
sentence with such a stem says (a status code with its reason, a page that was not found, scripts to be turned
on, text to be put in), and patterns of placeholders. A wording within quotation marks is talked about, not used. ``meta`` is evidence if all of it is a placeholder.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .forms import consistent_form
from .shared import kept

# Wordings of error pages, of script notices and of filler notes, in lower case.
ERRORS = (
    "die angeforderte ressource existiert nicht mehr", "access denied", "502 bad gateway", "bad gateway", "upstream request timeout",
    "ihre sitzung ist abgelaufen", "interner serverfehler", "dieser inhalt ist in ihrer region nicht verfügbar",
    "die seite kann nicht angezeigt werden", "zeitüberschreitung des gateways", "zugriff verweigert",
    "verbindung zur datenbank fehlgeschlagen", "seite nicht gefunden", "too many requests", "dienst vorübergehend nicht verfügbar",
    "internal server error", "service unavailable", "gateway timeout", "page not found", "404 not found", "403 forbidden",
    "die seite wurde nicht gefunden", "die angeforderte seite wurde nicht gefunden", "your session has expired", "ihre anfrage konnte nicht bearbeitet werden",
)
SCRIPTS = (
    "ihr browser unterstützt keine skripte", "diese anwendung benötigt javascript", "bitte aktivieren sie javascript",
    "please turn on scripting", "in ihrem browser sind skripte deaktiviert", "you need to enable javascript",
    "ohne aktivierte skripte kann", "javascript ist erforderlich", "javascript ist deaktiviert", "please enable javascript", "javascript is required",
    "javascript is disabled", "this site requires javascript", "diese seite benötigt javascript",
)
FILLERS = (
    "platzhaltertext für den", "hier steht später der", "text folgt", "inhalt wird noch ergänzt", "beispieltext, bitte ersetzen", "dies ist nur ein blindtext",
    "dies ist ein blindtext", "bitte ersetzen sie diesen text", "hier steht ein beispieltext", "hier könnte ihr text stehen", "dies ist ein platzhalter", "insert text here", "your text here",
)
# The words of the filler text of printers.
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur".split()
# Names of markup tags, which are no placeholders.
TAGS = "a abbr address article aside b big blockquote body br caption center cite code col dd del div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main mark meta nav ol option p pre q s script section select small span strike strong style sub sup table tbody td textarea tfoot th thead title tr tt u ul var video".split()

_placeholder = re.compile(
    r"""\{\{[^{}\n]{1,60}\}\}|\{%[^%{}\n]{1,60}%\}|[$\#]\{[^{}\n]{1,40}\}|(?<![\w{])\{[^\W\d][\w.-]{1,30}\}
    |<<\s?[^\W\d][\w. -]{0,40}>>|<%[=\s][^%\n]{1,60}%>|(?<!<)<(?P<tag>[^\W\d][\w.-]{1,30})>
    |%%[^\W\d][\w\ ]{0,40}%%|(?<![\w%])%[^\W\d](?:\w|\ (?!\W)){1,30}%(?![\w%])|%\([^\W\d]\w{0,30}\)[sd]|@@[^\W\d][\w\ ]{0,40}@@|\$\$[^\W\d][\w\ ]{0,40}\$\$
    |(?<!\w)__[^\W\d_]\w{0,30}__(?!\w)|(?<![\w_])_{4,}(?![\w_])|(?<!\w)X{3,}(?!\w)|(?<!\w)XX\.\s?XX\.\s?(?:\d\d)?(?:XX){1,2}(?!\w)|(?<!\w)TODO(?::|_\w+)
    |\[\s?(?:[Bb]itte|[Ii]hre?[nmrs]?)\s[^\[\]\n]{1,40}\]
    |\[[^\[\]\n]{1,40}?\s(?:hier\s|HIER\s)?(?:einfügen|EINFÜGEN|ergänzen|ERGÄNZEN|eintragen|EINTRAGEN|nachtragen|NACHTRAGEN|ausfüllen|AUSFÜLLEN|angeben)\]
    |\[(?:[Ii]nsert|INSERT|[Yy]our|YOUR)\s[^\[\]\n]{1,40}\]""",
    re.X,
)
# Stems that a sentence needs to be looked at for what it says, and what it then has to say.
CUES = (
    "javascript", "skript", "scripting", "scripts", "error", "fehler", "http", "nicht gefunden", "not found", "nicht verfügbar", "nicht mehr", "unavailable", "not available", "existiert nicht", "does not exist",
    "nicht erreichbar", "nicht geladen", "nicht angezeigt", "abgelaufen", "expired", "verweigert", "denied", "forbidden", "zeitüberschreitung", "timed out", "timeout", "gateway", "datenbank", "database", "wartungsarbeiten", "under maintenance",
    "platzhalter", "blindtext", "beispieltext", "mustertext", "placeholder", "dummy text", "einfügen", "insert", "ersetzen", "replace", "noch ergänzt", "wird ergänzt", "folgt", "coming soon", "to be added",
)
_code = r"(?<!\d)[45]\d\d(?!\d)"
_page = r"(?:seite|webseite|website|inhalte?|ressource|dokument|datei|adresse|url|anfrage|dienst|server|page|site|content|resource|document|file|address|request|service)"
_SAYS = (
    ("script", re.compile(r"(?=.*\b(?:javascript|skripte?|scripts?|scripting)\b)(?=.*(?:aktivier|einschalt|eingeschaltet|benötig|erforderlich|deaktivier|ausgeschaltet|unterstützt|zulassen|erlauben|enabl|requir|disabl|turn(?:ed)? on|switch(?:ed)? on|must be on))(?=.*\b(?:ihr\w*|dein\w*|your?|browser\w*|seite|webseite|website|page|app|anwendung|inhalte?|content|bitte|please|fortfahren|continue|anzeige\w*)\b)")),
    ("error", re.compile(rf"\W*(?:(?:http|error|fehler(?:code)?|status)\W{{0,3}})+{_code}(?!\s*(?:mal|fälle|euro))|\W*{_code}\W{{0,4}}(?:(?:internal|interner?)\W+server|bad\W|not\W|forbidden|unauthori|service|gateway|too many|request|(?:seite|page|dienst|zugriff|datei)\b|(?:server\W*)?(?:fehler|error)\b)")),
    ("error", re.compile(rf"(?=.*\b(?:die|der|das|diese[rs]?|the|this|requested|angeforderte[rns]?|gesuchte[rns]?|aufgerufene[rns]?)?\s*{_page}\b)(?=.*(?:nicht (?:mehr )?gefunden|not (?:be )?found|existiert nicht|does not exist|no longer exists|nicht (?:mehr )?verfügbar|not available|unavailable|nicht (?:mehr )?erreichbar|nicht (?:angezeigt|geladen|bearbeitet) werden))(?=.*(?:\b(?:angefordert|gesucht|aufgerufen|requested|on this server|auf diesem server|auf dem server|leider|sorry|unfortunately|vorübergehend|temporarily|derzeit|currently|zurzeit)))")),
    ("error", re.compile(r"\W*(?:error\b|fehler\b).{0,24}(?:database|datenbank|connection|verbindung|server|loading|laden|timeout|timed out)|.*\b(?:your|ihre|deine|the|die)\s+(?:session|sitzung)\b.*(?:expired|abgelaufen)|\W*(?:der\s+)?(?:access|zugriff|permission)\W+(?:is\W+|was\W+|wurde\W+)?(?:denied|verweigert)\W*$|.*(?:site|seite|webseite|website)\b.*(?:under maintenance|wartungsarbeiten)")),
    ("filler", re.compile(r"\W*(?:hier|here|bitte|please|insert|replace|your)\b(?=.*\b(?:\w*text|inhalt|content|titel|title|beschreibung|description|überschrift|headline|name)\b)(?=.*(?:einfügen|eintragen|einsetzen|ergänz|ersetzen|insert|replace|folgt|goes here|\bhere\W*$))|\W*(?:dies|das|this)\s+(?:ist|is)\s+(?:nur\s+|only\s+|just\s+)?(?:ein\w*|an?)\s+(?:\w+\s+)?(?:platzhalter|blindtext|beispieltext|mustertext|placeholder|dummy)|\W*(?:text|inhalt|beschreibung|content|description)\s+(?:folgt|wird (?:noch )?(?:ergänzt|nachgereicht)|coming soon|to be added)\W*$|\W*(?:coming soon|to be added)\W*$")),
)
_sentence = re.compile(r"[^.!?\n\r|]+")
#: A notice is a sentence of its own of up to so many words; longer ones are prose about it.
NOTICE_WORDS = 14
_some_mark = re.compile(r"[{<\[%@$]|____|__\w|XX|TODO")
_lorem = frozenset(LOREM)
_tags = frozenset(TAGS)
_line = re.compile(r"[\n\r|]+")
_word = re.compile(r"[^\W\d_]+")


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, wordings in (("error", ERRORS), ("script", SCRIPTS), ("filler", FILLERS)):
        for w in wordings:
            auto.add_word(w, (kind, len(w)))
    for w in CUES:
        auto.add_word(w, ("cue", len(w)))
    for w in ("lorem", "adipiscing", "consectetur", "eiusmod", "incididunt", "ullamco", "pariatur"):
        auto.add_word(w, ("lorem", len(w)))
    auto.make_automaton()
    return auto


def placeholders(text: str) -> list[tuple[int, int]]:
    """Where unfilled placeholders and blanks stand in a text, markup tags and the project's markers apart."""
    if not _some_mark.search(text):
        return []
    return [m.span() for m in _placeholder.finditer(text) if not (m.group("tag") and m.group("tag").lower() in _tags)]


def _noise(text: str, spans: list[tuple[int, int]]) -> bool:
    """Whether the text besides the spans is mostly no letters, digits or spaces: there, signs of placeholders
    come about by chance."""
    rest, at = [], 0
    for a, b in spans:
        rest.append(text[at:a])
        at = b
    rest = "".join([*rest, text[at:]])
    return sum(c.isalnum() or c.isspace() for c in rest) < 0.7 * len(rest)


def _lower(text: str) -> str:
    """The text in lower case with each character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def evidence(text: str, auto: ahocorasick.Automaton, whole: bool = True) -> list[tuple[str, int]]:
    """(kind, place) of the evidence in a text that is in the consistent form; where it isn't ``whole``, of all that
    may be evidence in a part of it: placeholders amid noise and sentences beside other evidence too."""
    spans = placeholders(text)
    out = [("placeholder", a) for a, _ in spans] if spans and not (whole and _noise(text, spans)) else []
    low = _lower(text)
    lorem = False
    cues: list[int] = []
    for end, (kind, n) in auto.iter(low):
        a = end - n + 1
        if kind == "lorem":
            lorem = True
        elif kind == "cue":
            cues.append(a)
        elif not (a and (low[a - 1].isalnum() or low[a - 1] in "„“\"»‚'")) and low[end + 1 : end + 2] not in ("“", "«"):
            out.append((kind, a))
    if cues and not (whole and out):
        for m in _sentence.finditer(low):
            if any(m.start() <= a < m.end() for a in cues) and len(m.group().split()) <= NOTICE_WORDS and not any(q in m.group() for q in "„“”\"«»"):
                out += [(kind, m.start()) for kind, says in _SAYS if says.match(m.group())][:1]
    if lorem and (hits := [m.start() for m in _word.finditer(low) if m.group() in _lorem]) and len(hits) >= 4:
        out.append(("filler", hits[0]))
    return out


def lines(text: str, marks: list[tuple[str, int]]) -> list[tuple[int, int, int, int | None]]:
    """(start, end, end of the separator after it, key) of each line; lines of the same content have the same key,
    those without letters, digits or marks have none. Content that differs in a number alone is not the same
    content, a notice that does is the same."""
    out = []
    breaks = [(0, 0), *(m.span() for m in _line.finditer(text)), (len(text), len(text))]
    for (_, a), (z, end) in zip(breaks, breaks[1:]):
        low, marked, key = text[a:z].lower(), any(a <= at < z for _, at in marks), None
        if marked or any(map(str.isalnum, low)):
            words = " ".join(_word.findall(low)) if marked else ""
            line = f"notice {words}" if words else f"line {' '.join(low.split())}"
            key = int.from_bytes(blake2b(line.encode(), digest_size=8).digest(), "big", signed=True)
        out.append((a, z, end, key))
    return out


def evidence_lines(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(row, host, lines, kinds, text): for each record with a text the keys of its different lines; kinds and text
    (in the consistent form) where it holds what may be evidence: kinds are those of the text as a whole."""
    src = df.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.col(text_col)).where(F.col(text_col).isNotNull())

    def make():
        auto = automaton()

        def fn(b: pa.RecordBatch) -> dict:
            out: dict = {"row": b.column(0), "host": b.column(1), "lines": [], "kinds": [], "text": []}
            for text in b.column(2).to_pylist():
                text = consistent_form(text)
                marks = evidence(text, auto, whole=False)
                out["lines"].append(list({key for *_, key in lines(text, marks) if key is not None}))
                out["kinds"].append(sorted({kind for kind, _ in evidence(text, auto)}) if marks else None)
                out["text"].append(text if marks else None)
            return out

        return fn

    return map_batches(src, make, "row bigint, host string, lines array<bigint>, kinds array<string>, text string")


def remaining(text: str, gone: set[int], auto: ahocorasick.Automaton) -> set[str]:
    """The kinds of evidence in what remains of a text without the lines whose keys are gone; in all of the text if
    nothing remains."""
    hits = evidence(text, auto)
    rest, left, bare = "", set(), True
    for a, z, end, key in lines(text, evidence(text, auto, whole=False)):
        if key not in gone:
            rest += text[a:end]
            left |= {kind for kind, at in hits if a <= at < z}
            bare &= key is None
    return {kind for kind, _ in hits} if bare else left | {kind for kind, _ in evidence(rest, auto)}


def evidence_left(df: DataFrame) -> DataFrame:
    """(row, kinds) of (row, text, gone), where gone are the keys of a record's lines that are its host's boilerplate."""

    def make():
        auto = automaton()

        def fn(b: pa.RecordBatch) -> dict:
            return {"row": b.column(0), "kinds": [sorted(remaining(text, set(gone), auto)) for text, gone in zip(*(c.to_pylist() for c in b.columns[1:]))]}

        return fn

    return map_batches(df.select("row", "text", "gone"), make, "row bigint, kinds array<string>")


def is_unfilled(meta):
    """Column: all of the value is a placeholder."""
    m = F.trim(meta)
    whole = r"^(\{\{.+\}\}|\{%.+%\}|[$#]\{.+\}|\{[\p{L}_][\w. -]*\}|<<.+>>|<%.+%>|<[\p{L}_][\w. -]*>|%%.+%%|%\(\w+\)[sd]|%\w+%|@@.+@@|\$\$.+\$\$|__\w+__|_{3,}|X{3,}|TODO(\b|_).*|\[(bitte|Bitte|Ihre?) .+\]|\[.+ (hier )?(einfügen|ergänzen|eintragen|nachtragen|ausfüllen|angeben)\])$"
    return F.coalesce(m.rlike("(?iu)" + whole), F.lit(False))


def residue(df: DataFrame, id_col: str = "row_id", text_col: str = "text", meta_col: str = "meta", host_col: str = "source", recurrent: float = 0.02, sure: float = 3.0) -> DataFrame:
    """(row_id, kinds): the records to leave out and why (placeholder, filler, error, script, meta; sorted). A line is
    a host's boilerplate if two or more of its records have it and the share of its records with a text that do
    is surely above ``recurrent``: the lower end of the share's confidence interval (Wilson's, of ``sure``
    standard deviations) is. Null and blank texts hold no evidence; records without a host are one host."""
    records = kept(evidence_lines(df, id_col, text_col, host_col))
    totals = records.groupBy("host").agg(F.count("*").alias("total"))
    counts = records.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    n, z = F.col("total"), sure
    p = F.col("n") / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    boiler = counts.join(totals, "host").where(low > recurrent).groupBy("host").agg(F.collect_list("line").alias("boiler"))
    marked = records.where(F.col("text").isNotNull()).join(boiler, "host", "left")
    marked = kept(marked.select("row", "kinds", "text", F.coalesce(F.array_intersect("lines", "boiler"), F.array().cast("array<bigint>")).alias("gone")))
    left = marked.where(F.size("gone") == 0).select("row", "kinds").unionByName(evidence_left(marked.where(F.size("gone") > 0)))
    left = left.select("row", F.explode("kinds").alias("kind"))
    meta = df.where(is_unfilled(F.col(meta_col)) & F.col(text_col).rlike(r"\S")).select(F.col(id_col).cast("bigint").alias("row"), F.lit("meta").alias("kind"))
    return left.unionByName(meta).groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).withColumnRenamed("row", "row_id")


def found(df: DataFrame, **how) -> DataFrame:
    """p1_found: (row_id) of the records to leave out."""
    return residue(df, **how).select("row_id")


def without_residue(df: DataFrame, id_col: str = "row_id", **how) -> DataFrame:
    """The records without those, as stored."""
    out = residue(df, id_col=id_col, **how).select(F.col("row_id").alias("_out"))
    return df.join(out, F.col(id_col) == F.col("_out"), "left_anti")
