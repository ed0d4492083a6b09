"""Rule lists of the text cleaners, and how they become column expressions or SQL of the same meaning.

A rule is (pattern, replacement, ignore case). Patterns are written for any engine: ``\\s`` and ``\\S`` stand
for Unicode white space, ``\\1`` in a replacement for the first group. A list of rules is applied in its order,
each to the result of the one before; a list of triggers is one alternation, as its order can't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a class that Java and RE2 read alike.
_SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NOT_WS = f"[{_SPACES}]", f"[^{_SPACES}]"

# Party names, name words and rule lists of the cleaners.
_PARTIES = "CDU|CSU|SPD|Grüne|Grünen|FDP|AfD|Linke|BSW|ÖDP|Volt|Freie Wähler|Freien Wähler"
_NAME = r"(?:[A-ZÄÖÜß][a-zäöüß]+)\s+(?:[A-ZÄÖÜß][a-zäöüß]+)"
MARKERS = (
    (r"§+\s*\d+(?:\s*(?:Abs\.|Absatz|Satz)\s*\d+)*", "[PARAGRAPH]", True),
    (r"\b(?:Abs\.|Absatz)\s*\d+\b", "[PARAGRAPH]", True),
    (r"\b(?:Art\.|Artikel)\s*\d+\b", "[PARAGRAPH]", True),
    (r"\bAz\.\s*[A-Za-z0-9./-]+\b", "[AZ]", True),
    (r"\b\d{2,4}/\d{4,6}\b", "[AZ]", False),
    (r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b", "[DATUM]", False),
    (rf"\b(?:{_PARTIES})\b", "[PARTEI]", True),
    (rf"auf\s+Initiative\s+von\s+(?:Abgeordnet(?:em|er|en)\s+)?{_NAME}", "auf Initiative von [PERSON]", False),
    (rf"unter\s+Aufsicht\s+von\s+{_NAME}", "unter Aufsicht von [PERSON]", False),
    (rf"unter\s+Bezug(?:nahme)?\s+auf\s+{_NAME}", "unter Bezugnahme auf [PERSON]", False),
    (rf"im\s+Namen\s+von\s+{_NAME}", "im Namen von [PERSON]", False),
    (rf"unter\s+Leitung\s+von\s+{_NAME}", "unter Leitung von [PERSON]", False),
    (rf"durch\s+{_NAME}", "durch [PERSON]", False),
    (rf"gezeichnete\s+Antrag\s+von\s+{_NAME}", "gezeichnete Antrag von [PERSON]", False),
    (rf"\((?:Abgeordnet(?:er|em|en)\s+)?{_NAME}\)", "([PERSON])", False),
    (r"in\s+(?:dieser|der\s+heutigen)\s+\d+\.\s*Plenarsitzung", "in dieser [PLENARSITZUNG]", True),
    (r"\bPlenarsitzung\b", "[PLENARSITZUNG]", True),
    (r"\bDrucksache\b", "[DRUCKSACHE]", True),
    (r"\s+", " ", False),
    (r"\s+([.,;:!?])", r"\1", False),
)
ARTIFACTS = (
    (r"\d+\.\s*Plenarsitzung", "Plenarsitzung", False),
    (r"\((?:CDU(?:/CSU)?|SPD|Grüne|FDP|AfD|Linke|BSW|CSU)\)", "", False),
    (r"(?:auf Initiative von |Abgeordnet(?:em|er|en)\s+)[A-ZÄÖÜ][a-zäöüß]+\s+[A-ZÄÖÜ][a-zäöüß]+", "", False),
    (r"\s{2,}", " ", False),
)
TEMPLATES = tuple(
    (p, " ", True)
    for p in (
        r"am\s+heutigen\s+\d{2}\.\d{2}\.\d{4}", r"am\s+heutigen\s+Tag", r"am\s+heutigen", r"heutigen\s+Tag", "heutigen", r"aktuellen\s+Lage", "aktuellen",
        r"\((?:CDU(?:/CSU)?|SPD|Grüne|FDP|AfD|Linke|BSW|CSU|Volt|ÖDP|Freie\s+Wähler)\)",
        r"\b(?:CDU/CSU|CDU|CSU|SPD|Grüne|FDP|AfD|Linke|BSW|Volt|ÖDP|Freie\s+Wähler)\b",
        r"\b(?:\d+\.)?\s*Plenarsitzung\b", r"\bDrucksache\b", r"\bAktenzeichen\b", r"\bAz\.?\b", r"\bAbsatz\b", r"\bAbs\.?\b", r"\bParagraph\b", "§+",
        r"\bRechtsverordnung\b", r"\bLandesgesetz\b", r"\bBundestag\b", r"\bLandtag\b", r"\bFraktion\b", r"\bAusschuss\b", r"\bGesetz(?:es)?\b",
        r"\bGesetzgebung\b", r"\bVorschrift(?:en)?\b",
        r"(?:auf\s+Initiative\s+von\s+|Abgeordnet(?:em|er|en)\s+)[A-ZÄÖÜ][a-zäöüß]+\s+[A-ZÄÖÜ][a-zäöüß]+",
        r"\b(?:Herr|Frau)\s+[A-ZÄÖÜ][a-zäöüß]+", r"\b(?:im\s+Namen\s+der|laut\s+der)\s+Fraktion\b", r"\bunter\s+Zeichnung\s+von\b",
        r"\blaut\s+[A-ZÄÖÜ][a-zäöüß]+\s+[A-ZÄÖÜ][a-zäöüß]+\b", r"\bvon\s+[A-ZÄÖÜ][a-zäöüß]+\s+[A-ZÄÖÜ][a-zäöüß]+\s+vertretenen\s+Bürger\b",
        r"\bdirekt\b", r"\bbezüglich\b", r"\baufgrund\b", r"\bAuskunftspflichten\b", r"\bim\s+Sinne\s+des\s+Gemeinwohls\b",
        r"\bim\s+internationalen\s+Vergleich\b", r"\bunter\s+keinen\s+Umständen\b", r"\bin\s+der\s+vorliegenden\s+Fassung\b",
        r"\bvorliegende\s+Entwurf\b", r"\bvorliegende\s+Fassung\b", r"\bin\s+eigenen\s+Worten\b", r"\bLassen\s+Sie\s+uns\b",
        r"\bgemeinsam\s+die\s+Ärmel\s+hochkrempeln\b", r"\bzügig\s+auf\s+den\s+Weg\s+bringen\b", r"\bverspielt\s+unsere\s+Zukunft\b",
        r"\bins\s+Hintertreffen\s+geraten\b", r"\bauf\s+die\s+lange\s+Bank\s+zu\s+schieben\b", r"\b Responsibility\s+zu\s+übertragen\b",
        r"\bVerantwortung\s+zu\s+übertragen\b", r"\bim\s+Bereich\b", r"\bbeim\s+Thema\b", r"\bzum\s+Thema\b", r"\bzum\s+Bereich\b",
        r"\büber\s+das\s+Thema\b", r"\büber\s+den\s+Bereich\b",
    )
) + ((r"\s+", " ", False),)
PHRASES = tuple(
    (p, "", True)
    for p in (
        r"\b(?:ist|sind|war|wäre)\s+(?:ein\s+)?Thema,\s*(?:das|zu\s+dem|über\s+das|welches)\s+(?:in\s+der\s+)?Öffentlichkeit\s+intensiv\s+diskutiert\s+wird",
        r"\b(?:ist|sind|war|wäre)\s+(?:ein\s+)?Thema,\s*(?:das\s+uns\s+alle\s+angeht|zu\s+dem\s+ich\s+mich\s+äußern\s+möchte)",
        r"\b(?:ist|sind|war|wäre)\s+(?:ein\s+)?Thema\b", r"\b(?:ist|sind|war|wäre)\s+(?:ein\s+)?Politikfeld\b",
        r"\b(?:die\s+)?vorgeschlagenen\s+Maßnahmen\b", r"\b(?:die\s+)?vorgeschlagenen\s+(?:Änderungen|Regelungen|Vorschläge)\b",
        r"\bder\s+einzelnen\s+Regelungsgegenstände\b", r"\bRegelungen\s+zur\b", r"\bwerden\s+einwenden,\s+dass\b", r"\bwerden\s+einwenden\b",
        r"\b(?:hat\s+sich\s+)?dazu\s+klar\s+positioniert\b", r"\böffentlichkeit\s+intensiv\s+diskutiert\b", r"\bTräger\s+der\s+Maßnahme\b",
        r"\bnach\s+pflichtgemäßem\s+Ermessen\b", r"\bgesetzlichen\s+Grenzen\s+des\s+Ermessens\b",
        r"\bDie\s+Beteiligten\s+sind\s+vor\s+der\s+Entscheidung\s+anzuhören\b", r"\bDie\s+Durchführung\s+obliegt\s+den\s+zuständigen\s+Landesbehörden\b",
        r"\bDie\s+Vorschriften\s+dieses\s+Gesetzes\s+sind\s+zu\s+beachten\b", r"\bErmessensentscheidungen\s+sind\s+zu\s+begründen\b",
        r"\bDie\s+Kosten\s+trägt\s+der\s+Veranlasser\b", r"\bDie\s+Finanzierung\s+ist\s+im\s+Bundeshaushalt\s+vorgesehen\b",
        r"\bDoch\s+dieser\s+Einwand\s+greift\s+zu\s+kurz\b", r"\bWir\s+empfehlen\s+daher\s+eine\s+differenzierte\s+Betrachtung\b",
        r"\bBegründung\s+zum\s+Gesetzentwurf\s+zur\b", r"\bBegründung\s+zum\s+Gesetzentwurf\b", r"\bA\.\s+Allgemeiner\s+Teil\b",
        r"\bZiel\s+des\s+Gesetzentwurfs\s+ist\s+es,\s+die\s+Rechtslage\b", r"\bzeitgemäß\s+zu\s+gestalten\b", r"\bDie\s+derzeitige\s+Rechtslage\s+weist\b",
        r"\bDie\s+derzeitige\s+Rechtslage\b", r"\b(?:1|2|3|4|5)\.\s+(?:Ausgangslage|Zielsetzung|Alternativen|Kosten|Finanzierung)\b",
        r"\bB\.\s+Besonderer\s+Teil\b", r"\bBesonderer\s+Teil\b", r"\bNotwendigkeit\s+ergibt\s+sich\s+aus\b", r"§+\s*\d+:\s*(?:die|der|das)?", r"§+\s*\d+",
        r"\bder\s+Verantwortliche\b", r"\bder\s+Auftragnehmer\b", r"\bder\s+Antragsteller\b", r"\bbetroffene\s+Person\b", r"\bzuständige\s+Behörde\b",
        r"\bzu\s+beachten,\b", r"\(\d+\)", r"\bC\.\s+Finanzielle\s+Auswirkungen\b", r"\bKosten\s+werden\s+auf\s+.*?\s+geschätzt\b",
        r"\bMilliarden\s+Euro\s+geschätzt\b", r"\bAusübung\s+des\s+Ermessens\b", r"\bdes\s+Ermessens\b", r"\bwahrt\s+bei\b", r"\bgesetzlichen\s+Grenzen\b",
        r"\bnach\s+Prüfung\s+der\b", r"\bbei\s+Vorliegen\s+besonderer\b", r"\bvorliegen\s+besonderer\b",
    )
) + ((r"\s+", " ", False), (r"\s+([.,;:!?])", r"\1", False))
TRIGGERS = (
    "Defizite auf", "grundsätzlich zu begrüßen", "grundsätzlich zu begrüssen", "differenzierte Betrachtung", "ist ein Thema", "sind ein Thema",
    "war ein Thema", "wäre ein Thema", "ist ein Politikfeld", "sind ein Politikfeld", "kritisch anzumerken", "hätte jedoch zur Folge",
    "Als Alternative kommt", "Träger der Maßnahme", "Träger der Massnahme", "pflichtgemäßem Ermessen", "pflichtgemässem Ermessen",
    "Grenzen des Ermessens", "vor der Entscheidung anzuhören", "obliegt den zuständigen Landesbehörden",
    "Vorschriften dieses Gesetzes sind zu beachten", "Ermessensentscheidungen sind zu begründen", "Kosten trägt der Veranlasser",
    "im Bundeshaushalt vorgesehen", "Einwand greift zu kurz", "Begründung zum Gesetzentwurf", "Allgemeiner Teil", "Besonderer Teil",
    "zeitgemäß zu gestalten", "zeitgemäss zu gestalten", "Finanzielle Auswirkungen", "Erfüllungsaufwand", "Vollzug obliegt den Ländern",
    "Ich danke Ihnen für die Aussprache", "bitte um Zustimmung", "Koalition hat sich viel vorgenommen", "ob sie Wort hält", "vorgeschlagenen",
    "vorgelegten", "hoffe auf", "ich hoffe", "aufmerksamkeit", "werde einwenden", "werden einwenden", "möchte mich", "möchte betonen",
    "Analyse:", "Empfehlung", "Ausgangslage", "Alternativen", "Bewertung", r"Notwendigkeit\s+ergibt\s+sich\s+aus", r"§+\s*\d+:\s*(?:die|der|das)?",
    r"§+\s*\d+", r"der\s+Verantwortliche", r"der\s+Auftragnehmer", r"der\s+Antragsteller", r"betroffene\s+Person", r"zuständige\s+Behörde",
    r"zu\s+beachten,", r"\(\d+\)",
)
SUBSTRINGS = ("aufgrund der aktuellen Lage", "im Namen der Fraktion", "unter Zeichnung von", "Plenarsitzung", "Rechtsverordnung", "Drucksache", "Landesgesetz", "Auskunftspflichten")
SHORTCUTS = (("session_number", r"\d+\.\s*Plenarsitzung"), ("party_in_parens", r"\((CDU|CSU|SPD|Grüne|FDP|AfD|Linke|BSW)\)"), ("opener", "^Meine Damen und Herren"), ("member_name", r"Abgeordnet(em|er|en)\s+\w+\s+\w+"))
SPECIAL_CHARS = ("„", "“", "”", "«", "»", '"', "'", "`", "’", "–", "—", "[", "]", "(", ")", "§", "%", "&")
BAD_PHRASES = ("als ki ", "als sprachmodell", "ich kann leider", "gerne helfe ich", "natürlich, hier", "hier sind die", "bitte beachten sie", "als assistent")
BAD_PHRASES_STRICT = ("als ki", *BAD_PHRASES[1:])
BAD_PHRASES_PARAGRAPH = ("als ki", "als sprachmodell", "ich kann leider", "gerne helfe", "natürlich, hier", "bitte beachten", "als assistent", "hier ist", "hier sind", "selbstverständlich")
ENGLISH_MARKERS = ("the ", " of ", " and ", " to ", "this ", "is ")
STOPWORDS = ("der", "die", "das", "und", "ist", "in", "zu", "den", "von", "mit", "sich", "des", "dem", "auf", "für")
URLS = ((r"http\S+", "", False),)
SOCIAL = ((r"\|LBR\|", " ", False), (r"@[\p{L}\p{N}_]+", "", False), (r"#[\p{L}\p{N}_]+", "", False))
MARKDOWN = ((r"(?m)^[#*\-–•\d]+[.):]?\s*", "", False), (r"\*\*|__|\*|_", "", False), (r"\s+", " ", False))
COLON_PREFIX = ((r"^[A-Za-z0-9ÄÖÜäöüß\s,-]+\s*:\s*", "", False),)
COLON_PREFIX_ANY = ((r"^.*?\s*:\s*", "", False),)
ABSTRACT = (
    (r"^[A-ZÄÖÜ][\p{L}\p{N}_-]*(?:\s+und\s+[A-ZÄÖÜ][\p{L}\p{N}_-]*)?\s+(ist|sind)\s+ein\s+Thema", r"[TOPIC] \1 ein Thema", False),
    (r"^[A-ZÄÖÜ][\p{L}\p{N}_-]*(?:\s+und\s+[A-ZÄÖÜ][\p{L}\p{N}_-]*)?\s+(ist|sind)\s+ein\s+Politikfeld", r"[TOPIC] \1 ein Politikfeld", False),
)
LIST_HEADER = r"^\d+\.\s*(?:[A-ZÄÖÜ]|$)"
LIST_MARK = r"^[A-Za-z0-9]\.$"


def portable(pattern: str) -> str:
    """White space as a class; within a class of the pattern as its members."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(_SPACES if inside and two == r"\s" else WS if two == r"\s" else NOT_WS)
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        inside = (inside or two[0] == "[") and two[0] != "]"
        out.append(two[0])
        i += 1
    return "".join(out)


def apply_rules(text: Column, rules) -> Column:
    """The rules in order, as one expression."""
    return reduce(lambda c, r: F.regexp_replace(c, ("(?iu)" if r[2] else "") + portable(r[0]), r[1].replace("\\1", "$1")), rules, text)


def any_match(text: Column, patterns, ignore_case: bool = True) -> Column:
    """Whether one of the patterns is found: one alternation, one pass."""
    return text.rlike(("(?iu)" if ignore_case else "") + "|".join(f"(?:{portable(p)})" for p in patterns))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules_sql(text: str, rules) -> str:
    """The rules in order, as SQL for an engine with RE2 patterns."""
    return reduce(lambda c, r: f"regexp_replace({c}, {quoted(('(?i)' if r[2] else '') + portable(r[0]))}, {quoted(r[1])}, 'g')", rules, text)


def any_match_sql(text: str, patterns, ignore_case: bool = True) -> str:
    return f"regexp_matches({text}, {quoted(('(?i)' if ignore_case else '') + '|'.join(f'(?:{portable(p)})' for p in patterns))})"
