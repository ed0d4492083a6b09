"""Text functions on columns; all stay in the JVM. Null texts give null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ABSTRACT, LIST_HEADER, LIST_MARK, MARKERS, TRIGGERS, URLS, WS, any_match, apply_rules, portable


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def normalize_ws(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def fingerprint(text: Column) -> Column:
    """MD5 of the text in lower case with white space normalised."""
    return F.md5(normalize_ws(F.lower(text)))


def words(text: Column) -> Column:
    """The words between white space; an empty text has none."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def bound(value: Column, make) -> Column:
    """make(value) with the value computed once: within a lambda of a higher-order function an expression from
    outside would be computed again for each element."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Split after . ! ? where white space follows; trailing empty ones stay."""
    return F.split(text, f"(?<=[.!?]){WS}+", -1)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space, repeats too."""

    def runs(w: Column) -> Column:
        k = F.size(w) - (n - 1)
        each = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(k > 0, each).otherwise(F.array().cast("array<string>"))

    return bound(tokens, runs)


def trigram_set(text: Column) -> Column:
    """Different runs of three lower-case words; a shorter text is one run."""
    return bound(words(F.lower(text)), lambda w: F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(ngrams(w, 3))))


def digit_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double") / F.length(text)


def truncate_chars(text: Column, n: int = 1024) -> Column:
    """At most n characters, without a word cut in two at the end."""
    return F.when(F.length(text) > n, F.regexp_replace(F.substring(text, 1, n), "(?s) [^ ]*$", "")).otherwise(text)


def truncate_words(text: Column, n: int = 300) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def word_prefix(text: Column, n: int = 8) -> Column:
    return F.array_join(F.slice(words(F.lower(text)), 1, n), " ")


def groups_of(items: Column, k: int) -> Column:
    """Every k consecutive items joined by a space; the last group may be shorter."""
    return bound(items, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(k)), lambda i: F.array_join(F.slice(x, i, k), " ")))


def chunks(text: Column, size: int = 256, step: int = 128, least: int = 10) -> Column:
    """Overlapping windows of words; windows of fewer than ``least`` words are left out, and the text itself
    stands where none remains. No window begins after one that reached the end."""

    def windows(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / F.lit(step)), F.lit(0)).cast("int")
        all_ = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * step + 1, size))
        return F.transform(F.filter(all_, lambda c: F.size(c) >= least), lambda c: F.array_join(c, " "))

    return bound(bound(words(text), windows), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(text)))


def discard_reason(sentence: Column) -> Column:
    """Why a sentence is discarded, or null: empty, list header, list mark, template."""
    return (
        F.when(sentence == "", "empty")
        .when(sentence.rlike("(?iu)" + portable(LIST_HEADER)), "list_header")
        .when(sentence.rlike(LIST_MARK), "list_mark")
        .when(any_match(sentence, TRIGGERS), "template")
    )


def discard_sentences(text: Column) -> Column:
    """The text without the sentences that have a reason to go."""
    kept = F.filter(F.transform(sentences(text), trimmed), lambda s: discard_reason(s).isNull())
    return F.array_join(kept, " ")


def group_of_id(id_: Column) -> Column:
    """The group a record id belongs to, by the formats of ids; null ids are in group unknown."""
    return (
        F.when(id_.isNull(), "unknown")
        .when(id_.contains("_seg"), F.substring_index(id_, "_seg", 1))
        .when(id_.contains("__"), F.substring_index(id_, "__", 1))
        .when(id_.rlike("^gesetz_[a-zA-Z0-9]+_[0-9]+$"), F.regexp_extract(id_, "^(gesetz_[a-zA-Z0-9]+)_[0-9]+$", 1))
        .when(id_.rlike("^eupdcorp_[0-9]+_[0-9]+$"), F.regexp_extract(id_, "^(eupdcorp_[0-9]+)_[0-9]+$", 1))
        .when(id_.rlike("^[0-9]+_[^_]+_[0-9]+$"), F.regexp_extract(id_, "^([0-9]+_[^_]+)_[0-9]+$", 1))
        .otherwise(id_)
    )


def word_tokens(text: Column, least: int = 1) -> Column:
    """Longest runs of letters, digits and underscores, as Unicode has them."""
    return F.regexp_extract_all(text, F.lit(f"([\\p{{L}}\\p{{N}}_]{{{least},}})"), 1)


#: Fixed value: the class of letters that a listed token is made of.
LISTED_TOKEN = "^[A-Za-zÄöüß1-9]{3,}$"


def listed_tokens(text: Column) -> Column:
    """Whole words of at least three characters of the class LISTED_TOKEN, in lower case."""
    return F.filter(word_tokens(F.lower(text)), lambda w: w.rlike(LISTED_TOKEN))


def preprocess(text: Column) -> Column:
    """What a text goes through before it is scored: markers, no URLs, white space, at most 1024 characters."""
    return truncate_chars(normalize_ws(apply_rules(text, MARKERS + URLS)))


def abstracted(sentence: Column) -> Column:
    return apply_rules(sentence, ABSTRACT)


def humanized(text: str, seed: int) -> str:
    """A text with a few of the slips of people, by chance of the seed: two neighbouring sentences change places
    (20 %), filler words are put in (15 %), a word is misspelt (20 %). Texts of fewer than five words change
    their sentences alone. An ordinary function, to be called from a batch."""
    import random
    import re

    r = random.Random(seed)
    parts = re.split(r"(?<=[.!?])\s+", text)
    if len(parts) >= 3 and r.random() < 0.20:
        i = r.randrange(len(parts) - 1)
        parts[i : i + 2] = parts[i + 1], parts[i]
    text = " ".join(parts)
    words = text.split()
    if len(words) < 5:
        return text
    if r.random() < 0.15:
        for _ in range(r.randint(1, 2)):
            words.insert(r.randint(1, len(words) - 2), r.choice(FILLERS))
    long = [i for i, w in enumerate(words) if len(w) > 5 and w.isalpha()]
    if r.random() < 0.20 and long:
        i, slip = r.choice(long), r.choice(("swap", "drop", "double"))
        w = words[i]
        k = r.randrange(len(w) - (slip == "swap"))
        words[i] = w[:k] + {"swap": w[k : k + 2][::-1], "drop": "", "double": 2 * w[k]}[slip] + w[k + (2 if slip == "swap" else 1) :]
    return " ".join(words)


# Filler words.
FILLERS = ("ja", "also", "halt", "mal", "eben", "sozusagen")


def humanize(text: Column, id_: Column, seed: int = 42) -> Column:
    """humanized() of each text; the chance comes from id and seed, so that a repeated task gives the same."""
    @F.pandas_udf("string")
    def slips(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else humanized(t, int(k)) for t, k in zip(texts, seeds)])

    return slips(text, F.xxhash64(F.lit(seed), id_))
