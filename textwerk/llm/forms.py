"""Consistent form, words, same-text key and shingles, shared by the llm operators.

Shared terms (TESTDATA.md): the *consistent form* is the text as it looks; *words* are the longest
runs of letters and digits of that form, letter case ignored; two texts are the *same text* when the
letters and digits of their consistent forms agree in order, for labelled-field texts whatever the
order of the fields.

Everything here is a plain Python function on strings or arrays, called from Arrow batches.
Null or blank texts have no words, no key and no shingles (``None`` / empty arrays).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Characters that look like a Latin letter (Greek, Cyrillic), and that letter.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Ϲ": "C", "Ϳ": "J", "Ү": "Y", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "ӏ": "l", "Ѵ": "V", "ѵ": "v",
}
# The same with an accent of their own, by rule.
for _o in (*range(0x0370, 0x0530), *range(0x1F00, 0x2000)):
    _base, *_accents = unicodedata.normalize("NFD", chr(_o)) or " "
    if _accents and _base in LOOK_ALIKES:
        LOOK_ALIKES[chr(_o)] = unicodedata.normalize("NFC", LOOK_ALIKES[_base] + "".join(_accents))
# Characters without any ink, and spaces that look like the ordinary one.
IGNORABLES = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe0e\ufe0f\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
JOINER = "\u200d"  # ignorable, but for its place between two pictographs, which it makes one
#: Ranges of presentation forms: Latin ligatures, and full-width or half-width forms.
FORM_RANGES = "ﬀ-ﬆ！-～￠-￦"
#: A text without any of these characters that is in composed form (NFC) is its own consistent form.
SUSPECT = f"[{IGNORABLES}{SPACES}{JOINER}{FORM_RANGES}\u0300-\u036f{''.join(LOOK_ALIKES)}]"

_suspect = re.compile(SUSPECT)
_table = {ord(a): b for a, b in LOOK_ALIKES.items()} | {ord(c): None for c in IGNORABLES} | {ord(c): " " for c in SPACES}
_table |= {o: unicodedata.normalize("NFKC", chr(o)) for a, b in ((0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0xFFE0, 0xFFE6)) for o in range(a, b + 1)}
_pict = "[☀-➿\U0001f000-\U0001faff]"
_joiner = re.compile(f"(?<!{_pict}){JOINER}|{JOINER}(?!{_pict})")
_runs = re.compile(r"[^\W_]+")


def consistent_form(text: str) -> str:
    """The text as it looks: full-width, ligature, combining, look-alike, no-break-space and invisible
    characters become their plain equivalents; all else, letter case and line breaks too, stays."""
    if _suspect.search(text):
        text = text.translate(_table)
        if JOINER in text:
            text = _joiner.sub("", text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def is_odd(text: str) -> bool:
    """Whether a text may differ from its consistent form."""
    return _suspect.search(text) is not None or not unicodedata.is_normalized("NFC", text)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the consistent form, in lower case."""
    return _runs.findall(consistent_form(text).lower()) if text else []


# A field starts a text or follows a line break, bar or semicolon: a name of one word, a colon.
_field = re.compile(r"(?:^|[\n\r;|])[\s;|]*([^\W\d_][\w-]{1,30})[ \t]*:(?=\s)")


def same_text_key(text: str | None) -> str | None:
    """The letters and digits in order; a text that begins with a labelled field and has at least two
    different ones is taken apart at the field names, and the fields are put into sorted order.
    None where there is no letter or digit."""
    if not text:
        return None
    t = consistent_form(text).lower()
    if ":" in t:
        starts = [(m.start(1), m.group(1)) for m in _field.finditer(t)]
        if len({n for _, n in starts}) > 1 and not _runs.search(t, 0, starts[0][0]):
            cuts = [a for a, _ in starts] + [len(t)]
            return "\x1f".join(sorted("".join(_runs.findall(t[a:b])) for a, b in zip(cuts, cuts[1:]))) or None
    return "".join(_runs.findall(t)) or None


_cache: dict[str, int] = {}


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words, alike in every process and on every machine."""
    get = _cache.get
    out = [get(w) for w in ws]
    if None in out:
        if len(_cache) > 400_000:
            _cache.clear()
        for i, v in enumerate(out):
            if v is None:
                out[i] = _cache[ws[i]] = xxhash.xxh3_64_intdigest(ws[i].encode("utf-8", "surrogatepass"))
    return np.array(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (in order, repeats kept); a shorter text is one run."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return mix(out)


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """The different runs of n words, as sorted 64-bit hashes."""
    return np.unique(run_hashes(word_hashes(words(text)), n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the runs found in both among those found in either; a and b as from shingles()."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Characters that are plain for sure: in composed form, their own consistent form, and of one lower-case letter each. The
#: words of texts of these alone are made for a whole batch at once, of all others one by one; they are the same.
_NOT_PLAIN = r"[^\x{00}-\x{9f}\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}\x{2013}\x{2014}\x{2018}-\x{201e}\x{2022}\x{2026}\x{20ac}]"


def _lettered(texts: pa.Array, between: str, other) -> pa.Array:
    """Each text in lower case with ``between`` in place of what is no letter or digit; other(text) where it has
    characters that are not plain. Null as an empty text."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _NOT_PLAIN)
    made = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", between)
    some = pa.array([other(t) for t in texts.filter(odd).to_pylist()], type=texts.type)
    return pc.replace_with_mask(made, odd, some)


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's begin and end (n + 1 offsets)."""
    spaced = pc.utf8_trim(_lettered(texts, " ", lambda t: " ".join(words(t))), " ")
    lists = pc.split_pattern(spaced, " ")
    size = np.where(pc.equal(spaced, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = pc.list_flatten(lists).dictionary_encode()
    h = word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.uint64)
    if (size == 0).any():  # an empty text was split into one empty word
        h = h[np.repeat(size > 0, np.maximum(size, 1))]
    return h, np.r_[0, np.cumsum(size)]


def batch_keys(texts: pa.Array) -> list[str | None]:
    """same_text_key() of each text."""
    texts = pc.fill_null(texts, "")
    fields = pc.match_substring(texts, ":")
    made = _lettered(pc.replace_with_mask(texts, fields, pa.scalar("", type=texts.type)), "", lambda t: same_text_key(t) or "").to_pylist()
    for i in np.flatnonzero(fields.to_numpy(zero_copy_only=False)):
        made[i] = same_text_key(texts[int(i)].as_py())
    return [k or None for k in made]


def batch_runs(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For all texts at once: all runs of n words, repeats too, as (index of the text, 64-bit hash), in text order."""
    h, ends = batch_words(texts)
    size = np.diff(ends)
    doc = np.repeat(np.arange(len(texts)), size)
    if not len(h):
        return doc, h
    k = len(h)
    out = np.zeros(k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[: k - i] = (out[: k - i] ^ h[i:]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    keep = np.ones(k, dtype=bool)
    for i in range(1, n):  # no run reaches over the end of its text
        at = ends[1:] - i
        keep[at[at >= ends[:-1]]] = False
    out, where = mix(out[keep]), doc[keep]
    if len(short := np.flatnonzero((size > 0) & (size < n))):
        out = np.concatenate([out, *(run_hashes(h[ends[i] : ends[i + 1]], n) for i in short)])
        where = np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    doc = where
    return doc, out


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What batch_runs() gave, sorted and each run once for each text."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], h[first]
