"""Problem 3: per-document text quality statistics, and which records are not natural prose.

Each text is described by STATS. Means and covariances of the statistics are estimated for each language from
all its texts, robustly: start from medians and median deviations over all texts, then re-estimate from the
texts within a given distance, twice, each time over all texts, as sums of products that are added up before
they are shuffled. A text's outlierness is its Mahalanobis distance to its language's prose; each statistic's
contribution is its share of the quadratic form. A language is what most of its common words say; texts
without any are held against the most frequent language, and languages of few texts are drawn towards it.
"""

from __future__ import annotations

import math
import re
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import residue
from .arrow import map_batches
from .forms import consistent_form
from .shared import kept

# Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die das und ist im in zu den mit von dem des auf für nicht wir ein eine einer eines einem einen nach zum zur als auch wer weil dass ob sich es am an aus bei bis durch hat haben wird werden wurde wurden war sind sie er ich nur noch nun wie aber oder so um über unter vor gegen ohne seit sobald statt weder zwischen darf müssen lassen kostet laut rund setzt fehlen warum daher dabei dennoch zugleich vielmehr immerhin schließlich inzwischen mittlerweile außerdem trotzdem deshalb allerdings andererseits überdies gleichwohl meine einige etliche viele manche zahlreiche fast alle kein keine sehr mehr schon".split(),
    "en": "the and of to in a is that for it on with as was by be are this at from or an which not have has were but they their its our every near we you he she his her had will would can".split(),
    "fr": "le la les des et du un une est dans que qui pour pas sur au avec ce il elle nous vous par plus sont ne se était".split(),
    "es": "el la los las de y que en un una es por con para no se del al lo como más pero sus su".split(),
    "it": "il lo la gli di e che un una è per con non si del della sono da al come più ma".split(),
    "nl": "de het een en van is dat op te zijn met voor niet aan er om ook als maar bij naar".split(),
}
_langs = tuple(FUNCTION_WORDS)
_lang_of: dict[str, tuple[int, ...]] = {}
for _i, _l in enumerate(_langs):
    for _w in FUNCTION_WORDS[_l]:  # one letter says nothing of a language: it may be a spelt-out word's
        if len(_w) > 1:
            _lang_of[_w] = (*_lang_of.get(_w, ()), _i)
_word = re.compile(r"[^\W_]+")
_vowel = re.compile("[aeiouyäöüáéíóúàèìòùâêîôûæøåаеиоуыэюя]", re.I)
_field = re.compile(r"(?:^|[\n;|])[\s;|]*[^\W\d_][\w-]{1,30}[ \t]*:\s+")

_marks = re.compile(r"\|LBR\||\[+[A-ZÄÖÜ_]{2,}\]+|https?://\S+|[@#]\w+")
_months = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_item = re.compile(rf"(?:^|[\s|])(?:[•*–·o-]|\(?\d{{1,3}}\)|\d{{1,3}}\.(?!\s(?:{_months}))|[a-z]\))(?=\s)", re.I)
_number_dot = re.compile(r"\d\.\s")
_cut = re.compile(rf"{_item.pattern}|\n", re.I)
_line_end = re.compile(r"[.!?…:;][)\]\"'“”»«]*$")
# Frequent German verb forms that don't end in t.
_verbs = frozenset("wurde wurden haben sind war waren werden wollen lassen müssen können sollen gehören halten fehlen entfielen blieben darf soll kann".split())

#: Statistics of a text as they are reported: plain counts and shares over the whole text.
PLAIN = ("words", "mean_word", "symbol_ratio", "line_end_share", "common_share")
#: What the distance is over: those (words as a logarithm), and shapes that tell prose from lists, tables and junk.
STATS = (
    "log_words", "mean_word", "sd_word", "symbols", "line_ends", "digits", "common", "common_run", "capital_run", "short_words",
    "repeat", "no_vowel", "separators", "grid", "items", "heads", "verbs", "function_gap", "odd_inside", "spaces",
)


#: Spread that each statistic is granted besides the measured one, as prose of other kinds than a corpus is made of
#: would have it: prose that is all alike in a statistic would else make an outlier of any other prose.
SPREAD = {
    "log_words": 0.5, "mean_word": 0.7, "sd_word": 0.7, "symbols": 0.04, "line_ends": 0.3, "digits": 0.14, "common": 0.06, "common_run": 0.08, "capital_run": 0.08, "short_words": 0.05,
    "repeat": 0.05, "no_vowel": 0.03, "separators": 0.04, "grid": 0.15, "items": 0.05, "heads": 0.2, "verbs": 0.012, "function_gap": 0.3, "odd_inside": 0.03, "spaces": 0.03,
}
_granted = np.diag(np.square([SPREAD[k] for k in STATS]))
#: Of these, more than the median never speaks against prose: a text may be long, and have many verbs and ends.
ONE_SIDED = tuple(STATS.index(k) for k in ("log_words", "line_ends", "verbs"))
SHORT_FIELD = 7


def _body(text: str) -> str:
    """A text of labelled fields without their names and without the short fields (up to SHORT_FIELD words), which
    are a record's head; where all fields are short it is a list of fields, and all of it counts."""
    heads = list(_field.finditer(text)) if text.count(":") > 1 else []
    if len(heads) < 2:
        return text
    cuts = [m.start() for m in heads] + [len(text)]
    parts = [text[m.end() : b] for m, b in zip(heads, cuts[1:])]
    long = [p for p in parts if len(p.split(None, SHORT_FIELD)) > SHORT_FIELD]
    return "\n".join([text[: cuts[0]], *long]).strip() if long else text


class _Words:
    """Facts of the words met so far, as columns: a word is looked at once, however often it stands in texts."""

    COLUMNS = ("size", "up", "caps", "langs", "no_vowel", "odd", "digits", "verb_t", "verb_en", "verb", "low")

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.lower: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, len(self.COLUMNS)), dtype=np.int32)

    def ids(self, words: list[str]) -> np.ndarray:
        at = self.at
        if len(at) > 300_000:
            self.__init__()
            at = self.at
        out = [at.get(w) for w in words]
        if None in out:
            for i, v in enumerate(out):
                if v is None:
                    w = words[i]
                    if (v := at.get(w)) is None:
                        v = at[w] = len(self.rows)
                        self.rows.append(self._facts(w))
                    out[i] = v
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], dtype=np.int32)])
        return np.array(out, dtype=np.int64)

    def fact(self, w: str) -> tuple:
        at = self.at.get(w)
        if at is None:
            at = self.at[w] = len(self.rows)
            self.rows.append(self._facts(w))
        return self.rows[at]

    def _facts(self, w: str) -> tuple:
        low = w.lower()
        bits = 0
        for i in _lang_of.get(low, ()):
            bits |= 1 << i
        digits = sum(map(str.isdigit, w))
        mute = len(low) > 3 and digits < len(w) and len(_vowel.findall(w)) < 0.2 * len(w)
        odd = len(w) > 1 and ((0 < digits < len(w)) or (w[1:] != low[1:] and not w.isupper()))
        verb = low in _verbs
        return (len(w), w[0].isupper(), len(w) > 1 and w.isupper(), bits, mute, odd, digits, verb or (len(low) > 2 and low[-1] == "t"), len(low) > 4 and low[-2:] == "en", verb, self.lower.setdefault(low, len(self.lower)))


_known = _Words()


def _runs(flag: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, length) of each run of neighbouring words of one text that all have the flag."""
    if not len(flag):
        return doc[:0], doc[:0]
    edge = np.flatnonzero(np.r_[True, (flag[1:] != flag[:-1]) | (doc[1:] != doc[:-1])])
    length = np.diff(np.r_[edge, len(flag)])
    on = flag[edge]
    return doc[edge][on], length[on]


def statistics(texts: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(language index or -1, PLAIN if asked for, STATS), a row for each text. Each text has a letter or digit."""
    k = len(texts)
    forms = [consistent_form(t) for t in texts]
    bodies = [_body(_marks.sub(" ", t) if "|" in t or "[" in t or "@" in t or "#" in t or "http" in t else t) for t in forms]
    found = [_word.findall(t) or ["-"] for t in bodies]
    n = np.array([len(w) for w in found])
    doc = np.repeat(np.arange(k), n)
    facts = dict(zip(_Words.COLUMNS, _known.table[ids].T)) if len(ids := _known.ids([w for ws in found for w in ws])) else {}
    count = lambda mask, w=None: np.bincount(doc[mask] if w is None else doc, weights=None if w is None else w, minlength=k)
    size = facts["size"].astype(np.float64)
    alnum = count(None, size)
    mean = alnum / n
    sd = np.sqrt(np.maximum(0.0, count(None, size * size) / n - mean * mean))
    by_lang = np.stack([count((facts["langs"] >> i) & 1 == 1) for i in range(len(_langs))])
    lang = by_lang.argmax(0)
    lang = np.where(by_lang.max(0) < np.maximum(2, 0.06 * n), -1, lang)
    up, caps = facts["up"] == 1, facts["caps"] == 1
    func = (facts["langs"] >> np.maximum(lang, 0)[doc]) & 1 == 1
    n_func, n_up = count(func), count(up)
    shout = (2 * count(up & func) > np.maximum(1, n_func)) | (count(caps) > 0.6 * n)
    loud = shout[doc]
    noun = up & ~func
    after = np.r_[False, noun[:-1] & (doc[1:] == doc[:-1])]  # the word before is a noun
    verb = (facts["verb"] == 1) | ((facts["verb_t"] == 1) & (loud | ~up)) | ((facts["verb_en"] == 1) & ~func & (loud | (n_up == 0)[doc] | (after & ~up)))
    total = lambda at, v: np.bincount(at, weights=v, minlength=k)
    at, length = _runs(func, doc)
    in_runs = total(at[length >= 6], length[length >= 6])
    at, length = _runs(up & ~loud, doc)
    in_caps = total(at[length >= 6], length[length >= 6])
    gap = np.zeros(k)
    at, length = _runs(~func, doc)
    np.maximum.at(gap, at, length)
    content = ~func & (facts["size"] > 4)
    different = np.unique(doc[content] * (1 << 32) + facts["low"][content])
    n_content = count(content)
    repeat = (n_content - np.bincount(different >> 32, minlength=k)) / np.maximum(1, n_content)
    chars = np.array([max(1, len(t)) for t in bodies], dtype=np.float64)
    spaces = np.array([len(t) - len("".join(t.split())) for t in bodies])
    cells = np.array([t.count("|") + t.count(";") + t.count("•") + t.count("=") for t in bodies])
    shapes = np.array([_shape(t, s) for t, s in zip(bodies, shout)])  # grid, items, heads, line ends
    share = lambda mask: count(mask) / n
    stats = np.column_stack([
        np.log(n), mean, sd, np.sqrt(np.maximum(0, chars - alnum - spaces) / chars), shapes[:, 3], np.sqrt(count(None, facts["digits"]) / np.maximum(1, alnum)), n_func / n,
        in_runs / n, in_caps / n, share(facts["size"] == 1), np.maximum(0.0, repeat - 0.15), share(facts["no_vowel"] == 1), cells / n, shapes[:, 0], shapes[:, 1] / n, shapes[:, 2],
        share(verb), np.log1p(gap), share(facts["odd"] == 1), spaces / chars,
    ])
    return lang, _plain(forms, lang) if plain else None, stats


def _plain(forms: list[str], lang: np.ndarray) -> np.ndarray:
    """PLAIN of each text, all of it."""
    out = np.zeros((len(forms), len(PLAIN)))
    for i, t in enumerate(forms):
        words = _word.findall(t)
        ids = _known.ids(words)
        alnum = sum(map(len, words))
        spaces = len(t) - sum(map(len, t.split()))
        lines = [x.rstrip() for x in t.splitlines() if x.strip()]
        common = int((((_known.table[ids, 3] >> max(int(lang[i]), 0)) & 1) == 1).sum()) if len(ids) else 0
        out[i] = len(words), alnum / max(1, len(words)), (len(t) - alnum - spaces) / max(1, len(t)), sum(_line_end.search(x) is not None for x in lines) / max(1, len(lines)), common / max(1, len(words))
    return out


def _may_have_items(t: str) -> bool:
    """Whether a list mark can stand in a text; quicker than to look for one."""
    return any([c in t for c in ")•*–·-"]) or " o" in t or "\no" in t or " O" in t or "\nO" in t or _number_dot.search(t) is not None or t[:1] in "oO" or "|o" in t


def _shape(t: str, shout: bool) -> tuple[float, float, float, float]:
    """(how alike the lines are in their numbers of cells, list marks, how many pieces begin with a noun, share of
    lines that end in punctuation) of a text."""
    grid = heads = 0.0
    breaks = t.count("\n")
    if breaks:
        lines = [x for x in (x.strip(" \t;|\r") for x in t.split("\n")) if x]
        ends = sum([1 for x in lines if _line_end.search(x)]) / max(1, len(lines))
        if breaks > 1:
            per_line = [x.count("\t") + x.count("|") + x.count(";") + x.count("   ") for x in lines]
            most = max(set(per_line), key=per_line.count) if len(per_line) > 2 else 0
            grid = max(0.0, 2 * per_line.count(most) / len(per_line) - 1) if most else 0.0
    else:
        ends = 1.0 if _line_end.search(t.rstrip()) else 0.0
    items = len(_item.findall(t)) if _may_have_items(t) else 0
    if not shout and items + breaks > 1:
        starts = [m.group() for x in _cut.split(t) if (m := _word.search(x)) and len(x) - m.end() > 2]
        if len(starts) > 2:
            first = [_known.fact(x) for x in starts]
            heads = max(0.0, 2 * sum([1 for f in first if f[1] and not f[3]]) / len(starts) - 1)
    return grid, items, heads, ends


def describe(df: DataFrame, id_col: str = "row_id", text_col: str = "text", plain: bool = False) -> DataFrame:
    """(row, lang, STATS, and with ``plain`` PLAIN with the prefix plain_) for each record whose text has a letter or
    digit. One row each."""
    src = df.select(F.col(id_col).cast("bigint"), F.col(text_col)).where(F.col(text_col).isNotNull())
    cols = [*STATS, *(f"plain_{k}" for k in PLAIN if plain)]

    def make():
        def fn(b: pa.RecordBatch) -> dict | None:
            texts = b.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if _word.search(t)]
            if not at:
                return None
            lang, more, x = statistics([texts[i] for i in at], plain)
            if plain:
                x = np.column_stack([x, more])
            return {"row": b.column(0).take(pa.array(at, type=pa.int64())), "lang": [_langs[i] if i >= 0 else "" for i in lang]} | {k: x[:, i] for i, k in enumerate(cols)}

        return fn

    return map_batches(src, make, "row bigint, lang string, " + ", ".join(f"{k} double" for k in cols))


def _moments(stats: DataFrame, centre: dict[str, dict], within: float) -> dict[str, dict]:
    """For each language: number, mean and covariance of the statistics of its texts within the given squared
    distance of its centre. Each batch adds up its own; a row for a batch and language is all that is shuffled,
    a row for a language all that is collected."""
    k = len(STATS)

    def make():
        def fn(b: pa.RecordBatch) -> dict | None:
            langs = np.array(b.column(0).to_pylist())
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            names, ns, s1, s2 = [], [], [], []
            for lang in np.unique(langs):
                y = _clipped(x[langs == lang], centre[lang])
                y = y[_distance(y, centre[lang])[0] <= within]
                names.append(str(lang))
                ns.append(len(y))
                s1.append(y.sum(0).tolist())
                s2.append((y.T @ y).ravel().tolist())
            return {"lang": names, "n": ns, "s1": s1, "s2": s2} if names else None

        return fn

    sums = map_batches(stats.select("lang", *STATS), make, "lang string, n bigint, s1 array<double>, s2 array<double>")
    long = sums.select("lang", "n", F.posexplode(F.concat("s1", "s2")).alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    out: dict[str, dict] = {}
    for r in long.groupBy("lang").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).toLocalIterator():
        v = np.array([x.v for x in r.v])
        if r.n:
            mean = v[:k] / r.n
            out[r.lang] = {"n": r.n, "mean": mean, "cov": v[k:].reshape(k, k) / r.n - np.outer(mean, mean)}
    return out


def _clipped(x: np.ndarray, c: dict) -> np.ndarray:
    """x with the ONE_SIDED statistics at most at the median of the language."""
    x = x.copy()
    for i in ONE_SIDED:
        np.minimum(x[:, i], c["median"][i], out=x[:, i])
    return x


def _distance(x: np.ndarray, c: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared Mahalanobis distances of clipped x, and what each statistic contributes to them."""
    z = x - c["mean"]
    parts = z * (z @ c["inverse"])
    return parts.sum(1), parts


def _shrunk(m: dict[str, dict], medians: dict[str, np.ndarray], main: str) -> dict[str, dict]:
    """Each language's centre, drawn towards the most frequent language's as if that gave as many texts as a
    covariance has entries; a language of few texts is so held against the main one, one of many against itself."""
    few = len(STATS) * (len(STATS) + 1) / 2
    out, top = {}, m[main]
    for lang, v in m.items():
        w = 1.0 if lang == main else v["n"] / (v["n"] + few)
        cov = w * v["cov"] + (1 - w) * top["cov"]
        out[lang] = {"n": v["n"], "mean": w * v["mean"] + (1 - w) * top["mean"], "cov": cov, "median": w * medians[lang] + (1 - w) * medians[main], "inverse": np.linalg.inv(cov + _granted)}
    return out


def prose_model(stats: DataFrame, within: float = 60.0, rounds: int = 2) -> dict[str, dict]:
    """Robust centre for each language, and under "" (texts of no known language) that of the most frequent one.

    The start is the median and the median deviation of each statistic (percentile_approx over all texts);
    then mean and covariance of the texts within, re-estimated ``rounds`` times, each time over all texts.
    """
    known = stats.where("lang <> ''")
    mid = {r.lang: r for r in known.groupBy("lang").agg(F.count("*").alias("n"), *(F.percentile_approx(c, 0.5, 1000).alias(c) for c in STATS)).collect()}
    if not mid:
        return {}
    medians = {x: np.array([r[c] for c in STATS], dtype=float) for x, r in mid.items()}
    centre_of = F.create_map(*(y for x, v in medians.items() for y in (F.lit(x), F.array(*(F.lit(float(u)) for u in v)))))
    off = known.withColumn("_mid", centre_of[F.col("lang")]).select("lang", *(F.abs(F.col(c) - F.col("_mid")[i]).alias(c) for i, c in enumerate(STATS)))
    mad = {r[0]: np.array(r[1:], dtype=float) for r in off.groupBy("lang").agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in STATS)).collect()}
    main = max(mid, key=lambda x: (mid[x].n, x))
    start = {x: {"n": mid[x].n, "mean": medians[x], "cov": np.diag(np.square(1.4826 * mad[x]))} for x in mid}
    centre = _shrunk(start, medians, main)
    for _ in range(rounds):
        got = _moments(known, centre, within)
        if main not in got:
            break
        centre = _shrunk({x: got.get(x, {"n": 0, "mean": medians[main], "cov": got[main]["cov"]}) for x in centre}, medians, main)
    centre[""] = centre[main]
    return centre


def outlierness(stats: DataFrame, centre: dict[str, dict]) -> DataFrame:
    """(row, lang, distance, contributions): the squared Mahalanobis distance, and a map from statistic to its part
    of it. Without a centre (no text of any known language) every distance is infinite: nothing shows prose."""

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            langs = b.column(1).to_pylist()
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]])
            d, parts = np.full(len(x), np.inf), np.zeros_like(x)
            key = np.array([v if v in centre else "" for v in langs])
            for v in np.unique(key):
                if v in centre:
                    d[key == v], parts[key == v] = _distance(_clipped(x[key == v], centre[v]), centre[v])
            return {"row": b.column(0), "lang": b.column(1), "distance": d, "parts": parts.tolist()}

        return fn

    made = map_batches(stats.select("row", "lang", *STATS), make, "row bigint, lang string, distance double, parts array<double>")
    names = F.array(*(F.lit(c) for c in STATS))
    return made.select("row", "lang", "distance", F.map_from_arrays(names, "parts").alias("contributions"))


def chi_square_point(share: float = 0.95, free: int = len(STATS)) -> float:
    """The value below which the given share of a chi-square distribution lies (cube-root approximation)."""
    z, a = NormalDist().inv_cdf(share), 2 / (9 * free)
    return free * (1 - a + z * math.sqrt(a)) ** 3


def quality(df: DataFrame, id_col: str = "row_id", text_col: str = "text", **how) -> DataFrame:
    """(row_id, lang, PLAIN, STATS, distance, contributions): one row for each record whose text has a letter or
    digit. PLAIN, with the prefix plain_, is over the whole text, unclipped: words, mean word length, share of symbols, of lines
    that end in punctuation, and of common words."""
    stats = kept(describe(df, id_col, text_col, plain=True))
    out = outlierness(stats, prose_model(stats, **how))
    return stats.join(out.drop("lang"), "row").withColumnRenamed("row", "row_id")


def found(df: DataFrame, id_col: str = "row_id", text_col: str = "text", share: float = 0.95, **how) -> DataFrame:
    """p3_found: (row_id) of the records with a text whose squared distance is above the point of the chi-square
    distribution below which the given share of prose lies, or which have no letter or digit at all (but some
    sign); the cases of problem 1 are left out. Null and blank texts are none."""
    stats = kept(describe(df, id_col, text_col))
    far = outlierness(stats, prose_model(stats, **how)).where(F.col("distance") > chi_square_point(share)).select("row")
    signs = df.where(F.col(text_col).rlike(r"\S") & ~F.col(text_col).rlike(r"[\p{L}\p{N}]")).select(F.col(id_col).cast("bigint").alias("row"))
    return far.unionByName(signs).join(residue.found(df, id_col=id_col, text_col=text_col).withColumnRenamed("row_id", "row"), "row", "left_anti").select(F.col("row").alias("row_id"))
