"""Problem 2: one consistent form for text that looks the same in different characters.

Vocabulary tries are traversed with a weighted edit automaton. The vocabulary is every token of the corpus
that is written in plain characters; a token with an odd character is looked up in it. The automaton's
edits of zero cost are: a look-alike, full-width form or ligature for its plain spelling, a base letter and
a combining mark for the composed letter, and an ignorable character for nothing. Some characters resemble more
than they equal a Latin letter (``MAYBE``): one costs 1, only within a token that has a plain Latin letter too,
and up to ``BOUND`` in all. Every other edit costs more than the bound, so a state is a node of the trie, a
place in the token and a cost. Of several hits the cheapest is taken, then the most frequent spelling, then the
smallest; tokens without any are brought to the consistent form by table.

No edit changes a token's skeleton, which has for each letter the one that it may stand for; the tries are
sharded by the skeleton's hash, into as many shards as the counted vocabulary needs, so that none grows with
the corpus and none is larger for a frequent beginning. Only texts with an odd character are taken apart; all
others are their own consistent form.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .forms import IGNORABLES, JOINER, SUSPECT, _table, consistent_form
from .shared import cut, kept, released, restricted

# Characters that look like a Latin letter in some fonts and words only.
MAYBE = {"α": "a", "β": "ß", "ε": "e", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "и": "u", "к": "k", "п": "n", "т": "m", "г": "r", "в": "b", "м": "m", "н": "h"}
_maybe_table = {ord(a): b for a, b in MAYBE.items()}
_token = re.compile(rf"[\w\u0300-\u036f{IGNORABLES}{JOINER}]+")
_odd = re.compile(f"[{SUSPECT[1:-1]}{''.join(MAYBE)}]")
_plain_letter = re.compile("[A-Za-zÄÖÜäöüß]")
_marks = re.compile(r"[\u0300-\u036f]")
#: The most that MAYBE letters of a token may cost, and how many words a shard's trie holds, about.
BOUND, SHARD_WORDS = 4, 50_000


def _is_odd(text: str) -> bool:
    return _odd.search(text) is not None or not unicodedata.is_normalized("NFC", text)


class Trie:
    """Vocabulary of one shard; each word ends in its number of occurrences."""

    def __init__(self, words: list[tuple[str, int]]):
        self.root: dict = {}
        for w, n in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = n

    def lookup(self, token: str) -> str | None:
        """The word that the token can be turned into at the least cost, of equal ones the most frequent."""
        mixed = _plain_letter.search(token) is not None
        states = {"": (self.root, 0)}  # spelling so far -> node (None: not in the trie, but a mark may come), cost
        for c in token:
            nxt: dict = {}
            if (plain := _table.get(ord(c), c)) is not None:
                plain = unicodedata.normalize("NFC", plain)
            ways = {c: 0} if plain is None or plain == c else {c: 0, plain: 0}
            if plain is None or c == JOINER:  # an ignorable: no step in the trie
                ways = {"": 0} if plain is None else {c: 0, "": 0}
            if mixed and c in MAYBE:
                ways.setdefault(MAYBE[c], 1)
            for said, (node, cost) in states.items():
                steps = [(said + w, here, cost + more) for w, more in ways.items() if (here := self._step(node, w)) is not None or w == plain]
                if _marks.match(c) and said:  # composes with the letter before
                    whole = unicodedata.normalize("NFC", said + c)
                    steps.append((whole, self._step(self.root, whole), cost))
                for way in steps:
                    if way[2] <= BOUND and (way[0] not in nxt or way[2] < nxt[way[0]][1]):
                        nxt[way[0]] = way[1:]
            states = nxt
        hits = [(cost, -node[""], said) for said, (node, cost) in states.items() if node is not None and "" in node]
        return min(hits)[2] if hits else None

    @staticmethod
    def _step(node: dict | None, letters: str) -> dict | None:
        for x in letters:
            if node is None:
                break
            node = node.get(x)
        return node


def skeleton(token: str) -> str:
    """The token's form by table, MAYBE letters replaced too: what all spellings that edits lead to have in common."""
    return unicodedata.normalize("NFC", consistent_form(token).replace(JOINER, "").translate(_maybe_table))


def _place(token: str) -> int:
    return xxhash.xxh3_64_intdigest(skeleton(token).encode("utf-8", "surrogatepass")) >> 2


def vocabulary(texts: DataFrame) -> DataFrame:
    """(place, word, n): the plain tokens of column ``text`` and how often they stand there; place: hash of the
    skeleton."""

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            seen: dict[str, int] = {}
            for t in b.column(0).to_pylist():
                if t:
                    for w in _token.findall(t):
                        seen[w] = seen.get(w, 0) + 1
            plain = [(w, n) for w, n in seen.items() if not _is_odd(w)]
            return {"place": [_place(w) for w, _ in plain], "word": [w for w, _ in plain], "n": [n for _, n in plain]}

        return fn

    return map_batches(texts.select("text"), make, "place bigint, word string, n bigint").groupBy("place", "word").agg(F.sum("n").alias("n"))


def odd_tokens(texts: DataFrame) -> DataFrame:
    """(place, row, field, token): the different odd tokens of each text (row, field, text)."""

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            out: dict = {"place": [], "row": [], "field": [], "token": []}
            for row, field, t in zip(*(c.to_pylist() for c in b.columns)):
                for w in {w for w in _token.findall(t) if _is_odd(w)}:
                    for k, v in zip(out, (_place(w), row, field, w)):
                        out[k].append(v)
            return out

        return fn

    return map_batches(texts.select("row", "field", "text"), make, "place bigint, row bigint, field string, token string")


def lookups(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, spelling): the tokens (place, token) that are found in the tries of vocab. A task builds the trie of
    one shard at a time."""
    words = kept(vocab)
    shards = max(1, -(-words.count() // SHARD_WORDS))
    here = lambda df: df.withColumn("shard", F.pmod("place", F.lit(shards)))

    def look(known: pd.DataFrame, odd: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(list(zip(known["word"], known["n"])))
        hits = {t: trie.lookup(t) for t in odd["token"]}
        return pd.DataFrame([(t, h) for t, h in hits.items() if h is not None], columns=["token", "spelling"])

    found = here(words).groupBy("shard").cogroup(here(tokens.select("place", "token").distinct()).groupBy("shard")).applyInPandas(look, "token string, spelling string")
    found = kept(found)
    found.count()
    released(words)
    return found


def spellings(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row, field, spelling MAP): for each odd text (row, field, text) its odd tokens found in the vocabulary
    and their canonical spellings."""
    tokens = kept(odd_tokens(texts))
    pairs = tokens.join(lookups(vocab, tokens), "token").select("row", "field", F.struct("token", "spelling").alias("s"))
    return pairs.groupBy("row", "field").agg(F.map_from_entries(F.collect_set("s")).alias("spelling"))


def decisions(df: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("text", "source")) -> DataFrame:
    """(field, way, n_tokens, n_places): how many different odd tokens, and how many places of records, are spelt by the
    tries ("trie") and by the table ("table")."""
    every = df.select(F.col(id_col).cast("bigint").alias("row"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x")).select("row", "x.field", "x.text").where("text is not null")
    tokens = kept(odd_tokens(every))
    ways = tokens.join(lookups(vocabulary(every), tokens).withColumn("way", F.lit("trie")), "token", "left").withColumn("way", F.coalesce("way", F.lit("table")))
    return ways.groupBy("field", "way").agg(F.countDistinct("token").alias("n_tokens"), F.count("*").alias("n_places"))


def odd_forms(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(row, and for each field i its consistent form ci) of the rows of which a field has an odd character."""
    kinds = dict(df.dtypes)
    rows = df.select(F.col(id_col).cast("bigint").alias("row"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    assert all(kinds[f] == "string" for f in fields)

    def pick():
        def fn(b: pa.RecordBatch) -> dict:
            cols = [c.to_pylist() for c in b.columns[1:]]
            at = [k for k, values in enumerate(zip(*cols)) if any(v is not None and _is_odd(v) for v in values)]
            took = b.take(pa.array(at, type=pa.int64()))
            return {n: took.column(i) for i, n in enumerate(("row", *(f"f{i}" for i in range(len(fields)))))}

        return fn

    odd = kept(map_batches(rows, pick, "row bigint" + "".join(f", f{i} string" for i in range(len(fields)))))
    stacked = F.explode(F.array(*(F.struct(F.lit(f"f{i}").alias("field"), F.col(f"f{i}").alias("text")) for i in range(len(fields)))))
    texts = odd.select("row", stacked.alias("x")).select("row", "x.field", "x.text").where(F.col("text").isNotNull())
    every = rows.select(F.explode(F.array(*(f"f{i}" for i in range(len(fields))))).alias("text")) if len(fields) > 1 else rows.select(F.col("f0").alias("text"))
    maps = spellings(texts, vocabulary(every))
    wide = maps.groupBy("row").agg(*(F.first(F.when(F.col("field") == f"f{i}", F.col("spelling")), ignorenulls=True).alias(f"m{i}") for i in range(len(fields))))
    cols = [c for i in range(len(fields)) for c in (f"f{i}", f"m{i}")]

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            out: dict = {"row": b.column(0)}
            for i in range(len(fields)):
                texts, maps = b.column(1 + 2 * i).to_pylist(), b.column(2 + 2 * i).to_pylist()
                out[f"c{i}"] = [None if t is None else apply(t, dict(m or ())) for t, m in zip(texts, maps)]
            return out

        return fn

    return kept(map_batches(odd.join(wide, "row", "left").select("row", *cols), make, "row bigint" + "".join(f", c{i} string" for i in range(len(fields)))))


def consistent(df: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("text", "source")) -> DataFrame:
    """(row, and the fields in their consistent form): one row for each row of df. Null fields stay null, empty
    texts empty. Ids are BIGINT and unique."""
    odd = odd_forms(df, id_col, fields)
    rows = df.select(F.col(id_col).cast("bigint").alias("row"), *fields)
    return restricted(rows, odd.select("row"), "left_anti").unionByName(odd.select("row", *(F.col(f"c{i}").alias(f) for i, f in enumerate(fields))))


def apply(text: str, spelling: dict[str, str]) -> str:
    """The text with its odd tokens in their canonical spellings, and all else in the consistent form by table."""
    if spelling:
        text = _token.sub(lambda m: spelling.get(m.group(), m.group()), text)
    return consistent_form(text)


def found(df: DataFrame) -> DataFrame:
    """p2_found: (row_id_a, row_id_b), smaller first: records whose consistent forms of text and of source are
    equal while the stored text or source differs. Null and blank texts and null sources match nothing.

    Two records of which neither has a suspect character differ as stored only if their forms differ, so one
    of each pair is odd: the odd records' forms, few, are what all forms are compared with, by two 64-bit
    hashes; clean records of the same form are equal as stored, and each is a pair with each odd one."""
    two = lambda *c: (F.xxhash64(*c), F.xxhash64(F.lit(1), *c))
    forms = odd_forms(df, "row_id", ("text", "source")).where(F.col("c1").isNotNull() & F.col("c0").rlike(r"\S"))
    h1, h2 = two("c0", "c1")
    forms = forms.select("row", h1.alias("h1"), h2.alias("h2"))
    s1, s2 = two("text", "source")
    stored = df.where(F.col("source").isNotNull() & F.col("text").rlike(r"\S")).select(F.col("row_id").cast("bigint").alias("row"), s1.alias("s1"), s2.alias("s2"))
    ids = kept(forms.select("row"))
    odd = cut(forms.join(restricted(stored, ids), "row"))
    clean = restricted(stored, ids, "left_anti").select(F.col("row").alias("b"), F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    other = clean.unionByName(odd.select(F.col("row").alias("b"), "h1", "h2", F.col("s1").alias("t1"), F.col("s2").alias("t2")))
    pairs = odd.withColumnRenamed("row", "a").join(other, ["h1", "h2"]).where((F.col("a") != F.col("b")) & ((F.col("s1") != F.col("t1")) | (F.col("s2") != F.col("t2"))))
    return pairs.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b")).distinct()
