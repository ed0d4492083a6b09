"""Problem 7: long stretches that stand word for word in other records too.

Paragraph MinHash banding, with every window of ``span`` characters as a paragraph. The MinHash of such a
paragraph is the smallest hash of the runs of ``gram`` characters in it; two equal paragraphs have equal
MinHashes, so one band of one row finds every pair of them: recall is 1 for what is asked, exact spans of at
least ``span`` characters, also where they begin and end within lines. Neighbouring paragraphs mostly share
their smallest run, so a text of L characters has about 2 L / (span - gram + 1) different (MinHash,
position), which are what is joined. A collision is verified on the characters: the two texts agree around
the run over at least ``span`` characters.

Surroundings of a run that are equal as stored are collapsed before. Where more than ``pairwise`` different ones share a
run, pairs would grow as the square; there the paragraphs around the run are themselves compared by 128-bit hash,
every one of them, which is linear in the texts and finds the same characters; only the record named as the
other one is the smallest there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .forms import mix
from .groups import components
from .shared import kept, restricted

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


def gram_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters from each place (len - k + 1 of them), equal for equal characters."""
    with np.errstate(over="ignore"):
        n = len(chars)
        up, down = _powers(BASE, n), _powers(INVERSE, n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, in time independent of w (block minima from both sides)."""
    n = len(h)
    pad = -n % w
    full = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _last_equal(h: np.ndarray, low: np.ndarray, w: int) -> np.ndarray:
    """The last place of the smallest of each w neighbours; low: what _window_min() gave."""
    place = np.empty(len(low), dtype=np.int64)
    for a in range(0, len(low), 1 << 14):
        view = np.lib.stride_tricks.sliding_window_view(h[a : a + (1 << 14) + w - 1], w)
        place[a : a + len(view)] = np.arange(a, a + len(view)) + w - 1 - view[:, ::-1].argmin(axis=1)
    return place


def minhashes(texts: list[str], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, MinHash, place of its run): the different MinHashes of all windows of span characters.
    Shorter texts have none."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    size = np.array([len(c) for c in codes])
    long = np.flatnonzero(size >= span)
    none = np.zeros(0, dtype=np.int64)
    if not len(long):
        return none, none.astype(np.uint64), none
    start = np.r_[0, np.cumsum(size[long])]
    h = gram_hashes(np.concatenate([codes[i] for i in long]), gram)
    doc = np.repeat(np.arange(len(long)), size[long])
    low = _window_min(h, span - gram + 1)  # of the window from each place
    ok = np.arange(len(low)) + span <= start[doc[: len(low)] + 1]
    # Where in each window the smallest run stands, the last of equal ones: a place is emitted whenever it changes.
    w = span - gram + 1
    place = _last_equal(h, low, w)
    new = ok.copy()
    new[1:] &= (place[1:] != place[:-1]) | (doc[1 : len(low)] != doc[: len(low) - 1]) | ~ok[:-1]
    at = np.flatnonzero(new)
    place = place[at]
    d = doc[at]
    return long[d], low[at], place - start[d]


def occurrences(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(h, row, place): each MinHash of each text (row, text), and where its run begins."""

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            doc, h, place = minhashes(b.column(1).to_pylist(), span, gram)
            return {"h": h.view(np.int64), "row": b.column(0).to_numpy(zero_copy_only=False)[doc], "place": place}

        return fn

    return map_batches(texts.select("row", "text"), make, "h bigint, row bigint, place bigint")


def _around(texts: DataFrame, shared: DataFrame, span: int, gram: int) -> DataFrame:
    """(h, dig, row, place, before, around): for each shared occurrence the characters that a span over its
    run can reach, their digest, and how many of them come before the run."""
    lists = shared.groupBy("row").agg(F.collect_list(F.struct("h", "place")).alias("at"))
    reach = span - gram

    def make():
        def fn(b: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("h", "dig", "row", "place", "before", "around")}
            for row, text, at in zip(*(c.to_pylist() for c in b.columns)):
                for x in at:
                    p = x["place"]
                    a = max(0, p - reach)
                    piece = text[a : p + gram + reach]
                    for k, v in zip(out, (x["h"], xxhash.xxh3_128_digest(piece.encode("utf-8", "surrogatepass")), row, p, p - a, piece)):
                        out[k].append(v)
            return out

        return fn

    lists = kept(lists)
    both = restricted(texts, lists.select("row")).join(lists, "row").select("row", "text", "at")
    return map_batches(both, make, "h bigint, dig binary, row bigint, place bigint, before bigint, around string")


def _agree(a: np.ndarray, i: int, b: np.ndarray, j: int, gram: int) -> tuple[int, int]:
    """How many characters before and from the runs at i and j agree, the run included."""
    n = min(i, j)
    d = np.flatnonzero(a[i - n : i][::-1] != b[j - n : j][::-1])
    back = int(d[0]) if len(d) else n
    m = min(len(a) - i, len(b) - j)
    d = np.flatnonzero(a[i : i + m] != b[j : j + m])
    return back, int(d[0]) if len(d) else m


def _matches(pieces: DataFrame, span: int, gram: int, pairwise: int) -> DataFrame:
    """From the different pieces (h, n, dig, row, before, around), sorted by h, n of them with this h: (h, dig,
    a, b, other, w1, w2), the verified agreements with another piece as from a to b relative to the run and
    the row of the other. Where n > pairwise, in place of ``other`` the hashes w1, w2 of each window."""

    def run(batches):
        names = ("h", "dig", "a", "b", "other", "w1", "w2")
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        group, key, out = [], None, []
        code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

        def ended():
            for x, (dx, rx, bx, cx) in enumerate(group):
                for dy, ry, by, cy in group[:x]:
                    back, on = _agree(cx, bx, cy, by, gram)
                    if on >= gram and back + on >= span:
                        out.append((key, dx, -back, on, ry, None, None))
                        out.append((key, dy, -back, on, rx, None, None))
            group.clear()

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=list(names))
            out.clear()
            return made

        for b in batches:
            for h, n, dig, row, before, around in zip(*(c.to_pylist() for c in b.columns)):
                if h != key:
                    ended()
                    key = h
                if n <= pairwise:
                    group.append((dig, row, before, code(around)))
                else:
                    for a in range(max(0, before + gram - span), min(before, len(around) - span) + 1):
                        w = xxhash.xxh3_128_digest(around[a : a + span].encode("utf-8", "surrogatepass"))
                        out.append((h, dig, a - before, a - before + span, None, int.from_bytes(w[:8], "big", signed=True), int.from_bytes(w[8:], "big", signed=True)))
                if len(out) > 8000:
                    yield batch()
        ended()
        if out:
            yield batch()

    src = pieces.select("h", "n", "dig", "row", "before", "around")
    return src.mapInArrow(run, "h bigint, dig binary, a bigint, b bigint, other bigint, w1 bigint, w2 bigint")


def shared_spans(df: DataFrame, id_col: str = "row_id", text_col: str = "text", span: int = 160, gram: int = 60, pairwise: int = 24) -> DataFrame:
    """(row, other, begin, end): stretches of a record's text as stored, of at least span characters, that
    stand in the other record too. A record has at least one row here for each of its characters that any
    such stretch holds, though not one for every other record: of records with equal surroundings of a run
    the smallest stands for all. Null, blank and shorter texts have none."""
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text")).where((F.length("text") >= span) & F.col("text").rlike(r"\S"))
    occ = kept(occurrences(texts, span, gram))
    occ.count()  # made here once; the two sides of the join would each make it
    # Runs of two texts at least: counted with partial sums, and joined back, where a run of many texts is split by
    # the adaptive join. No task holds all texts of a run.
    common = occ.groupBy("h").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("h")
    members = kept(_around(texts, occ.join(common, "h").select("h", "row", "place"), span, gram))
    pieces = kept(members.groupBy("h", "dig").agg(F.min("row").alias("row"), F.max("row").alias("last"), F.first("before").alias("before"), F.first("around").alias("around")))
    counts = kept(pieces.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    n = F.col("n")
    few = pieces.join(counts.where(n <= pairwise), "h").repartition(n_parts, "h").sortWithinPartitions("h")
    many = pieces.join(counts.where(n > pairwise), "h")  # piece by piece: in any task
    one = _matches(few, span, gram, pairwise).select("h", "dig", "a", "b", "other")
    wide = kept(_matches(many, span, gram, pairwise))
    ends = wide.join(pieces.select("h", "dig", "row"), ["h", "dig"]).groupBy("w1", "w2").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    hot = wide.join(ends, ["w1", "w2"]).select("h", "dig", "a", "b", F.col("lo").alias("other"))
    same = pieces.where("row < last").select("h", "dig", (-F.col("before")).alias("a"), (F.length("around") - F.col("before")).alias("b"), F.col("row").alias("other"))
    rel = one.unionByName(hot).unionByName(same)
    return members.select("h", "dig", "row", "place").join(rel, ["h", "dig"]).select("row", "other", (F.col("place") + F.col("a")).alias("begin"), (F.col("place") + F.col("b")).alias("end"))


def found(df: DataFrame, **how) -> DataFrame:
    """p7_found: (row_id) of the records with a stretch of at least 160 characters found in another."""
    return shared_spans(df, **how).select(F.col("row").alias("row_id")).distinct()


def coverage(df: DataFrame, id_col: str = "row_id", text_col: str = "text", **how) -> DataFrame:
    """(row_id, n_chars, shared_chars, share, cluster_id) for each record with a text: how many of its
    characters stand in stretches found elsewhere, and the smallest row_id of those it is connected with by
    such stretches (its own where there is none). Characters are code points."""
    spans = kept(shared_spans(df, id_col, text_col, **how))
    merged = "aggregate(array_sort(collect_set(struct(begin, end))), struct(0L as n, 0L as upto), (s, x) -> struct(s.n + greatest(0L, x.end - greatest(x.begin, s.upto)) as n, greatest(s.upto, x.end) as upto), s -> s.n)"
    shared = spans.groupBy("row").agg(F.expr(merged).alias("shared_chars"))
    top = components(spans.where("row <> other").select(F.col("row").alias("a"), F.col("other").alias("b")).distinct())
    texts = df.select(F.col(id_col).cast("bigint").alias("row"), F.length(text_col).cast("bigint").alias("n_chars")).where(F.col("n_chars") > 0)
    out = texts.join(shared, "row", "left").join(top.withColumnRenamed("node", "row"), "row", "left")
    n = F.coalesce("shared_chars", F.lit(0))
    return out.select(F.col("row").alias("row_id"), "n_chars", n.cast("bigint").alias("shared_chars"), F.round(n / F.col("n_chars"), 6).alias("share"), F.coalesce("component", "row").alias("cluster_id"))
