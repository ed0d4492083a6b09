"""Problem 8: evaluation texts leaking into training text.

Wu-Manber multi-pattern search over words. The patterns are all runs of ``run`` consecutive words of the
items; all have the same length. Blocks are pairs of neighbouring words: the shift table says how far the
window may move on when its last pair is this one, which for a pair of no pattern is the whole window but
one word. Where the shift is zero, the bucket of the patterns ending in that pair is narrowed by its first
pair, and the words are compared. Most positions of most documents are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .forms import words


class WuManber:
    """Finds which owners' patterns (runs of ``run`` words) stand in a list of words."""

    def __init__(self, items: Iterable[tuple[int, str | None]], run: int):
        if run < 2:
            raise ValueError("a pattern has two words at least")
        self.run, self.shift = run, {}
        self.buckets: dict[tuple, dict[tuple, dict[tuple, set]]] = {}  # last pair, first pair, pattern, owners
        for owner, text in items:
            ws = words(text)
            for i in range(len(ws) - run + 1):
                p = tuple(ws[i : i + run])
                self.buckets.setdefault(p[-2:], {}).setdefault(p[:2], {}).setdefault(p, set()).add(owner)
                for j in range(run - 1):
                    block, far = p[j : j + 2], run - 2 - j
                    if far < self.shift.get(block, run - 1):
                        self.shift[block] = far

    def search(self, ws: list[str]) -> set[int]:
        found: set[int] = set()
        run, get, far, at, n = self.run, self.shift.get, self.run - 1, self.run - 1, len(ws)
        while at < n:
            pair = (ws[at - 1], ws[at])
            step = get(pair, far)
            if step:
                at += step
                continue
            a = at - run + 1
            patterns = self.buckets[pair].get((ws[a], ws[a + 1]))
            if patterns and (owners := patterns.get(tuple(ws[a : at + 1]))):
                found |= owners
            at += 1
        return found


def leaked(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", run: int = 12, block_chars: int = 32 << 20) -> DataFrame:
    """p8_found: (doc_id, item_id): documents with at least ``run`` consecutive words of the item, whatever
    stands between the words but letters and digits. Null and blank texts, and items of fewer words, match
    nothing. The items are a stated query set: they go to the tasks in blocks of up to block_chars characters
    (one item at least), so that what is broadcast, and a task's tables, are bounded however many items there
    are; the documents are read once for each block, so once for evaluation sets of any usual size."""
    rows = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"\S"))
    docs = documents.select(F.col(doc_col).cast("bigint").alias("d"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"\S"))
    sc = documents.sparkSession.sparkContext

    def one(block: list) -> DataFrame:
        sent = sc.broadcast(block)

        def make():
            finder = WuManber(sent.value, run)

            def fn(b: pa.RecordBatch) -> dict:
                d, i = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item in sorted(finder.search(words(text))):
                        d.append(doc)
                        i.append(item)
                return {"doc_id": d, "item_id": i}

            return fn

        return map_batches(docs, make, "doc_id bigint, item_id bigint")

    out, block, chars = None, [], 0
    for r in rows.toLocalIterator():
        if block and chars + len(r.t) > block_chars:
            out, block, chars = (one(block) if out is None else out.unionByName(one(block))), [], 0
        block.append((r.i, r.t))
        chars += len(r.t)
    if block or out is None:
        out = one(block) if out is None else out.unionByName(one(block))
    return out.distinct()
