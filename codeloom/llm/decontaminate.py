"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space is made single blanks. An item of L characters may stand in a
text with up to k = ceil(L * RATE) edits. It is split into k + 1 pieces: k edits leave one piece whole at least, so every
occurrence holds an exact piece. An Aho-Corasick automaton finds all pieces of all items in one walk over a text; around
each hit, Myers' bit-parallel algorithm gives the smallest edit distance of the whole item.

The items are a stated query set: they are read in blocks of at most BLOCK_CHARS characters, and each block is held
against all rows, so there may be any number of them.

Defined cases: a null or empty text holds nothing; null, empty or white items match nothing; items that are equal after
normalisation are all reported; repeated rows give repeated results; texts of any length are searched whole; an empty table
on either side gives an empty result; other columns are not read by find() and are kept by clean().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import slices

#: Edits allowed for each character of an item.
RATE = 0.06
#: Characters of items that one automaton holds.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return min(max(0, length - 1), math.ceil(length * rate))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places; none is empty as k is less than the length."""
    cut = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of an item of m characters to a substring of text, and where the first such ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans in order of their starts."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Matcher:
    """One block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        by: dict[str, list[int]] = {}
        for item_id, text in items:
            if t := normal(text or ""):
                by.setdefault(t, []).append(item_id)
        self.items = [(t, ids, budget(len(t), rate), masks(t)) for t, ids in sorted(by.items())]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (t, _, k, _) in enumerate(self.items):
            for at, piece in pieces(t, k):
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """For each item in text: the smallest distance and the place in the normalised text where it ends."""
        if not text or not self.items:
            return {}
        t = normal(text)
        windows: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(t):
            for i, at in where:
                windows.setdefault(i, []).append(end - size + 1 - at)
        out: dict[int, tuple[int, int]] = {}
        for i, starts in windows.items():
            item, ids, k, peq = self.items[i]
            # The item begins within k of where the piece puts it, and is at most k longer. Places that overlap are walked once.
            best = None
            for a, b in _merged([(max(0, s - k), s + len(item) + 2 * k) for s in sorted(set(starts))]):
                distance, end = myers(peq, len(item), t[a:b])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, a + end)
                if best and best[0] == 0:
                    break
            if best:
                out |= dict.fromkeys(ids, best)
        return out


def blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks that are fetched one after another."""
    block, size = [], 0
    for r in items.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame, rate: float = RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, ends: every item that a document holds within its budget."""
    schema = "doc_id long, item_id long, distance int, ends long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in slices(batches):
                rows = [(d, i, *x) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, x in sorted(matcher.find(text).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "distance", "ends"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold an item within its budget; all columns stay."""
    at = docs.columns.index("text")
    for block in blocks(items, chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in slices(batches):
                yield b.filter(pa.array([not matcher.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
