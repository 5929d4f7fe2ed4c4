"""Sharding of indivisible groups by best-fit-decreasing bin packing.

Documents with equal texts are one group and never part. A group's size is that of its documents: UTF-8 bytes of the text
and OVERHEAD each.

1. Groups of at least 1/FINE of a shard are units of their own; by their size there are at most FINE a shard. Smaller groups
   are joined to bundles by a hash of their digest, about FINE bundles a shard. So the number of units follows the number of
   shards and not the number of documents, and a document finds its unit by itself: large groups are a broadcast of bounded
   size, bundles are a hash. The rule is the same at every size.
2. Units in descending order of size go to the bin with the tightest room that takes them, else to a new one. The bins are kept in
   a balanced search tree by (room, bin), so a unit costs a logarithm of the number of bins.
3. `pack` has a fixed capacity and as few shards as that gives. `even` has a fixed number of shards and bisects for the
   smallest capacity with which best fit needs no more of them. A group larger than a fair share gets a shard of its own,
   and the others share the rest.
4. Rows are numbered within their shard in two steps, cells by a hash and rows within a cell. Equal rows are counted first and
   numbered in chunks, so neither a large shard nor a row that repeats a million times is one task's work.

Defined cases: a null text has no bytes and is equal to an empty one; repeated rows (one id, one text) are rows of their
own, in the same shard; a null id is a value like any other; with fewer groups than shards some shards are empty; a group
beyond `pack`'s capacity has a shard of its own, which holds nothing else; an empty table gives an empty result; other
columns are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, small, table

SHARDS = 40
OVERHEAD = 16
#: Groups of at least this part of a shard are packed by themselves, smaller ones in bundles of about that size.
FINE = 256
#: Rows of a cell in which rows are numbered, on average.
CELL_ROWS = 4096


class Rooms:
    """A height-balanced search tree of (room, bin) pairs; nodes are [key, left, right, height]."""

    def __init__(self) -> None:
        self._root = None

    def add(self, key: tuple[int, int]) -> None:
        self._root = self._add(self._root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the pair of the least room that is at least size, of the lowest bin among equals."""
        best, at = None, self._root
        while at:
            if at[0][0] >= size:
                best, at = at[0], at[1]
            else:
                at = at[2]
        if best:
            self._root = self._drop(self._root, best)
        return best

    @staticmethod
    def _balanced(n: list) -> list:
        height = lambda x: x[3] if x else 0
        lean = height(n[1]) - height(n[2])
        if abs(lean) > 1:
            tall, other = (1, 2) if lean > 0 else (2, 1)
            child = n[tall]
            if height(child[other]) > height(child[tall]):
                n[tall] = Rooms._turn(child, other, tall)
            return Rooms._turn(n, tall, other)
        n[3] = 1 + max(height(n[1]), height(n[2]))
        return n

    @staticmethod
    def _turn(n: list, up: int, down: int) -> list:
        """The child on side `up` takes the place of n, which goes to its side `down`."""
        top = n[up]
        n[up], top[down] = top[down], n
        for x in (n, top):
            x[3] = 1 + max(x[1][3] if x[1] else 0, x[2][3] if x[2] else 0)
        return top

    def _add(self, n: list | None, key: tuple) -> list:
        if n is None:
            return [key, None, None, 1]
        side = 1 if key < n[0] else 2
        n[side] = self._add(n[side], key)
        return self._balanced(n)

    def _drop(self, n: list, key: tuple) -> list | None:
        if key != n[0]:
            side = 1 if key < n[0] else 2
            n[side] = self._drop(n[side], key)
        elif n[1] and n[2]:
            low = n[2]
            while low[1]:
                low = low[1]
            n[0] = low[0]
            n[2] = self._drop(n[2], low[0])
        else:
            return n[1] or n[2]
        return self._balanced(n)


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each of the sizes, which descend; None if that takes more than `most` bins."""
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.tightest(size)
        if found is None:
            if bins == most:
                return None
            found, bins = (max(capacity, size), bins), bins + 1
        out.append(found[1])
        rooms.add((found[0] - size, found[1]))
    return out


def even_fit(sizes: list[int], shards: int) -> list[int]:
    """The bin of each of the sizes, which descend, in `shards` bins that are as even as best fit makes them."""
    alone, rest = 0, sum(sizes)
    # What exceeds a fair share of itself and all that follows stays alone.
    while alone < len(sizes) and alone < shards - 1 and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    left, bins = sizes[alone:], shards - alone
    if not left:
        return list(range(alone))
    low = max(left[0], -(-rest // bins))
    high = low + left[0]  # with so much room no bin can be missing
    found = best_fit(left, high, bins)
    while low < high:
        capacity = (low + high) // 2
        tried = best_fit(left, capacity, bins)
        if tried is None:
            low = capacity + 1
        else:
            high, found = capacity, tried
    return [*range(alone), *(alone + b for b in found)]


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest and the number n of rows that are equal in these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    own = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), digest(F.col("text")).alias("digest"))
    return own.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("n"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Packing:
    """Which shard each group goes to: `large` are digests that are units, others hash to one of `bundles`."""

    def __init__(self, rows: DataFrame, capacity: int, fit: Callable[[list[int]], list[int]]) -> None:
        """rows as of rows_of, written; capacity is that of a shard, or about that; fit deals descending sizes to bins."""
        least = max(1, -(-capacity // FINE))
        groups = rows.groupBy("digest").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"))
        # Groups of a FINE-th of a shard: at most FINE times as many as full shards.
        self.large = materialize(groups.filter(F.col("bytes") >= least), "shard-large").select(F.col("digest").alias("_large"))
        total = rows.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
        self.bundles = max(1, -(-total // least))
        units = self._units(rows).groupBy("unit").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows"))

        def deal(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["bytes", "unit"], ascending=[False, True])
            return pdf.assign(shard=fit([int(b) for b in pdf["bytes"]]))

        # One task for all units: their number is bounded by shards and FINE, whatever the number of documents.
        units = units.withColumn("unit", F.hex("unit")).groupBy().applyInPandas(deal, "unit string, bytes long, rows long, shard int")
        self.units = materialize(units.withColumn("unit", F.unhex("unit")), "shard-units")

    def _units(self, rows: DataFrame) -> DataFrame:
        bundle = F.encode(F.pmod(F.xxhash64("digest"), F.lit(self.bundles)).cast("string"), "UTF-8")
        return rows.join(small(self.large), F.col("digest") == F.col("_large"), "left").withColumn("unit", F.coalesce("_large", bundle)).drop("_large")

    def deal(self, rows: DataFrame) -> DataFrame:
        """rows (with a digest each) and their shard. No shuffle while the units fit a broadcast."""
        units = small(self.units.select(F.col("unit").alias("_unit"), "shard"))
        return self._units(rows).join(units, F.col("unit") == F.col("_unit")).drop("unit", "_unit")


def numbered(dealt: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, from 0 without gaps in each shard, one row for each of the n of a row."""
    cells = F.ceil(F.sum("rows") / CELL_ROWS).cast("long")
    per = small(units.groupBy(F.col("shard").alias("_s")).agg(cells.alias("cells")))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CELL_ROWS).cast("long")))
    parts = dealt.select("*", chunk.alias("at")).withColumn("some", F.least(F.col("n") - F.col("at"), F.lit(CELL_ROWS)))
    parts = parts.withColumn("key", F.xxhash64("digest", "doc_id", "at"))
    parts = parts.join(per, F.col("shard") == F.col("_s")).withColumn("cell", F.pmod("key", "cells")).drop("_s", "cells", "n")
    parts = materialize(parts, "shard-parts")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("shard", "cell").agg(F.sum("some").alias("some"))
    base = base.select(F.col("shard").alias("_s"), F.col("cell").alias("_c"), F.coalesce(F.sum("some").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "cell").orderBy("key", "digest", "doc_id", "at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("some").over(inner), F.lit(0)))
    parts = parts.join(small(materialize(base, "shard-cells")), (F.col("shard") == F.col("_s")) & (F.col("cell") == F.col("_c")))
    first = F.col("base") + F.col("ahead")
    slot = F.explode(F.sequence(first, first + F.col("some") - 1)).alias("slot")
    return parts.select("doc_id", "size", "text_crc32", "shard", slot)


def _total(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0


def even(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, Packing]:
    """The rows of docs, written, and a packing of them into `shards` shards of nearly equal size."""
    rows = materialize(rows_of(docs), "shard-rows")
    return rows, Packing(rows, -(-_total(rows) // shards), lambda sizes: even_fit(sizes, shards))


def pack(docs: DataFrame, capacity: int) -> tuple[DataFrame, Packing]:
    """The rows of docs, written, and a packing of them into few shards of at most `capacity` bytes."""
    rows = materialize(rows_of(docs), "shard-rows")
    return rows, Packing(rows, capacity, lambda sizes: best_fit(sizes, capacity))


def write(docs: DataFrame, packing: Packing, path: str) -> None:
    """Whole rows of docs as Parquet, a folder `_shard=N` for each shard."""
    dealt = packing.deal(docs.select(F.struct("*").alias("_row"), digest(F.col("text")).alias("digest")))
    dealt.select("_row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    rows, packing = even(table(spark, sf_dir, "documents"))
    out = numbered(packing.deal(rows), packing.units)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
