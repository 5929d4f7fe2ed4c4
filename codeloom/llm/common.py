"""Shared helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.work import materialize, meet, new_path, release, small  # noqa: F401

#: White space and words of the contracts: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows and bytes (or one row), so that a worker never holds many texts as Python values."""
    for b in batches:
        left = [b]
        while left:
            b = left.pop()
            if b.num_rows > 1 and (b.num_rows > rows or b.nbytes > size):
                half = b.num_rows // 2
                left += [b.slice(half), b.slice(0, half)]
            elif b.num_rows:
                yield b


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
