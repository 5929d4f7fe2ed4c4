"""Mixing sources to target weights with exact word budgets.

1. Every document gets a hash-random key: the SHA-256 digest of the seed and its id.
2. The documents of a source are range-sorted by that key: the leading bits of the key name a range, and the number of
   ranges of a source follows its number of rows, so that a source with a third of all rows is spread like any other.
3. Prefix sums of sizes are taken in two steps: sums of ranges (aggregated before the shuffle), then rows within a range.
4. Each source is cut at its exact budget. Whole epochs count for every document; the rest goes to the first documents in
   key order, and the last of them gives only the words still missing.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents with equal ids are
ordered by their size, and equal rows are interchangeable; a source of size 0 gets target 0; an empty table gives an
empty result; other columns are not read and may have any name.

take() gives the same for whole rows of documents: texts are not sorted, only counted again and held against the place of
each source's cut. Rows that are equal in id and size at the cut share what is left there evenly, rounded down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import WORD, materialize, small

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times its source's size.
MOST_EPOCHS = 3
#: Rows that a range of a source has on average.
RANGE_ROWS = 4096
SEED = "mix-1"
#: Of a SHA-256 digest in hexadecimal, the digits that number the ranges.
DIGITS = 8


def size_of(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.regexp_extract_all(text, F.lit(WORD), 0))).cast("long")


def key_of(doc_id: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key"))


def targets(rows: DataFrame) -> DataFrame:
    """source, source_rows, source_size, target. Water filling: sources in order of cap by weight, full ones first.

    One row for each source comes here, so that the windows over all of them sort a small table.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(one) - 1) % len(WEIGHTS) + 1)
    by = by.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by = by.withColumns({
        "total": F.sum("source_size").over(every),
        "before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left_w": F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    # A source is full if the share that is left for it and all after it reaches its cap.
    by = by.withColumn("full", F.col("cap") * F.col("left_w") <= (F.col("total") - F.col("before")) * F.col("w"))
    by = by.withColumns({
        "full_caps": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every),
        "rest_w": F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(every),
    })
    share = (F.col("total") - F.col("full_caps")).cast("double") * F.col("w") / F.col("rest_w")
    return by.select("source", "source_rows", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, key, size, source_size, target, budget, epochs, extra and taken for every document."""
    rows = materialize(sizes(docs, seed), "mix-sizes")
    goal = materialize(targets(rows.select("source", "size")), "mix-targets")
    # The number of ranges is a power of 16, as they are told apart by digits of the key.
    digits = F.least(F.lit(DIGITS), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("source_rows") / range_rows)))).cast("int")
    goal = goal.withColumns({"budget": F.least(F.round("target").cast("long"), F.col("source_size") * MOST_EPOCHS), "digits": digits})
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    goal = goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_s")
    placed = rows.join(small(goal), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("range", F.expr("substring(key, 1, digits)"))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(small(sums), F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("ahead")))
    placed = placed.withColumn("extra", extra.cast("long"))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", "budget", "epochs", "extra", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def take(docs: DataFrame, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """_row, a struct of all columns of docs, and size, source_size, target and taken of every document."""
    mixed = materialize(mix(docs, seed, range_rows), "mix-taken")
    # One row for each source: the last place in its order that gives words, and what the rows there give in all.
    place = F.struct("key", F.col("doc_id").isNotNull().alias("named"), "doc_id", "size")
    last = mixed.groupBy("source").agg(F.max(F.when(F.col("extra") > 0, place)).alias("cut"), F.any_value("source_size").alias("source_size"), F.any_value("target").alias("target"), F.any_value("epochs").alias("epochs"))
    here = mixed.groupBy("source", place.alias("cut")).agg(F.sum("extra").alias("given"), F.count(F.lit(1)).alias("rows")).filter("given > 0")
    cuts = last.join(here.withColumnRenamed("source", "_h").withColumnRenamed("cut", "_c"), F.col("source").eqNullSafe(F.col("_h")) & (F.col("cut") == F.col("_c")), "left")
    cuts = materialize(cuts.select(F.col("source").alias("_s"), "cut", "source_size", "target", "epochs", F.expr("given div rows").alias("share")), "mix-cuts")
    rows = docs.select(F.struct("*").alias("_row"), size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key"))
    met = rows.join(small(cuts), F.col("_row.source").eqNullSafe(F.col("_s")))
    at = F.struct("key", F.col("_row.doc_id").isNotNull().alias("named"), F.col("_row.doc_id").alias("doc_id"), "size")
    extra = F.when(at < F.col("cut"), F.col("size")).when(at == F.col("cut"), F.col("share")).otherwise(0)
    return met.select("_row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def sql(docs: str = "documents") -> str:
    return rf"""
WITH s AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
  sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM {docs}),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) * {MOST_EPOCHS} AS BIGINT) AS cap,
  CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM s GROUP BY source),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
  CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w FROM b),
g AS (SELECT *, cap * left_w <= (total - before) * w AS is_full FROM f),
r AS (SELECT CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) AS BIGINT) AS full_caps, CAST(sum(CASE WHEN is_full THEN 0 ELSE w END) AS BIGINT) AS rest_w FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(total - full_caps AS DOUBLE) * w / rest_w END AS target FROM g, r),
u AS (SELECT *, least(CAST(round(target) AS BIGINT), source_size * {MOST_EPOCHS}) AS budget FROM t),
v AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM u),
w AS (SELECT s.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM s)
SELECT w.doc_id, w.size, v.source_size, v.target,
  CAST(v.epochs * w.size + greatest(0, least(w.size, v.budget - v.epochs * v.source_size - w.ahead)) AS BIGINT) AS taken
FROM w JOIN v ON w.source IS NOT DISTINCT FROM v.source
"""
