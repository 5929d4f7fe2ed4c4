"""Interaction of document filters, by direct replay of every document under every order.

1. One pass over the texts gives each document a mask of the filters that it fails. Equal texts are found by their SHA-256
   digests: the smallest doc_id of each text that occurs more than once comes back to its copies (see common.meet, so a
   text that a third of all documents share is no hot key). Labels join by doc_id.
2. Masks are crossed with all orders of the filters, a broadcast table of fixed size (120 rows for five filters), and
   each pair is exploded into its steps. The position of the first failing filter says where a document goes.
3. Rows are aggregated by (part, order, step) under conditions; partial sums are taken before the shuffle, which so moves
   at most parts times 600 rows a task and not documents.

Defined cases: a null text is empty, and equal to other empty texts; a null source is the part "" together with empty
sources; of two rows with one id and text neither fails E, as no id is smaller; a null id is smaller than nothing and never
fails E, but counts as a document; a document is good (toxic) if any of its labels has quality (toxic) 1, null labels say
nothing; an empty table gives an empty result; other columns are not read and may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import WORD, materialize, meet, small, table

FEWEST_WORDS = 200
#: Percent: distinct words of all words at least, capital letters of all code points at most.
DISTINCT, CAPITALS = 50, 2
SYMBOLS = "[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """Letter of a filter and the condition under which a text fails it."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    n = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < FEWEST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT * n,
        "C": 100 * capitals.cast("long") > CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of every document; bit i of the mask is set if it fails the i-th of the filters A to E."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = list(text_filters(text).values())
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    own = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "doc_id", mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    own = materialize(own, "audit-masks")
    copies = own.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = meet(own, materialize(copies, "audit-copies"), ["digest"], "n", F.col("doc_id"), "copies")
    own = own.withColumn("mask", F.col("mask") + F.when(F.col("copies.first_id") < F.col("doc_id"), 1 << len(fails)).otherwise(0))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marks = small(materialize(marks.filter("good OR toxic"), "audit-labels").withColumn("_z", F.lit(0).cast("long")))
    # Rows without an id meet no label; they are dealt by their digest instead of to one task.
    own = own.withColumn("_s", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(1 << 30))).otherwise(0))
    own = own.join(marks, (F.col("doc_id") == F.col("_id")) & (F.col("_s") == F.col("_z")), "left")
    return own.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark, letters: str) -> DataFrame:
    """filter_order, place (of each filter, by letter) and steps (step, filter, bit): one row for every order."""
    rows = []
    for order in permutations(range(len(letters))):
        place = [order.index(i) + 1 for i in range(len(letters))]
        rows.append(("".join(letters[i] for i in order), place, [(k + 1, letters[i], 1 << i) for k, i in enumerate(order)]))
    return spark.createDataFrame(rows, "filter_order string, place array<int>, steps array<struct<step:int,filter:string,bit:int>>")


def replay(masked: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Counts of kept, removed, redundant, only failing, good and toxic documents at every step of every order, by part."""
    never = len(letters) + 1
    first = F.least(*(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("place")[i]).otherwise(never) for i in range(len(letters))))
    # The orders are a table of fixed size; each document replays all of them.
    runs = masked.crossJoin(F.broadcast(orders(masked.sparkSession, letters)))
    runs = runs.select("part", "filter_order", "mask", "good", "toxic", first.alias("first"), F.inline("steps"))
    when = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    here, fails = F.col("first") == F.col("step"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    by = runs.groupBy("part", "filter_order", "step", "filter").agg(
        when(F.col("first") > F.col("step")).alias("kept"),
        when(here).alias("removed"),
        when(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        when(F.col("mask") == F.col("bit")).alias("unique_fails"),
        when(here & F.col("good")).alias("good_lost"),
        when(here & F.col("toxic")).alias("toxic_lost"),
    )
    return by.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return replay(masks(docs, labels))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


SQL = rf"""
WITH t AS (SELECT coalesce(CAST(source AS VARCHAR), '') AS part, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT part, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
f AS (SELECT part, doc_id,
  [len(words) < {FEWEST_WORDS}, 100 * len(list_distinct(words)) < {DISTINCT} * len(words),
   100 * len(regexp_extract_all(text, '[A-Z]')) > {CAPITALS} * length(text), regexp_matches(text, '{SYMBOLS}'),
   coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
n AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM n a, n b, n c, n d, n e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT part, fails, good, toxic, seq, coalesce(list_position(list_transform(seq, lambda x: fails[x]), true), 6) AS first_fail FROM m, o),
s AS (SELECT part, seq, first_fail, good, toxic, n.i AS step, seq[n.i] AS f, fails[seq[n.i]] AS bad,
  fails[seq[n.i]] AND len(list_filter(fails, lambda x: x)) = 1 AS alone FROM p, n),
g AS (SELECT part, array_to_string(list_transform(seq, lambda x: substr('ABCDE', CAST(x AS INTEGER), 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, f,
  count(*) FILTER (first_fail > step) AS kept, count(*) FILTER (first_fail = step) AS removed,
  count(*) FILTER (bad AND first_fail < step) AS redundant, count(*) FILTER (alone) AS unique_fails,
  count(*) FILTER (first_fail = step AND good) AS good_lost, count(*) FILTER (first_fail = step AND toxic) AS toxic_lost
  FROM s GROUP BY part, seq, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""
