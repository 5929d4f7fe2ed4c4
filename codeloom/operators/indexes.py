"""Stored indexes: inverted lists of the words of statements, and of names and their 3-grams. A search reads only lists that can hold a hit.

Both give what a scan gives: candidates are a superset of the hits, and hits are decided by the functions that a scan uses.
Tables are range-partitioned and sorted by what they are looked up by, so a filter on it skips files and pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.sqltext import PART_LEAST, fingerprint, lock_clause, normalize, tokens
from codeloom.operators.search import matched, name_rank
from codeloom.work import materialize, meet

#: Words in common, of all words of two statements, at which they are alike (see sqltext.matches).
ALIKE = 0.8
GRAM = 3


def _inner(part: Column) -> Column:
    """Words of a text that have something else on both sides: they are whole words of any text that holds this one."""
    return F.array_distinct(F.regexp_extract_all(part, F.lit(r"(?<=[^\p{L}\p{N}_])[\p{L}\p{N}_]+(?=[^\p{L}\p{N}_])"), 0))


def _prefix(n: Column) -> Column:
    """So many of the rarest of n words hold one in common with any text of a similarity of ALIKE or more."""
    return n - F.ceil(F.lit(ALIKE) * n - 1e-9) + 1


def statement_index(statements: DataFrame) -> DataFrame:
    """word, sid, place, n, df, signs: a row for each word of each distinct text of search.index(), rare words first.

    signs marks one word of a text with wildcards, or the word '' if it has none, which a query must hold in order to hold the
    text's first long part. sid is the digest of the text.
    """
    texts = statements.filter("sql_text IS NOT NULL").groupBy(F.sha2("sql_text", 256).alias("sid")).agg(F.any_value("normal").alias("normal"))
    texts = texts.withColumn("words", tokens(F.col("normal")))
    parts = F.filter(F.split("normal", r"\?"), lambda p: p != "")
    long = F.filter(parts, lambda p: F.length(p) >= PART_LEAST)
    first = F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.get(long, F.lit(0)))
    texts = texts.withColumn("must", F.when(F.col("normal").contains("?") & first.isNotNull(), _inner(first)))
    texts = materialize(texts.drop("normal"), "index-texts")
    each = texts.select("sid", F.explode("words").alias("word"))
    counts = materialize(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "index-words")
    # Words that many texts have come by broadcast; there are few of them.
    each = meet(each, counts, ["word"], "df", F.col("sid"), "m")
    lists = each.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct(F.col("m.df").alias("df"), "word"))).alias("own"))
    lists = texts.select("sid", "must").join(lists, "sid", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<df:bigint,word:string>>")))
    sign = F.when(F.col("must").isNotNull(), F.coalesce(F.get(F.filter("own", lambda x: F.array_contains("must", x["word"])), F.lit(0))["word"], F.lit("")))
    lists = lists.select("sid", sign.alias("sign"), F.size("own").alias("n"), F.posexplode_outer("own").alias("at", "x"))
    rows = lists.filter("x IS NOT NULL").select("x.word", "sid", (F.col("at") + 1).alias("place"), "n", "x.df", F.coalesce(F.col("x.word") == F.col("sign"), F.lit(False)).alias("signs"))
    free = lists.filter("sign = '' AND coalesce(at, 0) = 0").select(F.lit("").alias("word"), "sid", F.lit(0).alias("place"), "n", F.lit(0).cast("long").alias("df"), F.lit(True).alias("signs"))
    return rows.unionByName(free).repartitionByRange("word", "sid").sortWithinPartitions("word")


def candidates(index: DataFrame, query: str) -> DataFrame | None:
    """sid of every text that can match a query; None if any text can."""
    spark = index.sparkSession
    q = normalize(F.lower(F.lit(query)))
    parts = F.filter(F.split(q, r"\?"), lambda p: p != "")
    words, must = spark.range(1).select(tokens(q).alias("w"), F.array_distinct(F.flatten(F.transform(parts, _inner))).alias("m")).first()
    if not words or not must:
        return None
    # At most as many rows as the query has words.
    df = {r.word: r.df for r in index.filter(F.col("word").isin(words)).groupBy("word").agg(F.max("df").alias("df")).collect()}
    order = sorted(words, key=lambda w: (df.get(w, 0), w))
    m = len(order)
    head = order[: m - math.ceil(ALIKE * m - 1e-9) + 1]
    rarest = min(must, key=lambda w: (df.get(w, 0), w))
    word = F.col("word")
    # The query is in the text; both are alike; or the text's parts are in the query.
    holds = word == rarest
    alike = word.isin(head) & (F.col("place") <= _prefix(F.col("n"))) & F.col("n").between(math.ceil(ALIKE * m - 1e-9), math.floor(m / ALIKE + 1e-9))
    held = F.col("signs") & word.isin([*words, ""])
    return index.filter(word.isin([*words, ""])).filter(holds | alike | held).select("sid").distinct()


def search_sql(statements: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """What search.search_sql gives, from statements that have fingerprint and lock and an index of them."""
    q = F.lit(query)
    for column, value, score in (("fingerprint", fingerprint(q), 1.0), ("lock", lock_clause(q), 0.9)):
        exact = statements.filter("indexed").filter(F.col(column) == value)
        if not exact.isEmpty():
            return exact.select("node_key", F.lit(score).alias("score")).distinct()
    some = candidates(index, query)
    if some is not None:
        statements = statements.withColumn("sid", F.sha2("sql_text", 256)).join(some, "sid", "left_semi")
    return matched(statements, query)


def name_index(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """text, kind, node_key, total: the whole key, its name and bare name of each node (exact), and its 3-grams (gram), in lower case."""
    key = F.lower("node_key")
    name = F.when(F.instr(key, ":") > 0, F.substring_index(key, ":", -1)).otherwise(key)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - GRAM + 1)), lambda i: F.substring(key, i, F.lit(GRAM)))
    exact = F.transform(F.array_distinct(F.array(key, name, F.substring_index(name, ".", -1))), lambda t: F.struct(F.lit("exact").alias("kind"), t.alias("text")))
    gram = F.transform(F.array_distinct(grams), lambda t: F.struct(F.lit("gram").alias("kind"), t.alias("text")))
    # Joined before they are exploded, and shuffled: the planner takes exploded rows for as few as the nodes and would broadcast them.
    rows = nodes.select("node_key").join(degrees.select("node_key", "total").hint("merge"), "node_key")
    rows = rows.select(F.explode(F.concat(exact, gram)).alias("x"), "node_key", "total").select("x.text", "x.kind", "node_key", "total")
    # Grams that most keys share are spread over partitions by their keys.
    return rows.repartitionByRange("kind", "text", "node_key").sortWithinPartitions("kind", "text")


def search_names(index: DataFrame, query: str, mode: str = "contains", limit: int | None = 20) -> DataFrame:
    """What search.search_names gives in the modes exact and contains. limit None: all hits."""
    q = query.lower()
    if mode == "exact":
        found = index.filter((F.col("kind") == "exact") & (F.col("text") == q)).select("node_key", "total")
    elif len(q) < GRAM:
        # Too short for a gram: all texts of the exact kind that hold it, which are fewer than the grams.
        found = index.filter((F.col("kind") == "exact") & F.contains("text", F.lit(q))).select("node_key", "total").distinct()
    else:
        grams = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        found = index.filter((F.col("kind") == "gram") & F.col("text").isin(grams)).groupBy("node_key").agg(F.count_distinct("text").alias("c"), F.any_value("total").alias("total"))
        found = found.filter(F.col("c") == len(grams)).select("node_key", "total")
    found = found.select("node_key", name_rank(query, F.col("node_key")).alias("rank"), "total").filter("rank IS NOT NULL" if mode != "exact" else "rank = 0")
    found = found.orderBy("rank", F.desc("total"), "node_key")
    return found if limit is None else found.limit(limit)
