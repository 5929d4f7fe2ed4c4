"""Search by name and by SQL text, statement classification, and name resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.sqltext import fingerprint, forms_of, lock_clause, lock_of, matches_forms, normal_of, relevance, spaced
from codeloom.operators.traverse import nearest_paths
from codeloom.sources.plsql import BUILTINS
from codeloom.work import materialize, small

#: Rounds of edit distance and number of suggestions for a name that resolves to nothing.
NEAR_EDITS, NEAR_MOST = 3, 3


def name_rank(query: str, key: Column) -> Column:
    """0 exact (whole key, name part or bare name), 1 at a word boundary on either side, 2 inside, null if not at all."""
    q, k = query.lower(), F.lower(key)
    name = F.when(F.instr(k, ":") > 0, F.substring_index(k, ":", -1)).otherwise(k)
    at = F.instr(k, q)
    before, after = F.substring(k, at - 1, F.lit(1)), F.substring(k, at + len(q), F.lit(1))
    word = "^[A-Za-z0-9_]$"
    edge = (at == 1) | ~before.rlike(word) | ((after != "") & ~after.rlike(word))
    return F.when((k == q) | (name == q) | (F.substring_index(name, ".", -1) == q), 0).when(at == 0, F.lit(None)).when(edge, 1).otherwise(2)


def search_names(nodes: DataFrame, degrees: DataFrame, query: str, mode: str = "contains", limit: int = 20) -> DataFrame:
    """node_key, rank, total. Modes: exact, regex (on lower-case keys), contains. Ordered by rank, degree, key."""
    key = F.lower("node_key")
    found = nodes.select("node_key", name_rank(query, F.col("node_key")).alias("rank")).filter("rank is not null")
    if mode == "exact":
        found = found.filter("rank = 0")
    elif mode == "regex":
        found = nodes.filter(key.rlike(query)).select("node_key", F.lit(2).alias("rank"))
    return found.join(degrees.select("node_key", "total"), "node_key").orderBy("rank", F.desc("total"), "node_key").limit(limit)


def search_sql(statements: DataFrame, query: str) -> DataFrame:
    """node_key, score of the statements (node_key, sql_text, indexed) that match a query.

    Equal fingerprints of indexed statements are enough (1.0); else a lock clause that is asked for (0.9); else all texts are
    matched, and a node has the score of its best statement. Each step is one scan, and a step runs only if those before
    found nothing. Statements that went through index() bring their fingerprints and lock clauses; others go through it here
    and are written, so no step makes a form anew.
    """
    q = F.lit(query)
    if "fingerprint" not in statements.columns:
        statements = materialize(index(statements).select("node_key", "indexed", "normal", "plain", "fingerprint", "lock"), "forms")
    exact = statements.filter("indexed").filter(F.col("fingerprint") == fingerprint(q))
    if not exact.isEmpty():
        return exact.select("node_key", F.lit(1.0).alias("score")).distinct()
    locks = statements.filter("indexed").filter(F.col("lock") == lock_clause(q))
    if not locks.isEmpty():
        return locks.select("node_key", F.lit(0.9).alias("score")).distinct()
    return matched(statements, query)


def matched(statements: DataFrame, query: str) -> DataFrame:
    """node_key, score of the statements that match a query; forms that index() made are used."""
    q, table = forms_of(statements.sparkSession, query)
    if "normal" not in statements.columns:
        # Written, so that the forms are made once a text and not once for each place where the match uses them.
        statements = materialize(forms(statements).select("node_key", "normal", "plain"), "forms")
    hit = statements.filter(matches_forms(F.col("normal"), F.col("plain"), q, table))
    return hit.groupBy("node_key").agg(F.max(relevance(q, F.col("normal"))).alias("score"))


def forms(statements: DataFrame) -> DataFrame:
    plain = statements.withColumn("plain", spaced(F.lower("sql_text")))
    return plain.withColumn("normal", normal_of(F.col("plain"))).select(*statements.columns, "normal", "plain")


def index(statements: DataFrame) -> DataFrame:
    """statements with fingerprint, lock and the forms that matches are decided by, to be stored beside a graph."""
    return forms(statements).withColumns({"fingerprint": F.sha2("normal", 256), "lock": lock_of(F.col("normal"))})


def ordered(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.substring_index("node_key", ":", 1), "node_key")


def trace_sql(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """node_key, score, caller: hits with their direct callers, null without any."""
    callers = edges.filter("category = 'call'").select(F.col("dst_key").alias("node_key"), F.col("src_key").alias("caller")).distinct()
    return hits.join(callers, "node_key", "left")


def mark(statements: DataFrame, edges: DataFrame, routines: DataFrame, target: str, target_name: str, bodies: DataFrame | None = None) -> DataFrame:
    """statements (unique_sql_id, sql_text) with mark and path for one target, each row by its own text.

    direct: the text names the target; indirect: it names a routine (node_key, name) that leads to the target, or has the
    fingerprint of a statement in such a routine's body (bodies: node_key and fingerprint, or sql_text). Of several routines
    the nearest is taken, then the first by key, with a shortest way from it. One search back from the target finds all callers.
    """
    callers = nearest_paths(edges, target).join(routines, "node_key").select("node_key", "name", "depth", F.array_join("path", " > ").alias("path"))
    callers = materialize(callers, "mark-callers")
    texts = statements.select("sql_text").filter("sql_text IS NOT NULL").distinct().select("sql_text", F.sha2("sql_text", 256).alias("digest"))
    # Words of a text meet names in an equi-join, so no text is held against every caller. Names may hold $ and #.
    words = texts.select("digest", F.explode(F.array_distinct(F.split(F.lower("sql_text"), r"[^\p{L}\p{N}_$#]+"))).alias("word"))
    found = words.join(small(callers.withColumn("word", F.lower("name"))), "word").select("digest", "depth", "node_key", "path")
    if bodies is not None:
        made = F.col("fingerprint") if "fingerprint" in bodies.columns else fingerprint(F.col("sql_text"))
        held = bodies.select("node_key", made.alias("print")).distinct().join(small(callers), "node_key")
        prints = texts.select("digest", fingerprint(F.col("sql_text")).alias("print"))
        found = found.unionByName(prints.join(held, "print").select("digest", "depth", "node_key", "path"))
    best = found.groupBy("digest").agg(F.min(F.struct("depth", "node_key", "path")).alias("best"))
    direct = F.coalesce(F.col("sql_text").rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_$#]){re.escape(target_name)}(?![\p{{L}}\p{{N}}_$#])"), F.lit(False))
    out = statements.withColumn("digest", F.sha2("sql_text", 256)).join(best, "digest", "left")
    m = F.when(direct, F.lit(f"direct to {target}")).when(F.col("best").isNotNull(), F.lit(f"indirect to {target}"))
    return out.select("unique_sql_id", "sql_text", m.alias("mark"), F.when(direct, F.lit(target)).otherwise(F.col("best.path")).alias("path"))


COLLECTION_METHODS = ("EXTEND", "TRIM", "DELETE", "COUNT", "FIRST", "LAST", "NEXT", "PRIOR", "EXISTS")


def noise(raw: Column) -> Column:
    """syntax-dump, self-member, collection-method, builtin-function or null: call texts that are no calls of routines."""
    text = F.trim(raw)
    up = F.upper(text)
    dump = text.rlike(r"^(?:PlVariable\(|BinaryOp[ {]|FunctionCall[ {]|Literal\(|ColumnRef\()")
    kind = F.when(dump, "syntax-dump").when(up.startswith("SELF."), "self-member").when(up.rlike(rf"\.(?:{'|'.join(COLLECTION_METHODS)})$"), "collection-method")
    return kind.when(F.lower(text).isin(*sorted(BUILTINS)), "builtin-function")


def resolve_calls(calls: DataFrame, routines: DataFrame) -> DataFrame:
    """call_id, raw, strategy, routine_key for every call (call_id, raw, caller_schema) by the first strategy that applies.

    routines: routine_key, schema_name, package_name, name. Strategies: S1 qualified name; S2 qualified, but the bare name is
    of one routine; S3 prefix is a package; S4 bare name of one routine; S5 the caller's schema among several; S6 no schema
    among several; S7 the first of several by key. One candidate table of (text, rank) is built from the routines, so all
    strategies are one equi-join and one aggregation.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    r = routines.select("routine_key", F.lower("schema_name").alias("schema"), low(F.col("package_name")).alias("p"), low(F.col("name")).alias("n"))
    s = F.coalesce("schema", F.lit(""))
    full = F.concat_ws(".", F.when(s != "", s), F.when(F.col("p") != "", F.col("p")), F.col("n"))
    own = lambda schema, name: F.concat(schema, F.lit("\x01"), name)
    # A strategy takes the first routine by key, so each text keeps that one only and a call meets one row of each kind.
    keys = r.select("routine_key", F.explode(F.array(
        F.struct(F.lit("full").alias("by"), full.alias("text")), F.struct(F.lit("pkg").alias("by"), F.when(F.col("p") != "", F.concat_ws(".", "p", "n")).alias("text")), F.struct(F.lit("name").alias("by"), F.col("n").alias("text")),
        F.struct(F.lit("own").alias("by"), own(F.col("schema"), F.col("n")).alias("text")), F.struct(F.lit("none").alias("by"), F.when(F.col("schema").isNull(), F.col("n")).alias("text")),
    )).alias("a")).select("routine_key", "a.by", "a.text")
    table = keys.filter("text is not null").groupBy("by", "text").agg(F.min("routine_key").alias("routine_key"), F.count(F.lit(1)).alias("many"))
    c = calls.select("call_id", "raw", F.lower("caller_schema").alias("caller"), F.lower(F.trim("raw")).alias("t")).filter(noise(F.col("raw")).isNull())
    bare = F.substring_index("t", ".", -1)
    asked = c.select("call_id", "t", F.explode(F.array(
        F.struct(F.lit("full").alias("by"), F.col("t").alias("text")), F.struct(F.lit("pkg").alias("by"), F.col("t").alias("text")), F.struct(F.lit("name").alias("by"), bare.alias("text")),
        F.struct(F.lit("own").alias("by"), own(F.col("caller"), bare).alias("text")), F.struct(F.lit("none").alias("by"), bare.alias("text")),
    )).alias("a")).select("call_id", "t", "a.by", "a.text")
    met = asked.join(small(table), ["by", "text"])
    dotted = F.instr("t", ".") > 0
    one = F.col("many") == 1
    rank = (
        F.when(F.col("by") == "full", 1).when((F.col("by") == "name") & dotted & one, 2).when((F.col("by") == "pkg") & dotted, 3).when((F.col("by") == "name") & ~dotted & one, 4)
        .when(F.col("by") == "own", 5).when(F.col("by") == "none", 6).when(F.col("by") == "name", 7)
    )
    best = met.withColumn("rank", rank).filter("rank is not null").groupBy("call_id").agg(F.min(F.struct("rank", "routine_key")).alias("b"))
    out = c.select("call_id", "raw").join(best, "call_id", "left")
    return out.select("call_id", "raw", F.concat(F.lit("S"), F.col("b.rank").cast("string")).alias("strategy"), F.col("b.routine_key").alias("routine_key"))


def nearest_names(missing: DataFrame, routines: DataFrame, edits: int = NEAR_EDITS, most: int = NEAR_MOST) -> DataFrame:
    """raw, name, distance, rank: the closest names within an edit distance.

    Names meet on pairs of adjacent characters instead of in a cross join: an edit breaks two pairs at most, so longer names
    within the distance share one. A short name is held against the names of about its length.
    """

    a = missing.select("raw", F.lower("raw").alias("x")).distinct().filter("x <> ''")
    b = routines.select("name", F.lower("name").alias("y")).distinct().filter("y <> ''")
    grams = lambda c: F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2))), F.array(F.lit(""))))
    size_key = lambda n: F.concat(F.lit("n"), n.cast("string"))
    sizes = F.transform(F.sequence(F.greatest(F.lit(1), F.length("x") - edits), F.length("x") + edits), size_key)
    pairs = lambda c: F.filter(grams(c), lambda g: g != "")
    # Two names of more than 2 * edits + 1 characters within the distance share a pair of adjacent characters.
    pa = a.select("raw", "x", F.explode(F.when(F.length("x") > 2 * edits + 1, pairs(F.col("x"))).otherwise(sizes)).alias("k"))
    pb = b.select("name", "y", F.explode(F.concat(pairs(F.col("y")), F.array(size_key(F.length("y"))))).alias("k"))
    met = pa.join(pb, "k").filter(F.abs(F.length("x") - F.length("y")) <= edits).select("raw", "x", "name", "y").distinct()
    d = met.withColumn("distance", F.levenshtein("x", "y", edits)).filter("distance >= 0")
    rank = F.row_number().over(Window.partitionBy("raw").orderBy("distance", "name"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= most).select("raw", "name", "distance", "rank")
