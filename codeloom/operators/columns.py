"""Column products of routines: diagnostics, table operations, predicates, discriminator values and seed hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.model import READ


def filters(rows: DataFrame) -> DataFrame:
    """owner_key, table, column, op, value, transform (a function around the column), file, line of parsed rows."""
    return rows.filter("record = 'filter'").select(F.col("a").alias("owner_key"), F.col("b").alias("table"), F.col("c").alias("column"), F.col("d").alias("op"), F.col("e").alias("value"), F.col("f").alias("transform"), "file", "line").distinct()


def _pairs(rows: DataFrame, record: str) -> DataFrame:
    side = lambda t, c: F.struct(F.col(t).alias("table"), F.col(c).alias("column"))
    raw = rows.filter(F.col("record") == record).select(F.col("a").alias("owner_key"), side("b", "c").alias("x"), side("d", "e").alias("y"), F.col("f").alias("text"))
    return raw.select("owner_key", F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "text")


def equalities(rows: DataFrame) -> DataFrame:
    """owner_key, left, right, text: equalities of expressions over one column of each of two tables."""
    return _pairs(rows, "equality").distinct()


def joins(rows: DataFrame) -> DataFrame:
    """owner_key, the two sides in a fixed order, so that mirrored conditions are one, and source: column or record."""
    return _pairs(rows, "join").withColumnRenamed("text", "source").distinct()


def predicates(rows: DataFrame) -> DataFrame:
    """owner_key, predicate_id, table, column, op, value, confidence, file, line."""
    part = F.split("b", r"\|")
    return rows.filter("record = 'predicate'").select(F.col("a").alias("owner_key"), part[0].alias("predicate_id"), F.col("c").alias("table"), F.col("d").alias("column"), F.col("e").alias("op"), F.col("f").alias("value"), part[1].alias("confidence"), "file", "line")


def table_schemas(rows: DataFrame) -> DataFrame:
    """table_key, columns: an array of name, data_type, nullable, primary_key, default, comment in the order of definition.

    Comments may stand in any file; the first one of a column stays.
    """
    c = rows.filter("record = 'column'").select(F.col("a").alias("table_key"), "n", F.col("b").alias("name"), F.col("c").alias("data_type"), (F.col("d") == "null").alias("nullable"), F.col("e").isNotNull().alias("primary_key"), F.col("f").alias("default"))
    said = rows.filter("record = 'comment' AND b IS NOT NULL").groupBy(F.col("a").alias("table_key"), F.col("b").alias("name")).agg(F.min(F.struct("file", "line", F.col("c").alias("comment"))).alias("x"))
    c = c.join(said.select("table_key", "name", "x.comment"), ["table_key", "name"], "left")
    return c.groupBy("table_key").agg(F.array_sort(F.collect_list(F.struct("n", "name", "data_type", "nullable", "primary_key", "default", "comment"))).alias("columns"))


def schema_diagnostics(rows: DataFrame) -> DataFrame:
    """rule, subject: tables that several statements define, statements that could not be read, and what was bounded."""
    twice = rows.filter("record = 'node' AND b = 'table'").groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.lit("duplicate-table").alias("rule"), F.col("a").alias("subject"))
    bound = rows.filter("record = 'bound'").select(F.concat(F.lit("only-some-"), "b").alias("rule"), F.col("a").alias("subject"))
    return twice.unionByName(bound).unionByName(rows.filter("record = 'error'").select(F.lit("unread-statement").alias("rule"), F.concat_ws(":", "file", "line").alias("subject")))


def enum_mappings(rows: DataFrame) -> DataFrame:
    """owner_key, table, column, literal, result of CASE and DECODE."""
    return rows.filter("record = 'enum'").select(F.col("a").alias("owner_key"), F.col("b").alias("table"), F.col("c").alias("column"), F.col("d").alias("literal"), F.col("e").alias("result"), "file", "line").distinct()


def table_operations(edges: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """table, operations: read and the write kinds of all accesses of the owners (src_key), sorted."""
    e = edges.filter("edge_type = 'TableAccess'")
    if owners is not None:
        e = e.join(owners, "src_key", "left_semi")
    ops = F.concat(F.when(F.col("modes").bitwiseAND(READ) != 0, F.array(F.lit("read"))).otherwise(F.array().cast("array<string>")), F.coalesce("write_kinds", F.array().cast("array<string>")))
    return e.select(F.col("dst_key").alias("table"), F.explode(ops).alias("op")).groupBy("table").agg(F.array_sort(F.collect_set("op")).alias("operations"))


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "^'(.*)'$", "$1")


def discriminator_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """owner_key, column, value, source, confidence, file, line for the named columns, first place wins.

    Values of = in code are high, those of IN and of filters in statements medium.
    """
    names = [c.lower() for c in columns]
    p = predicates(rows).filter(F.lower("column").isin(*names) & F.col("op").isin("=", "in"))
    p = p.select("owner_key", "column", F.when(F.col("op") == "in", F.split(F.regexp_replace("value", r"[()\s]", ""), ",")).otherwise(F.array("value")).alias("v"), F.lit("predicate").alias("source"), F.when(F.col("op") == "=", "high").otherwise("medium").alias("confidence"), "file", "line")
    f = filters(rows).filter(F.lower("column").isin(*names) & F.col("op").isin("=", "in"))
    f = f.select("owner_key", "column", F.split("value", ",").alias("v"), F.lit("filter").alias("source"), F.lit("medium").alias("confidence"), "file", "line")
    every = p.unionByName(f).withColumn("value", F.explode("v")).withColumn("value", unquoted(F.col("value"))).drop("v")
    rank = F.row_number().over(Window.partitionBy("owner_key", "column", "value", "source").orderBy("file", "line"))
    return every.withColumn("_r", rank).filter("_r = 1").drop("_r")


def parameters(rows: DataFrame) -> DataFrame:
    """routine_key, position, name, mode, type; of two parameters of one name the first stays."""
    p = rows.filter("record = 'param'").select(F.col("a").alias("routine_key"), F.col("n").alias("position"), F.col("b").alias("name"), F.col("c").alias("mode"), F.col("d").alias("type"))
    rank = F.row_number().over(Window.partitionBy("routine_key", "name").orderBy("position"))
    return p.withColumn("_r", rank).filter("_r = 1").drop("_r")


def seed_hints(rows: DataFrame, edges: DataFrame, discriminators: list[str]) -> DataFrame:
    """One row a routine: parameters, operations by table, filters, discriminator values and cross-table equalities, each a sorted
    array of structs."""
    sig = parameters(rows).groupBy(F.col("routine_key").alias("owner_key")).agg(F.array_sort(F.collect_list(F.struct("position", "name", "mode", "type"))).alias("parameters"))
    ops = edges.filter("edge_type = 'TableAccess'").groupBy(F.col("src_key").alias("owner_key")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst_key").alias("table"), "modes", "write_kinds"))).alias("tables"))
    hard = filters(rows).groupBy("owner_key").agg(F.array_sort(F.collect_set(F.struct("table", "column", "op", "value"))).alias("filters"))
    values = discriminator_values(rows, discriminators).groupBy("owner_key").agg(F.array_sort(F.collect_set(F.struct("column", "value", "source", "confidence"))).alias("discriminators"))
    keys = equalities(rows).groupBy("owner_key").agg(F.array_sort(F.collect_set(F.struct("left", "right", "text"))).alias("equalities"))
    out = sig
    for part in (ops, hard, values, keys):
        out = out.join(part, "owner_key", "full")
    return out
