"""Table and column lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.model import READ, WRITE
from codeloom.operators.traverse import walk
from codeloom.work import materialize

#: A write counts as a flow of a table if it takes so many of the table's columns, or this share of the written ones.
LEAST_COLUMNS, LEAST_SHARE = 8, 0.15


def table_hops(access: DataFrame, depends: DataFrame | None = None) -> DataFrame:
    """parent, routine, child: data of child flows into parent. access: routine, table, modes and maybe read_tables.

    A routine's reads meet its writes; if the write's statement names the tables it reads, only those count. Views depend on
    tables without a routine (depends: view, table).
    """
    w = access.filter(F.col("modes").bitwiseAND(WRITE) != 0)
    r = access.filter(F.col("modes").bitwiseAND(READ) != 0).select("routine", F.col("table").alias("child")).distinct()
    out = lambda df: df.select(F.col("table").alias("parent"), "routine", "child").filter("parent <> child")
    if "read_tables" in access.columns:
        # The tables of a statement meet the routine's reads one by one; only writes without them meet all reads.
        some = w.filter("read_tables IS NOT NULL").select("routine", "table", F.explode("read_tables").alias("child")).distinct()
        hops = out(some.join(r, ["routine", "child"]))
        # Both sides are distinct, so these hops are; a column that is never null spares the rest.
        if access.schema["read_tables"].nullable:
            hops = hops.unionByName(out(w.filter("read_tables IS NULL").join(r, "routine"))).distinct()
    else:
        hops = out(w.join(r, "routine")).distinct()
    if depends is not None:
        hops = hops.unionByName(depends.select(F.col("view").alias("parent"), F.lit(None).cast("string").alias("routine"), F.col("table").alias("child")))
    return hops


def _walk(e: DataFrame, start: str, depth: int) -> DataFrame:
    """node, by, path, n: every way of 1 to depth edges (src, by, dst) from the start that repeats no node."""
    front = e.sparkSession.createDataFrame([(start, [start], 0)], "node string, path array<string>, n int")
    return walk(e, front, depth, carry=("by",)).filter("n > 0")


def lineage_tables(hops: DataFrame, start: str, direction: str = "up", depth: int = 3) -> DataFrame:
    """path, routine, table, depth: every way from the start, without repeating a table on it. up goes to sources."""
    a, b = ("parent", "child") if direction == "up" else ("child", "parent")
    e = materialize(hops.select(F.col(a).alias("src"), F.col("routine").alias("by"), F.col(b).alias("dst")), "hops")
    walk = _walk(e, start, depth)
    return walk.select(F.array_join("path", " < " if direction == "up" else " > ").alias("path"), F.col("by").alias("routine"), F.col("node").alias("table"), F.col("n").alias("depth"))


def lineage_columns(mappings: DataFrame, table: str, column: str, direction: str = "up", depth: int = 5) -> DataFrame:
    """path, owner, col, depth over column mappings (target_table, target_column, source_table, source_column, owner_key)."""
    t, s = F.concat_ws(".", "target_table", "target_column"), F.concat_ws(".", "source_table", "source_column")
    a, b = (t, s) if direction == "up" else (s, t)
    e = materialize(mappings.filter("source_column is not null").select(a.alias("src"), F.col("owner_key").alias("by"), b.alias("dst")).distinct(), "columns")
    walk = _walk(e, f"{table}.{column}", depth)
    return walk.select(F.array_join("path", " < ").alias("path"), F.col("by").alias("owner"), F.col("node").alias("col"), F.col("n").alias("depth"))


def role(overlap: Column, total: Column, known: Column, least_columns: int = LEAST_COLUMNS, least_share: float = LEAST_SHARE) -> Column:
    """flow, reference or unknown. The threshold never exceeds the written columns; without any it is the fixed one."""
    need = F.when(total == 0, least_columns).otherwise(F.least(total, F.greatest(F.lit(least_columns), F.ceil(total * least_share))))
    return F.when(~known, "unknown").when(overlap >= need, "flow").otherwise("reference")


def edge_roles(mappings: DataFrame, columns: DataFrame, least_columns: int = LEAST_COLUMNS, least_share: float = LEAST_SHARE, ignore: tuple[str, ...] = ()) -> DataFrame:
    """target_table, source_table, overlap, total, role. columns: table, column of tables whose definition is known.

    Columns of the names to ignore (such as those of housekeeping) count on neither side.
    """
    if ignore:
        mappings = mappings.filter(~F.coalesce(F.lower("source_column").isin(*ignore), F.lit(False)) & ~F.lower("target_column").isin(*ignore))
        columns = columns.filter(~F.lower("column").isin(*ignore))
    total = mappings.groupBy("target_table").agg(F.count_distinct("target_column").alias("total"))
    used = mappings.filter("source_column is not null").select("target_table", "source_table", F.col("source_column").alias("column")).distinct()
    ddl = columns.select(F.col("table").alias("source_table"), "column").distinct()
    both = used.join(ddl, ["source_table", "column"], "left_semi").groupBy("target_table", "source_table").agg(F.count(F.lit(1)).alias("overlap"))
    known = ddl.select("source_table").distinct().withColumn("known", F.lit(True))
    out = used.select("target_table", "source_table").distinct().join(both, ["target_table", "source_table"], "left").join(total, "target_table").join(known, "source_table", "left")
    out = out.withColumns({"overlap": F.coalesce("overlap", F.lit(0)).cast("long"), "known": F.coalesce("known", F.lit(False))})
    return out.select("target_table", "source_table", "overlap", "total", role(F.col("overlap"), F.col("total"), F.col("known"), least_columns, least_share).alias("role"))


def roll_up(roles: DataFrame) -> DataFrame:
    """source_table, role, overlap: flow if any is, else reference if any is; the largest overlap."""
    any_of = lambda r: F.bool_or(F.col("role") == r)
    return roles.groupBy("source_table").agg(F.when(any_of("flow"), "flow").when(any_of("reference"), "reference").otherwise("unknown").alias("role"), F.max("overlap").alias("overlap"))


def steps(access: DataFrame) -> DataFrame:
    """parent, child, routines of table hops: one step a routine, with its modes joined and its write kinds as a sorted set.

    access: routine, table, modes, write_kinds; hops come from table_hops over the same rows.
    """
    kinds = access.groupBy("routine", F.col("table").alias("parent")).agg(F.bit_or("modes").alias("modes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("write_kinds")))).alias("write_kinds"))
    met = table_hops(access).join(kinds, ["routine", "parent"])
    return met.groupBy("parent", "child").agg(F.array_sort(F.collect_list(F.struct("routine", "modes", "write_kinds"))).alias("routines"))


def children(hops: DataFrame, roles: DataFrame) -> DataFrame:
    """parent, child, role, overlap, total, place: the sources of each table in order of role, overlap and key.

    roles: target_table, source_table, overlap, total, role; hops without a mapping are unknown.
    """
    pairs = hops.select("parent", "child").distinct()
    r = roles.select(F.col("target_table").alias("parent"), F.col("source_table").alias("child"), "role", "overlap", "total")
    met = pairs.join(r, ["parent", "child"], "left").withColumns({"role": F.coalesce("role", F.lit("unknown")), "overlap": F.coalesce("overlap", F.lit(0)).cast("long")})
    rank = F.when(F.col("role") == "flow", 0).when(F.col("role") == "reference", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("parent").orderBy(rank, F.desc("overlap"), "child"))
    return met.select("parent", "child", "role", "overlap", "total", place.alias("place"))


def external_sources(hops: DataFrame) -> DataFrame:
    """table: sources that no hop writes, so their data comes from outside."""
    ends = hops.select(F.explode(F.array(F.struct(F.col("child").alias("table"), F.lit(False).alias("written")), F.struct(F.col("parent").alias("table"), F.lit(True).alias("written")))).alias("x"))
    return ends.groupBy("x.table").agg(F.bool_or("x.written").alias("written")).filter("NOT written").select("table")


def relations(hops: DataFrame) -> DataFrame:
    """parent, child, routines, n: one row a pair of tables, with the routines between them."""
    return hops.groupBy("parent", "child").agg(F.array_sort(F.collect_set("routine")).alias("routines")).withColumn("n", F.size("routines").cast("long"))
