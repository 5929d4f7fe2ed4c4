"""Node listings, degrees, statistics, file dependencies and summaries. One row in, few columns out; no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.model import READ, WRITE


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_key, in_degree, out_degree, total; parallel edges count each. One aggregation over both ends of the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_key").alias("k"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_key").alias("k"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy(F.col("e.k").alias("_k")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("node_key").join(counts, F.col("node_key") == F.col("_k"), "left").select(
        "node_key", zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("total")
    )


def low_degree(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    return degrees(nodes, edges).filter(F.col("total") <= most)


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes into which no edge leads."""
    return nodes.join(edges.select(F.col("dst_key").alias("node_key")).distinct(), "node_key", "left_anti")


def dead_routines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Complete procedures and functions without any edge."""
    ends = edges.select(F.explode(F.array("src_key", "dst_key")).alias("node_key")).distinct()
    return nodes.filter(F.col("type_tag").isin("proc", "func")).join(ends, "node_key", "left_anti")


def node_filter(tag: str | None = None, schema: str | None = None, predicate: Column | None = None) -> Column:
    """Tag and schema ignore case and are compared whole, so proc is not proc*."""
    out = F.lit(True)
    if tag is not None:
        out = out & (F.lower("type_tag") == tag.lower())
    if schema is not None:
        out = out & (F.lower("schema_name") == schema.lower())
    return out if predicate is None else out & predicate


def edge_filter(categories: list[str] | None = None, predicate: Column | None = None) -> Column:
    out = F.lower("category").isin(*map(str.lower, categories)) if categories else F.lit(True)
    return out if predicate is None else out & predicate


SORT_COLUMNS = {"name": "name", "type": "type_tag", "in": "in_degree", "out": "out_degree", "total": "total"}


def parse_sort(spec: str) -> list[Column]:
    """name:asc,total:desc and so on; the node key comes last, so that pages are stable."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, _, way = part.partition(":")
        if name not in SORT_COLUMNS or way not in ("", "asc", "desc"):
            raise ValueError(f"cannot sort by {part!r}")
        c = F.col(SORT_COLUMNS[name])
        out.append(c.desc() if way == "desc" else c.asc())
    return [*out, F.col("node_key").asc()]


def list_nodes(
    nodes: DataFrame, edges: DataFrame, search: str | None = None, tag_prefix: str | None = None, tag: str | None = None, inferred: bool = False,
    most_degree: int | None = None, sort: str = "name", offset: int = 0, limit: int | None = 100, system: bool | None = None, known: DataFrame | None = None,
    partitioned: bool = False, distributed: bool = False,
) -> DataFrame:
    """A page of nodes with their degrees. The cheap filters come before the degree join. Without a limit it is the whole list,
    whose count is the total of its pages.

    partitioned, distributed: tables whose definition (sql) has such a clause.

    known: degrees that are stored beside the graph; without them they are counted from all edges.
    """
    out = nodes
    if search:
        out = out.filter(F.lower("node_key").contains(search.lower()))
    if tag_prefix:
        out = out.filter(F.lower("type_tag").startswith(tag_prefix.lower()))
    if tag:
        out = out.filter(node_filter(tag))
    if inferred:
        out = out.filter(~F.col("explicit"))
    for wanted, clause in ((partitioned, r"\bpartition\s+by\b"), (distributed, r"\bdistribute\s+by\b")):
        if wanted:
            out = out.filter(F.lower("sql").rlike(clause))
    if system is not None:
        out = out.filter(F.coalesce("system", F.lit(False)) == system)
    out = out.join(degrees(out, edges) if known is None else known, "node_key")
    if most_degree is not None:
        out = out.filter(F.col("total") <= most_degree)
    out = out.orderBy(*parse_sort(sort))
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def store_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, n: nodes of each tag, all edges, all files."""
    return (
        nodes.groupBy(F.concat(F.lit("node:"), "type_tag").alias("what")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "n"))
        .unionByName(nodes.agg(F.count_distinct("file").alias("n")).select(F.lit("files").alias("what"), "n"))
    )


def file_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def reverse_file_deps(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """file, used_by: files whose nodes have edges into the file, itself excluded.

    tasks: how many tasks pairs of file and node are dealt to; None: as many as a shuffle has partitions.
    """
    where = nodes.select("node_key", "file").filter("file is not null")
    src = where.select(F.col("node_key").alias("src_key"), F.col("file").alias("used_by"))
    dst = where.select(F.col("node_key").alias("dst_key"), "file")
    # Edges shrink to distinct pairs of file and node before the second join.
    half = edges.select("src_key", "dst_key").join(src, "src_key").select("used_by", "dst_key")
    half = (half if tasks is None else half.repartition(tasks, "dst_key")).distinct()
    return half.join(dst, "dst_key").filter("file <> used_by").select("file", "used_by").distinct()


def package_tables(edges: DataFrame) -> DataFrame:
    """package, table, modes, usage: what the routines of each package do with each table."""
    inside = edges.filter("edge_type = 'ContainsRoutine'").select(F.col("src_key").alias("package"), F.col("dst_key").alias("src_key"))
    access = edges.filter("edge_type = 'TableAccess'").select("src_key", F.col("dst_key").alias("table"), "modes")
    out = access.join(inside, "src_key").groupBy("package", "table").agg(F.bit_or("modes").alias("modes"))
    r, w = F.col("modes").bitwiseAND(READ) != 0, F.col("modes").bitwiseAND(WRITE) != 0
    return out.withColumn("usage", F.when(r & w, "READ+WRITE").when(w, "WRITE").when(r, "READ").otherwise("OTHER"))


def merge_access(raw: DataFrame, keys: list[str]) -> DataFrame:
    """One access a key: modes joined bit by bit, write kinds as a sorted set."""
    return raw.groupBy(*keys).agg(F.bit_or("mode").cast("int").alias("modes"), F.array_sort(F.collect_set("write_kind")).alias("write_kinds"))


def edge_labels(edges: DataFrame, label: Column) -> DataFrame:
    """src_key, dst_key and the distinct labels of all edges between them."""
    return edges.select("src_key", "dst_key", label.alias("label")).filter("label is not null").groupBy("src_key", "dst_key").agg(F.array_join(F.array_sort(F.collect_set("label")), ";").alias("labels"))


def drop_identical(edges: DataFrame) -> DataFrame:
    """Edges without repeats of the same ends, type and payload; of several places the first stays."""
    payload = [c for c in edges.columns if c not in ("file", "line")]
    place = [c for c in ("file", "line") if c in edges.columns]
    if not place:
        return edges.dropDuplicates()
    return edges.groupBy(*payload).agg(F.min(F.struct(*place)).alias("_p")).select(*payload, "_p.*")


def tags(nodes: DataFrame) -> DataFrame:
    """node_key, tag, sub_tag (defined, inferred or partial) and display, what a node is called in listings."""
    tag = F.regexp_replace("type_tag", r"\*$", "")
    partial = F.col("partial") if "partial" in nodes.columns else F.lit(False)
    sub = F.when(partial, "partial").when(F.col("type_tag").endswith("*"), "inferred").otherwise("defined")
    return nodes.select("node_key", tag.alias("tag"), sub.alias("sub_tag"), F.concat_ws(" ", tag, F.coalesce("name", "node_key")).alias("display"))
