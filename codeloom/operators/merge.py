"""Merging and deduplicating stores, and file change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, deleted, modified or unchanged. Tables: path, mtime, hash. Equal times are not hashed again."""
    o = old.select("path", F.col("mtime").alias("om"), F.col("hash").alias("oh"))
    n = new.select("path", F.col("mtime").alias("nm"), F.col("hash").alias("nh"))
    change = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "deleted").when((F.col("om") == F.col("nm")) | (F.col("oh") == F.col("nh")), "unchanged").otherwise("modified")
    return o.join(n, "path", "full").select("path", change.alias("change"))


def canonical_keys(nodes: DataFrame) -> DataFrame:
    """node_key, canonical over several stores (node_key, relaxed_key, store_ord).

    A key is itself; a key without a schema goes to the one qualified key of an earlier or later store that has the same
    relaxed form, if there is exactly one.
    """
    keys = nodes.select("node_key", "relaxed_key").distinct()
    full = keys.filter("node_key <> relaxed_key").groupBy("relaxed_key").agg(F.min("node_key").alias("one"), F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("relaxed_key").alias("node_key"), "one")
    return keys.select("node_key").join(full, "node_key", "left").select("node_key", F.coalesce("one", "node_key").alias("canonical"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row a canonical key: the first store that has it gives the payload."""
    rows = nodes.join(canonical_keys(nodes), "node_key")
    rank = F.row_number().over(Window.partitionBy("canonical").orderBy("store_ord", "node_key"))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r", "node_key").withColumnRenamed("canonical", "node_key")


def merge_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with canonical ends. Accesses of all stores become one an (ends, type); other edges are distinct within a store.

    Anchors are the same over all stores if ends and detail (kind, column and site) are.
    """
    e = edges if "detail" in edges.columns else edges.withColumn("detail", F.lit(None).cast("string"))
    for c in ("src_key", "dst_key"):
        e = e.join(keys.select(F.col("node_key").alias("_k"), F.col("canonical").alias("_c")), F.col(c) == F.col("_k")).drop("_k", c).withColumnRenamed("_c", c)
    access = e.filter("edge_type = 'TableAccess'").groupBy("src_key", "dst_key", "edge_type").agg(F.bit_or("modes").alias("modes")).withColumn("detail", F.lit(None).cast("string"))
    anchors = e.filter("edge_type = 'AnchorsOn'").select("src_key", "dst_key", "edge_type", F.lit(None).cast("int").alias("modes"), "detail").distinct()
    other = e.filter("edge_type NOT IN ('TableAccess', 'AnchorsOn')").select("store_ord", "src_key", "dst_key", "edge_type", "detail").distinct()
    return access.unionByName(anchors).unionByName(other.select("src_key", "dst_key", "edge_type", F.lit(None).cast("int").alias("modes"), "detail"))


def richness(row_columns: list[str]) -> list:
    """Order that puts the richer of two nodes first: explicit, complete, with a place, with more columns set."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in row_columns), F.lit(0))
    return [F.col("explicit").desc_nulls_last(), F.col("partial").asc_nulls_first(), filled.desc()]


def dedup(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with one row a key (the richer), edges rewired to them without repeats, and a report of counts before and after.

    Keys that differ by case are one node. If nodes has a column relaxed_key (the key without its schema), a node whose key is
    that form goes to the only fuller key of it. Edges that rewiring makes loops are dropped; accesses of one pair are joined,
    and anchors are one if their detail is.
    """
    low = F.lower("node_key")
    payload = [c for c in nodes.columns if c not in ("node_key", "relaxed_key")]
    named = nodes.withColumn("_low", low)
    if "relaxed_key" in nodes.columns:
        fuller = canonical_keys(nodes.select(low.alias("node_key"), F.lower("relaxed_key").alias("relaxed_key")))
        named = named.join(fuller.withColumnRenamed("node_key", "_low"), "_low").withColumn("_low", F.col("canonical")).drop("canonical")
    order = [*richness([c for c in payload if c not in ("explicit", "partial")]), (F.lower("node_key") != F.col("_low")).asc(), F.xxhash64("node_key", *payload)]
    rank = F.row_number().over(Window.partitionBy("_low").orderBy(*order))
    ranked = named.withColumn("_r", rank)
    n2 = ranked.filter("_r = 1").drop("_r", "_low")
    keys = ranked.select("node_key", F.first("node_key").over(Window.partitionBy("_low").orderBy("_r")).alias("_to")).distinct()
    e = edges.withColumn("_was_loop", F.col("src_key") == F.col("dst_key"))
    for c in ("src_key", "dst_key"):
        e = e.join(keys.select(F.col("node_key").alias("_k"), F.col("_to")), F.col(c) == F.col("_k"), "left").withColumn(c, F.coalesce("_to", c)).drop("_k", "_to")
    e = e.filter("src_key <> dst_key OR _was_loop").drop("_was_loop")
    rest = [c for c in edges.columns if c not in ("src_key", "dst_key", "edge_type", "modes", "write_kinds", "file", "line")]
    if "modes" in edges.columns:
        kinds = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("write_kinds")))).alias("write_kinds")] if "write_kinds" in edges.columns else []
        place = [F.min(c).alias(c) for c in ("file", "line") if c in edges.columns]
        joined = e.filter("edge_type = 'TableAccess'").groupBy("src_key", "dst_key", "edge_type", *(c for c in rest if c != "read_tables")).agg(
            F.bit_or("modes").alias("modes"), *kinds, *place, *([F.array_distinct(F.flatten(F.collect_list("read_tables"))).alias("read_tables")] if "read_tables" in rest else []))
        e = e.filter("edge_type <> 'TableAccess'").dropDuplicates(["src_key", "dst_key", "edge_type", *rest]).unionByName(joined)
    else:
        e = e.dropDuplicates(["src_key", "dst_key", "edge_type", *rest])
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    report = count(nodes, "nodes_before").unionByName(count(n2, "nodes_after")).unionByName(count(edges, "edges_before")).unionByName(count(e, "edges_after"))
    return n2, e, report
