"""A code graph derived from relational tables: suppliers are procedures, nations packages, parts tables, line items accesses.

The same views exist as DataFrames and as SQL for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codeloom.work import tasks_for

# The views in SQL that both engines run.
VIEWS = {
    "g_proc": "SELECT CAST(s_suppkey AS BIGINT) AS id, 'proc:s' || s_suppkey AS node_key, 'pkg:n' || s_nationkey AS pkg_key, 'src/n' || s_nationkey || '.sql' AS file, 's' || s_suppkey AS name FROM supplier",
    "g_table": "SELECT CAST(p_partkey AS BIGINT) AS id, 'table:p' || p_partkey AS node_key, p_size > 10 AS explicit, 'ddl/' || p_brand || '.sql' AS file, 'p' || p_partkey AS name FROM part",
    "g_raw": "SELECT l_suppkey AS proc_id, l_partkey AS table_id, (CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 4 END) + (CASE WHEN l_quantity >= 50 THEN 8 ELSE 0 END) AS mode, "
    "CASE WHEN l_quantity >= 50 THEN 'truncate' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'update' WHEN l_returnflag = 'R' THEN 'insert' END AS write_kind FROM lineitem",
    "g_access": "SELECT proc_id, table_id, CAST(bit_or(mode) AS INT) AS modes, count(*) AS n FROM g_raw GROUP BY proc_id, table_id",
    "g_call": "SELECT s.s_suppkey AS src, CAST((s.s_suppkey * 7) % n.cnt + 1 AS BIGINT) AS dst FROM supplier s, (SELECT count(*) AS cnt FROM supplier) n WHERE s.s_suppkey % 3 <> 0 "
    "UNION ALL SELECT s.s_suppkey AS src, CAST((s.s_suppkey * 5) % n.cnt + 1 AS BIGINT) AS dst FROM supplier s, (SELECT count(*) AS cnt FROM supplier) n WHERE s.s_suppkey % 4 = 0",
    "g_sql": "SELECT CAST(p_partkey AS BIGINT) AS id, 'SELECT name  FROM part_' || (p_partkey % 20) || ' WHERE size = ' || p_size || ' AND brand = ''' || p_brand || '''' "
    "|| CASE WHEN p_partkey % 5 = 0 THEN ' FOR UPDATE' ELSE '' END AS sql_text FROM part",
    "g_nodes": "SELECT node_key, 'proc' AS type_tag, name, file, true AS explicit FROM g_proc UNION ALL SELECT node_key, CASE WHEN explicit THEN 'table' ELSE 'table*' END AS type_tag, name, file, explicit FROM g_table "
    "UNION ALL SELECT 'pkg:n' || n_nationkey AS node_key, 'pkg' AS type_tag, 'n' || n_nationkey AS name, 'src/n' || n_nationkey || '.sql' AS file, true AS explicit FROM nation",
    "g_edges": "SELECT 'proc:s' || proc_id AS src_key, 'table:p' || table_id AS dst_key, 'TableAccess' AS edge_type, 'dataflow' AS category, modes FROM g_access "
    "UNION ALL SELECT 'proc:s' || src AS src_key, 'proc:s' || dst AS dst_key, 'DirectCall' AS edge_type, 'call' AS category, CAST(NULL AS INT) AS modes FROM g_call "
    "UNION ALL SELECT pkg_key AS src_key, node_key AS dst_key, 'ContainsRoutine' AS edge_type, 'composition' AS category, CAST(NULL AS INT) AS modes FROM g_proc",
    # Column c of part p is written by the routine of its lines from column c of the next part.
    "g_colmap": "SELECT DISTINCT 'p' || l_partkey AS target_table, 'c' || (l_partkey % 3) AS target_column, 'p' || (l_partkey * 3 % 97 + 1) AS source_table, 'c' || ((l_partkey * 3 % 97 + 1) % 3) AS source_column, "
    "'proc:s' || (l_partkey % 10 + 1) AS owner_key FROM lineitem",
    # Statements: an order is a statement of one of 997 routines that accesses the parts of its lines.
    "g_stmt": "SELECT l_orderkey AS statement, 'o' || (l_orderkey % 997) AS routine, 'p' || l_partkey AS tab, CAST(bit_or(CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END) AS INT) AS modes FROM lineitem GROUP BY l_orderkey, l_partkey",
    # A statement for each routine, so that a search by text finds routines that others call.
    "g_body": "SELECT node_key, 'SELECT name FROM part_' || (id % 20) || ' WHERE size = ' || id AS sql_text FROM g_proc",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASE = ("supplier", "part", "lineitem", "nation", "orders", "documents")


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All views as lazy DataFrames; only what a query uses is read."""
    tables = {t: read(spark, sf_dir, t) for t in _BASE}
    out: dict[str, DataFrame] = {}
    for name, text in VIEWS.items():
        # Every view is given what it may name; names are bound when the query is analysed.
        used = {k: v for k, v in {**tables, **out}.items() if f" {k}" in text}
        if name == "g_access":
            # There are about as many accesses as line items: tasks follow the size of these, and not the number of shuffle partitions.
            used["g_raw"] = used["g_raw"].repartition(tasks_for(spark, f"{sf_dir}/lineitem.parquet"), "proc_id", "table_id")
        body = text
        for k in sorted(used, key=len, reverse=True):
            body = _bind(body, k)
        out[name] = spark.sql(body, **used)
    return out


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view g_stmt over line items that lie together by order."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").repartition("l_orderkey")
    return spark.sql(_bind(VIEWS["g_stmt"], "lineitem"), lineitem=lines)


def _bind(text: str, name: str) -> str:
    return re.sub(rf"(\bFROM|\bJOIN|,) +{name}\b", rf"\1 {{{name}}}", text)


def with_sql(*names: str, recursive: str = "") -> str:
    """WITH clause of the named views and all they need, in order."""
    need, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [k for k in VIEWS if f" {k}" in VIEWS[n]]
    parts = [f"{k} AS ({VIEWS[k]})" for k in VIEWS if k in need]
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(parts) + (", " + recursive if recursive else "") + "\n"
