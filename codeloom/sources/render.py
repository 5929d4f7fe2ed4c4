"""Text views of results that are small by construction: trees and chains of one start, and one JSON document.

The rows come from a depth-bounded query; they are fetched one by one and never held beyond the tree itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(paths: DataFrame, separator: str = " > ", more: str | None = None) -> str:
    """A tree with box characters. paths: a column path of keys joined by the separator, each prefix being a row too."""
    root: dict = {}
    cut: dict[str, int] = {}
    columns = ["path"] + ([more] if more else [])
    for r in paths.select(*columns).orderBy("path").toLocalIterator():
        node = root
        for key in r.path.split(separator):
            node = node.setdefault(key, {})
        if more and r[more]:
            cut[r.path] = r[more]
    lines: list[str] = []

    def walk(node: dict, prefix: str, path: list[str]) -> None:
        for i, (key, below) in enumerate(sorted(node.items())):
            last = i == len(node) - 1
            here = [*path, key]
            hidden = cut.get(separator.join(here))
            lines.append(f"{prefix}{'' if not path else '└── ' if last else '├── '}{key}{f' (+{hidden} more)' if hidden else ''}")
            walk(below, prefix + ("" if not path else "    " if last else "│   "), here)

    walk(root, "", [])
    return "\n".join(lines)


def chains(paths: DataFrame, arrow: str = " → ", separator: str = " > ") -> str:
    """One line for each path, in order."""
    return "\n".join(r.path.replace(separator, arrow) for r in paths.select("path").distinct().orderBy("path").toLocalIterator())


def document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ord, line: one JSON document of nodes, edges and the types that occur, a row for each of them.

    export.write_lines() sorts the rows by ord; nothing but the few types is gathered. The first element of a list is the one
    without a comma before it.
    """
    spark = nodes.sparkSession
    kinds = nodes.agg(F.array_sort(F.collect_set("type_tag")).alias("node_types")).crossJoin(edges.agg(F.array_sort(F.collect_set("edge_type")).alias("edge_types")))  # one row each
    head = kinds.select(F.lit("0").alias("ord"), F.concat(F.lit('{"_meta":'), F.to_json(F.struct("node_types", "edge_types")), F.lit(',"nodes":[')).alias("line"))
    frame = spark.createDataFrame([("2", '],"edges":['), ("9", "]}")], "ord string, line string")
    place = F.concat_ws(" ", "src_key", "dst_key", "edge_type")
    n = nodes.select(F.concat(F.lit("1 "), "node_key").alias("ord"), F.to_json(F.struct("node_key", "type_tag", "name")).alias("json"))
    e = edges.select(F.concat(F.lit("3 "), place).alias("ord"), F.to_json(F.struct("src_key", "dst_key", "edge_type")).alias("json"))
    out = head.unionByName(frame)
    for rows in (n, e):
        first = rows.agg(F.min(F.struct("ord", "json")).alias("first"))
        # Of rows with one ord only one has no comma, as the rest come with a comma and a later place.
        numbered = rows.crossJoin(F.broadcast(first)).select("ord", "json", (F.struct("ord", "json") == F.col("first")).alias("is_first")).groupBy("ord", "json", "is_first").agg(F.count(F.lit(1)).alias("k"))
        again = numbered.select("ord", "json", "is_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
        lead = F.when(F.col("is_first") & (F.col("i") == 0), "").otherwise(",")
        out = out.unionByName(again.select(F.concat("ord", F.when(lead == ",", F.lit(" ,")).otherwise(F.lit(""))).alias("ord"), F.concat(lead, "json").alias("line")))
    return out


def read_statements(df: DataFrame) -> DataFrame:
    """A CSV of statements with its header brought to unique_sql_id and sql_text, whatever its case, blanks or underscores."""
    want = {"uniquesqlid": "unique_sql_id", "sqltext": "sql_text"}
    out = df
    for c in df.columns:
        plain = "".join(x for x in c.lower() if x.isalnum())
        if plain in want:
            out = out.withColumnRenamed(c, want[plain])
    missing = set(want.values()) - set(out.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return out


def snippet(text: str, line: int, context: int = 3) -> str:
    """Numbered lines around a place of a text."""
    lines = text.splitlines()
    first = max(1, line - context)
    return "\n".join(f"{'>' if i == line else ' '} {i:5} {lines[i - 1]}" for i in range(first, min(len(lines), line + context) + 1))


def to_json(rows: DataFrame) -> str:
    return json.dumps([r.asDict(True) for r in rows.toLocalIterator()], ensure_ascii=False)
