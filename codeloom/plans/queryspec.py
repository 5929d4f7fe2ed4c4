"""The declarative query: a JSON document of start, steps and what to collect, compiled to DataFrames.

{"start": {"type": "proc", "name": "s1", "schema": null},
 "steps": [{"direction": "out", "depth": 3, "edges": ["call"], "until": "table:p1"}], "collect": "nodes"}

Steps are folded into one traversal in which the last direction, filter and depth win. collect: nodes, paths or subgraph
(which is nodes). Starts meet all criteria that are given; without any criterion the document is wrong.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.listing import edge_filter
from codeloom.operators.traverse import paths, reachable

CATEGORIES = ("call", "dataflow", "reference", "composition", "inheritance")


@dataclass
class Traversal:
    direction: str = "out"
    depth: int | None = None
    categories: list[str] = field(default_factory=list)
    node_type: str | None = None
    until: str | None = None
    target: str | None = None


@dataclass
class QuerySpec:
    start: dict
    traversal: Traversal
    collect: str = "nodes"


def parse(text: str) -> QuerySpec:
    doc = json.loads(text)
    start = {k: v for k, v in doc.get("start", {}).items() if v is not None}
    if not start or set(start) - {"type", "name", "schema"}:
        raise ValueError("start needs type, name or schema")
    t = Traversal()
    for step in doc.get("steps", []):
        for k, v in step.items():
            if k == "edges":
                wrong = [c for c in v if c.lower() not in CATEGORIES]
                if wrong:
                    raise ValueError(f"no such category: {wrong[0]}")
                t.categories = [c.lower() for c in v]
            elif k == "direction":
                t.direction = {"outgoing": "out", "incoming": "in"}.get(v.lower(), v.lower())
                if t.direction not in ("out", "in", "both"):
                    raise ValueError(f"no such direction: {v}")
            elif k in ("depth", "until", "target"):
                setattr(t, k, v)
            elif k == "nodes":
                t.node_type = v
            else:
                raise ValueError(f"no such step: {k}")
    collect = doc.get("collect", "nodes")
    if collect not in ("nodes", "paths", "subgraph"):
        raise ValueError(f"cannot collect {collect}")
    return QuerySpec(start, t, collect)


def starts(nodes: DataFrame, start: dict) -> DataFrame:
    out = nodes
    if "type" in start:
        out = out.filter(F.lower("type_tag") == start["type"].lower())
    if "schema" in start:
        out = out.filter(F.lower("schema_name") == start["schema"].lower())
    if "name" in start:
        out = out.filter(F.lower("node_key").contains(start["name"].lower()))
    return out.select("node_key")


def execute(nodes: DataFrame, edges: DataFrame, spec: QuerySpec | str) -> DataFrame:
    """node_key and type_tag, or path and n."""
    spec = parse(spec) if isinstance(spec, str) else spec
    t = spec.traversal
    e = edges.filter(edge_filter(t.categories or None))
    if spec.collect == "paths":
        if t.node_type:  # in paths the filter prunes
            ok = nodes.filter(F.lower("type_tag") == t.node_type.lower()).select(F.col("node_key").alias("dst_key"))
            e = e.join(ok, "dst_key", "left_semi")
        out = paths(e, starts(nodes, spec.start), t.direction, t.depth or 10, t.target, F.col("dst") == t.until if t.until else None)
        return out.select(F.array_join("path", " > ").alias("path"), "n")
    found = reachable(e, starts(nodes, spec.start), t.direction, t.depth, F.col("node_key") == t.until if t.until else None)
    out = found.select("node_key").distinct().join(nodes.select("node_key", "type_tag"), "node_key")
    return out.filter(F.lower("type_tag") == t.node_type.lower()) if t.node_type else out
