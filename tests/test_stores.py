"""Interchange documents, saved graphs, exports and the stream of files."""

import json
import shutil

import pytest

from codeloom.sources import export, interchange, store
from codeloom.streaming import incremental

DOC = {
    "format_version": 1, "metadata": {"source": "x"}, "node_schemas": {"report": {"display_name": "Report", "key_fields": ["name"]}}, "edge_schemas": {},
    "nodes": [
        {"id": "1", "type": "table", "key": {"schema": "S", "name": "T"}, "location": {"file": "./a/b.sql", "line": 3}}, {"id": "2", "type": "report", "key": {"title": "q"}},
        {"id": "2", "type": "odd", "key": {"name": "o"}}, {"id": "3", "type": "procedure", "key": {"name": "P"}},
    ],
    "edges": [{"source": "3", "target": "1", "type": "TableAccess"}, {"source": "3", "target": "9", "type": "feeds"}],
}


def test_interchange(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOC))
    (tmp_path / "e.json").write_text(json.dumps({"format_version": 2, "nodes": [], "edges": []}))
    docs = interchange.read(spark, f"file://{tmp_path}")
    got = {(r.rule, r.subject) for r in interchange.validate_documents(docs).collect()}
    assert got == {("duplicate-id", "2"), ("dangling-end", "9"), ("undeclared-node-type", "odd"), ("undeclared-edge-type", "feeds"), ("missing-key-field", "2"), ("format-version", "2"), ("empty-document", None)}
    nodes, edges = interchange.import_graph(docs, "root")
    assert {r.node_key: r.file for r in nodes.collect()}["table:s.t"] == "root/a/b.sql"
    assert [(r.src_key, r.dst_key) for r in edges.collect()] == [("proc:p", "table:s.t")]


def test_store_and_exports(spark, tmp_path):
    nodes = spark.createDataFrame([('proc:a"', "proc", "a"), ("table:t", "table*", "t"), ("mapper:m", "mapper", "m")], "node_key string, type_tag string, name string")
    edges = spark.createDataFrame([('proc:a"', "table:t", "TableAccess", "dataflow", 5), ("mapper:m", 'proc:a"', "CallsProcedure", "call", None)], "src_key string, dst_key string, edge_type string, category string, modes int")
    path = f"file://{tmp_path}/store"
    for form in ("parquet", "json"):
        store.save(path, nodes, edges, edges, nodes, form)
        got = store.load(spark, path)
        assert got["nodes"].count() == 3 and {r.src_key for r in got["edges"].filter("category = 'call'").collect()} == {"mapper:m"}
    (tmp_path / "store/_meta").rename(tmp_path / "old")
    shutil.copytree(tmp_path / "old", tmp_path / "store/_meta")
    for p in (tmp_path / "store/_meta").iterdir():
        if p.name.endswith(".json"):
            p.write_text('{"version": 99, "form": "json"}')
        elif p.name.endswith(".crc"):
            p.unlink()
    with pytest.raises(ValueError):
        store.load(spark, path)
    lines = [r.line for r in export.dot(nodes, edges).orderBy("ord").collect()]
    assert lines[0] == "digraph code {" and lines[-1] == "}" and '  "proc:a\\"" [shape=box];' in lines and len(lines) == 7
    clustered = [r.line for r in export.dot(nodes, edges, nodes.filter("type_tag = 'proc'").selectExpr("node_key", "'c' AS cluster")).orderBy("ord").collect()]
    assert clustered[1].strip() == 'subgraph "cluster_c" {' and clustered[3].strip() == "}"
    assert export.mermaid(nodes, edges).count() == 6 and [json.loads(r.line)["record"] for r in export.ndjson(nodes, edges).orderBy("ord").collect()] == ["node"] * 3 + ["edge"] * 2
    export.write_lines(export.ndjson(nodes, edges), f"file://{tmp_path}/out")
    assert sum(len(p.read_text().splitlines()) for p in sorted((tmp_path / "out").glob("part-*"))) == 5
    n, e = export.thin(nodes, edges)
    assert n.count() == 2 and e.collect()[0].modes == ["read", "lock"]
    assert export.filtered(nodes, edges, "table:t")[0].count() == 2


def test_thin_graph_keeps_edges_to_ends_without_a_node(spark):
    nodes = spark.createDataFrame([("proc:a", "proc", "a"), ("class:c", "class", "c"), ("table:t", "table*", "t")], "node_key string, type_tag string, name string")
    ends = [("proc:a", "proc:gone"), ("proc:a", "table:t"), ("proc:a", "class:c"), ("proc:a", "unres:x"), ("class:c", "proc:a")]
    edges = spark.createDataFrame([(a, b, "DirectCall", None) for a, b in ends], "src_key string, dst_key string, edge_type string, modes int")
    assert {(r.src_key, r.dst_key) for r in export.thin(nodes, edges)[1].collect()} == {("proc:a", "proc:gone"), ("proc:a", "table:t")}


def test_stream_parses_new_files_once(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    out, check = f"file://{tmp_path}/rows", f"file://{tmp_path}/check"
    (src / "a.sql").write_text("SELECT * FROM t1;")
    incremental.start(spark, f"file://{src}", out, check).awaitTermination()
    (src / "b.sql").write_text("SELECT * FROM t2;")
    incremental.start(spark, f"file://{src}", out, check).awaitTermination()
    assert sorted(r.b for r in incremental.current(spark, out).filter("record = 'access'").collect()) == ["t1", "t2"]


def test_refresh_sees_changed_and_deleted_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    root, out = f"file://{src}", f"file://{tmp_path}/out"
    tables = lambda: sorted(r.b for r in incremental.refreshed(spark, out).filter("record = 'access'").collect())
    changes = lambda: {r.path: r.change for r in incremental.refresh(spark, root, out).collect()}
    for name in "abc":
        (src / f"{name}.sql").write_text(f"SELECT * FROM {name}1;")
    assert changes() == {"a.sql": "added", "b.sql": "added", "c.sql": "added"} and tables() == ["a1", "b1", "c1"]
    (src / "a.sql").write_text("SELECT * FROM a2;")
    (src / "b.sql").unlink()
    assert changes() == {"a.sql": "modified", "b.sql": "deleted", "c.sql": "unchanged"} and tables() == ["a2", "c1"]
    (src / "b.sql").write_text("SELECT * FROM b3;")
    assert changes()["b.sql"] == "added" and tables() == ["a2", "b3", "c1"]
