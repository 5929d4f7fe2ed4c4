import json

import pytest

from codeloom.operators import columns
from codeloom.sources import ingest, render
from codeloom.sources.plsql import read_sql

DDL = """
CREATE TABLE s.t (id NUMBER(10, 2) NOT NULL, name VARCHAR(20) DEFAULT 'x' , a INT, b INT UNIQUE, CONSTRAINT pk PRIMARY KEY (id, a));
COMMENT ON COLUMN s.t.name IS 'the ''name''';
COMMENT ON TABLE s.t IS 'about';
CREATE PROCEDURE p AS BEGIN
  MERGE INTO s.t g USING src z ON (g.id = z.id) WHEN MATCHED THEN UPDATE SET g.name = z.n WHEN NOT MATCHED THEN INSERT (id, a) VALUES (z.id, z.q + 1);
  SELECT CASE k.kind WHEN 'A' THEN 'Active' WHEN 'B' THEN 'Bad' ELSE 'o' END, DECODE(k.x, 1, 'one', 2, 'two', 'none') INTO v, w FROM kinds k;
END;
"""


def test_definitions_merges_and_enums():
    f = read_sql(DDL, "d.sql")
    assert [c[1:7] for c in f.columns] == [(0, "id", "NUMBER(10,2)", False, True, None), (1, "name", "VARCHAR(20)", True, False, "'x'"), (2, "a", "INT", False, True, None), (3, "b", "INT", True, False, None)]
    assert f.comments == [("table:s.t", "name", "the 'name'", 3), ("table:s.t", None, "about", 4)]
    assert {(m[2], m[4], m[5], m[6]) for m in f.mappings if m[1] == "s.t"} == {("name", "src", "n", "direct"), ("id", "src", "id", "direct"), ("a", "src", "q", "derived")}
    assert {e[1:5] for e in f.enums} == {("kinds", "kind", "'A'", "'Active'"), ("kinds", "kind", "'B'", "'Bad'"), ("kinds", "x", "1", "'one'"), ("kinds", "x", "2", "'two'")}
    assert {n["node_key"] for n in f.nodes if n["type_tag"] == "index"} == {"index:t_pk_id_a", "index:t_uk_b"}


def test_table_schemas(spark):
    files = spark.createDataFrame([("d.sql", "sql", bytearray(DDL.encode())), ("e.sql", "sql", bytearray(b"CREATE TABLE s.t (z INT);"))], "path string, kind string, content binary")
    rows = ingest.parse(files)
    got = {r.table_key: r.columns for r in columns.table_schemas(rows.filter("file = 'd.sql'")).collect()}
    assert [(c.name, c.primary_key, c.comment) for c in got["table:s.t"]] == [("id", True, None), ("name", False, "the 'name'"), ("a", True, None), ("b", False, None)]
    assert [(r.rule, r.subject) for r in columns.schema_diagnostics(rows).collect()] == [("duplicate-table", "table:s.t")]
    assert columns.enum_mappings(rows).count() == 4


def test_text_views(spark):
    paths = spark.createDataFrame([("a", 0), ("a > b", 0), ("a > c", 2), ("a > b > d", 0)], "path string, more int")
    assert render.tree(paths, more="more") == "a\n├── b\n│   └── d\n└── c (+2 more)"
    assert render.chains(paths).splitlines()[1] == "a → b"
    nodes = spark.createDataFrame([("n", "proc", "n")], "node_key string, type_tag string, name string")
    edges = spark.createDataFrame([("n", "n", "DirectCall")], "src_key string, dst_key string, edge_type string")
    doc = json.loads("".join(r.line for r in render.document(nodes, edges.union(edges)).orderBy("ord").collect()))
    assert doc == {"_meta": {"node_types": ["proc"], "edge_types": ["DirectCall"]}, "nodes": [{"node_key": "n", "type_tag": "proc", "name": "n"}], "edges": [{"src_key": "n", "dst_key": "n", "edge_type": "DirectCall"}] * 2}
    assert json.loads("".join(r.line for r in render.document(nodes.limit(0), edges.limit(0)).orderBy("ord").collect()))["nodes"] == []
    csv = spark.createDataFrame([("1", "x", "y")], ["Unique SQL ID", "SQL_Text", "other"])
    assert render.read_statements(csv).columns == ["unique_sql_id", "sql_text", "other"]
    with pytest.raises(ValueError):
        render.read_statements(csv.select("other"))
    assert render.snippet("a\nb\nc", 2, 1).splitlines()[1].startswith(">")
