import json

from codeloom.api import Config, Project
from codeloom.operators import columns
from codeloom.sources.plsql import read_sql

SQL = """
CREATE TABLE orders (id INT, status VARCHAR(1));
CREATE TABLE audit_log (id INT);
CREATE PROCEDURE audit_it(p INT) AS BEGIN INSERT INTO audit_log (id) SELECT o.id FROM orders o WHERE o.status = 'A'; END;
CREATE PROCEDURE main_p(p IN INT) AS v VARCHAR(1); BEGIN
  SELECT o.status INTO v FROM orders o WHERE o.id = p;
  IF v = 'X' AND p > 3 THEN audit_it(p); END IF;
  FOR r IN (SELECT id, status FROM orders) LOOP IF r.status IN ('B', 'C') THEN TRUNCATE TABLE orders; END IF; END LOOP;
END;
"""


def test_predicates_tell_where_values_come_from():
    got = {(p[2], p[3], p[4], p[6]) for p in read_sql(SQL, "f").predicates}
    assert got == {("orders", "status", "=", "medium"), (None, None, ">", "low"), ("orders", "status", "in", "high")}


def test_project_from_sources_to_answers(spark, tmp_path):
    (tmp_path / "a.sql").write_text(SQL)
    (tmp_path / "codeloom.toml").write_text('exclude = ["skip*"]\ndiscriminators = ["status"]\nunknown = 1\n')
    config = Config.read(tmp_path / "codeloom.toml")
    p = Project(spark, f"file://{tmp_path}", f"file://{tmp_path}/.store", config)
    p.analyze()
    assert {r.what: r.n for r in p.run("stats").collect()}["node:proc"] == 2
    assert [r.change for r in p.diff().collect()] == ["unchanged"]
    assert {r.node_key for r in p.run("impact", name="table:audit_log", depth=3).filter("direction = 'in'").collect()} == {"proc:audit_it", "proc:main_p"}
    assert {r.node_key for r in p.run("impact", name="a.sql").collect()} == set()  # all of it is in the file
    assert [(r.parent, r.child, r.role) for r in p.run("sources").collect()] == [("audit_log", "orders", "flow")]
    assert {(r.proc_a, r.proc_b, r.table_key) for r in p.run("conflicts").collect()} == {("proc:audit_it", "proc:main_p", "table:orders")}
    assert [r.path for r in p.run("lineage", name="audit_log.id").collect()] == ["audit_log.id < orders.id"]
    assert {r.table for r in p.run("lineage", name="table:audit_log").collect()} == {"table:orders"}
    assert {(r.column, r.value, r.confidence) for r in columns.discriminator_values(p.rows(), ["status"]).collect()} == {("status", "A", "medium"), ("status", "X", "high"), ("status", "B", "medium"), ("status", "C", "medium")}
    assert p.run("columns", name="main_p").first().parameters[0].name == "p"
    assert {tuple(r.operations) for r in columns.table_operations(p.graph()["edges"]).collect()} == {("read", "truncate"), ("insert_select",)}
    assert [r.node_key for r in p.run("trace-sql", name="INSERT INTO audit_log (id) SELECT o.id FROM orders o WHERE o.status = 'Z'").select("node_key").distinct().collect()] == ["proc:audit_it"]
    for command in ("nodes", "files", "trace", "detail", "chain-files", "relations", "partition", "cycles", "dedup", "predicates"):
        p.run(command, name="main_p" if command in ("trace", "detail", "chain-files") else None).collect()
    p.export("json", f"file://{tmp_path}/json")
    json.dumps(config.__dict__)
