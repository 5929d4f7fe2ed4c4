"""Stored indexes against scans, and the graph after changes of files against a full build."""

import random

from pyspark.sql import functions as F

from codeloom.functions.sqltext import matches
from codeloom.operators import indexes, search
from codeloom.operators.merge import change_set
from codeloom.sources import delta, ingest
from codeloom.work import materialize


def statement(r):
    columns, tables = "id name size kind brand".split(), "t_a t_b t_c area zone".split()
    some, table, k = r.sample(columns, r.randint(1, 3)), r.choice(tables), r.random()
    if k < 0.6:
        where = " and ".join(f"{c} {r.choice('=<')} {r.choice(['?', '1', 'name'])}" for c in r.sample(columns, r.randint(1, 3)))
        return f"select {', '.join(some)} from {table}" + (f" where {where}" if r.random() < 0.8 else "") + (f" order by {some[0]}" if r.random() < 0.2 else "")
    if k < 0.75:
        return f"update {table} set {some[0]} = ? where {some[-1]} = 2"
    if k < 0.85:
        return f"insert into {table} ({', '.join(some)}) values (1)"
    return r.choice(["?", "call p(?)", "x", "", "select ? from ?", f"? {table} ?", "from " + table])


def test_statement_index_loses_no_hit(spark):
    r = random.Random(5)
    rows = [(f"n{i}", statement(r), True) for i in range(250)] + [("none", None, True)]
    s = materialize(search.index(spark.createDataFrame(rows, "node_key string, sql_text string, indexed boolean")), "s")
    index = materialize(indexes.statement_index(s), "ix")
    asked = [statement(r) for _ in range(8)] + ["name from t_a where", "t_b", "where id = 1 and name", "explain select name from area where id = 4", ""]
    q = spark.createDataFrame([(x,) for x in asked], "q string")
    met = s.filter("sql_text IS NOT NULL").crossJoin(F.broadcast(q)).filter(matches(F.col("sql_text"), F.col("q"))).select("q", F.sha2("sql_text", 256).alias("sid")).distinct().collect()
    pruned = 0
    for text in asked:
        found = indexes.candidates(index, text)
        if found is not None:
            got = {x.sid for x in found.collect()}
            assert {x.sid for x in met if x.q == text} <= got, text
            pruned += len(got) < 120
    assert pruned >= 5


def test_name_index_finds_what_a_scan_finds(spark):
    keys = ["proc:a.pay", "proc:a.Payment", "table:b.pay_log", "func:pay", "pkg:x.pa", "sql:a.Pay.run:3", "custom:é pay"]
    nodes = spark.createDataFrame([(k,) for k in keys], "node_key string")
    degrees = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "node_key string, total long")
    index = materialize(indexes.name_index(nodes, degrees), "names")
    for mode, query in (("contains", "pay"), ("contains", "PA"), ("contains", "a.pay"), ("exact", "Pay"), ("contains", "payx"), ("contains", "papay")):
        want = [tuple(x) for x in search.search_names(nodes, degrees, query, mode).collect()]
        assert [tuple(x) for x in indexes.search_names(index, query, mode).collect()] == want, query


BASE = {
    "spec.sql": "CREATE PACKAGE s.pk AS TYPE ids IS TABLE OF INT; v_n INT := 0; v_ids ids; CURSOR c IS SELECT x.ref, x.note FROM b.t x; PROCEDURE run; END;",
    "body.sql": "CREATE PACKAGE BODY s.pk AS w_last INT; PROCEDURE run IS v INT; w INT; BEGIN OPEN c; FETCH c INTO v, w; INSERT INTO b.o (id, note) VALUES (v, w); v_ids(1) := 2; pk.v_ids(3) := 1; v_ids.extend(1); w_last(1); other(1); END; END;",
    "use.sql": "CREATE PROCEDURE s.q AS BEGIN pk.v_ids(1) := 3; pk.run(); pk.gone(2); UPDATE y SET (id, note) = (SELECT t.ref, upper(t.note) FROM b.t t WHERE t.id = 1); "
    "INSERT ALL INTO c.y (id) VALUES (ref) WHEN ref > 1 THEN INTO c.u (id, k) VALUES (ref + 1, 'x') INTO c.w SELECT id AS ref, note FROM b.t; END;",
    "t.sql": "CREATE TABLE b.t (id INT, ref INT, note INT); CREATE TABLE b.o (id INT, note INT); CREATE TABLE c.y (id INT); CREATE SYNONYM s.y FOR b.o;",
    "far.sql": "CREATE PROCEDURE z.far AS BEGIN DELETE FROM b.o; q(); END;",
    "A.java": "package j; class A { @Autowired private B b; void f() { b.g(); } }",
    "B.java": "package j; class B { void g() { } }",
}


def files(spark, texts):
    return spark.createDataFrame([(p, p.rpartition(".")[2], bytearray(t.encode())) for p, t in texts.items()], "path string, kind string, content binary")


def manifest(spark, texts):
    return files(spark, texts).select("path", F.lit(None).cast("long").alias("mtime"), F.sha2("content", 256).alias("hash"))


def as_set(df):
    return {str(r) for r in df.select(*sorted(df.columns)).collect()}


def test_package_scope_comes_from_another_file(spark):
    rows = materialize(ingest.parse(files(spark, BASE)), "rows")
    _n, e, m = ingest.build(rows)
    calls = {(r.src_key, r.dst_key) for r in e.filter("edge_type = 'DirectCall'").collect()}
    assert calls == {("proc:s.pk.run", "unres:other"), ("proc:s.q", "proc:s.pk.run"), ("proc:s.q", "unres:pk.gone"), ("proc:z.far", "proc:s.q")}
    got = {(r.target_table, r.target_column, r.source_table, r.source_column) for r in m.collect()}
    assert {("b.o", "id", "b.t", "ref"), ("b.o", "note", "b.t", "note"), ("c.y", "id", "b.t", "id"), ("c.u", "id", "b.t", "id"), ("c.w", "ref", "b.t", "id"), ("c.w", "note", "b.t", "note")} <= got
    # The owner's synonym counts, not the only table of that name elsewhere.
    assert ("proc:s.q", "table:b.o") in {(r.src_key, r.dst_key) for r in e.filter("edge_type = 'TableAccess'").collect()}


def test_changed_files_give_what_a_full_build_gives(spark):
    rows = materialize(ingest.parse(files(spark, BASE)), "rows")
    _n, edges, mappings = ingest.build(rows)
    mappings = materialize(mappings, "mappings")
    new = {k: v for k, v in BASE.items() if k != "B.java"}
    new["t.sql"] = BASE["t.sql"].replace("CREATE SYNONYM s.y FOR b.o;", "")
    new["spec.sql"] = BASE["spec.sql"].replace("v_ids ids;", "")
    new["more.sql"] = "CREATE FUNCTION other(x INT) RETURN INT IS BEGIN RETURN x; END;"
    after, dirty = delta.reparse(rows, files(spark, new), change_set(manifest(spark, BASE), manifest(spark, new)))
    assert {r.file for r in dirty.collect()} == {"t.sql", "spec.sql", "body.sql", "more.sql", "B.java"}
    got = delta.rebuild(rows, after, dirty, edges, mappings)
    owners = {r.owner for r in got[3].collect()}
    assert "proc:z.far" not in owners and {"proc:s.q", "proc:s.pk.run", "method:j.A.f"} <= owners
    want = ingest.build(materialize(ingest.parse(files(spark, new)), "rows"))
    for a, b in zip(got, want):
        assert as_set(a) == as_set(b)


def test_name_index_broadcasts_no_exploded_rows(spark):
    # Tables that look small to the planner; their grams are not.
    nodes = materialize(spark.createDataFrame([("proc:s1",), ("table:p21",)], "node_key string"), "n")
    totals = materialize(spark.createDataFrame([("proc:s1", 3), ("table:p21", 1)], "node_key string, total long"), "d")
    index = indexes.name_index(nodes, totals)
    assert "Broadcast" not in index._jdf.queryExecution().executedPlan().toString()
    assert {(r.node_key, r.total) for r in indexes.search_names(materialize(index, "ix"), "p21", limit=None).collect()} == {("table:p21", 1)}


def test_changed_accesses_alone_are_those_of_a_full_build(spark):
    records, kinds = ("access", "edge", "head", "item"), ("TableAccess",)
    rows = materialize(ingest.parse(files(spark, BASE), records=records), "rows")
    e, m = ingest.link(rows, materialize(ingest.definitions(rows), "defined"), ingest.package_items(rows), kinds)
    new = BASE | {"t.sql": BASE["t.sql"].replace("CREATE SYNONYM s.y FOR b.o;", "")}
    after, dirty = delta.reparse(rows, files(spark, new), change_set(manifest(spark, BASE), manifest(spark, new)), records)
    assert {r.record for r in after.select("record").distinct().collect()} <= {"access", "edge", "node", "item", "error"}
    got = delta.rebuild(rows, after, dirty, e, m, kinds)
    want = ingest.build(materialize(ingest.parse(files(spark, new)), "rows"))[1].filter("edge_type = 'TableAccess'")
    ends = ("src_key", "dst_key", "modes", "write_kinds")
    assert as_set(got[1].select(*ends)) == as_set(want.select(*ends)) and "proc:z.far" not in {r.owner for r in got[3].collect()}
