import pytest

from codeloom.operators import columns
from codeloom.sources import ingest
from codeloom.sources.other import lex_jsp, read_java, read_jsp, read_mapper

MAPPER = b"""<?xml version="1.0"?><!DOCTYPE mapper PUBLIC "-//x//DTD" "http://x/y.dtd">
<mapper namespace="com.x.OrderMapper">
 <sql id="cols">id, name</sql>
 <select id="find">SELECT <include refid="cols"/> FROM orders <where><if test="a">AND a = #{a}</if><choose><when test="b">AND b = 1</when><otherwise>AND c = 2</otherwise></choose></where></select>
 <update id="go" statementType="CALLABLE">{call pkg_order.go(#{id})}</update>
</mapper>"""

JAVA = """package com.x; import com.x.OrderMapper;
public class OrderService extends Base implements Api {
  private static final String SQL = "SELECT a " + "FROM items";
  @Autowired private OrderMapper orderMapper;
  public OrderService(Helper helper) { this.h = helper; }
  /* comment { */
  @Select("SELECT x FROM t1") List<A> all();
  public void run(int n) { orderMapper.find(n); helper.work(); conn.prepareStatement("UPDATE t2 SET x = 1 WHERE id = " + n); sqlSession.selectOne("com.x.OrderMapper.find", n); local(); }
  void local() { char c = '{'; }
}
class Helper { void work() {} }
interface OrderMapper { A find(int n); }
class Base {}
"""


def test_mapper_statements_and_variants():
    got = {s["statement_id"]: s for s in read_mapper(MAPPER)}
    assert got["find"]["variants"] == ["SELECT id, name FROM orders where a = ? AND b = 1", "SELECT id, name FROM orders where a = ? AND c = 2", "SELECT id, name FROM orders where b = 1", "SELECT id, name FROM orders where c = 2"]
    assert got["go"]["kind"] == "procedure" and read_mapper(b"<beans/>") == [] and read_mapper(b"<broken") == []


def test_java_structure():
    j = read_java(JAVA)
    assert [(c["fqn"], c["extends"], c["implements"]) for c in j["classes"]][0] == ("com.x.OrderService", ["Base"], ["Api"])
    assert {m["fqn"] for m in j["methods"]} >= {"com.x.OrderService.run", "com.x.OrderService.local", "com.x.Helper.work"}
    assert {s["sql"] for s in j["sql"]} == {"SELECT a FROM items", "SELECT x FROM t1", "UPDATE t2 SET x = 1 WHERE id = ?"}
    assert {(c["object"], c["callee"]) for c in j["calls"]} >= {("orderMapper", "find"), ("helper", "work"), (None, "local"), ("sqlSession", "selectOne")}


def test_jsp_segments():
    page = '<%@ page x %>\n<%! int f() { return 1; } %><%-- c --%>text <%= a %>\n<% stmt.executeQuery("SELECT * FROM t9 WHERE a = ${q}"); %>'
    assert [k for k, _, _ in lex_jsp(page)] == ["directive", "text", "declaration", "comment", "text", "expression", "text", "scriptlet"]
    assert [s["sql"] for s in read_jsp(page, "p")["sql"]] == ["SELECT * FROM t9 WHERE a = <EL_q>"]


def test_analyze_resolves_over_all_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("CREATE TABLE s.orders (id INT);\nCREATE PROCEDURE main_p AS BEGIN pkg_order.go(1); nowhere(2); UPDATE orders SET x = 1; SELECT 1 INTO v FROM other; END;")
    (tmp_path / "sub" / "b.sql").write_bytes("CREATE PACKAGE BODY pkg_order AS PROCEDURE go(i INT) IS BEGIN inner_p; END; PROCEDURE inner_p IS BEGIN NULL; END; END; -- 中文".encode("gbk"))
    (tmp_path / "m.xml").write_bytes(MAPPER)
    (tmp_path / "S.java").write_text(JAVA)
    (tmp_path / "p.jsp").write_text('<% x.executeQuery("SELECT * FROM other"); %>')
    (tmp_path / "skip.sql").write_text("SELECT * FROM hidden;")
    nodes, edges, _ = ingest.analyze(spark, f"file://{tmp_path}", ("skip*",))
    e = {(r.src_key, r.dst_key, r.edge_type) for r in edges.collect()}
    assert ("proc:main_p", "proc:pkg_order.go", "DirectCall") in e and ("proc:main_p", "unres:nowhere", "DirectCall") in e
    assert ("proc:pkg_order.go", "proc:pkg_order.inner_p", "DirectCall") in e and ("mapper:com.x.OrderMapper.go", "proc:pkg_order.go", "CallsProcedure") in e
    assert ("proc:main_p", "table:s.orders", "TableAccess") in e and ("mapper:com.x.OrderMapper.find", "table:s.orders", "TableAccess") in e
    assert ("method:com.x.OrderService.run", "mapper:com.x.OrderMapper.find", "InvokesMapper") in e and ("method:com.x.OrderService.run", "method:com.x.OrderService.local", "CallsJava") in e
    assert ("class:com.x.OrderService", "class:com.x.Base", "Extends") in e and ("class:com.x.OrderService", "class:com.x.OrderMapper", "CallsJava") in e
    n = {r.node_key: r for r in nodes.collect()}
    assert not n["table:other"].explicit and n["table:other"].type_tag == "table*" and n["table:s.orders"].explicit and "table:hidden" not in n


def test_names_go_to_the_owner_schema_views_and_synonyms(spark, tmp_path):
    (tmp_path / "a.sql").write_text("""
    CREATE TABLE a.t (id INT); CREATE TABLE b.t (id INT); CREATE TABLE hr.emp (id INT); CREATE VIEW hr.v AS SELECT e.id FROM emp e;
    CREATE SYNONYM pub.people FOR hr.emp; CREATE PROCEDURE b.p AS BEGIN UPDATE t SET id = 1; DELETE FROM c.t; END;
    CREATE PROCEDURE q AS BEGIN INSERT INTO people (id) SELECT v.id FROM v; SELECT 1 INTO x FROM t; END;
    """)
    nodes, edges, mappings = ingest.analyze(spark, f"file://{tmp_path}")
    e = {(r.src_key, r.dst_key, r.edge_type) for r in edges.collect()}
    assert {("proc:b.p", "table:b.t", "TableAccess"), ("proc:b.p", "table:c.t", "TableAccess"), ("view:hr.v", "table:hr.emp", "DependsOn"), ("synonym:pub.people", "table:hr.emp", "AliasesObject")} <= e
    assert {("proc:q", "table:hr.emp", "TableAccess"), ("proc:q", "view:hr.v", "TableAccess"), ("proc:q", "table:t", "TableAccess")} <= e
    assert {r.node_key for r in nodes.filter("NOT explicit").collect()} == {"table:c.t", "table:t"}
    assert {(r.target_table, r.source_table) for r in mappings.filter("source_table IS NOT NULL").collect()} == {("hr.v", "hr.emp"), ("hr.emp", "hr.v")}
    assert {tuple(r.read_tables) for r in edges.filter("src_key = 'proc:q' AND read_tables IS NOT NULL").collect()} == {("view:hr.v",)}


def test_bounded_variants_say_so(spark):
    body = "".join(f'<if test="a{i}">AND a{i} = 1</if>' for i in range(9))
    xml = f'<mapper namespace="m"><select id="many">SELECT 1 FROM t <where>{body}</where></select><select id="few">SELECT 1 FROM t</select></mapper>'
    files = spark.createDataFrame([("m.xml", "xml", bytearray(xml.encode()))], "path string, kind string, content binary")
    rows = ingest.parse(files)
    assert [(r.rule, r.subject) for r in columns.schema_diagnostics(rows).collect()] == [("only-some-variants", "mapper:m.many")]


def test_rows_and_edges_by_need_are_those_of_all(spark):
    from codeloom.plans import source_queries as q
    from codeloom.work import materialize

    fill = lambda text, k: text.replace("@?", "").replace("@k", str(k)).replace("@m", str(k % 7)).replace("@h", "1").replace("@z", "5")
    texts = [("a", "sql", q.SCHEMA_A), ("b", "sql", q.SCHEMA_B), ("m", "xml", q.MAPPER), ("j", "java", q.JAVA), ("w", "jsp", q.JSP), ("s", "sql", q.SPEC + q.BODY + q.USE)]
    files = spark.createDataFrame([(f"{n}{k}.{kind}", kind, bytearray(fill(t, k).encode())) for n, kind, t in texts for k in (1, 2)], "path string, kind string, content binary")
    key = lambda df: sorted(map(repr, df.collect()))
    whole = materialize(ingest.parse(files), "whole")
    for records in (("call",), ("access", "node"), ingest.GRAPH):
        assert key(ingest.parse(files, records=records)) == key(whole.filter(whole.record.isin(*records)))
    defined = materialize(ingest.definitions(whole), "defined")
    edges, mappings = ingest.link(whole, defined, ingest.package_items(whole))
    for kinds in (("DirectCall",), ("TableAccess",), ("DependsOn", "AnchorsOn"), ("InvokesMapper", "ContainsMethod")):
        rows = whole.filter(whole.record.isin(*ingest.records_of(kinds)))
        assert key(ingest.link(rows, defined, ingest.package_items(rows), kinds)[0]) == key(edges.filter(edges.edge_type.isin(*kinds)))
    only = whole.filter(whole.record.isin("mapping", "node"))
    assert key(ingest.link(only, defined, ingest.package_items(only), ())[1]) == key(mappings)


def test_files_are_made_and_read_by_many_tasks(spark):
    from codeloom.plans import source_queries as q

    # The table of parts is one small file, which comes as one partition.
    assert spark.read.parquet("/root/testdata/sf0.001/part.parquet").rdd.getNumPartitions() == 1
    files = q._files(spark, "/root/testdata/sf0.001", ("a_sql", q.SCHEMA_A))
    many = 4 * spark.sparkContext.defaultParallelism
    assert files.rdd.getNumPartitions() == many
    assert ingest.heads(files.coalesce(1), deal=True).rdd.getNumPartitions() == many


def test_pieces_of_a_text_are_those_of_the_grammar():
    from codeloom.sources import plsql

    def plain(text):
        line = 1
        for m in plsql._TOKEN.finditer(text):
            kind, t = m.lastgroup, m[0]
            low = t.lower() if kind == "name" else t[1:-1].lower() if kind == "quoted" else t
            if kind != "space":
                yield kind, t, low, low if kind in ("op", "name", "quoted") else "", line
            line += t.count("\n")

    texts = ["a  :=\n  'x''\n' || $t$ b\n$t$ -- c\n/* d\n*/ \"Q r\".é_1 1.5e3..2", "  ", "$ $a$ 'open\n", "e'x' n 'y' \"z", "x/* open"]
    for text in texts + texts:
        assert [(t.kind, t.text, t.low, t.word, t.line) for t in plsql.tokenize(text)] == list(plain(text))
    long = " ".join(f"n{i}" for i in range(plsql.MOST_KEPT + 10))
    assert len(plsql.tokenize(long)) == plsql.MOST_KEPT + 10 and len(plsql._kinds) <= plsql.MOST_KEPT


HEADED = "CREATE TABLE a.t (id INT);\nCREATE PACKAGE BODY a.k AS\n  PROCEDURE one(x INT) IS BEGIN UPDATE t SET id = 1; EXECUTE IMMEDIATE 'DROP TABLE ' || 'u'; END;\nEND;\n/\nCREATE PROCEDURE a.p AS v a.t.id%TYPE; PROCEDURE inner_p IS BEGIN f(1); END; BEGIN IF (SELECT 1 FROM t) = 1 THEN BEGIN DELETE FROM t; END; END IF; END;\n/\nCREATE VIEW a.v AS SELECT id FROM t;\n"


def test_heads_of_nodes_are_read_without_statements(spark, monkeypatch):
    from codeloom.sources.plsql import Reader

    files = spark.createDataFrame([("a.sql", "sql", HEADED.encode())], "path string, kind string, content binary")
    whole = [tuple(r) for r in ingest.parse(files).collect() if r.record in ("node", "item")]
    routines = ("proc:a.k.one", "proc:a.p", "proc:a.inner_p")
    assert {r[2] for r in whole if r[0] == "node"} >= {*routines, "pkg:a.k", "table:a.t", "view:a.v"}
    # No record here can depend on a specification, so no file is read twice.
    monkeypatch.setattr(ingest, "heads", lambda *a: pytest.fail("a first pass"))
    got = [tuple(r) for r in ingest.parse(files, records=("head", "item")).collect()]
    assert sorted(map(repr, got)) == sorted(repr(r[:6] + (None,) + r[7:]) if r[2] in routines and r[0] == "node" else repr(r) for r in whole)
    seen = []
    monkeypatch.setattr(Reader, "query", lambda self, *a: seen.append("query"))
    monkeypatch.setattr(Reader, "possible", lambda self, *a: seen.append("possible"))
    list(ingest._rows("a.sql", "sql", HEADED.encode(), None, frozenset(("head", "item", "anchor"))))
    assert not seen


def test_pieces_are_shared_but_rows_stay_the_same():
    from codeloom.sources import plsql

    a, b = plsql.tokenize("x x\nx"), plsql.tokenize("x x\nx")
    assert a[0] is a[1] is b[0] and [t.line for t in a] == [1, 1, 2] and a[2] is not a[0]
    text = "CREATE FUNCTION g.f() RETURN INT AS $$\nBEGIN\n  FOR r IN (SELECT id FROM g.t WHERE id IN (1, 2)) LOOP h(1); END LOOP;\n  INSERT ALL INTO g.y (id) VALUES (b) SELECT ref AS b, c FROM g.s;\nEND $$;\nDROP TABLE g.z;"
    first, again = (plsql.read_sql(text, "f.sql") for _ in range(2))
    assert first == again and [(c[1], c[3]) for c in first.calls] == [("h", 3)] and first.accesses[-1][-1] == 6
    assert [f[1:5] for f in first.filters] == [("g.t", "id", "in", "1,2")]
    assert [m[1:6] for m in first.mappings] == [("g.y", "id", "column", "g.s", "ref")]
    for text in ("a=>b n'x' N 'y' e\"z\" E'q''r'", "f(1..2)<<l>>x::y", "a$b$c $t$ ; $t$ d"):
        assert [(t.kind, t.text) for t in plsql.tokenize(text)] == [(m.lastgroup if m.lastgroup != "tag" else "dollar", m[0]) for m in plsql._TOKEN.finditer(text) if m.lastgroup != "space"]


def test_mappers_are_read_without_a_second_reader(monkeypatch):
    import xml.sax

    monkeypatch.setattr(xml.sax, "make_parser", lambda *a: pytest.fail("a reader of events"))
    assert [s["line"] for s in read_mapper(MAPPER)] == [4, 5]
    # Entities of a document type elsewhere are passed over; without one an unknown entity is an error. Nothing is fetched.
    one = '<?xml version="1.0"?>{}<mapper namespace="m"><select id="x">a &far; b\x0a c &lt; #d.e#</select></mapper>'
    assert [s["sql"] for s in read_mapper(one.format('<!DOCTYPE mapper SYSTEM "http://x/y.dtd">').encode())] == ["a b c < ?"]
    assert read_mapper(one.format("").encode()) == []
    own = one.format('<!DOCTYPE mapper [<!ENTITY far SYSTEM "file:///etc/hostname">]>')
    assert [s["sql"] for s in read_mapper(own.encode())] == ["a b c < ?"]


def test_nodes_of_java_need_no_edges(spark, monkeypatch):
    from codeloom.plans import source_queries as q
    from codeloom.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    whole = ingest.finish(*(lambda d, rows: (d, ingest.link(rows, d, ingest.package_items(rows), ("ContainsMethod", "ContainsSql", *ingest.JAVA))[0]))(ingest.definitions(q._other_rows(spark, sf)), q._other_rows(spark, sf)))
    tags = ("class", "method", "sql", "jsp", "jspsql")
    want = {(r.type_tag, r.node_key) for r in whole.collect() if r.type_tag in tags and ("w_jsp_" not in r.node_key or r.type_tag in ("jsp", "jspsql"))}
    monkeypatch.setattr(ingest, "link", lambda *a: pytest.fail("edges are made"))
    monkeypatch.setattr(q, "_held", {})
    assert {tuple(r) for r in QUERIES["java_nodes"](spark, sf).collect()} == want and len(want) > 100


def test_inferred_nodes_are_those_that_edges_lead_to(spark):
    from codeloom.plans import source_queries as q
    from codeloom.work import materialize

    fill = lambda text, k: (text.replace("@?", "") if k % 2 else "".join(x if "@?" not in x else "" for x in text.splitlines(True))).replace("@k", str(k)).replace("@m", str(k % 7)).replace("@h", "1").replace("@z", "5")
    odd = "CREATE SYNONYM h.s FOR h.far; CREATE SYNONYM h.f FOR a.p1; CREATE SYNONYM y9 FOR y8; CREATE PROCEDURE h.q AS BEGIN UPDATE s SET x = 1; DELETE FROM \"T 1\"; k1.run(1); run; own; two(3); z.nextval; a.g(nvl(1, 2)); END;"
    texts = [("a", "sql", q.SCHEMA_A), ("b", "sql", q.SCHEMA_B), ("m", "xml", q.MAPPER), ("j", "java", q.JAVA), ("w", "jsp", q.JSP), ("s", "sql", q.SPEC + q.BODY + q.USE), ("o", "sql", odd)]
    files = spark.createDataFrame([(f"{n}{k}.{kind}", kind, bytearray(fill(t, k).encode())) for n, kind, t in texts for k in (1, 2)], "path string, kind string, content binary")
    whole = materialize(ingest.parse(files), "whole")
    defined, items = materialize(ingest.definitions(whole), "defined"), ingest.package_items(whole)
    key = lambda df: sorted(repr(r.asDict()) for r in df.collect())
    for kinds in ((*ingest.CALLS, *ingest.POINTING, "TableAccess", "AnchorsOn", "AliasesObject"), ("TableAccess",), ingest.CALLS, ("AliasesObject", "DependsOn")):
        want = ingest.finish(defined, ingest.link(whole, defined, items, kinds)[0]).filter("NOT explicit")
        got = ingest.inferred(whole.filter("record <> 'mapping'"), defined, items, kinds)
        assert key(got) == key(want) and got.count() > 0
