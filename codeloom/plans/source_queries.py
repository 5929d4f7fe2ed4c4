"""Registered queries over sources that are generated from the tables, one or two files a part, with the SQL of what they hold.

The texts use every statement kind that the readers know; the SQL says from the same tables what must come out. Parsed rows
and the graph built from them are made once for each session and folder of tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import columns, search
from codeloom.plans.queries import query
from codeloom.operators.merge import change_set
from codeloom.sources import delta, ingest
from codeloom.work import materialize

#: Marks in the texts: @k key, @m key modulo 7, @h key modulo 10, @z size.
SCHEMA_A = """CREATE TABLE a.t@k (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL, kind CHAR(1) DEFAULT 'x', size INT);
COMMENT ON COLUMN a.t@k.name IS 'name @m';
CREATE VIEW a.v@k (vid, total) AS SELECT t.id, sum(t.size) FROM t@k t WHERE t.kind = '@z' GROUP BY t.id;
CREATE SEQUENCE a.q@k;
CREATE INDEX a.i@k ON a.t@k (size);
CREATE TYPE a.ty@h AS OBJECT (x INT);
CREATE SYNONYM a.y@k FOR b.t@k;
CREATE TRIGGER a.g@k BEFORE INSERT ON t@k FOR EACH ROW EXECUTE PROCEDURE p@k();
CREATE FUNCTION helper@h(x INT) RETURN INT IS BEGIN RETURN nvl(x, 0); END;
/
CREATE PACKAGE a.pk@k AS PROCEDURE one(x INT); PROCEDURE two; END;
/
CREATE PACKAGE BODY a.pk@k AS
  PROCEDURE one(x INT) IS BEGIN helper@h(x); own; END;
  PROCEDURE own IS BEGIN NULL; END;
END;
/
CREATE PROCEDURE a.p@k(p_id IN INT, p_name OUT a.t@k.name%TYPE) AS
  v_id a.t@k.id%TYPE; v_row t@k%ROWTYPE; v_ty ty@h; v_n INT := 0; v_ref INT; v_note VARCHAR(10);
  TYPE names IS TABLE OF INT; v_list names;
  CURSOR c IS SELECT s.ref, s.note FROM b.t@k s WHERE s.id = p_id;
BEGIN
  OPEN c; FETCH c INTO v_ref, v_note; CLOSE c;
  INSERT INTO t@k (id, name, kind) VALUES (v_ref, v_note, 'k');
  UPDATE t@k SET size = (SELECT max(o.ref) FROM b.t@k o WHERE o.id = 3) WHERE kind IN ('a','b') AND upper(name) = 'N@m' AND size IS NOT NULL AND id NOT IN (1,2) AND id BETWEEN 3 AND 9;
  MERGE INTO a.t@k d USING b.t@k s ON (d.id = s.id) WHEN MATCHED THEN UPDATE SET name = s.note WHEN NOT MATCHED THEN INSERT (id, size) VALUES (s.id, s.ref + 1);
  FOR r IN (SELECT x.id, x.note FROM b.t@k x) LOOP
    IF r.note = 'n@m' AND 5 < r.id THEN v_n := a.q@k.nextval; END IF;
    SELECT count(*) INTO v_n FROM a.t@k z WHERE z.id = r.id;
  END LOOP;
  SELECT kind INTO v_note FROM a.t@k WHERE id = p_id;
  IF v_note = 'z' OR v_n = 1 THEN nowhere@m(1); ELSIF v_note = 'w' THEN v_list.extend(1); END IF;
  SELECT CASE kind WHEN 'a' THEN 'one' WHEN 'b' THEN 'two' END, decode(size, 1, 'x', 2, 'y') INTO v_note, v_note FROM a.t@k;
  SELECT count(*) INTO v_n FROM a.t@k l JOIN b.t@k m ON l.id = m.id AND substr(l.name, 1, 2) = m.note WHERE EXISTS (SELECT 1 FROM v@k w WHERE w.vid = l.id) AND (l.size = 1 OR l.size = 2);
  v_note := 'DELETE FROM '; IF v_n > 3 THEN v_note := v_note || 'd1'; ELSE v_note := v_note || 'd2'; END IF;
  EXECUTE IMMEDIATE v_note;
  helper@h(v_n); b.p@k; v_list(1) := 2;
END;
/
"""
SCHEMA_B = """@?CREATE TABLE b.t@k (id INT, ref INT, note VARCHAR(10));
CREATE PROCEDURE b.p@k AS v INT; BEGIN
  UPDATE t@k SET note = 'x' WHERE id = 1;
  SELECT count(*) INTO v FROM y@k;
  INSERT INTO log_@m SELECT s.ref FROM y@k s UNION ALL SELECT size FROM a.t@k;
END;
/
"""
STATEMENTS = """TRUNCATE TABLE s1_@k, s2_@k;
ALTER TABLE s3_@k ADD x INT;
DROP TABLE IF EXISTS s4_@k;
LOCK TABLE s5_@k IN SHARE ROW EXCLUSIVE MODE;
CREATE INDEX CONCURRENTLY ix ON s6_@k (x);
DELETE FROM s7_@k WHERE x = 1;
WITH c AS (SELECT x FROM s8_@k) SELECT * FROM c, s9_@k FOR UPDATE;
VACUUM s10_@k;
ANALYZE s11_@k;
REINDEX TABLE s12_@k;
INSERT INTO s13_@k VALUES (1);
SELECT EXTRACT(YEAR FROM d1) FROM s14_@k WHERE x IS NOT DISTINCT FROM y HAVING max(x) > (SELECT 1 FROM s15_@k);
"""
# A package's specification and body in two files; a schema with a synonym of its own beside a table of that name elsewhere.
SPEC = """CREATE PACKAGE d.k@k AS
  TYPE ids IS TABLE OF INT; v_ids ids; v_last INT := 0;
  CURSOR c IS SELECT x.ref, x.note FROM g.t@k x;
  PROCEDURE run;
END;
/
CREATE TABLE g.t@k (id INT, ref INT, note VARCHAR(10)); CREATE TABLE g.o@k (id INT, note VARCHAR(10)); CREATE TABLE e.y@k (id INT, note INT);
@?CREATE SYNONYM d.y@k FOR g.o@k;
"""
BODY = """CREATE PACKAGE BODY d.k@k AS
  w_seen INT;
  PROCEDURE run IS v_a INT; v_b VARCHAR(10); BEGIN
    OPEN c; FETCH c INTO v_a, v_b; INSERT INTO g.o@k (id, note) VALUES (v_a, v_b);
    v_ids(1) := 2; k@k.v_ids(3) := 1; v_ids.extend(1); w_seen := v_last; absent@m(1);
  END;
END;
/
"""
USE = """CREATE PROCEDURE d.u@k AS BEGIN
  k@k.v_ids(1) := 3; k@k.run();
  UPDATE y@k SET (id, note) = (SELECT t.ref, upper(t.note) FROM g.t@k t WHERE t.id = 1);
  INSERT ALL INTO e.y@k (id) VALUES (ref) WHEN ref > 1 THEN INTO e.z@k (id, k) VALUES (ref + 1, 'x') INTO e.w@k SELECT id AS ref, note FROM g.t@k;
END;
/
"""
MAPPER = """<?xml version="1.0"?><mapper namespace="m.M@k">
 <select id="find">SELECT id FROM a.t@k <where><if test="x">AND size = #{x}</if><choose><when test="y">AND kind = 'a'</when><otherwise>AND kind = 'b'</otherwise></choose></where></select>
 <update id="go" statementType="CALLABLE">{call a.p@k(#{id})}</update>
</mapper>"""
JAVA = """package j; public class S@k extends Base@h implements Api {
  @Autowired private M@k dao;
  public void run(int n) { dao.find(n); local(); sqlSession.selectOne("m.M@k.find", n); conn.prepareStatement("UPDATE a.t@k SET size = 1 WHERE id = " + n); }
  void local() { }
}
class Base@h { }
interface M@k { }
"""
JSP = """<%@ page x %><%! int f() { return 1; } %><%-- c --%>text <%= a %>
<% stmt.executeQuery("SELECT name FROM a.t@k WHERE kind = '${q}'"); stmt.executeQuery("SELECT name FROM a.t@k WHERE kind = '${q}'"); %>"""

_held: dict[tuple, DataFrame] = {}


def _fill(text: str) -> F.Column:
    k = F.col("p_partkey")
    out = F.lit(text)
    # A statement after @? is there for even keys only.
    if "@?" in text:
        head, _, rest = text.partition("@?")
        line, _, rest = rest.partition("\n")
        out = F.concat(F.lit(head), F.when(k % 2 == 0, F.lit(line + "\n")).otherwise(F.lit("")), F.lit(rest))
    for mark, value in (("@k", k), ("@m", k % 7), ("@h", k % 10), ("@z", F.col("p_size"))):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def _once(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _held:
        _held[key] = materialize(make(), name)
    return _held[key]


def _files(spark: SparkSession, sf: str, *parts: tuple[str, str]) -> DataFrame:
    """path, kind, content. The keys are dealt to tasks, which is cheap, and the texts are made where they are read."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    every = [F.struct(F.concat(F.lit(f"{ending}_"), F.col("p_partkey").cast("string"), F.lit(f".{ending.rpartition('_')[2]}")).alias("path"), F.lit(ending.rpartition("_")[2]).alias("kind"), _fill(text).cast("binary").alias("content")) for ending, text in parts]
    return part.select(F.explode(F.array(*every)).alias("f")).select("f.*")


def _parsed(spark: SparkSession, sf: str, name: str, records: tuple[str, ...] | None, *parts: tuple[str, str]) -> DataFrame:
    """Rows of files, of some records or (None) of all; what the session has parsed already is used if it holds them."""
    for (app, folder, what, *held), df in list(_held.items()):
        if (app, folder, what) == (spark.sparkContext.applicationId, sf, name) and (held[0] is None or records is not None and set(records) <= {*held[0], *(("head",) if "node" in held[0] else ())}):
            return df if records is None else df.filter(F.col("record").isin(*("node" if r == "head" else r for r in records), "error"))
    key = (spark.sparkContext.applicationId, sf, name, records)
    _held[key] = materialize(ingest.parse(_files(spark, sf, *parts), deal=False, records=records), name)
    return _held[key]


def _rows(spark: SparkSession, sf: str, records: tuple[str, ...] | None = None) -> DataFrame:
    return _parsed(spark, sf, "sql-rows", records, *_SQL)


_SQL = (("a_sql", SCHEMA_A), ("b_sql", SCHEMA_B))
_OTHERS = (("m_xml", MAPPER), ("j_java", JAVA), ("w_jsp", JSP))
_PACKAGES = (("spec_sql", SPEC), ("body_sql", BODY), ("use_sql", USE))


def _package_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "package-rows", lambda: ingest.parse(_files(spark, sf, *_PACKAGES), deal=False))


def _package_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = (spark.sparkContext.applicationId, sf, "package-graph")
    if key not in _held:
        n, e, m = ingest.build(_package_rows(spark, sf))
        _held[key] = (materialize(n, "nodes"), e, materialize(m, "mappings"))
    return _held[key]


def _statement_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse(_files(spark, sf, ("s_sql", STATEMENTS)), deal=False, records=("access",))


def _other_rows(spark: SparkSession, sf: str, records: tuple[str, ...] | None = None) -> DataFrame:
    return _parsed(spark, sf, "other-rows", records, *_OTHERS)


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = (spark.sparkContext.applicationId, sf, "graph")
    if key not in _held:
        n, e, m = ingest.build(_rows(spark, sf, ingest.GRAPH).unionByName(_other_rows(spark, sf, ingest.GRAPH)))
        _held[key] = (materialize(n, "nodes"), e, materialize(m, "mappings"))
    return _held[key]


def _linked(spark: SparkSession, sf: str, kinds: tuple[str, ...], of: str = "sql", more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and mappings as in the whole graph, but edges of these types only, of owners in files of `of` (sql, other,
    both), and mappings only if more names their record. Definitions come from SQL files besides; with others, whose edges lead
    to nothing in those, they do not.

    DirectCall, AnchorsOn, DependsOn and a routine's edges come from SQL files only, those of classes, mappers and pages from others only.
    """
    key = (spark.sparkContext.applicationId, sf, "linked", (kinds, of, more))
    if key not in _held:
        records = tuple(sorted({*ingest.records_of(kinds), *more, "head"} - {"node"}))
        mine = {"sql": [_rows], "other": [_other_rows], "others": [_other_rows], "both": [_rows, _other_rows]}[of]
        rows = [read(spark, sf, records) for read in mine]
        names = [_rows(spark, sf, ("head", "item"))] if of == "other" else []
        rows, names = (x if len(x) < 2 else [x[0].unionByName(x[1])] for x in (rows, rows + names))
        defined = materialize(ingest.definitions(names[0]), "defined")
        e, m = ingest.link(rows[0], defined, ingest.package_items(names[0]), kinds)
        _held[key] = (ingest.finish(defined, e), e, m)
    return _held[key]


def _each(*rows: str) -> str:
    """One SELECT over all parts for each row of columns; k is the key, even says whether it is even."""
    base = "(SELECT p_partkey AS k, p_partkey % 7 AS m, p_partkey % 10 AS h, p_size AS z, p_partkey % 2 = 0 AS even FROM part)"
    return " UNION ALL ".join(f"SELECT {r} FROM {base}" if " WHERE " not in r else f"SELECT {r.split(' WHERE ')[0]} FROM {base} WHERE {r.split(' WHERE ')[1]}" for r in rows)


def _edited(sql: str) -> str:
    """The same over files of which every hundredth has lost its statement after @?."""
    return sql.replace("p_partkey % 2 = 0 AS even", "p_partkey % 2 = 0 AND p_partkey % 100 <> 0 AS even")


_B = "CASE WHEN even THEN 'table:b.t' || k ELSE 'table:b.t' || k END"  # b.t of an odd key is used but not defined

# ---- objects --------------------------------------------------------------------------------------------------------

_KINDS = [("table", "a.t"), ("view", "a.v"), ("seq", "a.q"), ("index", "a.i"), ("synonym", "a.y"), ("trigger", "g"), ("pkg", "a.pk"), ("proc", "a.p"), ("proc", "b.p")]


@query(
    "source_nodes",
    "SELECT DISTINCT * FROM (" + _each(*(f"'{t}' AS type_tag, '{t}:{p}' || k AS node_key" for t, p in _KINDS), "'table', 'table:b.t' || k WHERE even", "'type', 'type:a.ty' || h", "'func', 'func:helper' || h", "'proc', 'proc:a.pk' || k || '.one'", "'proc', 'proc:a.pk' || k || '.own'", "'proc*', 'proc:a.pk' || k || '.two'", "'index', 'index:t' || k || '_pk_id'") + ")",
)
def _(spark, sf):
    n = ingest.defined_keys(_rows(spark, sf, ("head", "item"))).select("type_tag", "node_key")
    return n.filter(~F.substring_index("node_key", ":", 1).isin("mapper", "class", "method", "sql", "jsp", "jspsql"))


@query("source_inferred", "SELECT DISTINCT * FROM (" + _each("'table*' AS type_tag, 'table:b.t' || k AS node_key WHERE NOT even", "'table*', 'table:log_' || m", "'table*', 'table:d1'", "'table*', 'table:d2'", "'unres', 'unres:nowhere' || m") + ")")
def _(spark, sf):
    # All edges that can lead to a table or to no routine.
    kinds = (*ingest.CALLS, *ingest.POINTING, "TableAccess", "AnchorsOn", "AliasesObject")
    records = tuple(sorted({*ingest.records_of(kinds), "head"} - {"node", "mapping"}))
    rows = _rows(spark, sf, records).unionByName(_other_rows(spark, sf, records))
    n = ingest.inferred(rows, materialize(ingest.definitions(rows), "defined"), ingest.package_items(rows), kinds)
    return n.filter(F.col("type_tag").isin("table*", "unres")).select("type_tag", "node_key")


@query(
    "table_schemas",
    _each(
        "'table:a.t' || k AS table_key, 0 AS n, 'id' AS name, 'INT' AS data_type, false AS nullable, true AS primary_key, CAST(NULL AS VARCHAR) AS \"default\", CAST(NULL AS VARCHAR) AS comment",
        "'table:a.t' || k, 1, 'name', 'VARCHAR(20)', false, false, NULL, 'name ' || m", "'table:a.t' || k, 2, 'kind', 'CHAR(1)', true, false, '''x''', NULL", "'table:a.t' || k, 3, 'size', 'INT', true, false, NULL, NULL",
        "'table:b.t' || k, 0, 'id', 'INT', true, false, NULL, NULL WHERE even", "'table:b.t' || k, 1, 'ref', 'INT', true, false, NULL, NULL WHERE even", "'table:b.t' || k, 2, 'note', 'VARCHAR(10)', true, false, NULL, NULL WHERE even",
    ),
)
def _(spark, sf):
    return columns.table_schemas(_rows(spark, sf)).select("table_key", F.explode("columns").alias("c")).select("table_key", "c.*").withColumn("n", F.col("n").cast("int"))


@query("schema_diagnostics", "SELECT 'none' AS rule, 0::BIGINT AS n WHERE false")
def _(spark, sf):
    # All is read, so that all errors are found, but little of it is wanted.
    rows = _once(spark, sf, "diagnosed", lambda: ingest.parse(_files(spark, sf, *_SQL), deal=False, kept=("head", "bound")))
    return columns.schema_diagnostics(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("routine_parameters", "SELECT DISTINCT * FROM (" + _each("'proc:a.p' || k AS routine_key, 0::BIGINT AS position, 'p_id' AS name, 'in' AS mode, 'INT' AS type", "'proc:a.p' || k, 1, 'p_name', 'out', 'a . t' || k || ' . name % TYPE'", "'func:helper' || h, 0, 'x', 'in', 'INT'", "'proc:a.pk' || k || '.one', 0, 'x', 'in', 'INT'") + ")")
def _(spark, sf):
    return columns.parameters(_rows(spark, sf)).select("routine_key", "position", "name", "mode", "type").distinct()


@query("routine_statements", _each(*(f"'proc:a.p' || k AS node_key, '{w}' AS kind, {n}::BIGINT AS n" for w, n in (("insert", 1), ("update", 1), ("merge", 1), ("select", 4), ("dynamic", 2))), *(f"'proc:b.p' || k, '{w}', 1" for w in ("update", "select", "insert"))))
def _(spark, sf):
    n = _rows(spark, sf, ("node",)).filter("record = 'node' AND b = 'proc' AND e IS NOT NULL")
    body = n.select(F.col("a").alias("node_key"), F.explode(F.from_json("e", "array<array<string>>")).alias("s"))
    return body.groupBy("node_key", F.col("s")[1].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- edges that the resolver decides --------------------------------------------------------------------------------


_ACCESS = _each(
        "'proc:a.p' || k AS src_key, 'table:a.t' || k AS dst_key, 3 AS modes, 'insert,merge_insert,merge_update,update' AS write_kinds", f"'proc:a.p' || k, {_B}, 1, ''", "'proc:a.p' || k, 'view:a.v' || k, 1, ''",
        "'proc:a.p' || k, 'table:d1', 2, 'delete'", "'proc:a.p' || k, 'table:d2', 2, 'delete'", "'view:a.v' || k, 'table:a.t' || k, 1, ''", "'index:a.i' || k, 'table:a.t' || k, 32, 'create_index'",
        # In schema b the bare name is b's own table where it exists, else the only one of that name; the synonym leads to b.
        "'proc:b.p' || k, 'table:b.t' || k, 3, 'update' WHERE even", "'proc:b.p' || k, 'table:a.t' || k, 1, '' WHERE even", "'proc:b.p' || k, 'table:a.t' || k, 3, 'update' WHERE NOT even", "'proc:b.p' || k, 'table:b.t' || k, 1, '' WHERE NOT even", "'proc:b.p' || k, 'table:log_' || m, 2, 'insert_select'",
    )


def _accesses(edges: DataFrame) -> DataFrame:
    e = edges.filter(F.col("edge_type") == "TableAccess").filter(~F.substring_index("src_key", ":", 1).isin("mapper", "sql", "jspsql"))
    return e.select("src_key", "dst_key", "modes", F.array_join("write_kinds", ",").alias("write_kinds"))


@query("object_access", _ACCESS)
def _(spark, sf):
    return _accesses(_linked(spark, sf, ("TableAccess",))[1])


def _changed(spark, sf, records: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of these records before and after every hundredth file of schema b has lost its table, and the files whose rows may differ."""
    key = (spark.sparkContext.applicationId, sf, "changed", records)
    if key in _held:
        return _held[key]
    before = _files(spark, sf, *_SQL, *_OTHERS)
    lost = F.col("path").rlike("^b_sql_(0|[0-9]+00)[.]sql$")
    after = before.withColumn("content", F.when(lost, F.regexp_replace(F.col("content").cast("string"), "CREATE TABLE [^;]*;", "").cast("binary")).otherwise(F.col("content")))
    manifest = lambda files, time: files.select("path", F.lit(time).alias("mtime"), F.sha2("content", 256).alias("hash"))
    old = _rows(spark, sf, records).unionByName(_other_rows(spark, sf, records))
    new, dirty = delta.reparse(old, after, change_set(manifest(before, 1), manifest(after, 2)), records)
    _held[key] = (old, new, dirty)
    return _held[key]


@query("delta_access", _edited(_ACCESS))
def _(spark, sf):
    # Only accesses are asked for, and not what they read besides; edges are looked at for synonyms.
    kinds = ("TableAccess",)
    old, new, dirty = _changed(spark, sf, ("access", "edge", "head", "item"))
    e, m = ingest.link(old, materialize(ingest.definitions(old), "defined"), ingest.package_items(old), kinds)
    return _accesses(delta.rebuild(old, new, dirty, e, m, kinds)[1])


# Linked anew are the routines of changed files and those that name a table which came or went; never all of them.
_TOUCHED = "SELECT 'proc:b.p' || p_partkey AS owner FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT 'proc:a.p' || p_partkey FROM part WHERE p_partkey % 100 = 0"


@query("delta_owners", _TOUCHED)
def _(spark, sf):
    # Which owners are linked anew follows from the rows of a graph; no graph is needed.
    owners = delta.affected(*_changed(spark, sf, tuple(sorted({*ingest.GRAPH, "head"} - {"node"}))))
    return owners.filter("owner LIKE 'proc:a.p%' AND owner NOT LIKE '%.pk%' OR owner LIKE 'proc:b.p%'")


@query(
    "package_scope",
    "SELECT DISTINCT * FROM (" + _each("'DirectCall' AS edge_type, 'proc:d.u' || k AS src_key, 'proc:d.k' || k || '.run' AS dst_key", "'DirectCall', 'proc:d.k' || k || '.run', 'unres:absent' || m", "'TableAccess', 'proc:d.k' || k || '.run', 'table:g.o' || k", "'TableAccess', 'proc:d.u' || k, 'table:g.t' || k",
    # The owner's own synonym counts before the only table of that name elsewhere.
    "'TableAccess', 'proc:d.u' || k, 'table:g.o' || k WHERE even", "'TableAccess', 'proc:d.u' || k, 'table:e.y' || k", "'TableAccess', 'proc:d.u' || k, 'table:e.z' || k", "'TableAccess', 'proc:d.u' || k, 'table:e.w' || k") + ")",
)
def _(spark, sf):
    # What accesses read besides is not asked for, so neither are mappings.
    rows = _parsed(spark, sf, "scope-rows", ("access", "call", "head", "item"), *_PACKAGES)
    e = ingest.link(rows, materialize(ingest.definitions(rows), "defined"), ingest.package_items(rows), ("DirectCall", "TableAccess"))[0]
    return e.select("edge_type", "src_key", "dst_key")


@query(
    "package_mappings",
    "SELECT DISTINCT * FROM (" + _each(
        *(f"'{o}' || k AS owner_key, '{t}' || k AS target_table, '{c}' AS target_column, 'g.t' || k AS source_table, '{x}' AS source_column, '{w}' AS mapping_kind{cond}" for o, t, c, x, w, cond in (
            ("proc:d.k", "g.o", "id", "ref", "direct", ""), ("proc:d.u", "g.o", "id", "ref", "direct", " WHERE even"), ("proc:d.u", "g.o", "note", "note", "derived", " WHERE even"),
            ("proc:d.u", "e.y", "id", "ref", "direct", " WHERE NOT even"), ("proc:d.u", "e.y", "note", "note", "derived", " WHERE NOT even"), ("proc:d.u", "e.y", "id", "id", "direct", ""),
            ("proc:d.u", "e.z", "id", "id", "derived", ""), ("proc:d.u", "e.w", "ref", "id", "direct", ""), ("proc:d.u", "e.w", "note", "note", "direct", ""), ("proc:d.k", "g.o", "note", "note", "direct", ""),
        )),
    ) + ")",
)
def _(spark, sf):
    m = _package_graph(spark, sf)[2].filter("source_kind = 'column' AND source_table IS NOT NULL")
    return m.select(F.regexp_replace("owner_key", "[.]run$", "").alias("owner_key"), "target_table", "target_column", "source_table", "source_column", "mapping_kind").distinct()


@query(
    "statement_reads",
    _each("'proc:b.p' || k AS src_key, 'table:log_' || m AS dst_key, 'table:a.t' || k || ',table:b.t' || k AS read_tables", "'proc:b.p' || k, 'table:b.t' || k, '' WHERE even", "'proc:b.p' || k, 'table:a.t' || k, '' WHERE NOT even", "'proc:a.p' || k, 'table:d1', ''", "'proc:a.p' || k, 'table:d2', ''", "'proc:a.p' || k, 'table:a.t' || k, 'table:b.t' || k"),
)
def _(spark, sf):
    e = _linked(spark, sf, ("TableAccess",))[1].filter("read_tables IS NOT NULL AND src_key LIKE 'proc:%'").filter(F.col("modes").bitwiseAND(2) != 0)
    return e.select("src_key", "dst_key", F.array_join("read_tables", ",").alias("read_tables"))


@query("view_dependencies", _each("'view:a.v' || k AS src_key, 'table:a.t' || k AS dst_key"))
def _(spark, sf):
    return _linked(spark, sf, ("DependsOn",))[1].select("src_key", "dst_key")


@query(
    "source_anchors",
    _each("'proc:a.p' || k AS src_key, 'table:a.t' || k AS dst_key, 'type|name|parameter' AS detail", "'proc:a.p' || k, 'table:a.t' || k, 'type|id|variable'", "'proc:a.p' || k, 'table:a.t' || k, 'rowtype||variable'"),
)
def _(spark, sf):
    return _linked(spark, sf, ("AnchorsOn",))[1].select("src_key", "dst_key", "detail")


@query(
    "object_references",
    _each(
        "'ReferencesType' AS edge_type, 'proc:a.p' || k AS src_key, 'type:a.ty' || h AS dst_key", "'UsesSequence', 'proc:a.p' || k, 'seq:a.q' || k", "'IndexesTable', 'index:a.i' || k, 'table:a.t' || k", "'IndexesTable', 'index:t' || k || '_pk_id', 'table:a.t' || k",
        "'TriggersTable', 'trigger:g' || k, 'table:a.t' || k", "'AliasesObject', 'synonym:a.y' || k, 'table:b.t' || k", "'ContainsRoutine', 'pkg:a.pk' || k, 'proc:a.pk' || k || '.one'", "'ContainsRoutine', 'pkg:a.pk' || k, 'proc:a.pk' || k || '.two'", "'ContainsRoutine', 'pkg:a.pk' || k, 'proc:a.pk' || k || '.own'",
    ),
)
def _(spark, sf):
    kinds = ("ReferencesType", "UsesSequence", "IndexesTable", "TriggersTable", "AliasesObject", "ContainsRoutine")
    return _linked(spark, sf, kinds, "both")[1].select("edge_type", "src_key", "dst_key")


@query(
    "source_calls",
    "SELECT DISTINCT * FROM (" + _each("'proc:a.p' || k AS src_key, 'func:helper' || h AS dst_key", "'proc:a.p' || k, 'proc:b.p' || k", "'proc:a.p' || k, 'unres:nowhere' || m", "'proc:a.pk' || k || '.one', 'func:helper' || h", "'proc:a.pk' || k || '.one', 'proc:a.pk' || k || '.own'", "'trigger:g' || k, 'proc:a.p' || k") + ")",
)
def _(spark, sf):
    return _linked(spark, sf, ("DirectCall",))[1].select("src_key", "dst_key")


@query("builtin_uses", "SELECT DISTINCT * FROM (" + _each("'func:helper' || h AS src_key, 'builtin:nvl' AS dst_key", *(f"'proc:a.p' || k, 'builtin:{f}'" for f in ("count", "max", "upper", "decode", "substr", "exists")), "'proc:b.p' || k, 'builtin:count'") + ")")
def _(spark, sf):
    return _linked(spark, sf, ("UsesBuiltinFunction",))[1].select("src_key", "dst_key")


# ---- columns --------------------------------------------------------------------------------------------------------

_MAP = "AS owner_key, '{0}' || k AS target_table, '{1}' AS target_column, '{2}' || k AS source_table, '{3}' AS source_column, '{4}' AS mapping_kind"
_M = lambda owner, *x: f"'{owner}' || k " + _MAP.format(*x)


@query(
    "column_mappings",
    _each(
        _M("view:a.v", "a.v", "vid", "a.t", "id", "direct"), _M("view:a.v", "a.v", "total", "a.t", "size", "aggregated"),
        _M("proc:a.p", "a.t", "id", "b.t", "ref", "direct"), _M("proc:a.p", "a.t", "name", "b.t", "note", "direct"), _M("proc:a.p", "a.t", "size", "b.t", "ref", "aggregated"),
        _M("proc:a.p", "a.t", "id", "b.t", "id", "direct"), _M("proc:a.p", "a.t", "size", "b.t", "ref", "derived"),
        "'proc:b.p' || k, 'log_' || m, 'ref', 'b.t' || k, 'ref', 'direct'", "'proc:b.p' || k, 'log_' || m, 'size', 'a.t' || k, 'size', 'direct'",
    ),
)
def _(spark, sf):
    m = _linked(spark, sf, (), "sql", ("mapping",))[2].filter("source_kind = 'column' AND source_table IS NOT NULL AND owner_key RLIKE '^(proc|view):'")
    return m.select("owner_key", "target_table", "target_column", "source_table", "source_column", "mapping_kind").distinct()


@query("literal_mappings", _each("'proc:a.p' || k AS owner_key, 'a.t' || k AS target_table, 'kind' AS target_column, '''k''' AS source_column", "'proc:b.p' || k, 'b.t' || k, 'note', '''x''' WHERE even", "'proc:b.p' || k, 'a.t' || k, 'note', '''x''' WHERE NOT even"))
def _(spark, sf):
    return _linked(spark, sf, (), "sql", ("mapping",))[2].filter("source_kind = 'literal' AND owner_key LIKE 'proc:%'").select("owner_key", "target_table", "target_column", "source_column").distinct()


@query(
    "source_filters",
    _each(
        "'view:a.v' || k AS owner_key, 't' || k AS \"table\", 'kind' AS \"column\", '=' AS op, '''' || z || '''' AS value, CAST(NULL AS VARCHAR) AS transform", "'proc:a.p' || k, 't' || k, 'kind', 'in', '''a'',''b''', NULL", "'proc:a.p' || k, 't' || k, 'name', '=', '''N' || m || '''', 'upper'",
        "'proc:a.p' || k, 't' || k, 'size', 'is not null', NULL, NULL", "'proc:a.p' || k, 't' || k, 'id', 'not in', '1,2', NULL", "'proc:a.p' || k, 't' || k, 'id', 'between', '3 and 9', NULL", "'proc:a.p' || k, 'b.t' || k, 'id', '=', '3', NULL", "'proc:b.p' || k, 't' || k, 'id', '=', '1', NULL",
    ),
)
def _(spark, sf):
    return columns.filters(_rows(spark, sf)).select("owner_key", "table", "column", "op", F.lower("value").alias("v"), "value", "transform").withColumn("value", F.when(F.col("op") == "between", F.col("v")).otherwise(F.col("value"))).drop("v").distinct()


@query(
    "source_joins",
    _each(
        "'proc:a.p' || k AS owner_key, 'a.t' || k || '.id' AS \"left\", 'b.t' || k || '.id' AS \"right\", 'column' AS source", "'proc:a.p' || k, 'a.t' || k || '.id', 'b.t' || k || '.id', 'record'", "'proc:a.p' || k, 'a.t' || k || '.id', 'v' || k || '.vid', 'column'",
    ),
)
def _(spark, sf):
    side = lambda c: F.concat_ws(".", f"{c}.table", f"{c}.column").alias(c)
    return columns.joins(_rows(spark, sf, ("join",))).select("owner_key", side("left"), side("right"), "source")


@query("cross_table_equalities", _each("'proc:a.p' || k AS owner_key, 'a.t' || k || '.name' AS \"left\", 'b.t' || k || '.note' AS \"right\""))
def _(spark, sf):
    side = lambda c: F.concat_ws(".", f"{c}.table", f"{c}.column").alias(c)
    return columns.equalities(_rows(spark, sf, ("equality",))).select("owner_key", side("left"), side("right"))


@query("enum_mappings", _each(*(f"'proc:a.p' || k AS owner_key, 'a.t' || k AS \"table\", '{c}' AS \"column\", '{x}' AS literal, '{y}' AS result" for c, x, y in (("kind", "''a''", "''one''"), ("kind", "''b''", "''two''"), ("size", "1", "''x''"), ("size", "2", "''y''")))))
def _(spark, sf):
    return columns.enum_mappings(_rows(spark, sf)).select("owner_key", "table", "column", "literal", "result")


@query(
    "pl_predicates",
    _each(
        "'proc:a.p' || k AS owner_key, 'B001' AS predicate_id, 'b.t' || k AS \"table\", 'note' AS \"column\", '=' AS op, '''n' || m || '''' AS value, 'high' AS confidence", "'proc:a.p' || k, 'B002', 'b.t' || k, 'id', '>', '5', 'high'", "'proc:a.p' || k, 'B003', NULL, NULL, '=', NULL, 'low'",
        "'proc:a.p' || k, 'B004', 'a.t' || k, 'kind', '=', '''w''', 'medium'", "'proc:a.p' || k, 'B005', NULL, NULL, '>', '3', 'low'",
    ),
)
def _(spark, sf):
    p = columns.predicates(_rows(spark, sf)).select("owner_key", "predicate_id", "table", "column", "op", "value", "confidence")
    return p.withColumn("value", F.when((F.col("confidence") == "low") & (F.col("predicate_id") == "B003"), F.lit(None)).otherwise(F.col("value")))


@query(
    "discriminator_values",
    _each("'proc:a.p' || k AS owner_key, 'kind' AS \"column\", 'w' AS value, 'predicate' AS source, 'high' AS confidence", "'proc:a.p' || k, 'kind', 'a', 'filter', 'medium'", "'proc:a.p' || k, 'kind', 'b', 'filter', 'medium'", "'view:a.v' || k, 'kind', CAST(z AS VARCHAR), 'filter', 'medium'"),
)
def _(spark, sf):
    return columns.discriminator_values(_rows(spark, sf), ["KIND"]).select("owner_key", "column", "value", "source", "confidence")


@query("seed_hints", _each("'proc:a.p' || k AS owner_key, 2 AS parameters, 5 AS tables, 6 AS filters, 3 AS discriminators, 1 AS equalities"))
def _(spark, sf):
    # One parse for both the edges and the rest. What accesses read besides is not asked for, so neither are mappings.
    rows = _rows(spark, sf, ("access", "equality", "filter", "head", "param", "predicate"))
    e = ingest.link(rows, materialize(ingest.definitions(rows), "defined"), ingest.package_items(rows), ("TableAccess",))[0]
    h = columns.seed_hints(rows, e, ["kind"]).filter("owner_key LIKE 'proc:a.p%' AND owner_key NOT LIKE '%.pk%'")
    return h.select("owner_key", *(F.size(c).alias(c) for c in ("parameters", "tables", "filters", "discriminators", "equalities")))


# ---- statement kinds ------------------------------------------------------------------------------------------------

_KINDS_OF = [
    (1, 8, "truncate"), (2, 8, "truncate"), (3, 8, "alter"), (4, 8, "drop"), (5, 64, "lock_table"), (6, 16, "create_index_concurrent"), (7, 2, "delete"), (8, 1, None), (9, 1, None), (9, 4, None), (10, 16, "vacuum"), (11, 16, "analyze"),
    (12, 8, "reindex"), (13, 2, "insert"), (14, 1, None), (15, 1, None),
]


def _text(w: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if w is None else f"'{w}'"


@query("statement_kinds", "SELECT DISTINCT * FROM (" + _each(*(f"'s{i}_' || k AS \"table\", {m}::BIGINT AS mode, {_text(w)} AS write_kind" for i, m, w in _KINDS_OF)) + ")")
def _(spark, sf):
    r = _statement_rows(spark, sf).filter("record = 'access'").select(F.col("b").alias("table"), F.col("n").alias("mode"), F.col("c").alias("write_kind")).distinct()
    # FOR UPDATE locks every table of its statement, that of the common table expression too.
    return r.filter(~(F.col("table").startswith("s8_") & (F.col("mode") == 4)))


# ---- mappers, Java and pages ----------------------------------------------------------------------------------------


def _mapper_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Statements of mappers; only mapper files define such nodes, so no others are read."""
    rows = _parsed(spark, sf, "mapper-rows", ("node", "variant"), ("m_xml", MAPPER))
    return ingest.statements(rows, ingest.definitions(rows).filter("type_tag = 'mapper'"))


@query(
    "mapper_statements",
    _each(
        *(f"'mapper:m.M' || k || '.find' AS node_key, 'SELECT id FROM a.t' || k || '{w}' AS sql_text" for w in (" where size = ? AND kind = ''a''", " where size = ? AND kind = ''b''", " where kind = ''a''", " where kind = ''b''")),
        "'mapper:m.M' || k || '.go', '{call a.p' || k || '(?)}'",
    ),
)
def _(spark, sf):
    s = _mapper_texts(spark, sf)
    return s.filter("node_key LIKE 'mapper:%'").select("node_key", "sql_text")


@query("variant_search", "SELECT 'mapper:m.M' || p_partkey || '.find' AS node_key, 1.0::DOUBLE AS score FROM part WHERE p_partkey = 7")
def _(spark, sf):
    s = materialize(search.index(_mapper_texts(spark, sf)), "statements")
    return search.search_sql(s, "select id from a.t7 where kind = 'zz'")


@query(
    "java_graph",
    "SELECT DISTINCT * FROM (" + _each(
        "'ContainsMethod' AS edge_type, 'class:j.S' || k AS src_key, 'method:j.S' || k || '.run' AS dst_key", "'ContainsMethod', 'class:j.S' || k, 'method:j.S' || k || '.local'", "'CallsJava', 'method:j.S' || k || '.run', 'method:j.S' || k || '.local'",
        "'CallsJava', 'class:j.S' || k, 'class:j.M' || k", "'InvokesMapper', 'method:j.S' || k || '.run', 'mapper:m.M' || k || '.find'", "'CallsProcedure', 'mapper:m.M' || k || '.go', 'proc:a.p' || k",
        "'ContainsMethod', 'class:w_jsp_' || k || '_jsp', 'method:w_jsp_' || k || '_jsp.f'", "'ContainsMethod', 'class:w_jsp_' || k || '_jsp', 'method:w_jsp_' || k || '_jsp.service'",
        "'ContainsSql', 'method:j.S' || k || '.run', 'sql:j.S' || k || '.run:3'", "'ContainsSql', 'jsp:w_jsp_' || k || '.jsp', 'jspsql:w_jsp_' || k || '.jsp:1'",
    ) + ")",
)
def _(spark, sf):
    kinds = ("ContainsMethod", "CallsJava", "InvokesMapper", "CallsProcedure", "ContainsSql")
    return _linked(spark, sf, kinds, "other")[1].select("edge_type", "src_key", "dst_key")


@query(
    "embedded_access",
    _each("'mapper:m.M' || k || '.find' AS src_key, 'table:a.t' || k AS dst_key, 1 AS modes", "'sql:j.S' || k || '.run:3', 'table:a.t' || k, 2", "'jspsql:w_jsp_' || k || '.jsp:1', 'table:a.t' || k, 1"),
)
def _(spark, sf):
    e = _linked(spark, sf, ("TableAccess",), "other")[1].filter(F.substring_index("src_key", ":", 1).isin("mapper", "sql", "jspsql"))
    return e.select("src_key", "dst_key", "modes")


@query("java_nodes", "SELECT DISTINCT * FROM (" + _each("'class' AS type_tag, 'class:j.S' || k AS node_key", "'class', 'class:j.Base' || h", "'class', 'class:j.M' || k", "'method', 'method:j.S' || k || '.run'", "'method', 'method:j.S' || k || '.local'", "'sql', 'sql:j.S' || k || '.run:3'", "'jsp', 'jsp:w_jsp_' || k || '.jsp'", "'jspsql', 'jspsql:w_jsp_' || k || '.jsp:1'") + ") WHERE node_key NOT LIKE '%service%'")
def _(spark, sf):
    # Edges lead to classes, methods and their statements only where these are defined, so none is inferred and no edge is needed.
    n = ingest.defined_keys(_other_rows(spark, sf, ("head",))).filter(F.col("type_tag").isin("class", "method", "sql", "jsp", "jspsql"))
    return n.filter("node_key NOT LIKE '%w_jsp_%' OR type_tag IN ('jsp', 'jspsql')").select("type_tag", "node_key")


# ---- interchange ----------------------------------------------------------------------------------------------------


@query(
    "interchange_import",
    "SELECT 'node' AS what, 'table:s.t' || p_partkey AS a, 'in/src/f' || p_partkey % 7 || '.sql' AS b FROM part UNION ALL SELECT DISTINCT 'node', 'custom:report:' || p_partkey % 10, CAST(NULL AS VARCHAR) FROM part UNION ALL SELECT 'CustomEdge', 'table:s.t' || p_partkey, 'custom:report:' || p_partkey % 10 FROM part",
)
def _(spark, sf):
    from codeloom.sources import interchange
    from codeloom.work import new_path

    k = F.col("p_partkey")
    part = spark.read.parquet(f"{sf}/part.parquet")
    string = lambda c: c.cast("string")
    key = lambda *kv: F.to_json(F.create_map(*kv))
    none = F.lit("{}")
    node = lambda i, t, m, file: F.concat(F.lit('{"id":"'), i, F.lit(f'","type":"{t}","key":'), m, F.lit(',"properties":'), none, file, F.lit("}"))
    table = node(F.concat(F.lit("t"), string(k)), "table", key(F.lit("schema"), F.lit("S"), F.lit("name"), F.concat(F.lit("T"), string(k))), F.concat(F.lit(',"location":{"file":"./src/f'), string(k % 7), F.lit('.sql","line":1}')))
    report = node(F.concat(F.lit("r"), string(k)), "report", key(F.lit("name"), string(k % 10)), F.lit(""))
    edge = F.concat(F.lit('{"source":"t'), string(k), F.lit('","target":"r'), string(k), F.lit('","type":"feeds"}'))
    doc = F.concat(F.lit('{"format_version":1,"metadata":{},"node_schemas":{"report":{"display_name":"r","key_fields":["name"]}},"edge_schemas":{"feeds":{"display_name":"f"}},"nodes":['), table, F.lit(","), report, F.lit('],"edges":['), edge, F.lit("]}"))
    path = new_path(spark, "documents")
    part.select(doc.alias("value")).write.text(path)
    n, e = interchange.import_graph(interchange.read(spark, path, lines=True), "in")
    return n.select(F.lit("node").alias("what"), F.col("node_key").alias("a"), F.col("file").alias("b")).unionByName(e.select(F.col("edge_type").alias("what"), F.col("src_key").alias("a"), F.col("dst_key").alias("b")))
