from codeloom.model import ACCESS_EXCLUSIVE, LOCK_READ, READ, SHARE, WRITE
from codeloom.sources.plsql import read_sql


def accesses(sql, owner=None):
    return {(t, m, k) for o, t, m, k, *_ in read_sql(sql, "f.sql").accesses if owner is None or o == owner}


def test_subqueries_read_in_every_clause():
    sql = """
    CREATE PROCEDURE restock(p_day DATE) AS
      total INT;
      CURSOR late IS SELECT d.ship FROM delays d JOIN ports q ON q.code = (SELECT max(h.code) FROM harbours h);
    BEGIN
      DELETE FROM crates WHERE crates.lot NOT IN (SELECT lot FROM lots UNION SELECT lot FROM old_lots);
      INSERT INTO report (n) VALUES ((SELECT count(*) FROM bills WHERE day = p_day));
      UPDATE stock SET amount = amount - (SELECT sum(k.amount) FROM picks k) WHERE EXISTS (SELECT 1 FROM alarms WHERE alarms.item = stock.item);
      WITH recent AS (SELECT item FROM sales) SELECT count(*) INTO total FROM recent, (SELECT item FROM parts GROUP BY item HAVING count(*) > (SELECT low FROM bounds)) x;
    END;
    """
    got = accesses(sql, "proc:restock")
    assert {t for t, m, _ in got if m == READ} == {"delays", "ports", "harbours", "lots", "old_lots", "bills", "picks", "alarms", "sales", "parts", "bounds"}
    assert {(t, k) for t, m, k in got if m == WRITE} == {("crates", "delete"), ("report", "insert"), ("stock", "update")}


def test_branches_of_case_and_if_fork_values():
    sql = """
    CREATE PROCEDURE f(p INT) AS s VARCHAR(99); BEGIN
      s := 'LOCK TABLE ';
      CASE p WHEN 1 THEN s := s || 'c1'; WHEN 2 THEN s := s || 'c2'; ELSE s := 'LOCK TABLE c3'; END CASE;
      EXECUTE IMMEDIATE s;
      s := 'DELETE FROM x1'; IF p > 1 THEN s := 'DELETE FROM x2'; IF p > 2 THEN s := 'DELETE FROM x3'; END IF; END IF;
      EXECUTE IMMEDIATE s;
    EXCEPTION WHEN OTHERS THEN NULL; END;
    """
    assert {t for t, *_ in accesses(sql)} == {"c1", "c2", "c3", "x1", "x2", "x3"}


def test_cursor_flows_and_record_fields():
    sql = """
    CREATE PROCEDURE m AS CURSOR c IS SELECT a.k, max(a.v) FROM src a; x INT; y INT; r wide%ROWTYPE; d c%ROWTYPE; BEGIN
      FETCH c INTO x, y; INSERT INTO out1 (k, v) VALUES (x, y);
      FETCH c INTO d; UPDATE out2 SET k = d.k WHERE out2.id = r.code;
      OPEN z FOR SELECT * FROM all_of; FETCH z INTO x; INSERT INTO out3 (q) VALUES (x);
    END;
    """
    f = read_sql(sql, "f")
    assert {m[1:6] for m in f.mappings if m[3] == "column"} == {("out1", "k", "column", "src", "k"), ("out1", "v", "column", None, "y"), ("out2", "k", "column", "src", "k"), ("out3", "q", "column", "all_of", "x")}
    assert [j[1:6] for j in f.joins] == [("out2", "id", "wide", "code", "record")]


def test_conditions_with_or_give_nothing():
    f = read_sql("SELECT 1 FROM t WHERE (a = 1 OR b = 2) AND c = 3 AND NOT d IN (1) AND e LIKE 'x%' AND f NOT BETWEEN 1 AND 2 AND 5 >= g;", "f")
    assert {x[2:5] for x in f.filters} == {("c", "=", "3"), ("e", "like", "'x%'"), ("f", "not between", "1 AND 2"), ("g", "<=", "5")}


def test_statement_kinds_and_locks():
    sql = """TRUNCATE TABLE a, b; ALTER TABLE c ADD x INT; DROP TABLE IF EXISTS s.d; LOCK TABLE e IN SHARE MODE; LOCK TABLE e2;
    CREATE INDEX i ON f (x); DELETE FROM g WHERE x = 1; SELECT * FROM h, i2 FOR UPDATE; VACUUM FULL j;
    MERGE INTO k USING l ON (k.id = l.id) WHEN MATCHED THEN UPDATE SET x = 1 WHEN NOT MATCHED THEN INSERT (id) VALUES (1);
    SELECT EXTRACT(YEAR FROM d1) FROM m WHERE x IS NOT DISTINCT FROM y;"""
    got = accesses(sql)
    assert {("a", ACCESS_EXCLUSIVE, "truncate"), ("b", ACCESS_EXCLUSIVE, "truncate"), ("c", ACCESS_EXCLUSIVE, "alter"), ("s.d", ACCESS_EXCLUSIVE, "drop"), ("e", SHARE, "lock_table")} <= got
    assert {("e2", ACCESS_EXCLUSIVE, "lock_table"), ("f", SHARE, "create_index"), ("g", WRITE, "delete"), ("h", LOCK_READ, None), ("i2", LOCK_READ, None), ("j", ACCESS_EXCLUSIVE, "vacuum_full")} <= got
    assert {("k", WRITE, "merge_update"), ("k", WRITE, "merge_insert"), ("l", READ, None), ("m", READ, None)} <= got
    assert not {t for t, *_ in got} & {"d1", "y"}


def test_calls_locals_builtins_and_packages():
    sql = """
    CREATE PACKAGE BODY s.pk AS
      PROCEDURE one(p_a IN NUMBER, helper VARCHAR2 DEFAULT 'x') IS v NUMBER; TYPE arr IS TABLE OF NUMBER; l arr;
      BEGIN
        v := other.fn(p_a) + nvl(v, 0); two(v); l(1) := 2; helper(3); CALL ext.three(); PERFORM four();
        IF check_it(v) THEN five; END IF;
        SELECT seq1.nextval, six(x) INTO v FROM dual;
      END one;
      FUNCTION two(x NUMBER) RETURN NUMBER IS BEGIN RETURN seven(x); END;
    END pk;
    /
    CREATE PROCEDURE only_spec(x INT);
    """
    f = read_sql(sql, "f.sql")
    by = {}
    for caller, raw, dynamic, _ in f.calls:
        by.setdefault(caller, set()).add(raw)
    assert by["proc:s.pk.one"] == {"other.fn", "two", "ext.three", "four", "check_it", "five", "six"}
    assert by["func:s.pk.two"] == {"seven"}
    assert ("pkg:s.pk", "proc:s.pk.one", "ContainsRoutine") in {e[:3] for e in f.edges}
    assert ("proc:s.pk.one", "seq:seq1", "UsesSequence") in {e[:3] for e in f.edges}
    assert {n["node_key"]: n["params"] for n in f.nodes if n["type_tag"] == "proc"}["proc:s.pk.one"] == [("p_a", "in", "NUMBER"), ("helper", "in", "VARCHAR2")]
    assert [n["node_key"] for n in f.nodes if n["partial"]] == ["proc:only_spec"]


def test_dynamic_sql_values():
    sql = """
    CREATE PROCEDURE dyn(p VARCHAR2) AS v VARCHAR2(100); BEGIN
      v := 'UPDATE '; IF p = 1 THEN v := v || 'a1'; ELSE v := v || 'a2'; END IF;
      EXECUTE IMMEDIATE v || ' SET x = 1';
      EXECUTE IMMEDIATE 'DELETE FROM ' || p;
      EXECUTE IMMEDIATE 'BEGIN pkg.go(1); END;';
    END;
    """
    f = read_sql(sql, "f.sql")
    assert {("a1", "update"), ("a2", "update")} <= {(t, k) for _, t, _, k, *_ in f.accesses}
    assert [c[2] for c in f.calls if c[2]] == [True] and ("proc:dyn", "pkg.go") in {c[:2] for c in f.calls}


def test_column_mappings_filters_and_joins():
    sql = """
    CREATE PROCEDURE m AS BEGIN
      INSERT INTO tgt (a, b, c) SELECT s.x, sum(s.y), 'k' FROM src s JOIN dim d ON s.id = d.id WHERE s.kind = 'A' AND d.n IN (1, 2) AND s.z NOT IN ('q');
      UPDATE tgt SET a = other_col + 1 WHERE id = 5;
    END;
    CREATE VIEW v AS SELECT t.p AS q, t.r FROM base t;
    """
    f = read_sql(sql, "f.sql")
    rows = {(x[1], x[2], x[3], x[4], x[5], x[6]) for x in f.mappings}
    assert {("tgt", "a", "column", "src", "x", "direct"), ("tgt", "b", "column", "src", "y", "aggregated"), ("tgt", "c", "literal", None, "'k'", "direct"), ("tgt", "a", "column", "tgt", "other_col", "derived")} <= rows
    assert {("v", "q", "column", "base", "p", "direct"), ("v", "r", "column", "base", "r", "direct")} <= rows
    assert {("src", "kind", "=", "'A'"), ("dim", "n", "in", "1,2"), ("src", "z", "not in", "'q'")} <= {x[1:5] for x in f.filters}
    assert ("src", "id", "dim", "id") in {x[1:5] for x in f.joins}


def test_broken_text_does_not_stop_a_file():
    f = read_sql("CREATE PROCEDURE ; ))) '; \n garbage ( ; SELECT 1 FROM ok_table; CREATE TABLE t (a INT);", "f.sql")
    assert read_sql("", "x").nodes == [] and f is not None
    assert "ok" in {t for _, t, *_ in read_sql("nonsense here; SELECT * FROM ok;", "f").accesses}


def test_dollar_quoted_function():
    sql = "CREATE FUNCTION f(a int) RETURNS int AS $$ DECLARE b int; BEGIN SELECT x INTO b FROM t1; RETURN g(b); END; $$ LANGUAGE plpgsql;"
    f = read_sql(sql, "f.sql")
    assert [c[:2] for c in f.calls] == [("func:f", "g")] and accesses(sql) == {("t1", READ, None)}


def test_text_of_long_view_is_whole():
    sql = "CREATE VIEW v AS SELECT " + ", ".join(f"column_{i}" for i in range(3000)) + " FROM t_last WHERE last_word = 1;"
    assert any("last_word = 1" in str(x) for x in read_sql(sql, "f.sql").nodes)
