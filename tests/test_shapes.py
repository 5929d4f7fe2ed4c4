import pytest

from codeloom.sources import ingest

TEXT = """CREATE TABLE a.t@1 (id INT PRIMARY KEY, name VARCHAR(@2) DEFAULT 'x@1');
COMMENT ON COLUMN a.t@1.name IS '100 % of @3';
CREATE PACKAGE BODY d.k@1 AS PROCEDURE run IS v_a INT; BEGIN
  k@1.v_ids(@2) := 1; SELECT nvl2(t@3.x, md@4('a'), @2) INTO v_a FROM g.t@3; f@3(v_a); f@2(v_@2);
END; END;
/
CREATE PROCEDURE b.p@1 AS s VARCHAR(9); v_@2 INT; BEGIN
  SELECT x.id INTO v_@2 FROM t@1 x JOIN u@3 y ON x.id = y.id WHERE x.k = @2 AND y.n IN ('@1', 'é@3') AND x.z BETWEEN @2 AND @3;
  s := 'DELETE FROM d@2'; IF v_@2 > @3 THEN s := 'TRUNCATE TABLE e@3_'; END IF; EXECUTE IMMEDIATE s; EXECUTE IMMEDIATE s || '_x@4';
END;
/
"""
#: Two strings of dynamic SQL that are joined digit to digit: d1 and 23 name the table that d12 and 3 name, d1 and 34 do not.
JOINED = "CREATE PROCEDURE p AS s VARCHAR(9); BEGIN IF x THEN s := 'DELETE FROM d@1'; ELSE s := 'DELETE FROM d@2'; END IF; EXECUTE IMMEDIATE s || '@3'; END;\n/\n"


def filled(text, *numbers):
    for i, n in enumerate(numbers, 1):
        text = text.replace(f"@{i}", str(n))
    return text


def by_shape(shapes, files):
    out = []
    for path, text, specs in files:
        held = [[] for _ in range(10)]
        out.append(list(zip(*held)) if shapes.add(held, path, text, specs) else None)
        if out[-1] is not None:
            out[-1] = list(zip(*held))
    return out


@pytest.mark.parametrize("want", [None, frozenset(("access", "head", "error")), frozenset(("filter", "mapping", "call", "error"))])
def test_files_that_differ_in_numbers_are_read_once(monkeypatch, want):
    monkeypatch.setattr(ingest, "_shapes", {})
    numbers = [(7 + 13 * i, 30 + i, 900 - i, 5) for i in range(40)] + [(i, i, 3, 5) for i in range(11, 31)] + [(2, 5, 22, 2), (4, 1, 2, 5), (1, 5, 2, 6)]
    files = [(f"f{i}.sql", filled(TEXT, *n), {f"d.k{n[0]}": f"v_ids ids{n[1]}"}) for i, n in enumerate(numbers)]
    direct = [list(ingest._rows(path, "sql", text.encode(), specs, want)) for path, text, specs in files]
    reads, read = [], ingest.read_sql
    monkeypatch.setattr(ingest, "read_sql", lambda *a: reads.append(a) or read(*a))
    got = by_shape(ingest._sql_shapes(want, want), files)
    assert all(g is None or g == d for g, d in zip(got, direct))
    assert got.count(None) <= 5 and len(reads) <= 6
    # Numbers that stand in words the reader knows are letters: md5 is a function of the database, md6 is not.
    assert len({str(d) for d in direct}) == len(direct)


def test_joined_strings_have_no_template(monkeypatch):
    monkeypatch.setattr(ingest, "_shapes", {})
    shapes = ingest._sql_shapes(None, None)
    files = [(f"f{i}.sql", filled(JOINED, *n), {}) for i, n in enumerate([(1, 12, 34), (1, 12, 34), (7, 8, 9), (7, 8, 9)])]
    assert by_shape(shapes, files) == [None] * 4


def test_paths_and_marks_in_texts_are_safe(monkeypatch):
    monkeypatch.setattr(ingest, "_shapes", {})
    shapes = ingest._sql_shapes(None, None)
    odd = ["SELECT 'a\x02b' FROM t1;", "SELECT 'a\x03b' FROM t1;", "SELECT '830415926162712' FROM t1;"]
    assert by_shape(shapes, [("f", x, {}) for x in odd for _ in range(3)]) == [None] * 9
    # A digit at an end of a text, and texts that hold what parts a text from its specifications.
    ends = ["SELECT 1 FROM t7", "7 SELECT x FROM t", "SELECT 1 FROM t 7", "x7", "7x"]
    for x in ends * 3:
        held = [[] for _ in range(10)]
        if shapes.add(held, "g%s", x, {}):
            assert list(zip(*held)) == list(ingest._rows("g%s", "sql", x.encode()))
    assert not shapes.add([[] for _ in range(10)], "a\x03b", ends[0], {})


def test_kept_records_come_with_all_errors():
    broken = b"CREATE TABLE t1 (id INT); CREATE PROCEDURE p AS BEGIN DELETE FROM t1; END;\n/\n"
    every = list(ingest._rows("a", "sql", broken))
    kept = list(ingest._rows("a", "sql", broken, None, None, frozenset(("head", "error"))))
    assert [r[:6] for r in kept] == [r[:6] for r in every if r[0] in ("node", "error")] and all(r[6] is None for r in kept if r[3] == "proc")
