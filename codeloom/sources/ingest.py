"""From files to a graph: scan, decode, parse on the executors, then resolve names with joins.

All symbol tables are complete before any name is resolved, so results do not depend on the order of files.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.model import CATEGORY, WRITE
from codeloom.operators.search import noise, resolve_calls
from codeloom.sources.other import read_java, read_jsp, read_mapper
from codeloom.sources.plsql import Found, package_heads, read_sql
from codeloom.sources.shapes import Shapes
from codeloom.work import materialize, small

#: Kinds of files by ending, which is compared as it is written.
KINDS = {".sql": "sql", ".java": "java", ".xml": "xml", ".jsp": "jsp"}
# Schemas and tables of the database itself.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "sys", "dbe_perf", "snapshot", "blockchain", "cstore", "db4ai", "dbe_pldebugger", "dbe_pldeveloper", "dbe_sql_util", "pkg_service", "sqladvisor")
SYSTEM_TABLES = ("dual", "sys_dummy")

#: Records that a statement can give, and those that definitions, edges and column mappings of a graph are made of.
STATEMENT_RECORDS = frozenset("call access mapping filter join equality anchor type_use predicate enum edge error".split())
GRAPH = ("node", "item", "call", "edge", "access", "mapping", "anchor", "type_use", "type_ref", "field", "java_call")
#: Records that can depend on what the specification of a body's package declares.
SCOPED = STATEMENT_RECORDS - {"error"}
#: Rows that a parser hands on at a time at most.
ROWS_PER_BATCH = 20_000
#: Bytes of files whose rows are handed on together at most, but for the last file.
BYTES_PER_BATCH = 4 << 20
RAW = "record string, file string, a string, b string, c string, d string, e string, f string, n long, line int"


def decode(content: bytes) -> str:
    """UTF-8, else GBK, else UTF-8 with replacements."""
    for name in ("utf-8-sig", "gbk"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", "replace")


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), kind, content, hash, mtime of all source files under root, without those that match a pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{sql,java,xml,jsp}").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    path = F.substring_index("path", base, -1)
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.regexp_extract("path", r"(\.\w+)$", 1))
    out = files.select(path.alias("path"), kind.alias("kind"), "content", F.sha2("content", 256).alias("hash"), F.unix_millis("modificationTime").alias("mtime"))
    for pattern in exclude:
        out = out.filter(~F.col("path").rlike(_glob(pattern)))
    return out


def _glob(pattern: str) -> str:
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def _rows(path: str, kind: str, content: bytes, specs: dict[str, str] | None = None, want: frozenset[str] | None = None, kept: frozenset[str] | None = None) -> Iterator[tuple]:
    """record, file, a to f, n, line: all rows of a file in one wide shape, of the records of want (None: of all) that are kept (None: as want). specs: see plsql.Reader."""
    kept = want if kept is None else kept
    if kind == "sql":
        return _asked(_file_rows(path, read_sql(decode(content), path, specs, want), kept), kept)
    return _asked(_other_rows(path, kind, content, want), kept)


def _asked(rows: Iterator[tuple], want: frozenset[str] | None) -> Iterator[tuple]:
    return rows if want is None else (r for r in rows if r[0] in want or r[0] == "node" and "head" in want)


def _sql_shapes(want: frozenset[str] | None, kept: frozenset[str] | None) -> Shapes:
    """Rows of SQL files by their shapes (see shapes.py). A worker keeps those of the last records that were asked for."""

    def read(path: str, text: str, specs: dict[str, str]) -> tuple[list[tuple], bool]:
        f = read_sql(text, path, specs, want)
        return list(_asked(_file_rows(path, f, kept), kept)), f.joined

    if (want, kept) not in _shapes:
        _shapes.clear()
        _shapes[want, kept] = Shapes(read)
    return _shapes[want, kept]


_shapes: dict[tuple, Shapes] = {}


def _other_rows(path: str, kind: str, content: bytes, want: frozenset[str] | None) -> Iterator[tuple]:
    """Rows of a file of any other kind."""
    if kind == "xml":
        for s in read_mapper(content):
            key = f"mapper:{s['namespace']}.{s['statement_id']}"
            yield ("node", path, key, "mapper", s["namespace"], s["statement_id"], s["sql"], s["kind"], None, s["line"])
            for v in s["variants"]:
                yield ("variant", path, key, v, None, None, None, None, None, s["line"])
            if s["cut"]:
                yield ("bound", path, key, "variants", None, None, None, None, s["cut"], s["line"])
            yield from _sql_rows(path, s["sql"], key, s["line"], want)
        return
    text = decode(content)
    j = read_java(text) if kind == "java" else read_jsp(text, re.sub(r"\W", "_", path))
    for c in j["classes"]:
        yield ("node", path, f"class:{c['fqn']}", "class", c["package"], c["name"], None, c["kind"], None, c["line"])
        for how, names in (("Extends", c["extends"]), ("Implements", c["implements"])):
            for x in names:
                yield ("type_ref", path, f"class:{c['fqn']}", x, how, None, None, None, None, c["line"])
    for m in j["methods"]:
        yield ("node", path, f"method:{m['fqn']}", "method", m["class_fqn"], m["name"], m["signature"], None, None, m["line"])
        yield ("edge", path, f"class:{m['class_fqn']}", f"method:{m['fqn']}", "ContainsMethod", None, None, None, None, m["line"])
    for c in j["calls"]:
        yield ("java_call", path, f"method:{c['class_fqn']}.{c['method']}", c["object"], c["callee"], c["argument"], c["class_fqn"], None, None, c["line"])
    for x in j["fields"]:
        yield ("field", path, x["class_fqn"], x["type"], x["name"], x["how"], None, None, None, None)
    for s in j["sql"]:
        tag = "jspsql" if kind == "jsp" else "sql"
        key = f"{tag}:{path}:{s['line']}" if kind == "jsp" else f"sql:{s['class_name'] or ''}.{s['method_name'] or ''}:{s['line']}"
        yield ("node", path, key, tag, s["class_name"], s["method_name"], s["sql"], s["how"], None, s["line"])
        if s["method_name"] and s["class_name"] and kind == "java":
            yield ("edge", path, f"method:{s['class_name']}.{s['method_name']}", key, "ContainsSql", None, None, None, None, s["line"])
        if kind == "jsp":
            yield ("edge", path, f"jsp:{path}", key, "ContainsSql", None, None, None, None, s["line"])
        yield from _sql_rows(path, s["sql"], key, s["line"], want)
    if kind == "jsp":
        yield ("node", path, f"jsp:{path}", "jsp", None, path.rpartition("/")[2], None, None, None, 1)


def _sql_rows(path: str, sql: str, owner: str, line: int, want: frozenset[str] | None) -> Iterator[tuple]:
    """Rows of a statement that another language holds."""
    if want is not None and want.isdisjoint(STATEMENT_RECORDS):
        return
    called = re.match(r"(?is)^\s*\{?\s*\??\s*=?\s*call\s+([\w.$]+)", sql)
    if called:
        yield ("call", path, owner, called[1].lower(), "CallsProcedure", None, None, None, 0, line)
        return
    # Statements belong to no routine of their own text, so their rows go to the given owner.
    for record, _, a, *rest, _ in _found_rows(path, read_sql(sql, path, want=want), want):
        if a == f"file:{path}":
            if record == "access":
                rest[2] = f"{owner}|{rest[2]}"
            yield (record, path, owner, *rest, line)


def _file_rows(path: str, f: Found, want: frozenset[str] | None) -> Iterator[tuple]:
    """Rows of an SQL file, of nodes and the records of want."""
    whole = want is None or "node" in want
    for n in f.nodes:
        yield ("node", path, n["node_key"], n["type_tag"], n["schema_name"], n["name"], n["sql"] or (json.dumps(n.get("body_sql") or []) if whole or "body_sql" not in n else None), n["package_name"], int(n["partial"]), n["line"])
        for i, (p, mode, kind_) in enumerate(n.get("params") or []):
            yield ("param", path, n["node_key"], p, mode, kind_, None, None, i, n["line"])
    yield from _found_rows(path, f, want)


def _found_rows(path: str, f: Found, want: frozenset[str] | None) -> Iterator[tuple]:
    asked = lambda record, rows: rows if want is None or record in want else ()
    for caller, raw, dynamic, line in asked("call", f.calls):
        yield ("call", path, caller, raw, "DynamicCall" if dynamic else "DirectCall", None, None, None, int(dynamic), line)
    for owner, table, mode, kind, statement, line in asked("access", f.accesses):
        yield ("access", path, owner, table, kind, str(statement), None, None, mode, line)
    for owner, tt, tc, sk, st, sc, mk, text, line in asked("mapping", f.mappings):
        yield ("mapping", path, owner, tt, tc, st, sc, f"{sk}|{mk}|{text}", None, line)
    for owner, table, column, op, value, transform, line in asked("filter", f.filters):
        yield ("filter", path, owner, table, column, op, value, transform, None, line)
    for owner, lt, lc, rt, rc, source, line in asked("join", f.joins):
        yield ("join", path, owner, lt, lc, rt, rc, source, None, line)
    for owner, lt, lc, rt, rc, text, line in asked("equality", f.equalities):
        yield ("equality", path, owner, lt, lc, rt, rc, text, None, line)
    for owner, name, kind, column, site, line in asked("anchor", f.anchors):
        yield ("anchor", path, owner, name, kind, column, site, None, None, line)
    for owner, name, line in asked("type_use", f.types):
        yield ("type_use", path, owner, name, None, None, None, None, None, line)
    for owner, pid, table, column, op, value, confidence, _, line in asked("predicate", f.predicates):
        yield ("predicate", path, owner, f"{pid}|{confidence}", table, column, op, value, None, line)
    for table, i, name, kind, nullable, pk, default, line in asked("column", f.columns):
        yield ("column", path, table, name, kind, "null" if nullable else "not null", "pk" if pk else None, default, i, line)
    for table, column, text, line in asked("comment", f.comments):
        yield ("comment", path, table, column, text, None, None, None, None, line)
    for owner, table, column, literal, result, line in asked("enum", f.enums):
        yield ("enum", path, owner, table, column, literal, result, None, None, line)
    for src, dst, kind, line in asked("edge", f.edges):
        yield ("edge", path, src, dst, kind, None, None, None, None, line)
    for package, name, kind, text, spec, i, line in asked("item", f.items):
        yield ("item", path, package, name, kind, text, "spec" if spec else "body", None, i, line)
    for line, message in asked("error", f.errors):
        yield ("error", path, message, None, None, None, None, None, None, line)


def _append(held: list[list], rows: list[tuple]) -> None:
    for out, column in zip(held, zip(*rows)):
        out.extend(column)


def _dealt(files: DataFrame) -> DataFrame:
    """Files in four tasks a core, by their paths."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, F.xxhash64("path"))


def heads(files: DataFrame, deal: bool = False) -> DataFrame:
    """path, name, body, text of every package of SQL files (path, kind, content); text holds a specification's declarations.

    deal: as of parse; files that cannot hold a package are not dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_in = lambda path, text: [(path, *x) for x in package_heads(text)]
        shapes = Shapes(lambda path, text, _: (found_in(path, text), False))
        for b in batches:
            held = [[], [], [], []]
            for path, content in zip(b.column(0), b.column(1)):
                path, text = path.as_py(), decode(content.as_py())
                if not shapes.add(held, path, text, {}):
                    _append(held, found_in(path, text))
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.string(), pa.string(), pa.bool_(), pa.string()))], ["path", "name", "body", "text"])

    some = F.lower(F.col("content").cast("string")).contains("package")
    files = files.filter((F.col("kind") == "sql") & some).select("path", "content")
    return (_dealt(files) if deal else files).mapInArrow(run, "path string, name string, body boolean, text string")


def specs_of(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, specs: for each file with package bodies, the declarations of their specifications by name.

    found: as of heads, written; known: name, text of specifications of files that are not read now. A body takes the specification
    of its very name, else, if one of both names has no schema, the only one of its bare name. Of two of one name that
    of the first file counts.
    """
    text = found.filter("NOT body").select("name", "path", "text")
    if known is not None:
        # What is read now counts more than what was known of the same name.
        text = text.unionByName(known.select("name", F.lit(None).cast("string").alias("path"), "text").join(text.select("name"), "name", "left_anti"))
    text = text.groupBy("name").agg(F.min(F.struct("path", "text"))["text"].alias("text"))
    bare = lambda c: F.substring_index(c, ".", -1)
    single = text.groupBy(bare(F.col("name")).alias("bare")).agg(F.min(F.struct("name", "text")).alias("one"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    asked = found.filter("body").select("path", "name").distinct()
    exact = asked.join(text, "name")
    loose = asked.join(text.select("name"), "name", "left_anti").withColumn("bare", bare(F.col("name"))).join(single, "bare")
    loose = loose.filter((F.col("name") == F.col("bare")) | (F.col("one.name") == F.col("bare"))).select("name", "path", F.col("one.text").alias("text"))
    given = exact.select("name", "path", "text").unionByName(loose).filter("text <> ''")
    return given.groupBy(F.col("path").alias("_path")).agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("specs"))


def parse(files: DataFrame, deal: bool = True, known: DataFrame | None = None, records: tuple[str, ...] | None = None, kept: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of all files (path, kind, content); a file is parsed by one task.

    records: the kinds of rows that are asked for, such as those of a graph (GRAPH); they are the same as among all rows, and
    what gives only others is not looked at. Errors always come. None: all rows. The record head stands for rows of nodes without the
    statements of routines, which then have null for them.

    kept: records that are handed on of those asked for; what gives the others is looked at, and its errors are found. None: as records.

    Two passes: the first reads the specifications of packages only and hands each file with bodies what theirs declare, the
    second reads everything. Where no record that is asked for can depend on them, there is no first pass. known: specifications of files that are not among these (see specs_of).
    deal: files come in few partitions and are dealt to four tasks a core by their paths, for either pass. A scan of a folder is
    dealt by the sizes of its files already.
    """
    want = None if records is None else frozenset(records) | {"error"}
    keep = want if kept is None else frozenset(kept) | {"error"}
    given = None
    found = None if want is not None and want.isdisjoint(SCOPED) else materialize(heads(files, deal), "package-heads")
    # Without declarations there is nothing to hand on.
    if found is not None and not found.filter("body").isEmpty() and (known is not None or not found.filter("NOT body AND text <> ''").isEmpty()):
        given = materialize(specs_of(found, known), "package-specs")
    names = [x.split()[0] for x in RAW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 8 + [pa.int64(), pa.int32()]
        # Rows of several files go on together: small files have few rows each, and a batch has its price.
        held, size = [[] for _ in names], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds)], names)
        shapes = _sql_shapes(want, keep)
        # Rows that are held are no garbage; to look through them after every few files took a fifth of the time.
        gc.set_threshold(100_000, 20, 50)
        for b in batches:
            for path, kind, content, specs in zip(*(b.column(i) for i in range(4))):
                path, kind, content, specs, new = path.as_py(), kind.as_py(), content.as_py(), dict(specs.as_py() or ()), []
                size += len(content)
                try:
                    if kind != "sql" or not shapes.add(held, path, decode(content), specs):
                        for row in _rows(path, kind, content, specs, want, keep):
                            new.append(row)
                            if len(new) == ROWS_PER_BATCH:
                                _append(held, new)
                                yield batch()
                                held, new, size = [[] for _ in names], [], 0
                except Exception as e:  # a file that fails is reported and what came before stays
                    new.append(("error", path, f"{type(e).__name__}: {e}", *[None] * 7))
                _append(held, new)
                if held[0] and (size >= BYTES_PER_BATCH or len(held[0]) >= ROWS_PER_BATCH):
                    yield batch()
                    held, size = [[] for _ in names], 0
        if held[0]:
            yield batch()

    rows = files.select("path", "kind", "content")
    if deal:
        rows = _dealt(rows)
    if given is None:
        rows = rows.withColumn("specs", F.lit(None).cast("map<string,string>"))
    else:
        rows = rows.join(small(given), F.col("path") == F.col("_path"), "left").drop("_path")
    return rows.mapInArrow(run, RAW)


def category(edge_type: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORY.items() for x in kv)), edge_type)


RELATIONS = ("table", "view", "mview")
OTHERS = ("proc", "func", "pkg", "seq", "type")


def resolve_objects(uses: DataFrame, defined: DataFrame, tags: tuple[str, ...], synonyms: DataFrame | None = None) -> DataFrame:
    """text, schema, key: the defined object of each name as it is written (text) in an owner's schema (or null).

    A qualified text is only the object of that name. A bare text is, in this order, the object of the owner's schema, the one
    without a schema, the only one of that name in any schema, and the only synonym of that name. At each of the first two
    steps a synonym (full, name, key of its target) counts after an object, and before the next step. Of a table and a view
    of one name the view counts. A text that is nothing of these has no row. One equi-join on (text, how) and one minimum.
    """
    own = defined.filter(F.regexp_replace("type_tag", r"\*$", "").isin(*tags)).select("node_key", "type_tag", F.substring_index("node_key", ":", -1).alias("full"), "name")
    keys = own.select("node_key", (F.col("type_tag") == "table").alias("late"), F.explode(F.array(F.struct(F.lit("full").alias("how"), F.col("full").alias("name")), F.struct(F.lit("name").alias("how"), F.col("name").alias("name")))).alias("x"))
    keys = keys.select("node_key", F.col("late").cast("int").alias("late"), "x.how", "x.name", F.substring_index("node_key", ":", -1).alias("full"))
    if synonyms is not None:
        ways = F.explode(F.array(F.struct(F.lit("full").alias("how"), F.col("full").alias("name")), F.struct(F.lit("synonym").alias("how"), F.col("name").alias("name")))).alias("x")
        keys = keys.unionByName(synonyms.select(F.col("key").alias("node_key"), F.lit(2).alias("late"), ways, "full").select("node_key", "late", "x.how", "x.name", "full"))
    # A name counts as the only one if all its objects have one full name.
    first = F.min(F.struct("late", "node_key"))["node_key"]
    table = keys.groupBy("how", "name").agg(first.alias("key"), F.count_distinct("full").alias("many")).filter("how = 'full' OR many = 1")
    asked = uses.select("text", "schema").distinct()
    bare = F.instr("text", ".") == 0
    ask = F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("full").alias("how"), F.when(bare & F.col("schema").isNotNull(), F.concat_ws(".", "schema", "text")).alias("name")),
        F.struct(F.lit(2).alias("rank"), F.lit("full").alias("how"), F.col("text").alias("name")),
        F.struct(F.lit(3).alias("rank"), F.lit("name").alias("how"), F.when(bare, F.col("text")).alias("name")),
        F.struct(F.lit(4).alias("rank"), F.lit("synonym").alias("how"), F.when(bare, F.col("text")).alias("name")),
    )).alias("x")
    met = asked.select("text", "schema", ask).select("text", "schema", "x.*").join(small(table), ["how", "name"])
    return met.groupBy("text", "schema").agg(F.min(F.struct("rank", "key"))["key"].alias("key"))


def synonym_targets(defined: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """full, name, key of every synonym that leads to an object of these tags, or to a table that nothing defines."""
    own = defined.filter("type_tag = 'synonym'").select(F.substring_index("node_key", ":", -1).alias("full"), "name", F.lower("schema_name").alias("schema"), F.col("sql").alias("text"))
    own = own.withColumn("text", F.lower(F.regexp_replace(F.regexp_extract("text", r"(?i)\bfor\s+(.*)$", 1), r'[\s"]', ""))).filter("text <> ''")
    own = materialize(own, "synonyms")
    hit = _renamed(own.withColumnsRenamed({"schema": "_schema"}).withColumn("key", F.col("text")), "key", materialize(resolve_objects(own, defined, tags), "synonym-relations"), F.lit(None).cast("string"))
    hit = _renamed(hit, "text", materialize(resolve_objects(own, defined, OTHERS), "synonym-others"), F.concat(F.lit("table:"), "text"))
    return hit.withColumn("key", F.coalesce("key", "text")).filter(F.substring_index("key", ":", 1).isin(*tags)).select("full", "name", "key")


def _renamed(df: DataFrame, column: str, names: DataFrame, otherwise: Column) -> DataFrame:
    """df with the key of a name in column and the schema in _schema, or what stands for it if it has none."""
    hit = names.select(F.col("text").alias("_text"), F.col("schema").alias("_s"), F.col("key").alias("_key"))
    return df.join(small(hit), (F.col(column) == F.col("_text")) & F.col("_schema").eqNullSafe(F.col("_s")), "left").withColumn(column, F.coalesce("_key", otherwise)).drop("_text", "_s", "_key")


def definitions(rows: DataFrame) -> DataFrame:
    """One row for each defined node; of several definitions the complete and first one stays."""
    defined = rows.filter("record = 'node'").select(
        F.col("a").alias("node_key"), F.col("b").alias("type_tag"), F.col("c").alias("schema_name"), F.col("d").alias("name"), F.col("f").alias("package_name"), "file", "line",
        F.lit(True).alias("explicit"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("partial"), F.col("e").alias("sql"),
    )
    return defined.groupBy("node_key").agg(F.min(F.struct("partial", "file", "line", "type_tag", "schema_name", "name", "package_name", "explicit", "sql")).alias("x")).select("node_key", "x.*")


def defined_keys(rows: DataFrame) -> DataFrame:
    """node_key, type_tag of definitions(rows), without the texts of their statements on the way."""
    defined = rows.filter("record = 'node'").select(F.col("a").alias("node_key"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("partial"), "file", "line", F.col("b").alias("type_tag"))
    return defined.groupBy("node_key").agg(F.min(F.struct("partial", "file", "line", "type_tag"))["type_tag"].alias("type_tag"))


def package_items(rows: DataFrame) -> DataFrame:
    """package_key, name of what the specifications of packages declare besides routines."""
    return rows.filter("record = 'item' AND e = 'spec'").select(F.col("a").alias("package_key"), F.col("b").alias("name")).distinct()


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and column mappings of parsed rows (materialised by the caller)."""
    defined = materialize(definitions(rows), "defined")
    edges, mappings = link(rows, defined, package_items(rows))
    return finish(defined, edges), edges, mappings


#: Edge types by what they are made from; all others come from rows as they are.
CALLS, JAVA = ("DirectCall", "DynamicCall", "CallsProcedure"), ("Extends", "Implements", "CallsJava", "InvokesMapper")
POINTING = ("IndexesTable", "TriggersTable", "DependsOn")


def records_of(kinds: tuple[str, ...]) -> tuple[str, ...]:
    """Records that edges of these types are made from, besides the definitions of nodes."""
    out = {"node", "edge"}
    for some, records in ((CALLS, ("call", "item")), (("TableAccess",), ("access", "mapping")), (("AnchorsOn",), ("anchor",)), (("ReferencesType",), ("type_use",)), (JAVA, ("type_ref", "field", "java_call"))):
        if set(some) & set(kinds):
            out |= set(records)
    own = {k for some in (CALLS, JAVA) for k in some} | {"TableAccess", "AnchorsOn", "ReferencesType"}
    return tuple(sorted(out if set(kinds) - own else out - {"edge"}))


def link(rows: DataFrame, defined: DataFrame, items: DataFrame, kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and column mappings of the owners of rows, by the definitions and items of packages of the whole graph.

    Every name of a table, view or other object goes through resolve_objects, in accesses, dependencies, anchors, triggers,
    indexes, synonyms and column mappings alike. Calls are resolved by the cascade of search.resolve_calls; what stays open
    becomes an unresolved node, unless it is a package's variable or type. An access edge carries read_tables: what else the
    statements of its writes access, or what values of theirs come from. All edges of an owner follow from its own rows and from the
    definitions of the names that these hold, so a part of the owners can be linked by itself. Likewise with kinds only edges
    of these types are made, the same as among all; rows need hold no more than records_of(kinds) then. Mappings come from
    what rows of them there are.
    """
    want = lambda *some: kinds is None or bool(set(some) & set(kinds))
    schemas = defined.select(F.col("node_key").alias("_owner"), F.lower("schema_name").alias("_schema"), F.col("package_name").alias("_package"))
    schemas = materialize(schemas.filter("_schema IS NOT NULL OR _package IS NOT NULL"), "schemas")
    within = lambda df, owner: df.join(small(schemas), F.col(owner) == F.col("_owner"), "left").drop("_owner")
    none = {"modes": F.lit(None).cast("int"), "write_kinds": F.lit(None).cast("array<string>"), "read_tables": F.lit(None).cast("array<string>"), "detail": F.lit(None).cast("string")}
    shaped = lambda df: df.select("src_key", "dst_key", "edge_type", *((F.col(c) if c in df.columns else v).alias(c) for c, v in none.items()), "file", "line")
    parts = []
    if want(*CALLS):
        parts.append(shaped(_calls(rows, defined, items, within)))

    # Every name of a relation with its owner's schema, wherever it stands.
    plain = rows.filter("record = 'edge'").select(F.col("a").alias("src_key"), F.col("b").alias("dst_key"), F.col("c").alias("edge_type"), "file", "line")
    if kinds is not None:
        plain = plain.filter(F.col("edge_type").isin(*kinds))
    plain = within(plain.dropDuplicates(["src_key", "dst_key", "edge_type"]), "src_key").drop("_package")
    aliases = plain.filter("edge_type = 'AliasesObject'")
    anchors = within(rows.filter("record = 'anchor'").select(F.col("a").alias("src_key"), F.col("b").alias("name"), F.concat_ws("|", "c", F.coalesce("d", F.lit("")), "e").alias("detail"), "file", "line"), "src_key").drop("_package")
    pointing = plain.filter(F.col("dst_key").startswith("table:")).withColumn("dst_key", F.substring_index("dst_key", ":", -1))
    name_of = lambda df, c: df.filter(F.col(c).isNotNull()).select(F.col(c).alias("text"), F.col("_schema").alias("schema"))
    kind = F.split("f", r"\|", 3)
    mapped = rows.filter("record = 'mapping'").select(
        F.col("a").alias("owner_key"), F.col("b").alias("target_table"), F.col("c").alias("target_column"), kind[0].alias("source_kind"), F.col("d").alias("source_table"), F.col("e").alias("source_column"),
        kind[1].alias("mapping_kind"), kind[2].alias("expression"), "line",
    ).distinct()
    mapped = materialize(within(mapped, "owner_key").drop("_package"), "mapped")
    uses = name_of(mapped, "target_table").unionByName(name_of(mapped, "source_table"))
    if want("TableAccess"):
        used = rows.filter("record = 'access'").select(F.col("a").alias("src_key"), F.col("b").alias("name"), F.col("c").alias("write_kind"), F.col("d").alias("statement"), F.col("n").cast("int").alias("mode"), "file", "line")
        used = materialize(within(used, "src_key").drop("_package"), "uses")
        uses = uses.unionByName(name_of(used, "name"))
    if want("AnchorsOn"):
        uses = uses.unionByName(name_of(anchors, "name"))
    if want(*POINTING):
        uses = uses.unionByName(name_of(pointing, "dst_key"))
    if want("AliasesObject"):
        of_aliases = name_of(aliases, "dst_key")
        uses = uses.unionByName(of_aliases)
        # Targets of synonyms first; then a synonym stands for its target wherever a name is looked for.
        to_relations = materialize(resolve_objects(of_aliases, defined, RELATIONS), "alias-relations")
        others = materialize(resolve_objects(of_aliases, defined, OTHERS), "alias-others")
        aliases = _renamed(aliases.withColumn("text", F.col("dst_key")), "dst_key", to_relations, F.lit(None).cast("string"))
        aliases = _renamed(aliases, "text", others, F.concat(F.lit("table:"), "text")).withColumn("dst_key", F.coalesce("dst_key", "text")).drop("text")
        parts.append(shaped(materialize(aliases, "aliases")))
    resolving = want("TableAccess", "AnchorsOn", "AliasesObject", *POINTING) or not mapped.isEmpty()
    names = materialize(resolve_objects(uses.distinct(), defined, RELATIONS, synonym_targets(defined, RELATIONS)), "names") if resolving else None

    in_table = lambda c: F.concat(F.lit("table:"), c)
    if want("TableAccess"):
        parts.append(shaped(_table_access(used, mapped, names)))
    if want(*POINTING):
        parts.append(shaped(_renamed(pointing, "dst_key", names, in_table("dst_key"))))
    if want("AnchorsOn"):
        anchored = _renamed(anchors.withColumnRenamed("name", "dst_key"), "dst_key", names, in_table("dst_key")).withColumn("edge_type", F.lit("AnchorsOn"))
        parts.append(shaped(anchored.groupBy("src_key", "dst_key", "edge_type", "detail").agg(F.min(F.struct("line", "file")).alias("x")).select("src_key", "dst_key", "edge_type", "detail", "x.*")))
    if want("UsesSequence"):
        # A sequence in the owner's schema or of the very name; else an inferred one.
        seqs = plain.filter("edge_type = 'UsesSequence'").withColumn("dst_key", F.substring_index("dst_key", ":", -1))
        known = resolve_objects(name_of(seqs, "dst_key"), defined.withColumn("name", F.when(F.instr("node_key", ".") == 0, F.col("name"))), ("seq",))
        parts.append(shaped(_renamed(seqs, "dst_key", known, F.concat(F.lit("seq:"), "dst_key"))))
    if want("ReferencesType"):
        types = within(rows.filter("record = 'type_use'").groupBy(F.col("a").alias("src_key"), F.col("b").alias("dst_key")).agg(F.min(F.struct("line", "file")).alias("x")).select("src_key", "dst_key", "x.*"), "src_key").drop("_package")
        types = _renamed(types, "dst_key", resolve_objects(name_of(types, "dst_key"), defined, ("type",)), F.lit(None).cast("string"))
        parts.append(shaped(types.filter("dst_key IS NOT NULL").withColumn("edge_type", F.lit("ReferencesType"))))
    parts.append(shaped(plain.filter(~F.col("dst_key").startswith("table:") & ~F.col("edge_type").isin("UsesSequence", "AliasesObject"))))
    if want(*JAVA):
        parts.append(shaped(java_edges(rows, defined)))
    edges = parts[0]
    for x in parts[1:]:
        edges = edges.unionByName(x)
    edges = edges.dropDuplicates(["src_key", "dst_key", "edge_type", "detail"])
    if kinds is not None:
        edges = edges.filter(F.col("edge_type").isin(*kinds))
    edges = materialize(edges.withColumn("category", category(F.col("edge_type"))), "edges")

    mappings = mapped
    for c in ("target_table", "source_table") if resolving else ():
        mappings = _renamed(mappings, c, names, F.col(c)).withColumn(c, F.substring_index(c, ":", -1))
    return edges, mappings.select("owner_key", "target_table", "target_column", "source_kind", "source_table", "source_column", "mapping_kind", "expression", "line").distinct()


def _calls(rows: DataFrame, defined: DataFrame, items: DataFrame, within) -> DataFrame:
    """Call edges, one a caller and text."""
    raw = rows.filter("record = 'call'").select("file", "line", F.col("a").alias("src_key"), F.col("b").alias("raw"), F.col("c").alias("edge_type"))
    one = raw.groupBy("src_key", "raw").agg(F.min(F.struct("line", "file", "edge_type")).alias("x")).select("src_key", "raw", "x.*")
    one = within(one, "src_key").withColumnRenamed("_schema", "caller_schema").withColumnRenamed("_package", "caller_package")
    one = materialize(one.withColumn("call_id", F.xxhash64("src_key", "raw")), "calls")
    return _called(one, defined, items)


def _called(one: DataFrame, defined: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of one (call_id, raw, caller_schema, caller_package, written) that call a routine, with its key, or that of an unresolved one, as dst_key."""
    routines = defined.filter("substr(type_tag, 1, 4) IN ('proc', 'func')").select(F.col("node_key").alias("routine_key"), "schema_name", "package_name", "name")
    # A bare name is looked for in the caller's own package first.
    own = routines.filter("package_name is not null").select(F.lower("package_name").alias("caller_package"), F.lower("name").alias("raw"), F.col("routine_key").alias("own_key"))
    own = own.groupBy("caller_package", "raw").agg(F.min("own_key").alias("own_key"))
    found = resolve_calls(one.select("call_id", "raw", "caller_schema"), routines).select("call_id", "strategy", "routine_key")
    whole = F.substring_index("package_key", ":", -1)
    declared = items.select(F.explode(F.array(F.concat_ws(".", whole, "name"), F.concat_ws(".", F.substring_index(whole, ".", -1), "name"))).alias("raw")).distinct()
    calls = one.join(small(own), ["caller_package", "raw"], "left").join(found, "call_id", "left")
    # A call of a routine stays even if an item of another package has its text.
    calls = calls.join(small(materialize(declared, "package-items").withColumn("_item", F.lit(True))), "raw", "left").filter("_item IS NULL OR own_key IS NOT NULL OR routine_key IS NOT NULL").drop("_item")
    return calls.filter(noise(F.col("raw")).isNull()).withColumn("dst_key", F.coalesce("own_key", "routine_key", F.concat(F.lit("unres:"), "raw")))


def _table_access(used: DataFrame, mapped: DataFrame, names: DataFrame) -> DataFrame:
    """Access edges, one a pair of owner and table."""
    in_table = lambda c: F.concat(F.lit("table:"), c)
    used = materialize(_renamed(used, "name", names, in_table("name")).withColumnRenamed("name", "dst_key"), "accesses")
    # What the statement of a write accesses besides, and the tables that its columns come from.
    of = mapped.filter("source_table IS NOT NULL")
    of = _renamed(_renamed(of, "target_table", names, in_table("target_table")), "source_table", names, in_table("source_table"))
    from_values = of.filter("source_table <> target_table").groupBy(F.col("owner_key").alias("src_key"), F.col("target_table").alias("dst_key")).agg(F.collect_set("source_table").alias("from_values"))
    beside = used.groupBy("src_key", "file", "statement").agg(F.collect_set("dst_key").alias("beside"))
    writes = used.filter(F.col("mode").bitwiseAND(WRITE) != 0).select("src_key", "file", "statement", "dst_key").distinct()
    beside = writes.join(beside, ["src_key", "file", "statement"]).groupBy("src_key", "dst_key").agg(F.array_distinct(F.flatten(F.collect_list("beside"))).alias("beside"))
    reads = beside.join(from_values, ["src_key", "dst_key"], "left").select("src_key", "dst_key", F.array_sort(F.array_remove(F.array_union("beside", F.coalesce("from_values", F.array().cast("array<string>"))), F.col("dst_key"))).alias("read_tables"))
    access = used.groupBy("src_key", "dst_key").agg(F.bit_or("mode").alias("modes"), F.array_sort(F.collect_set("write_kind")).alias("write_kinds"), F.min("file").alias("file"), F.min("line").alias("line"))
    return access.join(reads, ["src_key", "dst_key"], "left").withColumn("edge_type", F.lit("TableAccess"))


def finish(defined: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes: those defined, and inferred ones for what edges lead to and nothing defines."""
    missing = edges.select(F.col("dst_key").alias("node_key")).distinct().join(defined, "node_key", "left_anti")
    tag, name = F.substring_index("node_key", ":", 1), F.regexp_replace("node_key", "^[^:]*:", "")
    inferred = missing.select(
        "node_key", F.when(tag.isin("table", "seq"), F.concat(tag, F.lit("*"))).otherwise(tag).alias("type_tag"), F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.*)\.", 1)).alias("schema_name"),
        F.substring_index(name, ".", -1).alias("name"), F.lit(None).cast("string").alias("package_name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"),
        F.lit(False).alias("explicit"), F.lit(False).alias("partial"), F.lit(None).cast("string").alias("sql"),
    )
    nodes = defined.unionByName(inferred)
    nodes = nodes.withColumn("system", F.coalesce(F.lower("schema_name").isin(*SYSTEM_SCHEMAS), F.lit(False)) | (tag.eqNullSafe("table") & F.lower("name").isin(*SYSTEM_TABLES)))
    return nodes


def inferred(rows: DataFrame, defined: DataFrame, items: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The nodes that edges of these types lead to and nothing defines: those of finish(defined, link(rows, defined, items, kinds)).

    kinds: of calls (all of CALLS or none), accesses, anchors, what points at a table, and synonyms. Each name is resolved once for each schema (and
    package) that it is used in, however many edges lead there. What accesses read besides makes no node, so rows need no mappings.
    """
    want = lambda *some: bool(set(some) & set(kinds))
    homes = defined.select(F.col("node_key").alias("_owner"), F.lower("schema_name").alias("_schema"), F.col("package_name").alias("_package"))
    homes = materialize(homes.filter("_schema IS NOT NULL OR _package IS NOT NULL"), "schemas")
    named = [F.col("a").alias("owner"), F.col("b").alias("text")]
    plain = rows.filter("record = 'edge'").filter(F.col("c").isin(*kinds))
    to_table = plain.filter("c <> 'AliasesObject' AND b LIKE 'table:%'").withColumn("b", F.substring_index("b", ":", -1))
    used = []
    if want(*CALLS):
        used.append(rows.filter("record = 'call'").filter(F.col("c").isin(*kinds)).select(F.lit("call").alias("what"), *named))
    for kind, record in (("TableAccess", "access"), ("AnchorsOn", "anchor")):
        if want(kind):
            used.append(rows.filter(F.col("record") == record).select(F.lit("relation").alias("what"), *named))
    used += [to_table.select(F.lit("relation").alias("what"), *named), plain.filter("c = 'AliasesObject'").select(F.lit("alias").alias("what"), *named)]
    every = used[0]
    for x in used[1:]:
        every = every.unionByName(x)
    every = every.distinct().join(small(homes), F.col("owner") == F.col("_owner"), "left")
    # Only calls look into the caller's package.
    package = F.when(F.col("what") == "call", F.col("_package"))
    every = materialize(every.select("what", "text", F.col("_schema").alias("schema"), package.alias("caller_package")).distinct().filter("text IS NOT NULL"), "names-used")
    ends = []
    if want(*CALLS):
        one = every.filter("what = 'call'").select(F.xxhash64("text", "schema", "caller_package").alias("call_id"), F.col("text").alias("raw"), F.col("schema").alias("caller_schema"), "caller_package")
        ends.append(_called(one, defined, items).select("dst_key"))
    relation, alias = every.filter("what = 'relation'").select("text", "schema"), every.filter("what = 'alias'").select("text", "schema")
    resolved = lambda uses, *how: _renamed(uses.select(F.col("text").alias("dst_key"), "text", F.col("schema").alias("_schema")), "dst_key", materialize(resolve_objects(uses, defined, *how), "names"), F.lit(None).cast("string"))
    table = F.coalesce("dst_key", F.concat(F.lit("table:"), "text")).alias("dst_key")
    ends.append(resolved(relation, RELATIONS, synonym_targets(defined, RELATIONS)).select(table))
    if want("AliasesObject"):
        # A target is a relation, else another object, else a table that nothing defines.
        other = resolved(alias, OTHERS).select(F.col("text").alias("_t"), F.col("_schema").alias("_c"), F.col("dst_key").alias("_other"))
        both = resolved(alias, RELATIONS).join(other, (F.col("text") == F.col("_t")) & F.col("_schema").eqNullSafe(F.col("_c")), "left")
        ends.append(both.select(F.coalesce("dst_key", "_other", F.concat(F.lit("table:"), "text")).alias("dst_key")))
    led = ends[0]
    for x in ends[1:]:
        led = led.unionByName(x)
    return finish(defined, led).filter("NOT explicit")


def statements(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_key, sql_text, indexed: statements of mappers and Java, each variant of a dynamic one, and those of routines."""
    whole = F.array("sql")
    of = nodes.filter("sql IS NOT NULL").select("node_key", F.explode(F.when(F.col("sql").startswith("["), F.transform(F.from_json("sql", "array<array<string>>"), lambda x: x[0])).otherwise(whole)).alias("sql_text"), F.col("type_tag").isin("mapper", "sql", "jspsql").alias("indexed"))
    variants = rows.filter("record = 'variant'").select(F.col("a").alias("node_key"), F.col("b").alias("sql_text"), F.lit(True).alias("indexed"))
    return of.unionByName(variants).filter("sql_text IS NOT NULL").distinct()


def java_edges(rows: DataFrame, defined: DataFrame) -> DataFrame:
    """Inheritance, injection, mapper and method calls. A simple class name goes to the only class of that name."""
    classes = defined.filter("type_tag = 'class'").groupBy(F.col("name").alias("simple")).agg(F.min("node_key").alias("class_key"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    classes = materialize(classes, "classes")
    none = ["file", "line"]
    refs = rows.filter("record = 'type_ref'").join(small(classes), F.col("b") == F.col("simple")).select(F.col("a").alias("src_key"), F.col("class_key").alias("dst_key"), F.col("c").alias("edge_type"), *none)
    fields = rows.filter("record = 'field'").select(F.col("a").alias("owner"), F.col("b").alias("type"), F.col("c").alias("var"), F.col("d").alias("how"), "file", "line").join(small(classes), F.col("type") == F.col("simple"))
    inject = fields.filter("how IN ('annotated', 'constructor')").select(F.concat(F.lit("class:"), "owner").alias("src_key"), F.col("class_key").alias("dst_key"), F.lit("CallsJava").alias("edge_type"), *none)
    calls = rows.filter("record = 'java_call'").select(F.col("a").alias("src_key"), F.col("b").alias("object"), F.col("c").alias("callee"), F.col("d").alias("argument"), F.col("e").alias("owner"), "file", "line")
    mappers = defined.filter("type_tag = 'mapper'").select(F.col("node_key").alias("mapper_key"), F.substring_index("node_key", ":", -1).alias("full"))
    by_text = calls.join(mappers, F.col("argument") == F.col("full")).select("src_key", F.col("mapper_key").alias("dst_key"), F.lit("InvokesMapper").alias("edge_type"), *none)
    # The class of an object is that of the field of its name; without an object it is the caller's own.
    known = calls.join(small(fields.select("owner", F.col("var").alias("object"), "class_key").dropDuplicates(["owner", "object"])), ["owner", "object"], "left")
    target = F.when(F.col("object").isNull() | (F.col("object") == "this"), F.concat(F.lit("class:"), "owner")).otherwise(F.col("class_key"))
    known = known.withColumn("fqn", F.concat(F.regexp_replace(target, "^class:", ""), F.lit("."), "callee")).filter("fqn is not null")
    by_interface = known.join(mappers, F.col("fqn") == F.col("full")).select("src_key", F.col("mapper_key").alias("dst_key"), F.lit("InvokesMapper").alias("edge_type"), *none)
    methods = defined.filter("type_tag = 'method'").select(F.col("node_key").alias("method_key"))
    by_method = known.join(methods, F.concat(F.lit("method:"), "fqn") == F.col("method_key")).join(mappers, F.col("fqn") == F.col("full"), "left_anti").select("src_key", F.col("method_key").alias("dst_key"), F.lit("CallsJava").alias("edge_type"), *none)
    out = refs.unionByName(inject).unionByName(by_text).unionByName(by_interface).unionByName(by_method)
    return out.dropDuplicates(["src_key", "dst_key", "edge_type"])


def analyze(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and column mappings of all sources under root."""
    return build(materialize(parse(scan(spark, root, exclude), deal=False), "parsed"))
