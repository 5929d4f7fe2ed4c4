"""A tolerant reader of SQL and PL/SQL text: objects, routine bodies, calls, table accesses and column mappings.

It works on tokens. A statement that it does not know gives no rows and never stops the rest of a file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codeloom.model import ACCESS_EXCLUSIVE, EXCLUSIVE, LOCK_READ, READ, SHARE, SHARE_ROW_EXCLUSIVE, SHARE_UPDATE_EXCLUSIVE, WRITE

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<string>[nNeE]?'(?:[^']|'')*(?:'|\Z))|(?P<quoted>"(?:[^"]|"")*")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d][\w$\#]*)|(?P<op>:=|\|\||=>|<>|!=|<=|>=|::|\.\.|<<|>>|.)""",
    re.S | re.X,
)
#: Possible values of a variable above this number make it unknown.
MOST_VALUES = 64

# Words that are no routine names before a parenthesis, and words that end a name's clause.
KEYWORDS = set(
    "select from where and or not in exists any all some between like is null case when then else end if elsif elseif loop while for return returning into values set insert update delete merge using on as "
    "by group order having union except intersect minus distinct with begin declare exception raise cursor open fetch close execute immediate exit continue create replace procedure function package body table "
    "view trigger type sequence index synonym event alter drop truncate lock primary key unique references foreign check constraint default partition range list hash over limit offset join left right inner outer "
    "full cross natural lateral perform call out inout varchar varchar2 nvarchar2 char number numeric decimal integer int bigint date timestamp interval boolean record rowtype array of matched grant revoke comment "
    "commit rollback savepoint goto reverse bulk collect forall row rows only first next share nowait skip locked columns column add modify rename to cascade restrict language returns immutable stable volatile strict "
    "vacuum analyze cluster reindex explain concurrently materialized temporary temp global local unlogged pragma found notfound sqlcode sqlerrm true false cast extract trim substring position overlay treat "
    "greatest least coalesce nullif".split()
)
# Functions that the database itself has.
BUILTINS = set(
    "count sum avg min max listagg string_agg array_agg stddev variance median rank dense_rank row_number lag lead first_value last_value ntile percent_rank cume_dist "
    "nvl nvl2 decode to_char to_date to_number to_timestamp upper lower initcap length lengthb substr instr replace translate ltrim rtrim lpad rpad concat chr ascii round trunc ceil floor mod abs power sqrt exp ln log sign "
    "sysdate systimestamp now current_date current_timestamp add_months months_between last_day next_day date_trunc date_part age regexp_like regexp_replace regexp_substr regexp_instr regexp_count "
    "nextval currval setval raise_application_error sys_guid userenv sys_context generate_series unnest md5 random xmlagg json_object json_array hextoraw rawtohex dump vsize".split()
)
# Functions that make a mapping an aggregated one.
AGGREGATES = set(
    "sum count avg min max stddev stddev_pop stddev_samp variance var_pop var_samp median listagg string_agg array_agg group_concat wm_concat bool_and bool_or".split()
)
# Named lock modes.
LOCK_MODES = {
    "": ACCESS_EXCLUSIVE, "access exclusive": ACCESS_EXCLUSIVE, "access share": READ, "row share": LOCK_READ, "row exclusive": WRITE, "share update exclusive": SHARE_UPDATE_EXCLUSIVE,
    "share": SHARE, "share row exclusive": SHARE_ROW_EXCLUSIVE, "exclusive": EXCLUSIVE,
}
#: All words that names are compared with.
WORDS = KEYWORDS | BUILTINS | AGGREGATES | {w for mode in LOCK_MODES for w in mode.split()}

#: The same pieces as whole matches, behind blanks; names come first, as most pieces are. Texts with dollar strings need the second.
_PIECE = re.compile(
    r"""[ ]*([^\W\d](?<![nNeE])[\w$\#]*|[nNeE](?!')[\w$\#]*|[(),;]|\s+|--[^\n]*|/\*.*?(?:\*/|\Z)|[nNeE]?'(?:[^']|'')*(?:'|\Z)|"(?:[^"]|"")*"|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|:=|\|\||=>|<>|!=|<=|>=|::|\.\.|<<|>>|.)""",
    re.S | re.X,
)
_DOLLAR_PIECE = re.compile(
    r"""[ ]*(\s+|--[^\n]*|/\*.*?(?:\*/|\Z)|\$(\w*)\$.*?\$\2\$|[nNeE]?'(?:[^']|'')*(?:'|\Z)|"(?:[^"]|"")*"|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[^\W\d][\w$\#]*|:=|\|\||=>|<>|!=|<=|>=|::|\.\.|<<|>>|.)""",
    re.S | re.X,
)
#: Pieces that are kept between files, and characters that a kept one has at most.
MOST_KEPT, LONGEST_KEPT = 20_000, 30


class Token:
    """A piece of text; low is what names and words are compared by, word the same of names and operators only.

    Pieces of one text on one line may be one object, in one file and in others: a piece is never changed nor compared by identity.
    """

    __slots__ = ("kind", "text", "low", "word", "line")

    def __init__(self, kind: str, text: str, low: str, word: str, line: int):
        self.kind, self.text, self.low, self.word, self.line = kind, text, low, word, line


def _kind(text: str) -> tuple[str, str, str]:
    """kind, low and word of a piece."""
    kind = _TOKEN.match(text).lastgroup
    low = text.lower() if kind == "name" else text[1:-1].lower() if kind == "quoted" else text
    return kind, low, low if kind in ("op", "name", "quoted") else ""


_kinds: dict[str, tuple[str, str, str]] = {}
_lines: dict[int, dict[str, Token]] = {}  # of each line the pieces that were met there
_kept = 0


def _new(text: str, line: int, here: dict[str, Token]) -> Token:
    """A piece that was not met on its line yet; here: the pieces of this line."""
    global _kept
    found = _kinds.get(text)
    if found is None:
        found = _kind(text)
        if len(text) <= LONGEST_KEPT:
            if len(_kinds) >= MOST_KEPT:
                _kinds.clear()
            _kinds[text] = found
    x = Token(found[0], text, found[1], found[2], line)
    if len(text) <= LONGEST_KEPT:
        here[text] = x
        _kept += 1
    return x


def _line(line: int) -> dict[str, Token]:
    global _kept
    here = _lines.get(line)
    if here is None:
        if _kept >= MOST_KEPT:
            _lines.clear()
            _kept = 0
        here = _lines[line] = {}
        _kept += 1
    return here


def tokenize(text: str, line: int = 1) -> list[Token]:
    out = []
    add, here = out.append, _line(line)
    known = here.get
    for t in [t for t, _ in _DOLLAR_PIECE.findall(text)] if "$" in text else _PIECE.findall(text):
        x = known(t)
        if x is None:
            x = _new(t, line, here)
        kind = x.kind
        if kind == "name" or kind == "op":
            add(x)
            continue
        if kind != "space":
            add(x)
        n = t.count("\n")
        if n:
            line += n
            here = _line(line)
            known = here.get
    return out


@dataclass
class Routine:
    key: str
    kind: str
    schema: str | None
    package: str | None
    name: str
    line: int
    file: str
    params: list[tuple[str, str, str]] = field(default_factory=list)
    locals: set[str] = field(default_factory=set)
    body: list[tuple[str, str, int]] = field(default_factory=list)
    into: dict[str, tuple[str, str]] = field(default_factory=dict)  # variable: table and column it was read from
    records: dict[str, str] = field(default_factory=dict)  # loop record: the one table of its query
    cursors: dict[str, list] = field(default_factory=dict)  # cursor: outputs of its query
    fields: dict[str, dict] = field(default_factory=dict)  # record: table and column of each of its fields
    flows: dict[str, tuple[str, str]] = field(default_factory=dict)  # variable: table and column that FETCH gives it
    count: int = 0
    partial: bool = False


@dataclass
class Found:
    """Rows of one file."""

    nodes: list[dict] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)  # caller_key, raw, dynamic, line
    accesses: list[tuple] = field(default_factory=list)  # owner_key, table, mode, write_kind, statement, line
    mappings: list[tuple] = field(default_factory=list)  # owner_key, target_table, target_column, source_kind, source_table, source_column, mapping_kind, expression, line
    filters: list[tuple] = field(default_factory=list)  # owner_key, table, column, op, value, transform, line
    joins: list[tuple] = field(default_factory=list)  # owner_key, left_table, left_column, right_table, right_column, source, line
    equalities: list[tuple] = field(default_factory=list)  # owner_key, left_table, left_column, right_table, right_column, text, line
    anchors: list[tuple] = field(default_factory=list)  # owner_key, object, kind, column, site, line
    types: list[tuple] = field(default_factory=list)  # owner_key, name, line
    predicates: list[tuple] = field(default_factory=list)  # owner_key, predicate_id, table, column, op, value, confidence, text, line
    edges: list[tuple] = field(default_factory=list)  # src_key, dst_key, edge_type, line
    columns: list[tuple] = field(default_factory=list)  # table_key, position, name, data_type, nullable, primary_key, default, line
    comments: list[tuple] = field(default_factory=list)  # table_key, column or None, text, line
    enums: list[tuple] = field(default_factory=list)  # owner_key, table, column, literal, result, line
    errors: list[tuple] = field(default_factory=list)  # line, message
    items: list[tuple] = field(default_factory=list)  # package_key, name, kind, declaration, in the specification, position, line
    joined: bool = False  # strings of dynamic SQL met digit to digit


_NAMED = {"name", "quoted"}
_BEFORE_TABLE = {"from", "join", "into", "update", "using"}


class Reader:
    """Reads the tokens of one file."""

    def __init__(self, text: str, file: str, specs: dict[str, str] | None = None, want: frozenset[str] | None = None, line: int = 1):
        """line: where the text begins in its file. specs: declarations of the specification of each package, by its name as it stands in its body.

        want: the records (see ingest.parse) that are asked for; what gives only others is not looked at. None: all.
        """
        self.file, self.out, self.t, self.i = file, Found(), tokenize(text, line), 0
        self.texts = [x.text for x in self.t]
        self.specs, self.want = specs or {}, want
        asked = lambda *records: want is None or not want.isdisjoint(records)
        self.tables, self.depends, self.called = asked("access"), asked("edge"), asked("call", "edge")
        self.mapped, self.filtered, self.predicates = asked("mapping"), asked("filter", "join", "equality"), asked("predicate")
        self.typed, self.listed, self.anchored = asked("type_use"), asked("enum"), asked("anchor")
        self.flows = self.mapped or self.filtered or self.predicates
        self.bodies = asked("node")  # the statements of routines as texts
        self.active = self.tables or self.depends or self.called or self.flows or self.typed or self.listed  # what statements hold
        self.scope: Routine | None = None  # what the package that is read declares
        self.known: tuple[list[Token], dict[str, str]] | None = None  # aliases of the last statement
        self.r: Routine | None = None  # the routine that statements belong to

    # -- tokens

    def at(self, k: int = 0) -> str:
        try:
            return self.t[self.i + k].word
        except IndexError:
            return ""

    def take(self, *words: str) -> bool:
        t, i = self.t, self.i
        if i + len(words) > len(t):
            return False
        for w in words:
            if t[i].word != w:
                return False
            i += 1
        self.i = i
        return True

    def name(self) -> list[str]:
        parts = []
        while self.i < len(self.t) and self.t[self.i].kind in ("name", "quoted"):
            parts.append(self.t[self.i].low)
            self.i += 1
            if self.at() != ".":
                break
            self.i += 1
        return parts

    def statement(self) -> list[Token]:
        """Tokens up to the next ; or a / alone, outside parentheses."""
        start, depth, texts = self.i, 0, self.texts
        at = start
        while True:
            try:
                end = texts.index(";", at)
            except ValueError:
                self.i = len(texts)
                return self.t[start:]
            between = texts[at:end]
            depth += between.count("(") - between.count(")")
            if depth <= 0:
                self.i = end + 1
                return self.t[start:end]
            at = end + 1

    # -- top level

    def read(self) -> Found:
        while self.i < len(self.t):
            at = self.i
            try:
                self.top()
            except Exception as e:  # a broken statement must not cost the rest of the file
                self.out.errors.append((self.t[min(at, len(self.t) - 1)].line, f"{type(e).__name__}: {e}"))
                self.i = at
                self.statement()
            if self.i == at:
                self.i += 1
        return self.out

    def top(self) -> None:
        if self.at() in (";", "/"):
            self.i += 1
            return
        line, mark = self.t[self.i].line, self.i
        if self.take("create"):
            self.take("or", "replace")
            while self.at() in ("global", "local", "temporary", "temp", "unlogged", "editionable", "force", "noforce", "unique", "public", "definer"):
                if self.at() == "global" and self.at(1) == "index":
                    break
                self.i += 1
            if self.at() in ("procedure", "function"):
                kind = self.at()
                self.i += 1
                self.routine(kind, self.name(), None, None, line)
                return
            if self.take("package"):
                body = self.take("body")
                self.package(self.name(), body, line)
                return
            for word, tag in (("table", "table"), ("view", "view"), ("sequence", "seq"), ("type", "type"), ("trigger", "trigger"), ("index", "index"), ("synonym", "synonym"), ("event", "event"), ("materialized", "mview")):
                if self.take(word):
                    self.take("view")
                    self.take("body")
                    concurrent = self.take("concurrently")
                    self.take("if", "not", "exists")
                    self.ddl(tag, line, mark, concurrent)
                    return
            self.statement()
            return
        if self.at() in ("declare", "begin"):
            r = Routine(f"block:{self.file}:{line}", "block", None, None, "", line, self.file)
            if self.take("declare"):
                self.declarations(r)
            self.body(r)
            return
        if self.take("comment", "on"):
            what = self.at()
            self.i += 1
            parts = self.name()
            said = next((x.text[1:-1].replace("''", "'") for x in self.statement() if x.kind == "string"), "")
            if what == "column" and len(parts) > 1:
                self.out.comments.append((f"table:{'.'.join(parts[:-1])}", parts[-1], said, line))
            elif what in ("table", "view"):
                self.out.comments.append((f"{what}:{'.'.join(parts)}", None, said, line))
            return
        self.dml(self.statement(), f"file:{self.file}", None, set())

    def node(self, tag: str, parts: list[str], line: int, **more) -> str:
        schema, name = (parts[-2] if len(parts) > 1 else None), parts[-1] if parts else "?"
        key = f"{tag}:{'.'.join(parts)}"
        self.out.nodes.append({"node_key": key, "type_tag": tag, "schema_name": schema, "package_name": None, "name": name, "file": self.file, "line": line, "explicit": True, "partial": False, "sql": None} | more)
        return key

    def ddl(self, tag: str, line: int, mark: int, concurrent: bool) -> None:
        if tag == "index":
            parts = [] if self.at() == "on" else self.name()
            rest = self.statement()
            on = next((k for k, x in enumerate(rest) if x.low == "on"), None)
            if on is not None:
                table = _name_at(rest, on + 1)[0]
                key = self.node("index", parts or ["?"], line, name=parts[-1] if parts else None)
                self.out.edges.append((key, f"table:{'.'.join(table)}", "IndexesTable", line))
                self.out.accesses.append((key, ".".join(table), SHARE_UPDATE_EXCLUSIVE if concurrent else SHARE, "create_index_concurrent" if concurrent else "create_index", 0, line))
            return
        parts = self.name()
        if tag == "trigger":
            rest, depth = self.i, 0
            on = None
            while self.i < len(self.t) and self.at() not in (";", "begin", "declare", "execute"):
                if self.at() == "on" and on is None:
                    self.i += 1
                    on = self.name()
                    continue
                self.i += 1
            key = self.node("trigger", parts[-1:], line, schema_name=parts[-2] if len(parts) > 1 else None)
            if on:
                self.out.edges.append((key, f"table:{'.'.join(on)}", "TriggersTable", line))
            if self.take("execute"):
                self.i += 1
                target = self.name()
                self.out.calls.append((key, ".".join(target), False, line))
                self.statement()
            else:
                r = Routine(key, "trigger", None, None, parts[-1], line, self.file)
                if self.take("declare"):
                    self.declarations(r)
                self.body(r)
            return
        rest = self.statement()
        sql = " ".join(x.text for x in rest)
        key = self.node(tag, parts, line, sql=sql)
        if tag in ("view", "mview"):
            begin = next((k for k, x in enumerate(rest) if x.low == "as"), None)
            if begin is not None:
                inner = rest[begin + 1 :]
                open_ = next((k for k, x in enumerate(rest[:begin]) if x.text == "("), None)
                inside = _split_commas(rest[open_ + 1 : _closing(rest, open_)]) if open_ is not None else []
                declared = [x[0].low for x in inside if x and x[0].kind in ("name", "quoted")]
                tables = self.dml(inner, key, None, set())
                for t in tables:
                    self.out.edges.append((key, f"table:{t}", "DependsOn", line))
                self.view_columns(key, ".".join(parts), declared, inner)
        elif tag == "synonym":
            to = next((k for k, x in enumerate(rest) if x.low == "for"), None)
            if to is not None:
                self.out.edges.append((key, ".".join(_name_at(rest, to + 1)[0]), "AliasesObject", line))
        elif tag == "table":
            self.columns(key, parts, rest, line)
            as_ = next((k for k, x in enumerate(rest[:-1]) if x.low == "as" and rest[k + 1].low in ("select", "with", "(")), None)
            if as_ is not None:
                self.dml(rest[as_ + 1 :], key, None, set())

    def columns(self, key: str, parts: list[str], s: list[Token], line: int) -> None:
        """Columns and keys of a table's definition. A primary key or a unique constraint also gives an index node."""
        if not s or s[0].text != "(":
            return
        keyed: set[str] = set()
        rows = []

        def index(kind: str, names: list[str]) -> None:
            node = self.node("index", [f"{parts[-1]}_{kind}_{'_'.join(names)}"], line)
            self.out.edges.append((node, key, "IndexesTable", line))

        for item in _split_commas(s[1 : _closing(s, 0)]):
            words = [x.low for x in item]
            if not item or words[0] in ("like", "check", "foreign", "exclude", "partial"):
                continue
            if words[0] in ("constraint", "primary", "unique"):
                for kind, word in (("pk", "primary"), ("uk", "unique")):
                    if word in words and "(" in words:
                        names = [x.low for x in item[words.index("(") : _closing(item, words.index("("))] if x.kind in ("name", "quoted")]
                        keyed |= set(names) if kind == "pk" else set()
                        index(kind, names)
                continue
            ends = ("not", "null", "primary", "unique", "default", "constraint", "references", "check", "generated", "collate", "comment", "encode", "enable")
            stop = next((k for k in range(1, len(item)) if words[k] in ends), len(item))
            at = words.index("default") + 1 if "default" in words else len(item)
            end = next((k for k in range(at + 1, len(item)) if words[k] in ends), len(item))
            kind = re.sub(r"\s*([(),.%])\s*", r"\1", " ".join(x.text for x in item[1:stop]))
            pk = "primary" in words
            needed = any(words[k : k + 2] == ["not", "null"] for k in range(len(words)))
            rows.append((words[0], kind, not (pk or needed), pk, " ".join(x.text for x in item[at:end]) or None, item[0].line))
            for short, word in (("pk", "primary"), ("uk", "unique")):
                if word in words:
                    index(short, [words[0]])
        for i, (name, kind, nullable, pk, default, at) in enumerate(rows):
            self.out.columns.append((key, i, name, kind, nullable and name not in keyed, pk or name in keyed, default, at))

    def package(self, parts: list[str], body: bool, line: int) -> None:
        schema, pkg = (parts[-2] if len(parts) > 1 else None), parts[-1]
        key = self.node("pkg", parts, line)
        while self.i < len(self.t) and self.at() not in ("is", "as"):
            self.i += 1
        self.i += 1
        self.scope = Routine(key, "package", schema, pkg, pkg, line, self.file)
        given = self.specs.get(".".join(parts)) if body else None
        if given:
            spec = Reader(given, self.file, want=self.want)
            while spec.i < len(spec.t):
                x = spec.statement()
                if x:
                    spec.declared(x, self.scope)
        while self.i < len(self.t):
            if self.at() == "end":
                self.statement()
                return
            if self.at() == "begin":
                self.body(Routine(key, "block", schema, pkg, pkg, line, self.file))
                return
            if self.at() in ("procedure", "function"):
                kind, at = self.at(), self.t[self.i].line
                self.i += 1
                r = self.routine(kind, self.name(), schema, pkg, at)
                self.out.edges.append((key, r.key, "ContainsRoutine", at))
            else:
                self.item(self.statement(), key, body)

    def item(self, s: list[Token], key: str, body: bool) -> None:
        """A variable, type, cursor or exception of a package: known to all of its routines from here on."""
        if not s or s[0].low == "pragma":
            return
        named = 1 if s[0].low in ("cursor", "type", "subtype") and len(s) > 1 else 0
        kind = s[0].low if named else "exception" if len(s) > 1 and s[1].low == "exception" else "variable"
        if s[named].kind in ("name", "quoted"):
            self.out.items.append((key, s[named].low, kind, " ".join(x.text for x in s), not body, len(self.out.items), s[0].line))
            self.declared(s, self.scope)

    def declared(self, s: list[Token], scope: Routine) -> None:
        """Enters a declaration into the scope of its package; what it refers to is not the work of any routine."""
        kept, self.out = self.out, Found()
        known = set(scope.locals)
        self.declaration(s, scope)
        self.out = kept
        scope.locals |= {f"{scope.package}.{x}" for x in scope.locals - known}

    # -- routines

    def routine(self, kind: str, parts: list[str], schema: str | None, package: str | None, line: int) -> Routine:
        if len(parts) > 1 and schema is None:
            schema = parts[-2]
        name = parts[-1]
        full = ".".join(x for x in (schema, package, name) if x)
        r = Routine(f"{'proc' if kind == 'procedure' else 'func'}:{full}", kind, schema, package, name, line, self.file)
        if package and self.scope and self.scope.package == package:
            r.locals |= self.scope.locals
            for mine, theirs in ((r.cursors, self.scope.cursors), (r.records, self.scope.records), (r.fields, self.scope.fields)):
                mine.update(theirs)
        if self.take("("):
            depth, part = 1, []
            while self.i < len(self.t) and depth:
                x = self.t[self.i]
                self.i += 1
                depth += (x.text == "(") - (x.text == ")")
                if (x.text == "," and depth == 1) or depth == 0:
                    if part:
                        mode = " ".join(p.low for p in part[1:3] if p.low in ("in", "out", "inout")) or "in"
                        kinds = " ".join(p.text for p in part[1:] if p.low not in ("in", "out", "inout"))
                        r.params.append((part[0].low, mode, re.split(r"(?i)\s+(?:default|:=)\s+", kinds)[0]))
                        r.locals.add(part[0].low)
                    part = []
                else:
                    part.append(x)
        head = self.i
        while self.i < len(self.t) and self.at() not in ("is", "as", ";", "begin", "declare") and self.t[self.i].kind != "dollar":
            self.i += 1
        if self.anchored:
            for _, _, kind_ in r.params:
                self.anchors(r, kind_, "parameter", line)
            self.anchors(r, " ".join(x.text for x in self.t[head : self.i] if x.low not in ("return", "returns")), "return", line)
        has_body = True
        if self.at() == ";":
            self.i += 1
            has_body = False
        elif self.at() in ("is", "as"):
            self.i += 1
            if self.i < len(self.t) and self.t[self.i].kind in ("dollar", "string"):
                inner = self.t[self.i]
                text = re.sub(r"\A\$\w*\$|\$\w*\$\Z", "", inner.text)
                self.i += 1
                sub = Reader(text, self.file, want=self.want, line=inner.line)
                sub.take("declare")
                sub.out = self.out
                sub.declarations(r)
                sub.body(r)
                self.statement()
            else:
                self.take("declare")
                self.declarations(r)
                self.body(r)
        else:
            self.take("declare")
            self.declarations(r)
            self.body(r)
        self.out.nodes.append(
            {"node_key": r.key, "type_tag": r.key.split(":")[0] + ("" if has_body else "*"), "schema_name": schema, "package_name": package, "name": name, "file": self.file, "line": line, "explicit": True, "partial": not has_body,
             "sql": None, "body_sql": r.body, "params": r.params}
        )
        return r

    def declarations(self, r: Routine) -> None:
        while self.i < len(self.t) and self.at() != "begin":
            if self.at() in ("procedure", "function"):
                kind, line = self.at(), self.t[self.i].line
                self.i += 1
                nested = self.routine(kind, self.name(), r.schema, r.package, line)
                r.locals.add(nested.name)
                self.out.edges.append((r.key, nested.key, "ContainsRoutine", line))
                continue
            s = self.statement()
            if s:
                self.declaration(s, r)

    def declaration(self, s: list[Token], r: Routine) -> None:
        if s[0].low == "cursor" and len(s) > 1:
            r.locals.add(s[1].low)
            start = next((k for k, x in enumerate(s) if x.low in ("is", "for")), None)
            if start is not None:
                self.dml(s[start + 1 :], r.key, r.schema, r.locals, r)
                r.cursors[s[1].low] = self.outputs(s[start + 1 :]) if self.flows else []
        elif s[0].low in ("type", "subtype") and len(s) > 1:
            r.locals.add(s[1].low)
        else:
            self.variable(s, r)

    def variable(self, s: list[Token], r: Routine) -> None:
        """A declared variable: its anchor or its type, and the fields of a record."""
        name, line = s[0].low, s[0].line
        value = next((k for k, x in enumerate(s) if x.text == ":=" or x.low == "default"), len(s))
        parts, k = _name_at(s, 2 if len(s) > 1 and s[1].low == "constant" else 1)
        if k < value and s[k].text == "%":
            if self.anchored:
                self.anchors(r, " ".join(x.text for x in s[1:value]), "variable", line)
            if k + 1 < len(s) and s[k + 1].low == "rowtype":
                if len(parts) == 1 and parts[0] in r.cursors:
                    r.fields[name] = _fields(r.cursors[parts[0]])
                else:
                    r.records[name] = ".".join(parts)
        elif parts and parts[-1] not in KEYWORDS:
            self.out.types.append((r.key, ".".join(parts), line))
        r.locals.add(name)
        if value < len(s):
            self.expression(s[value + 1 :], r, line)

    def anchors(self, r: Routine, text: str, site: str, line: int) -> None:
        """%TYPE needs an object and a column, %ROWTYPE an object; cursors and variables of the routine are no objects."""
        if not self.anchored or "%" not in text:
            return
        for m in re.finditer(r"([\w$#.]+)\s*%\s*(rowtype|type)\b", re.sub(r"\s*\.\s*", ".", text.lower())):
            parts = [x for x in m[1].split(".") if x]
            column = parts.pop() if m[2] == "type" and len(parts) > 1 else None
            if parts and (column or m[2] == "rowtype") and not (len(parts) == 1 and parts[0] in r.locals):
                self.out.anchors.append((r.key, ".".join(parts), m[2], column, site, line))

    def outputs(self, s: list[Token]) -> list[tuple[str | None, tuple[str, str] | None]]:
        """Name and, where it is one column as it stands, source of each column of a query; * stands for all of its one table."""
        items, alias, only = self.select_items(s)
        out = []
        for item in items:
            if len(item) == 1 and item[0].text == "*":
                out.append(("*", (only, "*") if only else None))
                continue
            cols, kind = self.source(item, alias, only)
            one = cols[0] if kind == "direct" and len(cols) == 1 and cols[0][0] == "column" and cols[0][1] else None
            out.append((_output_name(item), (one[1], one[2]) if one else None))
        return out

    def body(self, r: Routine) -> None:
        """Statements from BEGIN to its END. Blocks, branches and loops only nest."""
        self.take("begin")
        depth, values = 1, {}
        # Of each open IF or CASE: the values before it, those after its branches so far, and whether it has an ELSE.
        forks: list[list] = []

        def turn() -> None:
            """Ends a branch and begins the next one where the fork began."""
            forks[-1][1].append(dict(values))
            values.clear()
            values.update(forks[-1][0])

        while self.i < len(self.t) and depth:
            w = self.at()
            if w == "begin":
                depth += 1
                self.i += 1
            elif w == "declare":
                self.i += 1
                self.declarations(r)
            elif w == "end":
                self.i += 1
                inner = self.at()
                if inner in ("if", "case", "loop"):
                    if inner != "loop" and forks:
                        before, after, other = forks.pop()
                        after += [dict(values)] if other else [dict(values), before]
                        values.clear()
                        for v in {v for a in after for v in a}:
                            sets = [a.get(v, []) for a in after]
                            values[v] = None if None in sets else list(dict.fromkeys(x for some in sets for x in some))
                    self.statement()
                else:
                    depth -= 1
                    self.statement()
            elif w in ("if", "elsif", "elseif", "while", "when"):
                if w == "if":
                    forks.append([dict(values), [], False])
                elif w in ("elsif", "elseif") and forks:
                    turn()
                elif w == "when" and forks and forks[-1][2] is None:
                    forks[-1][2] = False
                elif w == "when" and forks and len(forks[-1]) == 3 and self.t[self.i - 1].low == ";":
                    turn()
                self.i += 1
                start = self.i
                stop = ("then",) if w != "while" else ("loop",)
                nest, t, i = 0, self.t, start
                while i < len(t):
                    x = t[i].word
                    if nest == 0 and x in stop:
                        break
                    nest += (x == "case") - (x == "end")
                    if x == ";":
                        break
                    i += 1
                self.i = i
                self.expression(self.t[start : self.i], r, self.t[start].line if start < len(self.t) else r.line)
                if w != "while" and self.predicates:
                    self.predicate(self.t[start : self.i], r)
                self.i += 1
            elif w in ("else", "loop", "exception", "<<", ">>"):
                if w == "else" and forks:
                    turn()
                    forks[-1][2] = True
                self.i += 1
            elif w == "case":
                forks.append([dict(values), [], None])
                self.i += 1
                start = self.i
                while self.i < len(self.t) and self.at() not in ("when", ";"):
                    self.i += 1
                self.expression(self.t[start : self.i], r, r.line)
            elif w == "for" or w == "forall":
                self.i += 1
                r.locals.add(self.at())
                self.i += 1
                start = self.i
                nest = 0
                while self.i < len(self.t) and not (nest <= 0 and self.at() in ("loop", "insert", "update", "delete", "merge", ";")):
                    nest += (self.t[self.i].text == "(") - (self.t[self.i].text == ")")
                    self.i += 1
                head = self.t[start : self.i]
                record = self.t[start - 1].low if w == "for" else ""
                if len(head) == 2 and head[0].low == "in" and head[1].low in r.cursors or len(head) == 1 and head[0].low in r.cursors:
                    self.record(r, record, r.cursors[head[-1].low])
                elif any(x.low == "select" for x in head):
                    k = next(j for j, x in enumerate(head) if x.low in ("select", "with"))
                    if self.flows:
                        self.record(r, record, self.outputs(head[k:]))
                    self.dml(head[1:] if head[0].low == "in" else head, r.key, r.schema, r.locals, r)
                else:
                    self.expression(head, r, self.t[start - 1].line)
                self.take("loop")
            elif w == ";":
                self.i += 1
            else:
                s = self.statement()
                if s:
                    self.pl(s, r, values)

    def record(self, r: Routine, name: str, outputs: list) -> None:
        r.fields[name] = _fields(outputs)
        tables = {x[1][0] for x in outputs if x[1]}
        if len(tables) == 1:
            r.records[name] = next(iter(tables))

    def fetch(self, s: list[Token], r: Routine) -> None:
        """FETCH variables match a cursor's columns by position; a single variable may be a record."""
        into = next((j for j, x in enumerate(s) if x.low == "into"), None)
        outputs = next((r.cursors[x.low] for x in s[1:into] if x.low in r.cursors), None)
        if into is None or outputs is None:
            return
        names = [x[0].low for x in _split_commas(s[into + 1 :]) if len(x) == 1]
        if len(names) == 1 and (names[0] in r.records or names[0] in r.fields or len(outputs) > 1):
            self.record(r, names[0], outputs)
            return
        if len(outputs) == 1 and outputs[0][0] == "*" and outputs[0][1]:
            outputs = [(n, (outputs[0][1][0], n)) for n in names]
        for name, (_, source) in zip(names, outputs):
            if source:
                r.flows[name] = r.into[name] = source

    def value_of(self, parts: list[str]) -> tuple[str, str] | None:
        """Table and column that a variable or a record's field of the routine holds."""
        r = self.r
        if r is None:
            return None
        if len(parts) == 1:
            return r.flows.get(parts[0])
        known = r.fields.get(parts[0], {})
        if parts[1] in known:
            return known[parts[1]]
        if known.get("*"):
            return known["*"][0], parts[1]
        return (r.records[parts[0]], parts[1]) if parts[0] in r.records and not known else None

    def pl(self, s: list[Token], r: Routine, values: dict[str, list[str] | None]) -> None:
        if not self.active and not self.bodies:
            return
        w, line = s[0].low, s[0].line
        if w in ("select", "insert", "update", "delete", "merge", "with", "truncate", "lock", "alter", "drop", "vacuum", "analyze", "cluster", "reindex", "create"):
            r.body.append((" ".join(x.text for x in s), w, line))
            self.dml(s, r.key, r.schema, r.locals, r)
            if w == "select" and self.flows:
                self.remember_into(s, r)
        elif w in ("call", "perform"):
            parts, k = _name_at(s, 1)
            if parts and (k >= len(s) or s[k].text in ("(", ";") or w == "call"):
                self.call(r, parts, line)
            self.expression(s[k:], r, line)
        elif w == "execute":
            k = 2 if len(s) > 1 and s[1].low == "immediate" else 1
            end = next((j for j in range(k, len(s)) if s[j].low in ("using", "into") and s[j].kind == "name"), len(s))
            for text in self.possible(s[k:end], values) or [None]:
                if text is None:
                    self.out.calls.append((r.key, " ".join(x.text for x in s[k:end]), True, line))
                    continue
                inner = Reader(text, self.file)
                toks = inner.t
                if toks and toks[0].low in ("call", "begin"):
                    parts, _ = _name_at(toks, 1)
                    if parts:
                        self.call(r, parts, line)
                elif toks:
                    r.body.append((text, "dynamic", line))
                    self.dml([Token(x.kind, x.text, x.low, x.word, line) for x in toks if x.text != ";"], r.key, r.schema, r.locals, r)
        elif w in ("open", "fetch", "close", "return", "raise", "exit", "continue", "null", "commit", "rollback", "savepoint", "goto", "pragma"):
            if w == "open" and any(x.low == "select" for x in s):
                k = next(j for j, x in enumerate(s) if x.low == "select")
                self.dml(s[k:], r.key, r.schema, r.locals, r)
                r.cursors[s[1].low] = self.outputs(s[k:]) if self.flows else []
            elif w == "fetch":
                if self.flows:
                    self.fetch(s, r)
            else:
                self.expression(s[1:], r, line)
        else:
            k = next((j for j, x in enumerate(s) if x.text == ":=" or (x.text == "=" and j and not any(y.text == "(" for y in s[:j]))), None)
            if k is not None:
                values[w] = self.possible(s[k + 1 :], values)
                self.expression(s[k + 1 :], r, line)
            else:
                parts, j = _name_at(s, 0)
                if parts and parts[0] not in KEYWORDS and (j >= len(s) or s[j].text == "("):
                    self.call(r, parts, line)
                self.expression(s[j:], r, line)

    def remember_into(self, s: list[Token], r: Routine) -> None:
        k = next((j for j, x in enumerate(s) if x.low == "into"), None)
        if k is None:
            return
        items, alias, only = self.select_items(s)
        for names, item in zip(_split_commas(s[k + 1 : next((j for j in range(k, len(s)) if s[j].low == "from"), len(s))]), items):
            cols, kind = self.source(item, alias, only)
            if len(names) == 1 and kind == "direct" and len(cols) == 1 and cols[0][0] == "column" and cols[0][1]:
                r.into[names[0].low] = (cols[0][1], cols[0][2])

    def predicate(self, s: list[Token], r: Routine) -> None:
        """One row a comparison of a condition. high: a loop record's column; medium: a variable read from a column; low: neither.

        AND is split; a condition with OR or NOT stays one row without a table.
        """
        if not s:
            return
        text = " ".join(x.text for x in s)
        parts: list[list[Token]] = [[]]
        for x in s:
            if x.low == "and" and not any(y.low == "between" for y in parts[-1]):
                parts.append([])
            else:
                parts[-1].append(x)
        if any(x.low in ("or", "not") for x in s):
            parts = [s]
        flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
        for part in parts:
            r.count += 1
            k = next((j for j, x in enumerate(part) if x.text in ("=", "<>", "!=", "<", ">", "<=", ">=") or x.low in ("in", "like")), None)
            left = _name_at(part, 0)[0] if k and len(parts) >= 1 and not any(x.low in ("or", "not") for x in part) else []
            value, op = " ".join(x.text for x in part[k + 1 :]) if k is not None else None, part[k].low if k is not None else None
            if k == 1 and not left and part[0].kind in ("string", "number"):  # a literal on the left
                left, value, op = _name_at(part, 2)[0], part[0].text, flip.get(op, op)
            table = column = None
            confidence = "low"
            if len(left) == 2 and left[0] in r.records:
                table, column, confidence = r.records[left[0]], left[1], "high"
            elif len(left) == 1 and left[0] in r.into:
                (table, column), confidence = r.into[left[0]], "medium"
            self.out.predicates.append((r.key, f"B{r.count:03}", table, column, op, value, confidence, text, s[0].line))

    def possible(self, s: list[Token], values: dict[str, list[str] | None]) -> list[str] | None:
        """All strings that an expression of literals, known variables and || can be, each once, as they come; None if unknown."""
        out = [""]
        for k, x in enumerate(s):
            if x.text == "||" or x.text in "()":
                continue
            if x.kind == "string":
                part = [x.text[x.text.index("'") + 1 : -1].replace("''", "'")]
            elif x.kind == "name" and values.get(x.low) and not (k + 1 < len(s) and s[k + 1].text in (".", "(")):
                part = values[x.low]
            else:
                return None
            self.out.joined = self.out.joined or any(a[-1:].isdigit() for a in out) and any(b[:1].isdigit() for b in part)
            out = list(dict.fromkeys(a + b for a in out for b in part))
            if len(out) > MOST_VALUES:
                return None
        return out

    def call(self, r: Routine, parts: list[str], line: int) -> None:
        if parts[0] in r.locals or ".".join(parts) in r.locals or ".".join(parts[-2:]) in r.locals or (len(parts) == 1 and (parts[0] in KEYWORDS or parts[0] in BUILTINS)):
            if len(parts) == 1 and parts[0] in BUILTINS:
                self.out.edges.append((r.key, f"builtin:{parts[0]}", "UsesBuiltinFunction", line))
            return
        if len(parts) > 1 and parts[-1] in ("nextval", "currval"):
            self.out.edges.append((r.key, f"seq:{'.'.join(parts[:-1])}", "UsesSequence", line))
            return
        self.out.calls.append((r.key, ".".join(parts), False, line))

    def expression(self, s: list[Token], r: Routine, line: int) -> None:
        """Calls and subqueries of an expression."""
        if not self.active:
            return
        if any(x.low == "select" for x in s):
            self.dml(s, r.key, r.schema, r.locals, r)
            return
        if self.called:
            self.calls_in(s, r)

    def calls_in(self, s: list[Token], r: Routine) -> None:
        k, n = 0, len(s)
        while k < n:
            # A call is a name before a parenthesis; other names are passed over at once.
            if s[k].kind in ("name", "quoted") and k + 1 < n and s[k + 1].text in "(." and not (k and s[k - 1].text == "."):
                parts, j = _name_at(s, k)
                if j < len(s) and s[j].text == "(" and not (k and s[k - 1].low in ("into", "update", "table", "join", "from", "as", "view", "with", ",") and s[k - 1].low in ("into", "update", "table", "with")):
                    if s[j - 1].kind == "quoted" or parts[-1] not in KEYWORDS:
                        self.call(r, parts, s[k].line)
                elif len(parts) > 1 and parts[-1] in ("nextval", "currval"):
                    self.call(r, parts, s[k].line)
                if parts == ["nextval"] or parts == ["currval"] or parts == ["setval"]:
                    if j + 1 < len(s) and s[j].text == "(" and s[j + 1].kind == "string":
                        self.out.edges.append((r.key, f"seq:{s[j + 1].text.strip(chr(39)).lower()}", "UsesSequence", s[k].line))
                k = max(j, k + 1)
            else:
                k += 1

    # -- statements on tables

    def dml(self, s: list[Token], owner: str, schema: str | None, local: set[str], r: Routine | None = None) -> set[str]:
        """Accesses, calls, mappings, filters and joins of one statement. Returns the tables that it reads."""
        if not s or not self.active:
            return set()
        line, w = s[0].line, s[0].low
        words = {x.low for x in s if x.kind == "name"}
        number = len(self.out.accesses) + 1
        self.r = r
        reads: set[str] = set()

        def add(parts: list[str], mode: int, kind: str | None = None) -> None:
            if parts and parts[-1] not in KEYWORDS:
                self.out.accesses.append((owner, ".".join(parts), mode, kind, number, line))
                if mode in (READ, LOCK_READ):
                    reads.add(".".join(parts))

        start = 0
        if w == "truncate":
            start = 2 if len(s) > 1 and s[1].low == "table" else 1
            for parts in _names(s, start):
                add(parts, ACCESS_EXCLUSIVE, "truncate")
        elif w in ("alter", "drop") and len(s) > 1 and s[1].low == "table":
            k = 4 if [x.low for x in s[2:4]] == ["if", "exists"] else 2
            for parts in _names(s, k) if w == "drop" else [_name_at(s, k)[0]]:
                add(parts, ACCESS_EXCLUSIVE, w)
        elif w == "create" and any(x.low == "index" for x in s[:4]):
            k = next((j for j, x in enumerate(s) if x.low == "on"), None)
            if k is not None:
                late = any(x.low == "concurrently" for x in s[:k])
                add(_name_at(s, k + 1)[0], SHARE_UPDATE_EXCLUSIVE if late else SHARE, "create_index_concurrent" if late else "create_index")
        elif w == "lock":
            k = 2 if len(s) > 1 and s[1].low == "table" else 1
            at = next((j for j, x in enumerate(s) if x.low == "in" and j > k), len(s))
            mode = " ".join(x.low for x in s[at + 1 :] if x.low not in ("mode", "nowait"))
            for parts in _names(s[:at], k):
                add(parts, LOCK_MODES.get(mode, ACCESS_EXCLUSIVE), "lock_table")
        elif w == "vacuum":
            full = any(x.low == "full" for x in s[:4])
            k = next((j for j in range(1, len(s)) if s[j].kind in ("name", "quoted") and s[j].low not in ("full", "analyze", "verbose", "freeze")), None)
            if k is not None:
                add(_name_at(s, k)[0], ACCESS_EXCLUSIVE if full else SHARE_UPDATE_EXCLUSIVE, "vacuum_full" if full else "vacuum")
        elif w in ("analyze", "cluster", "reindex"):
            k = next((j for j in range(1, len(s)) if s[j].kind in ("name", "quoted") and s[j].low not in ("verbose", "table", "index")), None)
            if k is not None:
                add(_name_at(s, k)[0], SHARE_UPDATE_EXCLUSIVE if w == "analyze" else ACCESS_EXCLUSIVE, w)
        elif self.tables or self.depends and r is None:
            self.query(s, owner, local, add, r)
        if r is not None and self.called:
            self.calls_in(s, r)
            self.operators(s, words, owner)
        if self.typed and ("cast" in words or any(x.text == "::" for x in s)):
            self.casts(s, owner)
        if self.mapped and w == "insert":
            self.insert_columns(owner, s)
        elif self.mapped and w == "update":
            self.update_columns(owner, s)
        elif self.mapped and w == "merge":
            self.merge_columns(owner, s)
        if self.filtered and words & {"where", "on", "having"}:
            self.conditions(owner, s)
        if self.listed and words & {"case", "decode"}:
            self.enum_values(owner, s)
        return reads

    def operators(self, s: list[Token], words: set[str], owner: str) -> None:
        """EXISTS, IN, NOT IN, ANY, SOME and ALL before a subquery count as functions of the database."""
        if not words & {"exists", "in", "any", "some", "all"}:
            return
        for k, x in enumerate(s[:-1]):
            if x.kind == "name" and x.low in ("exists", "in", "any", "some", "all") and s[k + 1].text == "(" and (x.low == "exists" or s[k + 2].low in ("select", "with")):
                name = "not_in" if x.low == "in" and k and s[k - 1].low == "not" else x.low
                self.out.edges.append((owner, f"builtin:{name}", "UsesBuiltinFunction", x.line))

    def casts(self, s: list[Token], owner: str) -> None:
        """Types of CAST(x AS type) and x::type; only known ones are kept when the graph is built."""
        for k, x in enumerate(s):
            if x.text == "::" or (x.low == "as" and x.kind == "name" and _in_cast(s, k)):
                parts, _ = _name_at(s, k + 1)
                if parts and parts[-1] not in KEYWORDS:
                    self.out.types.append((owner, ".".join(parts), x.line))

    def query(self, s: list[Token], owner: str, local: set[str], add, r: Routine | None) -> None:
        """Tables after FROM, JOIN, INTO, UPDATE and so on, at any depth; names of WITH are none within their statement."""
        ctes = {s[k].low for k in range(len(s) - 2) if s[k].kind in ("name", "quoted") and s[k + 1].low == "as" and s[k + 2].text == "(" and k and s[k - 1].low in ("with", ",", "recursive")}
        ctes |= {s[k].low for k in range(len(s)) if s[k].kind == "name" and k and s[k - 1].low in ("with", "recursive") and k + 1 < len(s) and s[k + 1].text == "("} if s[0].low == "with" else set()
        stack: list[str] = []  # the word before each open parenthesis
        tables: list[list[str]] = []
        first = s[0].low
        seen_select = False
        k = 0
        while k < len(s):
            x = s[k]
            if x.text == "(":
                stack.append(s[k - 1].low if k and s[k - 1].kind == "name" else "")
            elif x.text == ")" and stack:
                stack.pop()
            elif x.kind == "name":
                w = x.low
                if w == "select":
                    seen_select = True
                if w in ("from", "join", "using") and not (stack and stack[-1] in ("extract", "trim", "substring", "overlay", "position")):
                    if w == "using" and first != "merge" and first != "delete":
                        k += 1
                        continue
                    if w == "from" and k and s[k - 1].low == "distinct" and k > 1 and s[k - 2].low in ("is", "not"):
                        k += 1
                        continue
                    k = self.from_list(s, k + 1, ctes, add, tables, w, deleting=w == "from" and k and s[k - 1].low == "delete")
                    continue
                if w == "into" and k and s[k - 1].low in ("insert", "merge", "all", "first", "overwrite") or (w == "into" and first == "insert" and not seen_select):
                    parts, j = _name_at(s, k + 1)
                    if s[0].low == "merge" or (k and s[k - 1].low == "merge"):
                        for kind, word in (("merge_update", "update"), ("merge_insert", "insert"), ("merge_delete", "delete")):
                            if any(y.low == word for y in s[j:]):
                                add(parts, WRITE, kind)
                    else:
                        listed = j + 1 < len(s) and s[j].text == "(" and s[j + 1].low not in ("select", "with")
                        rest = s[_closing(s, j) + 1 :] if listed else s[j:]
                        add(parts, WRITE, "insert_select" if rest and rest[0].low not in ("values", "default") and any(y.low == "select" for y in rest) else "insert")
                    k = j
                    continue
                if w == "update" and not (k and s[k - 1].low in ("for", "then", "on", "key", "or")):
                    j = k + 1 + (k + 1 < len(s) and s[k + 1].low == "only")
                    parts, j = _name_at(s, j)
                    add(parts, WRITE, "update")
                    k = j
                    continue
                if w == "for" and k + 1 < len(s) and s[k + 1].low in ("update", "share", "no", "key"):
                    for t in tables:
                        add(t, LOCK_READ)
                    k += 2
                    continue
            k += 1

    def from_list(self, s: list[Token], k: int, ctes: set[str], add, tables: list[list[str]], word: str, deleting: bool) -> int:
        while k < len(s):
            while k < len(s) and s[k].low in ("only", "lateral"):
                k += 1
            if k < len(s) and s[k].text == "(":
                return k  # a subquery is walked by the caller
            parts, j = _name_at(s, k)
            if not parts:
                return max(k, j)
            if j < len(s) and s[j].text == "(":  # a table function
                return j
            if not (len(parts) == 1 and parts[0] in ctes) and parts[-1] not in ("dual", "sys_dummy"):
                add(parts, WRITE if deleting else READ, "delete" if deleting else None)
                if not deleting:
                    tables.append(parts)
            deleting = False
            if j < len(s) and s[j].low == "as":
                j += 1
            if j < len(s) and s[j].kind in ("name", "quoted") and s[j].low not in KEYWORDS:
                j += 1
            if word == "from" and j < len(s) and s[j].text == ",":
                k = j + 1
                continue
            return j
        return k

    # -- columns

    def aliases(self, s: list[Token]) -> dict[str, str]:
        if self.known and self.known[0] is s:
            return self.known[1]
        out: dict[str, str] = {}
        self.known = (s, out)
        for k, x in enumerate(s):
            if x.low == "into" and not (k and s[k - 1].low in ("insert", "merge", "all", "first", "overwrite") or s[0].low == "insert"):
                continue  # variables
            if x.low in _BEFORE_TABLE and x.kind == "name" or (x.text == "," and out):
                parts, j = _name_at(s, k + 1)
                if not parts or parts[-1] in KEYWORDS or (j < len(s) and s[j].text in ("(", ".", "=")):
                    if not (x.low == "into" and parts):
                        continue
                if x.text == "," and not (j < len(s) and (s[j].kind == "name" and s[j].low not in KEYWORDS or s[j].low in ("where", "as"))):
                    continue
                if j < len(s) and s[j].low == "as":
                    j += 1
                table = ".".join(parts)
                out.setdefault(parts[-1], table)
                if j < len(s) and s[j].kind in ("name", "quoted") and s[j].low not in KEYWORDS:
                    out[s[j].low] = table
        return out

    def source(self, s: list[Token], alias: dict[str, str], only: str | None) -> tuple[list[tuple[str, str | None, str | None]], str]:
        """Columns of a value and how it is made: direct, derived or aggregated."""
        s = [x for x in s]
        if len(s) > 1 and s[-1].kind in ("name", "quoted") and s[-2].kind in ("name", "quoted", "number", "string") or (len(s) > 2 and s[-2].low == "as"):
            s = s[:-2] if s[-2].low == "as" else s[:-1]
        if len(s) == 1 and s[0].kind in ("string", "number"):
            return [("literal", None, s[0].text)], "direct"
        if len(s) > 2 and s[0].text == "(" and s[1].low == "select" and _closing(s, 0) == len(s) - 1:
            # A scalar subquery is its first output, with names of its own.
            items, inner, one = self.select_items(s[1:-1])
            return self.source(items[0], inner, one) if items and items[0] else ([], "derived")
        cols, k, fn = [], 0, None
        while k < len(s):
            if s[k].text == "(" and k + 1 < len(s) and s[k + 1].low == "select":
                end = _closing(s, k)
                cols += self.source(s[k : end + 1], alias, only)[0]
                k = end + 1
            elif s[k].kind in ("name", "quoted"):
                parts, j = _name_at(s, k)
                if j < len(s) and s[j].text == "(":
                    fn = fn or parts[-1]
                elif parts[-1] not in KEYWORDS:
                    known = self.value_of(parts) if parts[0] not in alias else None
                    if known:
                        cols.append(("column", *known))
                    elif len(parts) == 1 and self.r is not None and parts[0] in self.r.locals:
                        cols.append(("column", None, parts[0]))
                    else:
                        cols.append(("column", alias.get(parts[-2]) if len(parts) > 1 else only, parts[-1]))
                k = max(j, k + 1)
            else:
                k += 1
        simple = len(_name_at(s, 0)[0]) and _name_at(s, 0)[1] >= len(s)
        return cols, "direct" if simple else "aggregated" if fn in AGGREGATES else "derived"

    def map(self, owner: str, table: str, column: str, value: list[Token], alias: dict[str, str], only: str | None) -> None:
        cols, kind = self.source(value, alias, only)
        text = " ".join(x.text for x in value)
        for source_kind, t, c in cols:
            self.out.mappings.append((owner, table, column, source_kind, t, c, kind, text, value[0].line if value else 0))

    def insert_columns(self, owner: str, s: list[Token]) -> None:
        k = next((j for j, x in enumerate(s) if x.low == "into"), None)
        if k is None:
            return
        parts, j = _name_at(s, k + 1)
        table = ".".join(parts)
        names: list[str] = []
        if s[1].low in ("all", "first"):
            self.insert_all(owner, s)
            return
        if j < len(s) and s[j].text == "(" and not (j + 1 < len(s) and s[j + 1].low == "select"):
            close = _closing(s, j)
            names = [x.low for x in s[j + 1 : close] if x.kind in ("name", "quoted")]
            j = close + 1
        if j < len(s) and s[j].low == "values" and names:
            if j + 1 < len(s) and s[j + 1].text == "(":
                for n, v in zip(names, _split_commas(s[j + 2 : _closing(s, j + 1)])):
                    if v:
                        self.map(owner, table, n, v, {}, None)
            return
        for branch in _branches(s[j:]):
            items, alias, only = self.select_items(branch)
            if any(len(v) == 1 and v[0].text == "*" for v in items):
                continue
            outs = names or [_output_name(v) for v in items]
            for n, v in zip(outs, items):
                if n and v:
                    self.map(owner, table, n, v, alias, only)

    def insert_all(self, owner: str, s: list[Token]) -> None:
        """INSERT ALL and INSERT FIRST: each INTO takes its values from the outputs of the one query at the end."""
        depth, intos, start = 0, [], None
        for k, x in enumerate(s):
            depth += (x.text == "(") - (x.text == ")")
            if depth == 0 and x.low == "into" and x.kind == "name":
                intos.append(k)
            elif depth == 0 and x.low in ("select", "with") and x.kind == "name":
                start = k
                break
        items, alias, only = self.select_items(s[start:]) if start is not None else ([], {}, None)
        outs = {_output_name(v): v for v in items if v}
        for k in intos:
            parts, j = _name_at(s, k + 1)
            groups = []
            while j < len(s) and (s[j].text == "(" or s[j].low == "values"):
                if s[j].text == "(":
                    groups.append((s[j - 1].low == "values", _split_commas(s[j + 1 : _closing(s, j)])))
                    j = _closing(s, j)
                j += 1
            names = next((["".join(x.low for x in g[-1:]) for g in v] for is_values, v in groups if not is_values), [])
            values = next((v for is_values, v in groups if is_values), items)
            for n, v in zip(names or list(outs), values):
                if n and v:
                    self.map(owner, ".".join(parts), n, self.through(v, outs) if values is not items else v, alias, only)

    def through(self, value: list[Token], outs: dict[str, list[Token]]) -> list[Token]:
        """A value over the outputs of a query as a value over the query's own columns."""
        if len(value) == 1 and value[0].low in outs:
            return outs[value[0].low]
        out = []
        for k, x in enumerate(value):
            bare = x.kind in ("name", "quoted") and not (k and value[k - 1].text == ".") and not (k + 1 < len(value) and value[k + 1].text in (".", "("))
            made = outs.get(x.low) if bare else None
            if made:
                end = len(made) - 2 if len(made) > 2 and made[-2].low == "as" else len(made) - 1 if len(made) > 1 and made[-2].kind == made[-1].kind == "name" else len(made)
                out += [Token("op", "(", "(", "(", x.line), *made[:end], Token("op", ")", ")", ")", x.line)]
            else:
                out.append(x)
        return out

    def assign(self, owner: str, table: str, item: list[Token], alias: dict[str, str], only: str | None) -> None:
        """An assignment of SET: column = value, or (columns) = (values or a query) by position."""
        if item and item[0].text == "(":
            close = _closing(item, 0)
            names = [_name_at(x, 0)[0] for x in _split_commas(item[1:close])]
            at = next((i for i in range(close, len(item)) if item[i].text == "("), None)
            if at is None:
                return
            inner = item[at + 1 : _closing(item, at)]
            values = _split_commas(inner)
            if inner and inner[0].low in ("select", "with"):
                values, alias, only = self.select_items(inner)
            for n, v in zip(names, values):
                if n and v:
                    self.map(owner, table, n[-1], v, alias, only)
            return
        eq, parts = next((i for i, x in enumerate(item) if x.text == "="), None), _name_at(item, 0)[0]
        if eq and parts:
            self.map(owner, table, parts[-1], item[eq + 1 :], alias, only)

    def select_items(self, s: list[Token]) -> tuple[list[list[Token]], dict[str, str], str | None]:
        k = next((j for j, x in enumerate(s) if x.low == "select"), None)
        if k is None:
            return [], {}, None
        depth, end = 0, len(s)
        for j in range(k, len(s)):
            depth += (s[j].text == "(") - (s[j].text == ")")
            if depth == 0 and s[j].low in ("from", "into") and s[j].kind == "name":
                end = j
                break
        alias = self.aliases(s[end:])
        tables = set(alias.values())
        items = _split_commas([x for x in s[k + 1 : end] if x.low != "distinct"])
        return items, alias, next(iter(tables)) if len(tables) == 1 else None

    def update_columns(self, owner: str, s: list[Token]) -> None:
        parts, j = _name_at(s, 1)
        k = next((i for i, x in enumerate(s) if x.low == "set"), None)
        if not parts or k is None:
            return
        depth, end = 0, len(s)
        for i in range(k + 1, len(s)):
            depth += (s[i].text == "(") - (s[i].text == ")")
            if depth == 0 and s[i].low in ("where", "from", "returning"):
                end = i
                break
        alias = self.aliases(s)
        for item in _split_commas(s[k + 1 : end]):
            self.assign(owner, ".".join(parts), item, alias, ".".join(parts))

    def merge_columns(self, owner: str, s: list[Token]) -> None:
        """The assignments of the update arm and the pairs of the insert arm; a delete arm gives none."""
        k = next((j for j, x in enumerate(s) if x.low == "into"), None)
        if k is None:
            return
        table, _ = _name_at(s, k + 1)
        target, alias = ".".join(table), self.aliases(s)
        for j, x in enumerate(s):
            if x.low == "set":
                end = next((i for i in range(j, len(s)) if s[i].low in ("when", "where")), len(s))
                for item in _split_commas(s[j + 1 : end]):
                    self.assign(owner, target, item, alias, None)
            if x.low == "insert" and j + 1 < len(s) and s[j + 1].text == "(":
                close = _closing(s, j + 1)
                names = [y.low for y in s[j + 2 : close] if y.kind in ("name", "quoted")]
                at = next((i for i in range(close, len(s)) if s[i].text == "("), None)
                for n, v in zip(names, _split_commas(s[at + 1 : _closing(s, at)]) if at else []):
                    if v:
                        self.map(owner, target, n, v, alias, None)

    def enum_values(self, owner: str, s: list[Token]) -> None:
        """CASE column WHEN literal THEN literal, and DECODE(column, literal, result, ...)."""
        alias = self.aliases(s)
        tables = set(self.aliases(_level(s, len(s) - 1)).values()) if any(x.low == "select" for x in s[1:]) else set(alias.values())
        self.known = (s, alias)
        only = next(iter(tables)) if len(tables) == 1 else None
        place = lambda parts: alias.get(parts[-2]) if len(parts) > 1 else only
        literal = lambda x: x.kind in ("string", "number")
        for k, x in enumerate(s):
            if x.low == "case" and x.kind == "name":
                parts, j = _name_at(s, k + 1)
                if not parts or parts[0] in KEYWORDS:
                    continue
                while j + 3 < len(s) and s[j].low == "when" and literal(s[j + 1]) and s[j + 2].low == "then":
                    if literal(s[j + 3]):
                        self.out.enums.append((owner, place(parts), parts[-1], s[j + 1].text, s[j + 3].text, x.line))
                    j = next((i for i in range(j + 3, len(s)) if s[i].low in ("when", "else", "end")), len(s))
            elif x.low == "decode" and k + 1 < len(s) and s[k + 1].text == "(":
                args = _split_commas(s[k + 2 : _closing(s, k + 1)])
                parts, _ = _name_at(args[0], 0)
                for a, b in zip(args[1::2], args[2::2]) if parts else ():
                    if len(a) == len(b) == 1 and literal(a[0]) and literal(b[0]):
                        self.out.enums.append((owner, place(parts), parts[-1], a[0].text, b[0].text, x.line))

    def view_columns(self, key: str, view: str, declared: list[str], s: list[Token]) -> None:
        if not self.mapped:
            return
        for branch in _branches(s):
            items, alias, only = self.select_items(branch)
            outs = declared or [_output_name(v) for v in items]
            for n, v in zip(outs, items):
                if n and v and v[0].text != "*":
                    self.map(key, view, n, v, alias, only)

    def conditions(self, owner: str, s: list[Token]) -> None:
        """Conditions of WHERE, ON and HAVING at any depth. Only AND is split; what holds an OR gives nothing.

        column = column of another table is a join; column op literal, function(column) op literal, IN with literals, BETWEEN,
        LIKE and IS NULL are filters, with their negation; an expression over one column = one over another table's column is
        a cross-table equality.
        """
        alias = self.aliases(s)
        nested = any(x.low == "select" for x in s[1:])
        for k, x in enumerate(s):
            if x.kind == "name" and x.low in ("where", "on", "having"):
                # A bare column belongs to the one table of its own query.
                tables = set(self.aliases(_level(s, k)).values()) if nested else set(alias.values())
                self.conjuncts(owner, _condition(s, k + 1), alias, next(iter(tables)) if len(tables) == 1 else None)
        self.known = (s, alias)

    def conjuncts(self, owner: str, s: list[Token], alias: dict[str, str], only: str | None) -> None:
        while len(s) > 1 and s[0].text == "(" and _closing(s, 0) == len(s) - 1 and s[1].low != "select":
            s = s[1:-1]
        parts, depth, between = [[]], 0, False
        for x in s:
            depth += (x.text == "(") - (x.text == ")")
            if depth == 0 and x.kind == "name":
                if x.low == "or":
                    return
                if x.low == "between":
                    between = True
                elif x.low == "and":
                    if not between:
                        parts.append([])
                        continue
                    between = False
            parts[-1].append(x)
        if len(parts) > 1:
            for part in parts:
                self.conjuncts(owner, part, alias, only)
        elif s:
            self.conjunct(owner, s, alias, only)

    def side(self, s: list[Token], alias: dict[str, str], only: str | None) -> tuple[list[tuple[str | None, str, str | None]], str | None, bool]:
        """Distinct columns (table, column, prefix) of an expression, its outer function, and whether it is a bare column."""
        cols, fn, k = [], None, 0
        while k < len(s):
            if s[k].kind in ("name", "quoted"):
                parts, j = _name_at(s, k)
                if j < len(s) and s[j].text == "(":
                    fn = fn or parts[-1]
                elif parts[-1] not in KEYWORDS or s[k].kind == "quoted":
                    prefix = ".".join(parts[:-1]) or None
                    known = self.value_of(parts) if parts[0] not in alias else None
                    table = alias.get(parts[-2]) if len(parts) > 1 else only
                    if known:
                        one = (*known, f"record {parts[0]}")
                    elif table is None and len(parts) > 2:
                        one = (parts[-2], parts[-1], prefix)
                    else:
                        one = (None if len(parts) == 1 and self.r is not None and parts[0] in self.r.locals else table, parts[-1], prefix)
                    if one not in cols:
                        cols.append(one)
                k = max(j, k + 1)
            else:
                k += 1
        parts, j = _name_at(s, 0)
        return cols, fn, bool(parts) and j >= len(s)

    def conjunct(self, owner: str, s: list[Token], alias: dict[str, str], only: str | None) -> None:
        k = _operator_at(s)
        if not k or s[k - 1].kind == "op" and s[k - 1].text not in (")", "]"):
            return
        negated = s[k - 1].low == "not"
        left, right = s[: k - negated], s[k + 1 :]
        op, line = s[k].low, s[0].line
        cols, fn, bare = self.side(left, alias, only)
        literal = lambda x: x.kind in ("string", "number")
        value = None
        if op == "is":
            op = "is not null" if right and right[0].low == "not" else "is null"
            if right and right[-1].low != "null":
                return
        elif op == "in":
            inside = right[1:-1]
            if len(right) < 3 or not all(literal(x) or x.text == "," for x in inside):
                return
            value = "".join(x.text for x in inside)
        elif op == "between":
            at = next((j for j, x in enumerate(right) if x.low == "and"), None)
            if at is None or not all(literal(x) or x.text == "-" for x in right[:at] + right[at + 1 :]):
                return
            value = " ".join(x.text for x in right)
        elif len(right) == 1 and literal(right[0]):
            value = right[0].text
        elif len(left) == 1 and literal(left[0]) and _name_at(right, 0)[1] >= len(right):
            # A literal on the left turns the comparison round.
            (cols, fn, bare), value = self.side(right, alias, only), left[0].text
            op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        else:
            if op == "=" and len(cols) == 1:
                self.equality(owner, left, right, cols[0], bare, alias, only, line)
            return
        if len(cols) == 1 and (bare or fn) and not (cols[0][2] or "").startswith("record "):
            name = "not " + op if negated else op
            self.out.filters.append((owner, cols[0][0], cols[0][1], name, value, None if bare else fn, line))

    def equality(self, owner: str, left: list[Token], right: list[Token], a: tuple, bare: bool, alias: dict[str, str], only: str | None, line: int) -> None:
        cols, _, other = self.side(right, alias, only)
        if len(cols) != 1 or not a[0] or not cols[0][0]:
            return
        b = cols[0]
        if bare and other:
            if a[0] != b[0]:
                record = (a[2] or "").startswith("record ") or (b[2] or "").startswith("record ")
                self.out.joins.append((owner, a[0], a[1], b[0], b[1], "record" if record else "column", line))
        elif not (a[2] and a[2] == b[2]) and (a[2] or b[2] or a[0] != b[0]):
            self.out.equalities.append((owner, a[0], a[1], b[0], b[1], " ".join(x.text for x in left) + " = " + " ".join(x.text for x in right), line))


# Words that end a condition.
_ENDS = set("group order having limit union except intersect minus join inner left right full cross natural where on when returning start connect for loop fetch offset window set using then model".split())


def _condition(s: list[Token], k: int) -> list[Token]:
    """The tokens from k to the end of a condition."""
    depth = 0
    for j in range(k, len(s)):
        x = s[j]
        if x.text == "(":
            depth += 1
        elif x.text == ")":
            depth -= 1
            if depth < 0:
                return s[k:j]
        elif depth == 0 and x.kind == "name" and x.low in _ENDS and not (j + 1 < len(s) and s[j + 1].text == "("):
            return s[k:j]
    return s[k:]


def _level(s: list[Token], k: int) -> list[Token]:
    """The tokens of the query around k, without what stands in parentheses within it."""
    depth, start = 0, k
    while start > 0:
        depth += (s[start - 1].text == ")") - (s[start - 1].text == "(")
        if depth < 0:
            break
        start -= 1
    out, depth = [], 0
    for x in s[start:]:
        depth -= x.text == ")"
        if depth < 0:
            break
        if depth == 0:
            out.append(x)
        depth += x.text == "("
    return out


def _operator_at(s: list[Token]) -> int | None:
    """Where the comparison of a condition stands, outside parentheses and CASE."""
    depth = 0
    for k, x in enumerate(s):
        if x.text == "(" or x.low == "case" and x.kind == "name":
            depth += 1
        elif x.text == ")" or x.low == "end" and x.kind == "name":
            depth -= 1
        elif depth == 0 and (x.text in ("=", "<>", "!=", "<", ">", "<=", ">=") or x.kind == "name" and x.low in ("like", "in", "between", "is")):
            return k
    return None


def _in_cast(s: list[Token], k: int) -> bool:
    """Whether the AS at k belongs to a CAST."""
    depth = 0
    for j in range(k - 1, -1, -1):
        depth += (s[j].text == ")") - (s[j].text == "(")
        if depth < 0:
            return j > 0 and s[j - 1].low == "cast"
    return False


def _fields(outputs: list) -> dict:
    return {name: source for name, source in outputs if name and source}


def _name_at(s: list[Token], k: int) -> tuple[list[str], int]:
    n = len(s)
    if k >= n or s[k].kind not in _NAMED:
        return [], k
    parts = [s[k].low]
    k += 1
    while k + 1 < n and s[k].text == "." and s[k + 1].kind in _NAMED:
        parts.append(s[k + 1].low)
        k += 2
    return parts, k


def _names(s: list[Token], k: int) -> list[list[str]]:
    out = []
    while True:
        parts, k = _name_at(s, k)
        if not parts:
            return out
        out.append(parts)
        if not (k < len(s) and s[k].text == ","):
            return out
        k += 1


def _closing(s: list[Token], k: int) -> int:
    depth = 0
    for j in range(k, len(s)):
        depth += (s[j].text == "(") - (s[j].text == ")")
        if depth == 0:
            return j
    return len(s)


def _split_commas(s: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for x in s:
        depth += (x.text == "(") - (x.text == ")")
        if x.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(x)
    return out


def _branches(s: list[Token]) -> list[list[Token]]:
    """Branches of set operations at depth 0."""
    out, depth = [[]], 0
    for x in s:
        depth += (x.text == "(") - (x.text == ")")
        if depth == 0 and x.low in ("union", "except", "intersect", "minus"):
            out.append([])
        else:
            out[-1].append(x)
    return out


def _output_name(v: list[Token]) -> str | None:
    return v[-1].low if v and v[-1].kind in ("name", "quoted") else None


def read_sql(text: str, file: str, specs: dict[str, str] | None = None, want: frozenset[str] | None = None) -> Found:
    return Reader(text, file, specs, want).read()


_PACKAGE = re.compile(r"""\bcreate\s+(?:or\s+replace\s+)?(?:(?:non)?editionable\s+)?package\s+(body\s+)?((?:[\w$\#]+|"[^"]+")(?:\s*\.\s*(?:[\w$\#]+|"[^"]+"))*)""", re.I)


def package_heads(text: str) -> list[tuple[str, bool, str | None]]:
    """Name, whether it is a body, and the declarations (of a specification) of each package of a file.

    Only specifications are read, and each only up to its END.
    """
    out = []
    for m in _PACKAGE.finditer(text):
        name = re.sub(r'[\s"]', "", m[2]).lower()
        if m[1]:
            out.append((name, True, None))
            continue
        held, part, depth, begun = [], [], 0, False
        for t in _TOKEN.finditer(text, m.end()):
            if t.lastgroup == "space":
                continue
            x = t[0]
            if not begun:
                begun = x.lower() in ("is", "as")
                continue
            depth += (x == "(") - (x == ")")
            if x == ";" and depth <= 0:
                if part and part[0].lower() not in ("procedure", "function", "pragma"):
                    held.append(" ".join(part))
                part = []
            elif not part and x.lower() == "end":
                break
            else:
                part.append(x)
        out.append((name, False, " ; ".join(held)))
    return out
