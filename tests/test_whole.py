"""Queries over whole tables against plain Python, on small tables with ids of all sizes."""

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from codeloom import registry
from codeloom.model import CONFLICTS

PARTS = [*range(1, 13), *range(401, 441)]


@pytest.fixture(scope="module")
def small_tables(tmp_path_factory):
    root, r = tmp_path_factory.mktemp("tables"), random.Random(7)
    lines = [
        {"l_orderkey": o, "l_linenumber": n, "l_partkey": r.choice(PARTS), "l_suppkey": r.randrange(1, 9), "l_quantity": float(r.choice([1, 20, 50])), "l_returnflag": r.choice("NRA"), "l_linestatus": r.choice("FO")}
        for o in (*range(1, 6), *range(301, 321)) for n in range(1, 6)
    ]
    tables = {
        "lineitem": lines,
        "part": [{"p_partkey": p, "p_size": p % 20, "p_brand": f"b{p % 3}", "p_type": f"t{p % 4}"} for p in PARTS],
        "supplier": [{"s_suppkey": s, "s_nationkey": s % 2} for s in range(1, 9)],
        "nation": [{"n_nationkey": n} for n in range(2)],
        "orders": [{"o_orderkey": 1}],
        "documents": [{"doc_id": 1, "text": "x"}],
    }
    for name, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), root / f"{name}.parquet")
    return str(root), tables


def run(spark, name, small_tables):
    df = registry.QUERIES[name](spark, small_tables[0])
    return sorted((tuple(r) for r in df.collect()), key=repr)


def routines():
    for p in PARTS:
        yield f"proc:r{p}", f"sch{p % 4}" if p % 4 else None, f"pkg{p % 5}" if p % 3 == 0 else None, f"only{p}" if p % 7 == 0 else f"fn{p % 40}"


def test_resolve_calls_whole(spark, small_tables):
    rs, want = list(routines()), []
    for x in small_tables[1]["lineitem"]:
        k, p = x["l_linenumber"], x["l_partkey"]
        raw = {1: f"only{p % 50 * 7}", 2: f"SCH{p % 5}.FN{p % 45}", 3: f"pkg{p % 6}.fn{p % 45}", 4: "self.x"}.get(k, f"fn{p % 60}")
        if raw == "self.x":
            continue
        t, caller = raw.lower(), f"sch{x['l_suppkey'] % 5}"
        bare, found = t.split(".")[-1], []
        for key, schema, package, name in rs:
            many = sum(y[3] == name for y in rs)
            if ".".join(y for y in (schema, package, name) if y) == t:
                found.append((1, key))
            if package and f"{package}.{name}" == t:
                found.append((3, key))
            if name == bare:
                found.append((2 if "." in t else 4, key) if many == 1 else (5 if schema == caller else 6 if schema is None else 7, key))
        best = min(found, default=None)
        want.append((x["l_orderkey"] * 10 + k, raw, best and f"S{best[0]}", best and best[1]))
    got = run(spark, "resolve_calls", small_tables)
    assert got == sorted(want, key=repr)
    assert any(r[0] > 3010 and r[3] and int(r[3][6:]) > 400 for r in got)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_names_whole(spark, small_tables):
    names, want = {x[3] for x in routines()}, []
    for raw in {f"onlx{p % 30}" for p in PARTS}:
        near = sorted((d, n) for n in names if (d := distance(raw, n)) <= 3)[:3]
        want += [(raw, n, d, i) for i, (d, n) in enumerate(near, 1)]
    got = run(spark, "nearest_names", small_tables)
    assert got == sorted(want, key=repr)
    assert {"only406", "only413"} & {r[1] for r in got}


def accesses(small_tables):
    out = {}
    for x in small_tables[1]["lineitem"]:
        key = x["l_suppkey"], x["l_partkey"]
        out[key] = out.get(key, 0) | {"N": 1, "R": 2, "A": 4}[x["l_returnflag"]] | (8 if x["l_quantity"] >= 50 else 0)
    return out


def hops(small_tables):
    """Of each statement (an order), what its writes take from its other tables, if the routine reads those."""
    modes, routine = {}, lambda o: f"o{o % 997}"
    for x in small_tables[1]["lineitem"]:
        key = x["l_orderkey"], f"p{x['l_partkey']}"
        modes[key] = modes.get(key, 0) | (2 if x["l_returnflag"] == "R" else 1)
    reads = {(routine(o), t) for (o, t), m in modes.items() if m & 1}
    return {(p, routine(o), c) for (o, p), m in modes.items() if m & 2 for (q, c) in modes if q == o and c != p and (routine(o), c) in reads}


def ways(edges, start, depth):
    out, front = [], [(start, None, (start,))]
    for n in range(1, depth + 1):
        front = [(c, r, (*path, c)) for node, _, path in front for p, r, c in edges if p == node and c not in path]
        out += [(" < ".join(path), r, node, n) for node, r, path in front]
    return sorted(out, key=repr)


def test_table_hops_whole(spark, small_tables):
    want = hops(small_tables)
    assert run(spark, "table_hops", small_tables) == sorted(want, key=repr)
    assert any(int(p[1:]) > 400 for p, _, _ in want)


def test_table_lineage_whole(spark, small_tables):
    want = ways(hops(small_tables), "p7", 3)
    assert run(spark, "table_lineage", small_tables) == want
    assert want


def mappings(small_tables):
    of = lambda p: p * 3 % 97 + 1
    return {(f"p{p}", f"c{p % 3}", f"p{of(p)}", f"c{of(p) % 3}", f"proc:s{p % 10 + 1}") for p in (x["l_partkey"] for x in small_tables[1]["lineitem"])}


def roles(small_tables):
    m = mappings(small_tables)
    ddl = {(s, c) for _, _, s, c, _ in m if int(s[1:]) % 3}
    for t, s in sorted({(x[0], x[2]) for x in m}):
        total = len({x[1] for x in m if x[0] == t})
        overlap = len({x[3] for x in m if x[0] == t and x[2] == s and (s, x[3]) in ddl})
        known = any(s == y for y, _ in ddl)
        yield t, s, overlap, total, "unknown" if not known else "flow" if overlap >= min(total, 8) else "reference"


def test_column_lineage_and_roles_whole(spark, small_tables):
    m = mappings(small_tables)
    assert run(spark, "column_lineage", small_tables) == ways([(f"{a}.{b}", o, f"{c}.{d}") for a, b, c, d, o in m], "p5.c2", 8)
    want = sorted(roles(small_tables), key=repr)
    assert run(spark, "lineage_roles", small_tables) == want
    assert any(int(r[0][1:]) > 97 for r in want)
    rank = ["flow", "reference", "unknown"]
    rolled = [(s, min((r[4] for r in want if r[1] == s), key=rank.index), max(r[2] for r in want if r[1] == s)) for s in {r[1] for r in want}]
    assert run(spark, "lineage_rollup", small_tables) == sorted(rolled, key=repr)


def test_tfidf_neighbours_whole(spark, small_tables):
    a = accesses(small_tables)
    procs = {r for r, _ in a}
    df = {t: sum(u == t for _, u in a) for _, t in a}
    idf = {t: math.log(len(procs) / n) for t, n in df.items() if n < len(procs)}
    v = {r: {t: idf[t] for q, t in a if q == r and t in idf} for r in procs}
    norm = {r: math.sqrt(sum(x * x for x in v[r].values())) for r in procs}
    want = {}
    for r in procs:
        sims = [(sum(x * v[q][t] for t, x in v[r].items() if t in v[q]) / (norm[r] * norm[q]), q) for q in procs if q != r]
        for sim, q in sorted((-round(s, 9), f"proc:s{q}") for s, q in sims if s >= 0.1)[:10]:
            want[tuple(sorted((f"proc:s{r}", q)))] = -sim
    got = {(x, y): s for x, y, s in run(spark, "tfidf_neighbours", small_tables)}
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_lock_matrix_whole(spark, small_tables):
    level = {1: 1, 4: 2, 2: 3, 16: 4, 32: 5, 64: 6, 128: 7, 8: 8}
    held = {m: {v for b, v in level.items() if m & b} for m in range(1, 256)}
    want = [(a, b, any(y in CONFLICTS.get(x, ()) for x in held[a] for y in held[b])) for a in held for b in held]
    assert len(want) == 65025
    assert run(spark, "lock_matrix", small_tables) == sorted(want, key=repr)


def test_validate_document_whole(spark, small_tables):
    kinds = ["table", "view", "report", "odd"]
    nodes = [(f"d{p % 3}", f"i{p // 2}", kinds[p % 4]) for p in PARTS]
    edges = [(f"d{x['l_partkey'] % 3}", f"i{x['l_partkey'] // 2}", f"i{x['l_suppkey'] % 200}", {1: "feeds", 2: "wrong"}.get(x["l_linenumber"], "DependsOn")) for x in small_tables[1]["lineitem"]]
    ids = [n[:2] for n in nodes]
    want = {(d, "error", "duplicate-id", i) for d, i in ids if ids.count((d, i)) > 1}
    want |= {(d, "error", "dangling-end", i) for d, a, b, _ in edges for i in (a, b) if (d, i) not in ids}
    want |= {(d, "error", "undeclared-node-type", t) for d, _, t in nodes if t == "odd"} | {(d, "error", "undeclared-edge-type", t) for d, _, _, t in edges if t == "wrong"}
    got = run(spark, "validate_document", small_tables)
    assert got == sorted([*want, *((f"d{p % 3}", "error", "missing-key-field", f"i{p // 2}") for p in PARTS if p % 8 == 2)], key=repr)
    assert any(r[3] in {f"i{p // 2}" for p in PARTS if p > 300} for r in got)
