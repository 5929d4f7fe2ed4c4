"""Traversals, clustering, search and merging against plain Python on small random graphs."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import access as acc
from codeloom.functions import sqltext
from codeloom.model import CONFLICTS, LEVEL_OF_BIT
from codeloom.operators import cluster, conflicts, lineage, listing, merge, search, traverse
from codeloom.plans import queryspec
from codeloom.work import materialize

EDGE = "src_key string, dst_key string, edge_type string, category string, modes int"


def graph(spark, pairs, nodes=()):
    e = spark.createDataFrame([(a, b, "DirectCall", "call", None) for a, b in pairs], EDGE)
    names = sorted({x for p in pairs for x in p} | set(nodes))
    n = spark.createDataFrame([(x, "proc", x, "f.sql", True) for x in names], "node_key string, type_tag string, name string, file string, explicit boolean")
    return n, e


def random_pairs(seed, n=14, m=22):
    r = random.Random(seed)
    return [(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)]


def closure(pairs, starts, depth):
    seen, front, out, level = set(starts), set(starts), {}, 0
    while front and level < depth:
        level += 1
        step = {b for a, b in pairs if a in front}
        for x in step:
            if x not in seen or x in starts:
                out.setdefault(x, level)
        front = step - seen
        seen |= step
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_equals_closure(spark, seed):
    pairs = random_pairs(seed)
    _, e = graph(spark, pairs)
    start = spark.createDataFrame([("n00",), ("n03",)], "node_key string")
    for depth in (2, None):
        got = {r.node_key: r.depth for r in traverse.reachable(e, start, "out", depth).collect()}
        assert got == closure(pairs, {"n00", "n03"}, depth or 99)


@pytest.mark.parametrize("seed", [3, 4])
def test_components_and_strong_components(spark, seed):
    pairs = random_pairs(seed)
    n, e = graph(spark, pairs, ["alone"])
    names = [r.node_key for r in n.collect()]
    both = pairs + [(b, a) for a, b in pairs]
    wcc = {r.node_key: r.component for r in traverse.components(e, n).collect()}
    assert wcc == {x: min([x, *closure(both, {x}, 99)]) for x in names}
    reach = {x: set(closure(pairs, {x}, 99)) for x in names}
    scc = {r.node_key: r.scc for r in traverse.strong_components(e, n).collect()}
    assert scc == {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in names}


def test_strong_components_of_many_graphs_chains_and_rings(spark, monkeypatch):
    pairs, expected = [], {}
    for seed in range(60):
        n = 3 + seed % 9
        own = [(f"g{seed}:{a}", f"g{seed}:{b}") for a, b in random_pairs(seed, n, n + seed % 7)]
        pairs += own
        names = {x for p in own for x in p}
        reach = {x: set(closure(own, {x}, 99)) for x in names}
        expected |= {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in names}
    chain = [f"chain:{i * 7919 % 10000:05}" for i in range(10000)]
    ring = [f"ring:{i * 389 % 1000:04}" for i in range(1000)]
    tail = [f"tail:{i:03}" for i in range(300)]
    pairs += [*zip(chain, chain[1:]), *zip(ring, ring[1:] + ring[:1]), *zip(tail, tail[1:]), (tail[-1], ring[5]), (ring[9], "leaf")]
    # A hub that many ways lead back to, each of its own length, entered in its midst; what comes before the entry is not in it.
    for i in range(20):
        way = [f"way:{i:02}:{j:02}" for j in range(i + 2)]
        pairs += [*zip(way, way[1:]), (way[-1], "way:hub"), ("way:hub", way[i // 2])]
        expected |= {x: "way:00:00" if j >= i // 2 else x for j, x in enumerate(way)}
    expected |= {x: x for x in [*chain, *tail, "leaf"]} | dict.fromkeys(ring, min(ring)) | {"way:hub": "way:00:00"}
    n, e = graph(spark, pairs, ["alone"])
    written, write = [], traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, name: written.append(name) or write(df, name))
    got = {r.node_key: r.scc for r in traverse.strong_components(e, n).collect()}
    assert got == expected | {"alone": "alone"}
    # Rounds follow the logarithm of the longest way, 10,000 here.
    assert written.count("jump") < 60 and len(written) < 200


def test_components_of_a_long_way_and_a_hub(spark):
    way = [f"w{i * 37 % 400:03}" for i in range(400)]
    pairs = [*zip(way, way[1:]), *(("hub", f"x{i:03}") for i in range(300)), ("x007", "x008"), ("a", "a")]
    n, e = graph(spark, pairs)
    got = {r.node_key: r.component for r in traverse.components(e, n).collect()}
    assert got == dict.fromkeys(way, "w000") | {"hub": "hub", "a": "a"} | {f"x{i:03}": "hub" for i in range(300)}


def test_paths_stop_at_cycles_targets_and_until(spark):
    _, e = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e")])
    start = spark.createDataFrame([("a",)], "node_key string")
    show = lambda df: sorted(">".join(r.path) for r in df.collect())
    assert show(traverse.paths(e, start, "out", 9)) == ["a>b>c", "a>b>d>e"]
    assert show(traverse.paths(e, start, "out", 2)) == ["a>b>c", "a>b>d"]
    assert show(traverse.paths(e, start, "out", 9, target="d")) == ["a>b>d"]
    assert show(traverse.paths(e, start, "out", 9, until=F.col("dst") == "d")) == ["a>b>c", "a>b>d"]


def test_paths_take_any_key_and_any_depth(spark):
    odd = ["table:dst_x", "proc:it's", "n.dst", 'q"\\', "%s {hops}"]
    _, e = graph(spark, list(zip(odd, odd[1:])))
    start = spark.createDataFrame([(odd[0],)], "node_key string")
    assert [r.path for r in traverse.paths(e, start, "out", 9, target=odd[-1]).collect()] == [odd]
    back = spark.createDataFrame([(odd[-1],)], "node_key string")
    assert [r.path for r in traverse.paths(e, back, "in", 9, target=odd[0]).collect()] == [odd[::-1]]
    assert [r.path for r in traverse.trace_rows(e, odd[1], "out", 1).orderBy("depth").collect()] == [odd[1], " > ".join(odd[1:3])]
    assert traverse.inspect(e, [odd[0], odd[2]])[1].filter("n_paths = 1").count() == 1
    m = spark.createDataFrame([("it's", "c'1", "s", "c2", "o")], "target_table string, target_column string, source_table string, source_column string, owner_key string")
    assert [r.path for r in lineage.lineage_columns(m, "it's", "c'1").collect()] == ["it's.c'1 < s.c2"]
    long = [(f"k{i:03}", f"k{i + 1:03}") for i in range(30)]
    _, e = graph(spark, long)
    (row,) = traverse.paths(e, spark.createDataFrame([("k000",)], "node_key string"), "out", 25).collect()
    assert row.n == 25
    got = {r.node_key: r.depth for r in traverse.nearest_paths(e, "k030").collect()}
    assert got == {f"k{i:03}": 30 - i for i in range(30)}


def test_trace_shares_its_budget(spark):
    _, e = graph(spark, [("a", "m"), ("b", "m"), ("m", "x"), ("m", "y"), ("m", "builtin:f"), ("x", "z"), ("z", "m")])
    rows = {(r.direction, r.path): r.more for r in traverse.trace(e, "m", 2, 5).collect()}
    assert rows == {("in", "m"): 0, ("out", "m"): 0, ("in", "m > a"): 0, ("in", "m > b"): 0, ("in", "m > z"): 1, ("out", "m > x"): 1, ("out", "m > y"): 0}
    few = {(r.direction, r.path): r.more for r in traverse.trace(e, "m", 2, 1).collect()}
    assert few == {("in", "m"): 2, ("out", "m"): 2, ("in", "m > a"): 0}


def test_files_are_found_by_their_ends(spark):
    n = spark.createDataFrame([("a", "src/x/f.sql"), ("b", "lib/f.sql"), ("c", "f.sql"), ("d", "src/x/xf.sql")], "node_key string, file string")
    want = spark.createDataFrame([("f.sql",), ("x/f.sql",), ("./lib/f.sql",)], "wanted string")
    assert sorted((r.wanted, r.node_key) for r in traverse.in_files(n, want).collect()) == [("./lib/f.sql", "b"), ("f.sql", "c"), ("x/f.sql", "a")]
    files = traverse.chain_files(n.select("node_key"), n.withColumn("file", F.when(F.col("node_key") < "c", F.lit("one")).otherwise(F.col("file"))))
    assert [(r.file, r.n) for r in files.collect()] == [("one", 2), ("f.sql", 1), ("src/x/xf.sql", 1)]


def test_dedup_rewires(spark):
    nodes = spark.createDataFrame([("table:t", "table:t", False, None), ("table:S.t", "table:t", True, "f"), ("table:s.T", "table:t", True, None), ("proc:p", "proc:p", True, "f")], "node_key string, relaxed_key string, explicit boolean, file string").withColumn("partial", F.lit(False))
    edges = spark.createDataFrame(
        [("proc:p", "table:t", "TableAccess", 1, None), ("proc:p", "table:s.T", "TableAccess", 2, None), ("table:t", "table:S.t", "DependsOn", None, None), ("proc:p", "proc:p", "DirectCall", None, None),
         ("proc:p", "table:t", "AnchorsOn", None, "type|c|variable"), ("proc:p", "table:S.t", "AnchorsOn", None, "type|c|variable"), ("proc:p", "table:t", "AnchorsOn", None, "type|d|variable")],
        "src_key string, dst_key string, edge_type string, modes int, detail string",
    )
    n2, e2, _ = merge.dedup(nodes, edges)
    assert sorted(r.node_key for r in n2.collect()) == ["proc:p", "table:S.t"]
    assert sorted((r.src_key, r.dst_key, r.edge_type, r.modes, r.detail) for r in e2.collect() if r.edge_type != "AnchorsOn") == [("proc:p", "proc:p", "DirectCall", None, None), ("proc:p", "table:S.t", "TableAccess", 3, None)]
    assert e2.filter("edge_type = 'AnchorsOn'").count() == 2


def test_query_documents(spark):
    n, e = graph(spark, [("proc:a", "proc:b"), ("proc:b", "proc:c")])
    got = queryspec.execute(n, e, '{"start": {"name": "proc:a"}, "steps": [{"depth": 1}, {"depth": 5}], "collect": "subgraph"}')
    assert sorted(r.node_key for r in got.collect()) == ["proc:b", "proc:c"]
    paths = queryspec.execute(n, e, '{"start": {"type": "PROC", "name": "c"}, "steps": [{"direction": "incoming"}], "collect": "paths"}')
    assert {r.path for r in paths.collect()} >= {"proc:c > proc:b > proc:a"}
    for bad in ('{"start": {}}', '{"start": {"type": "x"}, "steps": [{"edges": ["no"]}]}', '{"start": {"type": "x"}, "collect": "all"}'):
        with pytest.raises(ValueError):
            queryspec.parse(bad)


def test_conflicts_are_the_matrix(spark):
    rows = [(f"p{i}", "t", m) for i, m in enumerate([1, 2, 4, 8, 16, 32, 64, 128, 3, 36])]
    df = spark.createDataFrame(rows, "proc_key string, table_key string, modes int")
    got = {(r.proc_a, r.proc_b): r.severity for r in conflicts.find_conflicts(df).collect()}
    levels = lambda m: {lv for bit, lv in LEVEL_OF_BIT.items() if m & bit}
    want = {}
    for a, _, x in rows:
        for b, _, y in rows:
            if a < b and any(j in CONFLICTS[i] for i in levels(x) for j in levels(y)):
                want[a, b] = "high" if (x | y) & 8 else "medium"
    assert got == want
    assert all(i in CONFLICTS[j] for i, others in CONFLICTS.items() for j in others)


def test_labels(spark):
    rows = [(1, []), (3, ["update", "insert"]), (8, ["truncate"]), (6, []), (32, ["create_index", "create_index_concurrent"]), (16, ["vacuum"]), (0, [])]
    df = spark.createDataFrame(rows, "m int, k array<string>")
    assert [r.x for r in df.select(acc.access_label(F.col("m"), F.col("k")).alias("x")).collect()] == ["R", "R,W:insert,update", "L8,D:truncate", "W,lock", "L5,D:create_index", "L4", None]


# The blank before a last semicolon stays, as semicolons go after blanks are joined.
NORMAL = {
    "SELECT a1, t12 FROM t -- c\n WHERE x = 12.5 AND b_3 = 'it''s' ;": "SELECT a1,t1? FROM t WHERE x=? AND b_3=? ",
    "select 1 from t where 1=1 and  a >= 2 /* x */": "select ? from t where a>=?",
    "insert into t ( a , b ) values ( 'x', __xml_param_id__ );": "insert into t (a,b) values (?,?)",
    "a '--x' b": "a ?",
}


def test_sql_normal_form(spark):
    df = spark.createDataFrame([(k,) for k in NORMAL], "s string")
    assert {r.s: r.n for r in df.select("s", sqltext.normalize(F.col("s")).alias("n")).collect()} == NORMAL


def test_sql_matching(spark):
    q = "select name from users where id = ?"
    rows = [("SELECT name FROM users WHERE id = 5", True), ("SELECT name FROM orders WHERE id = 5", False), ("UPDATE users SET name = 'x' WHERE id = 5", False), ("select name from users where id = ? and x = 1", True), ("", False)]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string")
    got = [r.m for r in df.select(sqltext.matches(F.col("s"), F.lit(q)).alias("m")).collect()]
    assert got == [m for _, m in rows]
    t = spark.createDataFrame([("update a.b set x=?",), ("delete from t",), ("insert into u(a)values(?)",), ("merge into m using s on ?",), ("select ? from f g where ?",), ("truncate x",)], "s string")
    assert [r.t for r in t.select(sqltext.main_table(F.col("s")).alias("t")).collect()] == ["a.b", "t", "u", "m", "f", None]


def test_name_rank(spark):
    keys = ["proc:pay", "proc:s.pay", "proc:pay_all", "proc:xpayx", "table:repay", "proc:other"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.r for r in df.select(search.name_rank("pay", F.col("k")).alias("r")).collect()] == [0, 0, 1, 2, 2, None]


def test_clusters_of_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0"), ("x0", "x1")]
    n, e = graph(spark, pairs, ["lonely"])
    g = cluster.condensed(e, n.select("node_key", F.col("node_key").alias("unit")))
    units = n.select(F.col("node_key").alias("unit"))
    got = {}
    for r in cluster.cnm(g, units).collect():
        got.setdefault(r.cluster, set()).add(r.unit)
    assert {frozenset(x) for x in got.values()} == {frozenset(f"a{i}" for i in range(4)), frozenset(f"b{i}" for i in range(4)), frozenset({"x0", "x1"}), frozenset({"lonely"})}
    assert cluster.modularity(g, cluster.cnm(g, units)).first()[0] > 0.4
    none = cluster.cnm(g.limit(0), units)
    assert none.select("cluster").distinct().count() == 1
    assert [x["gamma"] for x in cluster.sweep(g, units, (1.0, 0.5))] == [1.0, 0.5]


def test_condensed_edges_to_ends_without_a_node(spark):
    n, e = graph(spark, [("a", "b"), ("b", "a"), ("a", "gone")])
    key = lambda rows: sorted((r.a, r.b, r.weight) for r in rows.collect())
    assert key(cluster.condensed(e)) == [("a", "b", 2.0), ("a", "gone", 1.0)]
    members = n.filter("node_key <> 'gone'").select("node_key", F.col("node_key").alias("unit"))
    assert key(cluster.condensed(e, members)) == [("a", "b", 2.0)]


def test_clusters_of_a_wanted_number_and_of_contracted_components(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "abcd" for i in range(4) for j in range(i)] + [("a0", "b0"), ("b1", "c0"), ("x0", "x1")]
    n, e = graph(spark, pairs)
    g = cluster.condensed(e, n.select("node_key", F.col("node_key").alias("unit")))
    units = n.select(F.col("node_key").alias("unit"))
    for k in (4, 2, 1):
        assert cluster.cnm(g, units, count=k).select("cluster").distinct().count() == k
    whole, parts = cluster.cnm(g, units), cluster.cnm(g, units, most=5)
    torn = parts.join(traverse.components(e, n), F.col("unit") == F.col("node_key")).groupBy("cluster").agg(F.count_distinct("component").alias("k")).filter("k > 1")
    assert torn.isEmpty() and parts.count() == units.count()
    q = [cluster.modularity(g, x).first()[0] for x in (whole, parts)]
    assert q[1] > 0.7 * q[0] > 0.3
    found = cluster.sweep(g, units, (1.0,), (2,))
    assert [x["k"] for x in found] == [5, 2] and cluster.recommended(found)["k"] == 2
    assert cluster.recommended([{"k": 30, "modularity": 1}, {"k": 9, "modularity": 0.2}, {"k": 7, "modularity": 0.3}])["k"] == 7
    assert cluster.recommended([{"k": 30, "modularity": 1}, {"k": 25, "modularity": 0.2}])["k"] == 25


def test_lineage_roles(spark):
    m = spark.createDataFrame([("t", f"c{i}", "s", f"c{i}") for i in range(10)] + [("t", "c0", "r", "c1"), ("t", "c0", "u", "z")], "target_table string, target_column string, source_table string, source_column string")
    ddl = spark.createDataFrame([("s", f"c{i}") for i in range(10)] + [("r", "c1")], "table string, column string")
    assert {r.source_table: r.role for r in lineage.edge_roles(m, ddl).collect()} == {"s": "flow", "r": "reference", "u": "unknown"}


def test_merge_is_idempotent_and_dedup_keeps_the_richer(spark):
    n = spark.createDataFrame([("table:a.t", "table:t", 0, "x"), ("table:t", "table:t", 1, "y"), ("proc:p", "proc:p", 1, "z")], "node_key string, relaxed_key string, store_ord int, payload string")
    once = {(r.node_key, r.payload) for r in merge.merge_nodes(n).collect()}
    assert once == {("table:a.t", "x"), ("proc:p", "z")}
    nodes = spark.createDataFrame([("k", True, False, None), ("k", False, False, "f"), ("k", True, True, "f")], "node_key string, explicit boolean, partial boolean, file string")
    edges = spark.createDataFrame([("k", "k", "TableAccess"), ("k", "j", "DirectCall"), ("k", "j", "DirectCall")], "src_key string, dst_key string, edge_type string")
    n2, e2, report = merge.dedup(nodes, edges)
    assert n2.collect()[0].partial is False and e2.count() == 2 and {r.what: r.n for r in report.collect()}["edges_before"] == 3
    merge.merge_edges(edges.selectExpr("*", "0 AS store_ord", "1 AS modes"), spark.createDataFrame([("k", "k"), ("j", "j")], "node_key string, canonical string")).collect()


def test_listing_filters_on_definitions(spark):
    n, e = graph(spark, [("a", "b"), ("b", "c")])
    n = n.withColumn("sql", F.when(F.col("node_key") == "a", "( id INT ) PARTITION  BY RANGE ( id )").when(F.col("node_key") == "b", "( x INT ) DISTRIBUTE BY HASH ( x )")).withColumn("system", F.col("node_key") == "c")
    keys = lambda **a: [r.node_key for r in listing.list_nodes(n, e, **a).collect()]
    assert keys(partitioned=True) == ["a"] and keys(distributed=True) == ["b"] and keys(system=True) == ["c"] and keys(system=False, known=listing.degrees(n, e)) == ["a", "b"]


def test_tfidf_sets_frequent_tables_aside(spark):
    r = random.Random(6)
    rows = {(f"p{i:02}", f"t{j}") for i in range(30) for j in (*([0] if i % 3 else []), *([1] if i % 2 else []), *(r.randrange(2, 25) for _ in range(5)))}
    procs = sorted({p for p, _ in rows})
    df = {t: sum(u == t for _, u in rows) for _, t in rows}
    v = {p: {t: math.log(len(procs) / df[t]) for q, t in rows if q == p} for p in procs}
    norm = {p: math.sqrt(sum(x * x for x in v[p].values())) for p in procs}
    for tau in (0.1, 0.45):
        want = {}
        for p in procs:
            sims = sorted((-round(sum(x * v[q].get(t, 0) for t, x in v[p].items()) / norm[p] / norm[q], 9), q) for q in procs if q != p)
            want |= {tuple(sorted((p, q))): -s for s, q in [x for x in sims if -x[0] >= tau][:4]}
        got = {(x.proc_a, x.proc_b): x.sim for x in cluster.tfidf(spark.createDataFrame(list(rows), "proc_key string, table_key string"), tau, 4).collect()}
        assert got == pytest.approx(want, abs=1e-8) and got


def test_sort_specs():
    assert len(listing.parse_sort("name:asc,total:desc")) == 3
    with pytest.raises(ValueError):
        listing.parse_sort("colour")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef"), st.floats(0.1, 3)), min_size=1, max_size=14))
def test_agglomeration_never_lowers_modularity(rows):
    sums = {}
    for a, b, w in rows:
        sums[min(a, b), max(a, b)] = sums.get((min(a, b), max(a, b)), 0) + w
    edges = [(a, b, w) for (a, b), w in sums.items()]
    units = sorted({x for a, b, _ in edges for x in (a, b)})
    total = sum(w if a == b else 2 * w for a, b, w in edges)

    def q(root):
        inside, degree = {}, {}
        for a, b, w in edges:
            degree[root[a]] = degree.get(root[a], 0) + w
            if a != b:
                degree[root[b]] = degree.get(root[b], 0) + w
            if root[a] == root[b]:
                inside[root[a]] = inside.get(root[a], 0) + (w if a == b else 2 * w)
        return sum(inside.values()) / total - sum(d * d for d in degree.values()) / total**2

    root, last = {u: u for u in units}, None
    last = q(root)
    for kept, merged, gain in cluster._agglomerate(units, edges, total, 1.0, 1e-9):
        root = {u: kept if r == merged else r for u, r in root.items()}
        now = q(root)
        assert now == pytest.approx(last + gain, abs=1e-6) and now > last
        last = now


def test_partition_keeps_a_cycle_together(spark):
    cliques = [[f"{c}{i}" for i in range(5)] for c in "xyz"]
    n, e = graph(spark, [(a, b) for c in cliques for i, a in enumerate(c) for b in c[i + 1 :]] + [("x4", "y0"), ("y4", "x0"), ("x0", "z0")])
    alone = n.select("node_key", F.col("node_key").alias("unit"))
    apart = {r.unit: r.cluster for r in cluster.cnm(cluster.condensed(e, alone), alone.select("unit")).collect()}
    assert apart["x4"] != apart["y0"]
    got = {r.unit: r.cluster for r in cluster.partition(n, e).collect()}
    assert sorted(got) == sorted(x for c in cliques for x in c)
    assert len({got[x] for c in cliques[:2] for x in c}) == 1


def test_hops_of_statements_that_all_name_their_reads(spark):
    rows = [("r", "a", 2, ["b", "x"]), ("r", "b", 3, ["a"]), ("r", "a", 1, []), ("s", "c", 2, ["b"]), ("s", "b", 1, [])]
    named = spark.createDataFrame(rows, "routine string, table string, modes int, read_tables array<string>")
    some = named.withColumn("read_tables", F.coalesce("read_tables", F.array().cast("array<string>")))
    key = lambda df: sorted((r.parent, r.routine, r.child) for r in df.collect())
    hops = lineage.table_hops(some)
    assert key(hops) == key(lineage.table_hops(named)) == [("a", "r", "b"), ("b", "r", "a"), ("c", "s", "b")]
    # Without nulls nothing is looked for twice.
    assert "Union" not in hops._jdf.queryExecution().optimizedPlan().toString()
    assert [r.table for r in lineage.external_sources(hops.filter("parent <> 'b'")).collect()] == ["b"]
    assert [(r.parent, r.routines, r.n) for r in lineage.relations(hops).orderBy("parent").collect()] == [("a", ["r"], 1), ("b", ["r"], 1), ("c", ["s"], 1)]


def test_components_are_found_once_for_clusters_that_need_no_contraction(spark, monkeypatch):
    from codeloom.operators import cluster
    from codeloom.plans import queries

    graph, units, _ = queries._units(spark, "/root/testdata/sf0.001", kept=True)
    assert graph.inputFiles() and all("/condensed-" in f for f in graph.inputFiles())  # written, and not made anew by each use
    calls, made = [], cluster.components
    monkeypatch.setattr(cluster, "components", lambda *a: calls.append(1) or made(*a))
    found = {tuple(r) for r in cluster.cnm(graph, units).collect()}
    assert len(calls) == 1 and len(found) == units.count()
    # Contraction changes the components' graph, so they are found anew.
    cluster.cnm(graph, units, most=3).collect()
    assert len(calls) > 2


def test_impact_finds_the_pairs_of_nodes_once(spark, monkeypatch):
    from codeloom.operators import traverse

    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e")], "src_key string, dst_key string")
    nodes = spark.createDataFrame([(k, "f") for k in "abcde"], "node_key string, file string")
    names, write = [], traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, name: names.append(name) or write(df, name))
    got = {(r.direction, r.node_key, r.depth) for r in traverse.impact(edges, nodes, spark.createDataFrame([("a",)], "node_key string"), 2).collect()}
    assert got == {("out", "b", 1), ("out", "c", 2), ("in", "c", 1), ("in", "d", 1), ("in", "b", 2)}
    assert names.count("pairs") == 1 and "hops" not in names


def test_sql_search_makes_the_forms_once_and_texts_are_dealt(spark, monkeypatch):
    from codeloom.operators import search
    from codeloom.plans import queries

    assert queries._texts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    s = spark.createDataFrame([("m:1", "SELECT a FROM t WHERE x = 1 FOR UPDATE", True), ("m:2", "SELECT a FROM t WHERE x = 2", True), ("m:3", "DELETE FROM u FOR UPDATE", False)], "node_key string, sql_text string, indexed boolean")
    names, write = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: names.append(name) or write(df, name))
    for query, want in (("for update", {("m:1", 0.9)}), ("select a from t where x = 9", {("m:2", 1.0)}), ("delete from u", {("m:3", 0.95)})):
        names.clear()
        assert {(r.node_key, r.score) for r in search.search_sql(s, query).collect()} == want and names == ["forms"]
        assert {(r.node_key, r.score) for r in search.search_sql(write(search.index(s), "statements"), query).collect()} == want


def test_declared_types_are_broadcast_to_the_nodes(spark, capsys):
    from codeloom.sources import interchange

    nodes = spark.createDataFrame([("d", "1", "report", {"name": "x"}), ("d", "2", "report", {}), ("d", "3", "odd", {})], "doc string, id string, type string, key map<string,string>")
    edges = spark.createDataFrame([("d", "1", "2", "feeds"), ("d", "1", "9", "wrong")], "doc string, source string, target string, type string")
    custom = spark.createDataFrame([("d", "node", "report", ["name"]), ("d", "edge", "feeds", None)], "doc string, what string, type string, key_fields array<string>")
    found = interchange.validate(nodes, edges, custom)
    assert {(r.rule, r.subject) for r in found.collect()} == {("missing-key-field", "2"), ("undeclared-node-type", "odd"), ("undeclared-edge-type", "wrong"), ("dangling-end", "9")}
    found.explain("formatted")
    assert capsys.readouterr().out.count("BroadcastHashJoin") >= 3


def test_tasks_follow_the_size_of_the_input(spark, monkeypatch, tmp_path):
    from codeloom import work
    from codeloom.plans import fixture

    sf = "/root/testdata/sf0.001"
    least = spark.sparkContext.defaultParallelism
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in (tmp_path / "t").iterdir())
    assert work.tasks_for(spark, f"{tmp_path}/t") == least and work.tasks_for(spark, f"{tmp_path}/t", 100) in range(size // 200, size // 100 + 2)
    want = {tuple(r) for r in fixture.views(spark, sf)["g_access"].collect()}
    monkeypatch.setattr(fixture, "tasks_for", lambda spark, path: least + 3)
    access = fixture.views(spark, sf)["g_access"]
    assert access.rdd.getNumPartitions() == least + 3 and {tuple(r) for r in access.collect()} == want


def test_file_deps_are_dealt_to_the_given_tasks(spark, capsys):
    n = spark.createDataFrame([(k, f) for k, f in zip("abcd", ["f", "g", "f", None])], "node_key string, file string")
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "a"), ("a", "c"), ("b", "d"), ("d", "a")], "src_key string, dst_key string")
    want = {("g", "f"), ("f", "g")}
    assert {tuple(r) for r in listing.reverse_file_deps(n, e).collect()} == want
    dealt = listing.reverse_file_deps(n, e, 37)
    assert {tuple(r) for r in dealt.collect()} == want
    dealt.explain()
    assert ", 37)" in capsys.readouterr().out


def test_tfidf_sends_lists_and_no_pairs(spark, monkeypatch):
    # Blocks of few routines, and tables set aside from two routines on: the same as one block and nothing aside.
    r = random.Random(9)
    rows = sorted({(f"p{i}", f"t{j}") for i in range(60) for j in (0, *([1] if i % 9 else []), *([2] if i % 4 else []), *(r.randrange(3, 40) for _ in range(6)))})
    df = spark.createDataFrame(rows, "proc_key string, table_key string")
    found = lambda **a: {(x.proc_a, x.proc_b): round(x.sim, 8) for x in cluster.tfidf(df, **a).collect()}
    for tau in (0.1, 0.4):
        whole = found(tau=tau, hot=1000)
        monkeypatch.setattr(cluster, "PAIRS_PER_TASK", 150)
        assert found(tau=tau, hot=2) == whole and len(whole) > 60
        monkeypatch.undo()
    shuffled = []
    monkeypatch.setattr(cluster, "materialize", lambda x, name: shuffled.append((name, x._jdf.queryExecution().executedPlan().toString())) or materialize(x, name))
    cluster.tfidf(df)
    # Between the lists and the sums of pairs rows are of a block and a table.
    plan = dict(shuffled)["met"]
    assert "hashpartitioning(block#" in plan and not re.search(r"hashpartitioning\([^)]*\bb#", plan)
