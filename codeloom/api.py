"""The library facade and command line: a project folder with sources, a configuration and a saved graph."""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import cluster, columns, conflicts, lineage, listing, merge, search, traverse
from codeloom.plans import queryspec
from codeloom.sources import export, ingest, render, store
from codeloom.work import materialize


@dataclass
class Config:
    """codeloom.toml: source paths, excludes, lineage thresholds and columns to ignore, and discriminator columns."""

    sources: list[str] = field(default_factory=lambda: ["."])
    exclude: list[str] = field(default_factory=list)
    discriminators: list[str] = field(default_factory=list)
    least_columns: int = lineage.LEAST_COLUMNS
    least_share: float = lineage.LEAST_SHARE
    ignore_columns: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, path: str | Path) -> Config:
        known = {f for f in cls.__dataclass_fields__}
        return cls(**{k: v for k, v in tomllib.loads(Path(path).read_text()).items() if k in known})


class Project:
    """Sources under root and the graph saved at path (default: root/.codeloom)."""

    def __init__(self, spark: SparkSession, root: str, path: str | None = None, config: Config | None = None):
        self.spark, self.root, self.path, self.config = spark, root.rstrip("/"), path or f"{root.rstrip('/')}/.codeloom", config or Config()
        self._store: dict[str, DataFrame] | None = None

    def files(self) -> DataFrame:
        return ingest.scan(self.spark, self.root, tuple(self.config.exclude))

    def diff(self) -> DataFrame:
        """path, change against the manifest of the saved graph; only the manifest is read."""
        return merge.change_set(store.load_manifest(self.spark, self.path), self.files().select("path", "mtime", "hash"))

    def analyze(self) -> dict[str, DataFrame]:
        files = self.files()
        rows = materialize(ingest.parse(files), "parsed")
        nodes, edges, mappings = ingest.build(rows)
        store.save(self.path, nodes, edges, mappings, files.select("path", "mtime", "hash"))
        rows.write.mode("overwrite").parquet(f"{self.path}/rows")
        # Made once and stored beside the graph: degrees for listings, fingerprints for searches by text.
        listing.degrees(nodes, edges).write.mode("overwrite").parquet(f"{self.path}/degrees")
        search.index(ingest.statements(rows, nodes)).write.mode("overwrite").parquet(f"{self.path}/statements")
        self._store = None
        return self.graph()

    def graph(self) -> dict[str, DataFrame]:
        self._store = self._store or store.load(self.spark, self.path)
        return self._store

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ingest.RAW).parquet(f"{self.path}/rows")

    def degrees(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/degrees")

    def statements(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/statements")

    def hops(self) -> DataFrame:
        """Table hops of routines, by statement, and of views."""
        e = self.graph()["edges"]
        access = e.filter("edge_type = 'TableAccess'").select(F.col("src_key").alias("routine"), F.col("dst_key").alias("table"), "modes", "read_tables")
        return lineage.table_hops(access, e.filter("edge_type = 'DependsOn'").select(F.col("src_key").alias("view"), F.col("dst_key").alias("table")))

    def roles(self) -> DataFrame:
        """Roles of the sources of each table, by the thresholds of the configuration."""
        tables = columns.table_schemas(self.rows()).select(F.substring_index("table_key", ":", -1).alias("table"), F.explode("columns").alias("c")).select("table", F.col("c.name").alias("column"))
        c = self.config
        return lineage.edge_roles(self.graph()["column_mappings"].filter("source_table IS NOT NULL"), tables, c.least_columns, c.least_share, tuple(x.lower() for x in c.ignore_columns))

    def targets(self, name: str) -> DataFrame:
        """node_key of what a name means: the nodes of a file that it names or ends, else the one node of that name."""
        found = traverse.in_files(self.graph()["nodes"], self.spark.createDataFrame([(name,)], "wanted string")).select("node_key")
        return self.start(name) if found.isEmpty() else found

    def resolve(self, name: str, mode: str = "contains") -> str:
        """The one node of a name; several or none are an error that names the first few."""
        g = self.graph()
        hits = search.search_names(g["nodes"], self.degrees(), name, mode, 5).collect()
        best = [h for h in hits if h["rank"] == hits[0]["rank"]]
        if len(best) != 1:
            raise LookupError(f"{name!r} is {'ambiguous: ' + ', '.join(h.node_key for h in best) if best else 'unknown'}")
        return best[0].node_key

    def start(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(self.resolve(name),)], "node_key string")

    def run(self, command: str, **a) -> DataFrame:
        """The result of a command by its name on the command line."""
        g = self.graph()
        n, e, m = g["nodes"], g["edges"], g["column_mappings"]
        access = lambda: e.filter("edge_type = 'TableAccess'").select(F.col("src_key").alias("proc_key"), F.col("dst_key").alias("table_key"), "modes")
        name = a.get("name")
        if command == "stats":
            return listing.store_stats(n, e)
        if command == "files":
            return listing.file_counts(n)
        if command == "nodes":
            return listing.list_nodes(n, e, name, sort=a.get("sort") or "name", limit=a.get("limit") or 100, known=self.degrees())
        if command == "trace":
            return traverse.trace(e.filter("category = 'call'"), self.resolve(name), a.get("depth") or 5, a.get("limit") or 200)
        if command == "detail":
            # The node itself, then its callers and callees to a depth; indexes are left out of the tree.
            tree = traverse.trace(e.filter("edge_type <> 'IndexesTable'"), self.resolve(name), a.get("depth") or 1, a.get("limit") or 200)
            return tree.join(n.select("node_key", "type_tag", "file", "line"), "node_key", "left")
        if command == "chain-files":
            tree = traverse.trace(e.filter("category = 'call'"), self.resolve(name), a.get("depth") or 5, a.get("limit") or 200)
            return traverse.chain_files(tree, n)
        if command == "impact":
            return traverse.impact(e, n, self.targets(name), a.get("depth") or 1).orderBy("file", "node_key", "direction")
        if command == "inspect":
            return traverse.inspect(e, [self.resolve(x) for x in name.split(",")], a.get("depth") or 6)[0]
        if command == "conflicts":
            return conflicts.ordered(conflicts.find_conflicts(access(), a.get("severity") or "high", name))
        if command == "lineage":
            if name and "." in name and not name.startswith("table:") and n.filter(F.col("node_key") == f"table:{name}").isEmpty():
                table, _, column = name.rpartition(".")
                return lineage.lineage_columns(m, table, column, a.get("direction") or "up", a.get("depth") or 5)
            return lineage.lineage_tables(self.hops(), self.resolve(name), a.get("direction") or "up", a.get("depth") or 3)
        if command == "sources":
            bare = lambda c: F.substring_index(c, ":", -1).alias(c)
            out = lineage.children(self.hops().select(bare("parent"), "routine", bare("child")), self.roles())
            return out.filter(F.col("parent") == name) if name else out
        if command == "relations":
            return lineage.relations(self.hops())
        if command == "columns":
            out = columns.seed_hints(self.rows(), e, self.config.discriminators)
            return out.filter(F.col("owner_key") == self.resolve(name)) if name else out
        if command == "predicates":
            out = columns.predicates(self.rows())
            return out.filter(F.col("owner_key") == self.resolve(name)) if name else out
        if command == "trace-sql":
            return search.ordered(search.trace_sql(search.search_sql(self.statements(), name), e))
        if command == "query":
            return queryspec.execute(n, e, name)
        if command == "partition":
            return cluster.partition(n, e, count=a.get("limit"))
        if command == "sweep":
            graph, members = cluster.condensed_units(n, e)
            found = cluster.sweep(graph, members.select("unit").distinct(), counts=cluster.COUNTS)
            best = cluster.recommended(found)
            return self.spark.createDataFrame([(x["gamma"], x["wanted"], x["k"], float(x["largest"]), float(x["modularity"]), x is best) for x in found], "gamma double, wanted int, k long, largest double, modularity double, recommended boolean")
        if command == "cycles":
            return traverse.cycles(e.filter("category = 'call'"), n)
        if command == "dedup":
            return merge.dedup(n, e)[2]
        if command == "diff":
            return self.diff()
        raise ValueError(f"no such command: {command}")

    def export(self, form: str, path: str, search_text: str | None = None) -> None:
        n, e = self.graph()["nodes"], self.graph()["edges"]
        if search_text:
            n, e = export.filtered(n, e, search_text)
        export.write_lines({"dot": export.dot, "mermaid": export.mermaid, "ndjson": export.ndjson, "json": render.document}[form](n, e), path)


#: Rows that the command line prints.
SHOWN = 10_000
COMMANDS = ("analyze", "diff", "stats", "files", "nodes", "trace", "detail", "chain-files", "impact", "inspect", "conflicts", "lineage", "sources", "relations", "columns", "predicates", "trace-sql", "query", "partition", "sweep", "cycles", "dedup", "export")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("root")
    p.add_argument("name", nargs="?")
    for flag in ("--depth", "--limit"):
        p.add_argument(flag, type=int)
    for flag in ("--sort", "--severity", "--direction", "--format", "--out", "--config"):
        p.add_argument(flag)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("codeloom").getOrCreate()
    project = Project(spark, a.root, config=Config.read(a.config) if a.config else None)
    if a.command == "analyze":
        project.analyze()
        out = project.run("stats")
    elif a.command == "export":
        project.export(a.format or "ndjson", a.out, a.name)
        return 0
    else:
        out = project.run(a.command, name=a.name, depth=a.depth, limit=a.limit, sort=a.sort, severity=a.severity, direction=a.direction)
    shown = 0
    for line in out.limit(SHOWN + 1).toJSON().toLocalIterator():
        if shown == SHOWN:
            print(f"more than {SHOWN} rows; export or Project.run gives all of them", file=sys.stderr)
            break
        print(json.dumps(json.loads(line), ensure_ascii=False))
        shown += 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
