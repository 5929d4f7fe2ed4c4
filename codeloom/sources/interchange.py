"""Graph interchange documents (JSON, format version 1): validation and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.model import CATEGORY
from codeloom.sources.ingest import category
from codeloom.work import materialize, small

SCHEMA = """format_version INT, metadata STRUCT<source: STRING, generated_at: STRING, description: STRING>,
node_schemas MAP<STRING, STRUCT<display_name: STRING, key_fields: ARRAY<STRING>>>, edge_schemas MAP<STRING, STRUCT<display_name: STRING, source_types: ARRAY<STRING>, target_types: ARRAY<STRING>>>,
nodes ARRAY<STRUCT<id: STRING, type: STRING, key: MAP<STRING, STRING>, location: STRUCT<file: STRING, line: INT>, properties: MAP<STRING, STRING>>>,
edges ARRAY<STRUCT<source: STRING, target: STRING, type: STRING, location: STRUCT<file: STRING, line: INT>, properties: MAP<STRING, STRING>>>"""
#: Node types that need no declaration, with the tag of their keys.
BUILT_IN = {"procedure": "proc", "function": "func", "table": "table", "view": "view", "package": "pkg", "trigger": "trigger", "sequence": "seq", "type": "type", "mapper": "mapper", "java_method": "method", "java_class": "class"}


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents with their names: one a file, or one a line."""
    docs = spark.read.schema(SCHEMA).json(path, multiLine=not lines)
    name = F.input_file_name()
    return docs.withColumn("doc", F.concat_ws("#", name, F.monotonically_increasing_id().cast("string")) if lines else name)


def tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (id, type, key, location, properties), edges and declared custom types, each with its document."""
    nodes = docs.select("doc", F.explode("nodes").alias("x")).select("doc", "x.*")
    edges = docs.select("doc", F.explode("edges").alias("x")).select("doc", "x.*")
    custom = docs.select("doc", F.explode_outer("node_schemas").alias("type", "schema")).filter("type is not null").select("doc", F.lit("node").alias("what"), "type", "schema.key_fields")
    custom = custom.unionByName(docs.select("doc", F.explode_outer("edge_schemas").alias("type", "schema")).filter("type is not null").select("doc", F.lit("edge").alias("what"), "type", F.lit(None).cast("array<string>").alias("key_fields")))
    return nodes, edges, custom


def validate(nodes: DataFrame, edges: DataFrame, custom: DataFrame) -> DataFrame:
    """doc, level, rule, subject: duplicate ids, dangling ends, undeclared types, missing key fields. Rows are never fatal."""
    say = lambda df, rule, subject: df.select("doc", F.lit("error").alias("level"), F.lit(rule).alias("rule"), subject.alias("subject"))
    twice = say(nodes.groupBy("doc", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate-id", F.col("id"))
    ends = edges.select("doc", F.explode(F.array("source", "target")).alias("id")).distinct()
    dangling = say(ends.join(nodes.select("doc", "id").distinct(), ["doc", "id"], "left_anti"), "dangling-end", F.col("id"))
    # Many nodes share a type and few types are declared, so these are broadcast; by a shuffle a type would be one task's.
    custom = materialize(custom, "declared")
    declared = small(custom.filter("what = 'node'").select("doc", "type", "key_fields"))
    declared_edges = small(custom.filter("what = 'edge'").select("doc", "type"))
    open_nodes = say(nodes.filter(~F.col("type").isin(*BUILT_IN)).join(declared, ["doc", "type"], "left_anti").select("doc", "type").distinct(), "undeclared-node-type", F.col("type"))
    open_edges = say(edges.filter(~F.col("type").isin(*CATEGORY)).join(declared_edges, ["doc", "type"], "left_anti").select("doc", "type").distinct(), "undeclared-edge-type", F.col("type"))
    missing = nodes.join(declared, ["doc", "type"]).filter(~F.forall("key_fields", lambda k: F.coalesce(F.map_contains_key("key", k), F.lit(False))))
    return twice.unionByName(dangling).unionByName(open_nodes).unionByName(open_edges).unionByName(say(missing, "missing-key-field", F.col("id")))


def validate_documents(docs: DataFrame) -> DataFrame:
    head = docs.filter("format_version IS NULL OR format_version <> 1").select("doc", F.lit("error").alias("level"), F.lit("format-version").alias("rule"), F.col("format_version").cast("string").alias("subject"))
    empty = docs.filter("coalesce(size(nodes), 0) = 0").select("doc", F.lit("warning").alias("level"), F.lit("empty-document").alias("rule"), F.lit(None).cast("string").alias("subject"))
    return head.unionByName(empty).unionByName(validate(*tables(docs)))


def map_path(path: Column, prefix: str = "") -> Column:
    p = F.regexp_replace(path, r"^(?:\./)+", "")
    return F.when(p.startswith("/") | F.lit(not prefix), p).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), p))


def import_graph(docs: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """nodes and edges by content keys. Edges with an unknown end are left out; validation names them."""
    nodes, edges, _ = tables(docs)
    tag = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in BUILT_IN.items() for x in kv)), F.col("type")), F.concat(F.lit("custom:"), "type"))
    part = lambda name: F.try_element_at("key", F.lit(name))
    name = F.coalesce(F.concat_ws(".", part("schema"), part("package"), part("name")), F.lit(""))
    name = F.when(name == "", F.array_join(F.array_sort(F.map_values("key")), ".")).otherwise(F.lower(name))
    keyed = nodes.withColumn("node_key", F.concat(tag, F.lit(":"), name))
    first = keyed.groupBy("node_key").agg(F.min(F.struct("type", "location", "id")).alias("x")).select("node_key", tag_of(F.col("node_key")).alias("type_tag"), map_path(F.col("x.location.file"), prefix).alias("file"), F.col("x.location.line").alias("line"))
    ids = keyed.select("doc", "id", "node_key").distinct()
    s, d = ids.select("doc", F.col("id").alias("source"), F.col("node_key").alias("src_key")), ids.select("doc", F.col("id").alias("target"), F.col("node_key").alias("dst_key"))
    e = edges.join(s, ["doc", "source"]).join(d, ["doc", "target"])
    kind = F.when(F.col("type").isin(*CATEGORY), F.col("type")).otherwise("CustomEdge")
    return first, e.select("src_key", "dst_key", kind.alias("edge_type"), category(kind).alias("category"), "properties").dropDuplicates(["src_key", "dst_key", "edge_type"])


def tag_of(key: Column) -> Column:
    return F.when(key.startswith("custom:"), F.regexp_extract(key, "^(custom:[^:]*)", 1)).otherwise(F.substring_index(key, ":", 1))
