"""Saving and loading a graph: Parquet or JSON folders and a version that must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.model import STORE_VERSION

PARTS = ("nodes", "edges", "column_mappings")


def save(path: str, nodes: DataFrame, edges: DataFrame, column_mappings: DataFrame, manifest: DataFrame | None = None, form: str = "parquet") -> None:
    """Edges are laid out by category and nodes by tag, so that filters on them read only their folders. The version comes last."""
    spark = nodes.sparkSession
    writer = lambda df: df.write.mode("overwrite").format(form)
    writer(nodes.withColumn("tag", F.regexp_replace("type_tag", r"\*", ""))).partitionBy("tag").save(f"{path}/nodes")
    writer(edges).partitionBy("category").save(f"{path}/edges")
    writer(column_mappings).save(f"{path}/column_mappings")
    if manifest is not None:
        writer(manifest).save(f"{path}/manifest")
    spark.createDataFrame([(STORE_VERSION, form)], "version int, form string").coalesce(1).write.mode("overwrite").json(f"{path}/_meta")


def load(spark: SparkSession, path: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    meta = spark.read.schema("version int, form string").json(f"{path}/_meta").first()
    if meta is None or meta.version != STORE_VERSION:
        raise ValueError(f"store version {meta.version if meta else None}, but {STORE_VERSION} is needed: analyse again")
    reader = lambda part: spark.read.format(meta.form).schema(schemas[part]) if schemas and part in schemas else spark.read.format(meta.form)
    out = {part: reader(part).load(f"{path}/{part}") for part in PARTS}
    return out | {"nodes": out["nodes"].drop("tag")}


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest alone; the graph is not read."""
    return spark.read.parquet(f"{path}/manifest")
