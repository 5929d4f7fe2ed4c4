"""The work folder that driver and executors share, materialised tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A small side is broadcast up to this many rows and bytes; beyond either the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

#: Keys that hold more than this part of all rows are met by a broadcast: by count there cannot be more than so many of them.
MOST_HOT = 10_000

#: Bytes of compressed files whose rows go to one task, where rows are dealt by the size of what they come from.
TASK_BYTES = 8 << 20

_made: set[str] = set()


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path and the path, by Hadoop's own interface, so any file system of Spark will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def work_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which goes when the application ends.

    Where that is unset: below a temporary folder of a local session, or below a folder of the warehouse.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        else:
            root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/codeloom-{spark.sparkContext.applicationId}"
    if own not in _made:
        fs, p = _hadoop(spark, own)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _made.add(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet to the work folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, path: str, size: int = TASK_BYTES) -> int:
    """How many tasks to deal the rows of a path's files to, so that those of one task stay as few however large the files are."""
    fs, p = _hadoop(spark, path)
    return max(spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(p).getLength() // size))


def release(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing will read again; other tables are left alone."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/codeloom-{spark.sparkContext.applicationId}/" in folder:
            fs, p = _hadoop(spark, folder)
            fs.delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has no more than the given numbers of rows and bytes, else df as it is."""
    width = F.lit(16 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType, T.NullType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def all_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) with u > v are stars around their smallest nodes: no u has two edges or is a v as well."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    odd = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.count(F.lit(1)).alias("edges")).filter("ups > 0 AND edges > 1")
    return odd.isEmpty()


def meet(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, spread: Column, name: str, how: str = "left") -> DataFrame:
    """rows with the row of `keyed` that has their values of `on`, as a struct of its other columns called `name`.

    `keyed` is a written table with unique keys without nulls; its column n tells how many rows have the key. Keys with more than a
    MOST_HOT-th of all those rows come by broadcast, the rest by a shuffled join in which no key is hot. Rows that met a hot
    key are dealt by `spread` there. how: left, or inner.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    bound = max(64, total // MOST_HOT)
    kept = F.struct(*[c for c in keyed.columns if c not in on])
    named = lambda side, tag: side.select(*(F.col(c).alias(f"_{tag}{i}") for i, c in enumerate(on)), kept.alias(f"_{tag}"))
    hot, light = named(keyed.filter(F.col(n) > bound), "h"), named(keyed.filter(F.col(n) <= bound), "l").withColumn("_z", F.lit(0).cast("long"))
    same = lambda tag: [F.col(c) == F.col(f"_{tag}{i}") for i, c in enumerate(on)]
    met = rows.join(F.broadcast(hot), same("h"), "left")
    met = met.withColumn("_s", F.when(F.col("_h").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30))))
    met = met.join(light, [*same("l"), F.col("_s") == F.col("_z")], "left").withColumn(name, F.coalesce("_h", "_l"))
    met = met.select(*rows.columns, name)
    return met if how == "left" else met.filter(F.col(name).isNotNull())
