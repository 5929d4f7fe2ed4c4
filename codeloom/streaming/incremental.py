"""A stream of source files: each new or changed file is parsed once, and its rows replace those it had before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.merge import change_set
from codeloom.sources.ingest import KINDS, RAW, parse, scan
from codeloom.work import exists, materialize

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str) -> DataFrame:
    """Streaming rows path, kind, content, hash of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{sql,java,xml,jsp}").load(root)
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.regexp_extract("path", r"(\.\w+)$", 1))
    base = root.rstrip("/").split("://")[-1] + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), kind.alias("kind"), "content", F.sha2("content", 256).alias("hash"))


def start(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the parsed rows of each batch to out with their batch number; a batch that is run again replaces its folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        parse(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return watch(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(spark: SparkSession, root: str, out: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, change of all files against the last refresh; only added and modified ones are parsed.

    A stream does not list a changed or deleted file again, so this compares the folder with what out knows of it. Deleted
    files are written as gone, and current() leaves them out from then on.
    """
    new = materialize(scan(spark, root, exclude), "scanned")
    old = _known(spark, out)
    changes = materialize(change_set(old.filter("NOT gone").select("path", "mtime", "hash"), new.select("path", "mtime", "hash")), "changes")
    epoch = (old.agg(F.max("epoch")).first()[0] or 0) + 1
    fresh = new.join(changes.filter("change IN ('added', 'modified')").select("path"), "path", "left_semi")
    parse(fresh).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
    seen = fresh.select("path", "mtime", "hash", F.lit(False).alias("gone"))
    gone = changes.filter("change = 'deleted'").select("path", F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("string").alias("hash"), F.lit(True).alias("gone"))
    # The list of files comes last: a refresh that fails before it is done again.
    seen.unionByName(gone).write.mode("overwrite").parquet(f"{out}/files/epoch={epoch}")
    return changes


def _known(spark: SparkSession, out: str) -> DataFrame:
    """path, mtime, hash, gone, epoch of each file's last change."""
    schema = "path string, mtime long, hash string, gone boolean, epoch long"
    if not exists(spark, f"{out}/files"):
        return spark.createDataFrame([], schema)
    every = spark.read.schema(schema).option("basePath", f"{out}/files").parquet(f"{out}/files")
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("epoch")))
    return every.withColumn("_r", last).filter("_r = 1").drop("_r")


def refreshed(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all files that are there, as the last refresh left them."""
    rows = spark.read.schema(f"{RAW}, epoch long").option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    now = _known(spark, out).filter("NOT gone").select(F.col("path").alias("file"), "epoch")
    return rows.join(now, ["file", "epoch"], "left_semi").drop("epoch")


def current(spark: SparkSession, out: str, files: DataFrame | None = None) -> DataFrame:
    """The rows of each file's last batch; with files (path), those of files that are still there."""
    rows = spark.read.schema(f"{RAW}, epoch long").option("basePath", out).parquet(out)
    last = rows.groupBy("file").agg(F.max("epoch").alias("epoch"))
    if files is not None:
        last = last.join(files.select(F.col("path").alias("file")), "file", "left_semi")
    return rows.join(last, ["file", "epoch"], "left_semi").drop("epoch")


