"""Lock conflicts between routines that access the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.access import locks_conflict, severity
from codeloom.work import materialize, small

#: Routines of one table and mode that are held against one another in one block.
BLOCK_ROWS = 2_000


def modes_in_conflict(access: DataFrame, least: str = "medium", table: str | None = None) -> DataFrame:
    """table_key, modes_a, modes_b, severity, pairs: combinations of modes that exclude each other, and how many pairs they are.

    A combination stands once in each direction; pairs counts unordered pairs of different routines, split over both. At most
    255 by 255 rows a table, whatever the number of routines: the size of find_conflicts can be read from it beforehand.
    """
    return _combinations(access, least, table).select("table_key", "modes_a", "modes_b", "severity", "pairs")


def _combinations(access: DataFrame, least: str, table: str | None) -> DataFrame:
    """What modes_in_conflict has, and nb, the rows of the second side."""
    kinds = access.groupBy("table_key", "modes").agg(F.count(F.lit(1)).alias("n"))
    if table is not None:
        kinds = kinds.filter(F.col("table_key") == table)
    x = kinds.select("table_key", F.col("modes").alias("modes_a"), F.col("n").alias("na"))
    y = kinds.select("table_key", F.col("modes").alias("modes_b"), F.col("n").alias("nb"))
    hit = x.join(y, "table_key").filter(locks_conflict(F.col("modes_a"), F.col("modes_b")))
    hit = hit.withColumn("severity", severity(F.col("modes_a"), F.col("modes_b")))
    if least == "high":
        hit = hit.filter("severity = 'high'")
    pairs = F.when(F.col("modes_a") == F.col("modes_b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb") / 2)
    return hit.select("table_key", "modes_a", "modes_b", "severity", pairs.alias("pairs"), "nb")


def find_conflicts(access: DataFrame, least: str = "medium", table: str | None = None) -> DataFrame:
    """table_key, proc_a, proc_b, modes_a, modes_b, severity for every unordered pair whose locks exclude each other.

    access: proc_key, table_key, modes, one row a pair. Rows are first reduced to combinations of modes that do exclude each
    other, and only those are expanded to routines again. Pairs are the output, so a table with many routines in conflict has
    many; its rows are dealt to blocks of about BLOCK_ROWS routines, so that one table is no single key. Tables of fewer
    routines have one block and no row of theirs is copied.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("nb") / BLOCK_ROWS)).cast("int")
    hit = materialize(_combinations(access, least, table).select("table_key", "modes_a", "modes_b", "severity", blocks.alias("blocks")), "conflict-modes")
    sizes = materialize(hit.select("table_key", "modes_b", "blocks").distinct(), "conflict-sizes")
    wide = access.select("table_key", F.col("modes").alias("modes_a"), F.col("proc_key").alias("proc_a"))
    # Each routine's rows meet the combinations first (few), then the other side in blocks of routines.
    other = access.select("table_key", F.col("modes").alias("modes_b"), F.col("proc_key").alias("proc_b")).join(small(sizes), ["table_key", "modes_b"])
    other = other.withColumn("block", F.pmod(F.xxhash64("proc_b"), F.col("blocks")).cast("int")).drop("blocks")
    one = wide.join(small(hit), ["table_key", "modes_a"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    out = one.join(other, ["table_key", "modes_b", "block"]).filter("proc_a < proc_b")
    return out.select("table_key", "proc_a", "proc_b", "modes_a", "modes_b", "severity")


def ordered(found: DataFrame) -> DataFrame:
    """Conflicts, the severe first, then by table and routines."""
    return found.orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), "table_key", "proc_a", "proc_b")


def placed(found: DataFrame) -> DataFrame:
    """found with place, from 1, in the order of `ordered`: ranges are sorted by themselves and counted before they are numbered."""
    keys = [F.when(F.col("severity") == "high", 0).otherwise(1), F.col("table_key"), F.col("proc_a"), F.col("proc_b")]
    rows = materialize(found.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "conflict-ranges")
    # One row for each range.
    base = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("_p")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return rows.withColumn("_w", within).join(F.broadcast(base), "_p").withColumn("place", F.col("base") + F.col("_w")).drop("_p", "_w", "base")
