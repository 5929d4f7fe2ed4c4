"""A bounded sample of labelled rows for fitting classifiers, and the base rate over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import held_out

#: Longer documents are left out of samples (never of scoring), which bounds what the driver gathers.
SAMPLE_CHARS = 100_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of up to per_class documents of each class in the order of a hash of their ids, and the share of label 1.

    Only labels whose document is not held out count; rows with a null label, id or text are left out. The share is taken
    over all such labels, not over the sample. Of several labels of a document 1 wins, of several texts the smallest.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    picked = known.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    part = lambda y: picked.filter(F.col("y") == y).orderBy("_h", "doc_id").limit(per_class)
    ids = F.broadcast(part(0).union(part(1)))  # at most two times per_class rows
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    # However often an id occurs, one text of it comes to the driver.
    rows = texts.join(ids, "doc_id").groupBy("doc_id", "_h", "y").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (r._h, r.y, r.text))], rate
