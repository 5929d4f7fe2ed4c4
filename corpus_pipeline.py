"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

1. toxicity: documents that the network scores at its threshold or more go.
2. dedup: of each class of near copies, one document stays.
3. decontaminate: documents that hold a benchmark item within its edit budget go.
4. pii: personal data is replaced by its kind.
5. mixing: words are taken from the sources up to their targets; documents of which none is taken go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, mixing, ngram_join, pii, toxicity
from codeloom.llm.common import materialize, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with size, source_size, target and taken, the words that the mix takes (repeats counted).

    Columns of documents that have one of these names give way.
    """
    mixed = mixing.take(docs).filter("taken > 0")
    own = ("size", "source_size", "target", "taken")
    return mixed.select(*(mixed._row[c].alias(c) for c in docs.columns if c not in own), *own)


STAGES = [
    ("toxicity", drop_toxic),
    ("dedup", drop_copies),
    ("decontaminate", drop_leaks),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]

#: A network and a classifier trained on the way cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
