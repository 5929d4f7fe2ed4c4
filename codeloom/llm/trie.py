"""Trie of the prefixes of conversations, built level by level.

1. Turns are numbered within their conversation in two steps: rows are range-partitioned by (conversation, turn), counted by
   conversation and partition, and numbered from there, so one very long conversation is spread over partitions.
2. Conversations are rebuilt (see `rebuilt`): the first turns of a base conversation, then their own later turns.
3. All conversations start at the root. At each depth the live ones are grouped by (parent node, next turn); a node is named by its
   depth and its smallest conv_id. Conversations of nodes with several members stay live; nodes that many share come back to
   them by broadcast, others by a shuffled join (common.meet). A conversation that is the only member of its node ends there:
   all nodes below are its own, one a turn, and need no further rounds. So there are as many rounds as the longest prefix
   that two conversations share has turns.
4. Level by level from the deepest, children are summed up by parent: their number, leaves and savings.
5. Ids of the conversations that end at a node are joined in blocks of neighbouring ids, and blocks are hashed one after
   the other in their order, so a node at which any number ends never stands in memory.

Defined cases: turns are ordered by turn (null first), equal ones by the SHA-256 digest of role and text; repeated rows are
turns of their own; null role and text are empty; rows with a null conv_id belong to no conversation and are left out; an
empty table has no root and gives an empty result; other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, meet, new_path, table

#: Conversations of one block of neighbours share their base, and so many turns of it at most.
BLOCK, MOST_HEAD = 100, 5
#: Ids are joined in blocks of 2 to this power, and nodes of single conversations are made in chunks of so many.
ID_BITS, CHAIN_ROWS = 12, 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos from 1, key, chars), and conversations (conv, own) with the number of their turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.length(text).cast("long").alias("chars"))
    order = (F.col("turn").asc_nulls_first(), "key")
    rows = materialize(rows.repartitionByRange("conv", *order).withColumn("p", F.spark_partition_id()), "trie-turns")
    ahead = Window.partitionBy("conv").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(rows.groupBy("conv", "p").agg(F.count(F.lit(1)).alias("n")), "trie-counts")
    base = counts.select("conv", "p", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("conv", "p").orderBy(*order))
    turns = rows.withColumn("within", within).join(base, ["conv", "p"])
    return turns.select("conv", (F.col("base") + F.col("within")).alias("pos"), "key", "chars"), counts.groupBy("conv").agg(F.sum("n").alias("own"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth from 1, key, chars) and lengths (conv, len) of rebuilt conversations, both written.

    Conversation c has the first h turns of conversation c - c % BLOCK, then its own after its first h; h is crc32(c) % 6.
    """
    turns, own = numbered_turns(conversations)
    turns, own = materialize(turns, "trie-numbered"), materialize(own, "trie-own")
    head = (F.crc32(F.col("conv").cast("string")) % (MOST_HEAD + 1)).cast("long")
    convs = own.select("*", head.alias("h"), (F.col("conv") - F.col("conv") % BLOCK).alias("block"))
    convs = convs.join(own.select(F.col("conv").alias("block"), F.col("own").alias("base_own")), "block", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0)))).drop("base_own")
    convs = materialize(convs.withColumn("len", F.col("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "trie-convs")
    # At most 2 * BLOCK conversations have one base, and at most MOST_HEAD turns of it count.
    heads = turns.filter(F.col("pos") <= MOST_HEAD).withColumnRenamed("conv", "block").join(convs.select("conv", "block", "head"), "block")
    heads = heads.filter("pos <= head").select("conv", F.col("pos").alias("depth"), "key", "chars")
    rest = meet(turns, convs.select("conv", "own", "h", "head"), ["conv"], "own", F.col("pos"), "c").filter("pos > c.h")
    rest = rest.select("conv", (F.col("c.head") + F.col("pos") - F.col("c.h")).alias("depth"), "key", "chars")
    # Sorted by depth, so that reading one depth skips pages of the others.
    return materialize(heads.unionByName(rest).sortWithinPartitions("depth"), "trie-rebuilt"), convs.select("conv", "len")


def _id_hashes(ends: DataFrame) -> DataFrame:
    """ends_sha256 by (depth, node) of (depth, node, conv) rows."""
    block = F.shiftright("conv", ID_BITS)
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    # A block has no more than 2 ** ID_BITS ids, as conv is unique.
    blocks = ends.groupBy("depth", "node", block.alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    blocks = blocks.repartition("depth", "node").sortWithinPartitions("depth", "node", "block")

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha = None, None
        for pdf in frames:
            out = []
            for depth, node, ids in zip(pdf["depth"], pdf["node"], pdf["ids"]):
                if (depth, node) == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, sha.hexdigest()))
                at, sha = (depth, node), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["depth", "node", "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=["depth", "node", "ends_sha256"])

    return blocks.mapInPandas(digests, "depth long, node long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the conversations with turns (conv, depth, key, chars) and lengths (conv, len); both are written tables."""
    spark = turns.sparkSession
    at = new_path(spark, "trie")

    def written(df: DataFrame, kind: str, depth: int) -> DataFrame:
        df.write.parquet(f"{at}/{kind}/{depth}")
        return spark.read.schema(df.schema).parquet(f"{at}/{kind}/{depth}")

    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("len").alias("len")).filter("n > 0")
    node = {0: written(root.select(F.lit(0).cast("long").alias("depth"), "conv", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"), "n", "len"), "nodes", 0)}
    step_schema, node_schema = None, node[0].schema
    live, depth = convs.crossJoin(F.broadcast(node[0].select(F.col("conv").alias("node")))), 0  # one root
    while True:
        # Of the conversations at a node of this depth: those with a next turn, which has a key, and those that end here.
        following = turns.filter(F.col("depth") == depth + 1).select("conv", "key", "chars")
        step = written(live.join(following, "conv", "left").select(F.lit(depth).cast("long").alias("depth"), "node", "conv", "len", "key", "chars"), "steps", depth)
        step_schema = step.schema
        grouped = step.filter("key IS NOT NULL").groupBy("node", "key").agg(F.min("conv").alias("conv"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.max("len").alias("len"))
        node[depth + 1] = written(grouped.select(F.lit(depth + 1).cast("long").alias("depth"), "conv", F.col("node").alias("parent"), "key", "chars", "n", "len"), "nodes", depth + 1)
        shared = node[depth + 1].filter("n > 1")
        if shared.isEmpty():
            break
        named = shared.select(F.col("parent").alias("node"), "key", "n", F.col("conv").alias("next"))
        live = meet(step.filter("key IS NOT NULL").select("node", "key", "conv", "len"), named, ["node", "key"], "n", F.col("conv"), "child", "inner")
        live, depth = live.select("conv", "len", F.col("child.next").alias("node")), depth + 1
    # Upwards: what the children of a node come to.
    below = None
    for d in range(depth, -1, -1):
        alone = node[d + 1].filter("n = 1").select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        up = alone if below is None else alone.unionByName(below.select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        up = up.groupBy(F.col("parent").alias("conv")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        own = node[d] if d == 0 else node[d].filter("n > 1")
        rolled = own.join(up, "conv", "left").select(
            "depth", "conv", "parent", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("chars")).alias("saved_tokens"),
        )
        below = written(rolled, "rolled", d)
    ends = spark.read.schema(step_schema).parquet(f"{at}/steps/*").filter("key IS NULL").select("depth", "node", "conv")
    inner = spark.read.schema(below.schema).parquet(f"{at}/rolled/*").withColumnRenamed("conv", "node")
    inner = inner.join(_id_hashes(ends), ["depth", "node"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    # Below the first node that a conversation has for itself: a chain down to its end.
    heads = spark.read.schema(node_schema).parquet(f"{at}/nodes/*").filter("n = 1 AND depth > 0").withColumnRenamed("depth", "top")
    chunk = F.explode(F.sequence(F.col("top"), F.col("len"), F.lit(CHAIN_ROWS).cast("long"))).alias("first")
    chains = heads.select("conv", "parent", "top", "len", chunk).repartition("conv", "first")
    chains = chains.select("*", F.explode(F.sequence("first", F.least(F.col("first") + CHAIN_ROWS - 1, "len"))).alias("depth"))
    last = F.col("depth") == F.col("len")
    chains = chains.select(
        "depth", F.col("conv").alias("node"), F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    return inner.unionByName(chains).withColumnsRenamed({"node": "conv_id", "parent": "parent_conv_id"})


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    nodes = trie(*rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = f"""
WITH b AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_of),
o AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(CAST(role AS VARCHAR), '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, turn, length(text) AS chars, sha256(concat(length(role), ':', role, text)) AS key FROM o),
t AS (SELECT c, chars, key, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS pos FROM k),
n AS (SELECT c, count(*) AS own FROM t GROUP BY c),
h AS (SELECT n.c, n.own, n.c - n.c % {BLOCK} AS b, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(n.c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, x: xor(a >> 8, crc_of[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % {MOST_HEAD + 1} AS h FROM n, b),
g AS (SELECT h.*, least(h.h, coalesce(n.own, 0)) AS head FROM h LEFT JOIN n ON h.b = n.c),
r AS (SELECT g.c, t.pos AS d, t.key, t.chars FROM g JOIN t ON g.b = t.c AND t.pos <= g.head
  UNION ALL SELECT g.c, g.head + t.pos - g.h, t.key, t.chars FROM g JOIN t ON g.c = t.c AND t.pos > g.h
  UNION ALL SELECT c, 0, '', 0 FROM g),
p AS (SELECT c, d, chars, string_agg(key, '/') OVER (PARTITION BY c ORDER BY d) AS path, max(d) OVER (PARTITION BY c) AS len FROM r),
v AS (SELECT d, path, min(c) AS m, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256 FROM p GROUP BY d, path),
a AS (SELECT p.c, p.d, v.m FROM p JOIN v ON p.d = v.d AND p.path = v.path),
e AS (SELECT v.*, a.m AS up FROM v LEFT JOIN a ON a.c = v.m AND a.d = v.d - 1),
f AS (SELECT d - 1 AS d, up AS m, count(*) AS n_children FROM e WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT e.m, e.d, (e.n_convs - 1) * e.chars AS saved, CASE WHEN f.m IS NULL THEN 1 ELSE 0 END AS leaf FROM e LEFT JOIN f ON e.m = f.m AND e.d = f.d),
u AS (SELECT a.d, a.m, sum(s.saved) AS saved, sum(s.leaf) AS leaves FROM s JOIN a ON a.c = s.m AND a.d <= s.d GROUP BY a.d, a.m)
SELECT e.m AS conv_id, CAST(e.d AS BIGINT) AS depth, e.up AS parent_conv_id, e.n_convs, CAST(coalesce(f.n_children, 0) AS BIGINT) AS n_children,
  CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e JOIN u ON e.m = u.m AND e.d = u.d LEFT JOIN f ON e.m = f.m AND e.d = f.d
"""
