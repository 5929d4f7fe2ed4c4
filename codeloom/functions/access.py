"""Access modes as column expressions: lock levels, labels, compatibility and severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.model import ACCESS_EXCLUSIVE, CONFLICTS, DDL_KINDS, LEVEL_OF_BIT, LOCK_READ, OPS_KINDS, READ, WRITE

BIT_OF_LEVEL = {level: bit for bit, level in LEVEL_OF_BIT.items()}


def lock_level(modes: Column) -> Column:
    """The highest lock level among the bits, or null."""
    out = F.lit(None).cast("int")
    for level in sorted(BIT_OF_LEVEL):
        out = F.when(modes.bitwiseAND(BIT_OF_LEVEL[level]) != 0, level).otherwise(out)
    return out


def conflict_mask(modes: Column) -> Column:
    """Bits of all levels that conflict with some level among the bits."""
    masks = {level: sum(BIT_OF_LEVEL[x] for x in others) for level, others in CONFLICTS.items()}
    parts = [F.when(modes.bitwiseAND(BIT_OF_LEVEL[level]) != 0, mask).otherwise(0) for level, mask in masks.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def locks_conflict(a: Column, b: Column) -> Column:
    return conflict_mask(a).bitwiseAND(b) != 0


def severity(a: Column, b: Column) -> Column:
    """high if either side takes the strongest lock, else medium; null without a conflict."""
    return F.when(locks_conflict(a, b), F.when(a.bitwiseOR(b).bitwiseAND(ACCESS_EXCLUSIVE) != 0, "high").otherwise("medium"))


def access_label(modes: Column, kinds: Column) -> Column:
    """R, W:kinds, lock, L4 and above, D:ddl; null without any. Kinds are an array of labels."""
    ddl, ops = F.array(*map(F.lit, DDL_KINDS)), F.array(*map(F.lit, OPS_KINDS))
    kinds = F.coalesce(kinds, F.array().cast("array<string>"))
    writes = F.array_sort(F.array_except(kinds, F.concat(ddl, ops)))
    defs = F.array_sort(F.array_distinct(F.transform(F.array_intersect(kinds, ddl), lambda k: F.when(k == "create_index_concurrent", "create_index").otherwise(k))))
    level = lock_level(modes)
    has = lambda bit: modes.bitwiseAND(bit) != 0
    out = F.concat_ws(
        ",",
        F.when(has(READ), "R"),
        F.when(has(WRITE), F.when(F.size(writes) > 0, F.concat(F.lit("W:"), F.array_join(writes, ","))).otherwise("W")),
        F.when(has(LOCK_READ), "lock"),
        F.when((level >= 4) | (level.isNotNull() & (F.size(defs) > 0)), F.concat(F.lit("L"), level.cast("string"))),
        F.when(F.size(defs) > 0, F.concat(F.lit("D:"), F.array_join(defs, ","))),
    )
    return F.when(out != "", out)
