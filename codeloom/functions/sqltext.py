"""SQL text as column expressions: normal form, fingerprint, main table, lock clause, similarity and matching.

All of it runs in the JVM. Only wildcard matching of a statement's segments against a query needs a fold over its parts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Replacements of the normal form, in order.
OPERATORS = [
    (" >= ", ">="), (" <= ", "<="), (" <> ", "<>"), (" != ", "!="), (" = ", "="), (" > ", ">"), (" < ", "<"), (" - ", "-"), (" + ", "+"), (" * ", "*"),
    ("( ", "("), (" )", ")"), (" ,", ","), (", ", ","), (" =", "="), ("= ", "="), (" >", ">"), ("> ", ">"), (" <", "<"), ("< ", "<"),
]
#: Lengths below which parts of a wildcard match do not count, and which a lone part needs.
PART_LEAST, LONE_LEAST = 4, 6


def spaced(sql: Column) -> Column:
    """Without comments and literals, and with single blanks, but with its blanks around operators."""
    s = F.regexp_replace(sql, r"--[^\n]*", "")
    s = F.regexp_replace(s, r"(?s)/\*.*?(?:\*/|\z)", "")
    for one in ("1=1", "1 = 1"):
        found = F.instr(F.lower(s), f"where {one} and ") > 0
        if one == "1=1":
            first = found
            s1 = F.regexp_replace(s, rf"(?is)\A(.*?)where {one} and \s*", "$1where ")
        else:
            s = F.when(first, s1).when(found, F.regexp_replace(s, rf"(?is)\A(.*?)where {one} and \s*", "$1where ")).otherwise(s)
    s = F.regexp_replace(s, r"'(?:[^']++|'')*+'?", "?")
    s = F.regexp_replace(s, r"(?<![A-Za-z_])[0-9][0-9.]*+", "?")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalize(sql: Column) -> Column:
    return normal_of(spaced(sql))


def normal_of(plain: Column) -> Column:
    """The normal form of a text that is spaced already."""
    s = F.regexp_replace(plain, ";+$", "")
    s = F.regexp_replace(s, r"__xml_(?:param|raw)_.*?__", "?")
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), OPERATORS, s)


def fingerprint(sql: Column) -> Column:
    return F.sha2(normalize(F.lower(sql)), 256)


def _first_word(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(\S*)", 1)


def main_table(normal: Column) -> Column:
    """The table that a lower-case statement is about, by its first words."""
    tail = lambda at: F.substring(normal, at, F.length(normal))
    # The first of these that occurs ends the name, in this order.
    until = lambda c, marks: F.coalesce(*(F.when(F.instr(c, m) > 0, F.left(c, F.instr(c, m) - 1)) for m in marks), c)
    after = F.substring(normal, F.instr(normal, " from ") + 6, F.length(normal))
    return (
        F.when(normal.startswith("update ") & (F.instr(tail(8), " set ") > 0), _first_word(until(tail(8), [" set "])))
        .when(normal.startswith("delete from "), _first_word(until(tail(13), [" where "])))
        .when(normal.startswith("insert into "), _first_word(until(tail(13), [" values", "(", " select"])))
        .when(normal.startswith("merge into ") & (F.instr(tail(12), " using ") > 0), _first_word(until(tail(12), [" using "])))
        .when(F.instr(normal, " from ") > 0, _first_word(until(after, [" where ", " group ", " order ", " having ", " limit ", " union "])))
    )


def keyword(normal: Column) -> Column:
    word = F.regexp_extract(normal, "^([A-Za-z]*)", 1)
    return F.when(word == "", "empty").when(word.isin("select", "insert", "update", "delete", "merge", "with"), word).otherwise("other")


def keywords_fit(a: Column, b: Column) -> Column:
    reads = lambda c: c.isin("select", "with")
    free = lambda c: c.isin("other", "empty")
    return (a == b) | (reads(a) & reads(b)) | free(a) | free(b)


def tables_fit(query_table: Column, normal: Column) -> Column:
    own = main_table(normal)
    return query_table.isNull() | (query_table == "?") | own.isNull() | (own == "?") | (own == query_table)


def lock_clause(sql: Column) -> Column:
    """for_update, for_share, for_no_key_update, for_key_share or null."""
    return lock_of(normalize(F.lower(sql)))


def lock_of(s: Column) -> Column:
    """The lock clause of a lower-case statement in its normal form."""
    return F.when(s.contains("for update"), "for_update").when(s.contains("for share"), "for_share").when(s.contains("for no key update"), "for_no_key_update").when(s.contains("for key share"), "for_key_share")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct words; 1 if neither has any."""
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def relevance(query: Column, normal: Column) -> Column:
    """Of a statement's normal form to a query's: 1 if equal, 0.95 if it holds it, else by words, keyword and table."""
    words = jaccard(query, normal) * 0.85
    bonus = F.when(keywords_fit(keyword(query), keyword(normal)), 0.10).otherwise(0.0) + F.when(tables_fit(main_table(query), normal), 0.05).otherwise(0.0)
    return F.when(normal == query, 1.0).when(normal.contains(query), 0.95).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), words + bonus)))


def like_segments(query_normal: str) -> str:
    """A pattern for rlike: the parts of a query between its wildcards, in order."""
    parts = [re.escape(p) for p in query_normal.split("?") if p]
    return "(?s)" + ".*".join(parts) if parts else "(?!)"


def parts_in_query(normal: Column, query: Column) -> Column:
    """Whether the parts of a statement between its wildcards occur in the query, in order.

    Parts below PART_LEAST characters do not count; one part alone must be long; two or more in order are enough if the
    query has no wildcard or is used up by them.
    """
    parts = F.filter(F.split(normal, r"\?"), lambda p: p != "")
    long = F.filter(parts, lambda p: F.length(p) >= PART_LEAST)

    begin = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit(0).alias("len"), F.lit(True).alias("on"))

    def fold(acc: Column, p: Column) -> Column:
        rest = F.substring(query, acc["pos"] + 1, F.length(query))
        at = F.position(p, rest)
        ok = acc["on"] & (at > 0) & ~((acc["n"] > 0) & (at == 1))
        return F.struct(
            F.when(ok, acc["pos"] + at - 1 + F.length(p)).otherwise(acc["pos"]).alias("pos"), F.when(ok, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(ok, F.length(p)).otherwise(acc["len"]).alias("len"), ok.alias("on"),
        )

    end = F.aggregate(long, begin, fold)
    rest = F.trim(F.regexp_replace(F.substring(query, end["pos"] + 1, F.length(query)), r"^\?+", ""))
    enough = F.when(end["n"] == 1, end["len"] >= LONE_LEAST).otherwise(end["n"] >= 2)
    used_up = F.when(query.contains("?") | (end["n"] == 1), rest == "").otherwise(True)
    one = F.element_at(parts, 1)
    return (
        F.when(F.size(parts) == 0, False)
        .when(F.size(parts) == 1, F.position(one, query) > 0)
        .when(F.size(long) == 0, False)
        .when(F.size(long) == 1, (F.length(F.element_at(long, 1)) >= LONE_LEAST) & (F.position(F.element_at(long, 1), query) > 0))
        .otherwise(enough & used_up)
    )


def matches(sql: Column, query: Column) -> Column:
    """Whether a statement matches a query (both raw): keyword, containment, table, wildcards both ways, then similarity."""
    low, q = F.lower(sql), F.lower(query)
    return matches_forms(normalize(low), spaced(low), normalize(q), main_table(spaced(q)))


def matches_forms(normal: Column, plain: Column, q: Column, table: Column) -> Column:
    """matches() for texts whose forms are known: a statement's normal and spaced form, the query's normal form and table.

    The forms are used many times over, so columns that hold them keep the expression small.
    """
    wild, own_wild = q.contains("?"), normal.contains("?")
    forward = F.regexp_like(normal, F.concat(F.lit("(?s)"), F.array_join(F.transform(F.filter(F.split(q, r"\?"), lambda p: p != ""), lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))), ".*")))
    alike = tables_fit(table, plain) & (jaccard(q, normal) >= 0.8)
    by_parts = (wild & (F.replace(q, F.lit("?"), F.lit("")) != "") & forward) | (own_wild & parts_in_query(normal, q)) | alike
    return keywords_fit(keyword(q), keyword(normal)) & (F.position(q, normal).__gt__(0) | (tables_fit(table, normal) & (wild | own_wild) & by_parts))


def forms_of(spark: SparkSession, query: str) -> tuple[Column, Column]:
    """The normal form and the table of one query, as literals."""
    q = F.lower(F.lit(query))
    normal, table = spark.range(1).select(normalize(q), main_table(spaced(q))).first()
    return F.lit(normal), F.lit(table).cast("string")
