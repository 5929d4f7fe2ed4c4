"""Changes of a graph by changes of its files: what a changed file cannot touch is neither parsed nor resolved again.

Edges of an owner follow from its own rows and from the definitions of the names that they hold. So after a change only
owners with rows in changed files, and owners that use a name of which some definition came, went or changed, are linked anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.ingest import JAVA, definitions, finish, heads, link, package_items, parse
from codeloom.work import materialize, small


def bare(text: Column) -> Column:
    """What two ways to write a name have in common: its last part."""
    return F.lower(F.regexp_extract(text, r"([^.:]*)$", 1))


def uses(rows: DataFrame) -> DataFrame:
    """owner, name: the last part of every name that an owner's rows hold."""
    held = F.when(F.col("record") == "mapping", F.array("b", "d")).when(F.col("record") == "java_call", F.array("c", "d")).otherwise(F.array("b"))
    plain = rows.filter(F.col("record").isin("call", "access", "mapping", "anchor", "type_use", "edge", "type_ref", "java_call"))
    plain = plain.select(F.col("a").alias("owner"), F.explode(held).alias("text"))
    # The type of a field decides where calls of its class go.
    fields = rows.filter("record = 'field'").select(F.col("a").alias("of"), F.col("b").alias("text"))
    callers = rows.filter("record = 'java_call'").select(F.col("e").alias("of"), F.col("a").alias("owner")).distinct()
    through = fields.join(callers, "of").select("owner", "text").unionByName(fields.select(F.concat(F.lit("class:"), "of").alias("owner"), "text"))
    return plain.unionByName(through).filter("text IS NOT NULL").select("owner", bare(F.col("text")).alias("name")).distinct()


def changed_names(old: DataFrame, new: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of which a definition differs between two sets of rows that differ in `files` (file), and keys of those nodes.

    Definitions in other files are not compared: a node's rows are gathered by its key only if a changed file defines it.
    """
    touched = lambda rows: rows.join(small(files), "file", "left_semi")
    keys = touched(old).unionByName(touched(new)).filter("record = 'node'").select("a").distinct()
    keys = materialize(keys, "delta-keys")
    of = lambda rows: definitions(rows.filter("record = 'node'").join(small(keys), "a", "left_semi")).select("node_key", F.struct("type_tag", "schema_name", "package_name", "name", F.when(F.col("type_tag") == "synonym", F.col("sql")).alias("sql")).alias("x"))
    both = of(old).withColumnRenamed("x", "o").join(of(new).withColumnRenamed("x", "n"), "node_key", "full").filter(~F.col("o").eqNullSafe(F.col("n")))
    nodes = materialize(both.select("node_key", F.explode(F.array("o.name", "n.name", F.lit(None).cast("string"))).alias("name")), "delta-nodes")
    names = nodes.select(F.explode(F.array(F.lower("name"), bare(F.col("node_key")))).alias("name"))
    item = lambda rows: touched(rows).filter("record = 'item'").select(F.concat_ws("\x01", "a", "e").alias("a"), "b").distinct()
    before, after = item(old), item(new)
    names = names.unionByName(before.exceptAll(after).unionByName(after.exceptAll(before)).select(F.lower("b").alias("name")))
    names = names.filter("name IS NOT NULL").distinct()
    # A synonym of a changed name is itself a changed name.
    aliases = new.filter("record = 'edge' AND c = 'AliasesObject'").select(bare(F.col("a")).alias("synonym"), bare(F.col("b")).alias("name"))
    names = materialize(names, "delta-names")
    names = names.unionByName(aliases.join(small(names), "name", "left_semi").select(F.col("synonym").alias("name"))).distinct()
    return materialize(names, "delta-all-names"), nodes.select("node_key").distinct()


def affected(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """owner of every edge or mapping that may differ between the graphs of old and new rows, which differ in `files` (file)."""
    names, nodes = changed_names(old, new, files)
    key = F.when(F.col("record") == "field", F.concat(F.lit("class:"), "a")).otherwise(F.col("a"))
    own = old.unionByName(new).join(small(files), "file", "left_semi").filter("record <> 'error'").select(key.alias("owner"))
    using = uses(new).join(small(names), "name", "left_semi").select("owner")
    return materialize(own.unionByName(using).unionByName(nodes.select(F.col("node_key").alias("owner"))).filter("owner IS NOT NULL").distinct(), "delta-owners")


def rebuild(old: DataFrame, new: DataFrame, files: DataFrame, edges: DataFrame, mappings: DataFrame, kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges, mappings of the rows `new`, and the owners that were linked anew.

    old: the rows that edges and mappings were built from; both row tables are written and equal outside `files` (file).
    kinds: as of ingest.link, with the edges of these types only; rows need hold no more than their records then, and those of synonyms (edge).
    """
    owners = affected(old, new, files)
    mine = small(owners)
    again = new.filter("record NOT IN ('node', 'field', 'item', 'error')").join(mine, F.col("a") == F.col("owner"), "left_semi")
    again = materialize(again, "delta-rows")
    if kinds is None or set(JAVA) & set(kinds):
        again = again.unionByName(_fields(again, new, owners))
    defined = materialize(definitions(new), "defined")
    fresh, maps = link(materialize(again, "delta-linked"), defined, package_items(new), kinds)
    # Fields bring edges of classes that were not affected too; only those of affected owners replace others.
    fresh = fresh.join(mine, F.col("src_key") == F.col("owner"), "left_semi")
    edges = edges.join(mine, F.col("src_key") == F.col("owner"), "left_anti").unionByName(fresh.select(*edges.columns))
    mappings = mappings.join(mine, F.col("owner_key") == F.col("owner"), "left_anti").unionByName(maps.select(*mappings.columns))
    edges = materialize(edges, "edges")
    return finish(defined, edges), edges, mappings, owners


def _fields(again: DataFrame, new: DataFrame, owners: DataFrame) -> DataFrame:
    """Fields of the classes whose calls are linked anew, and of affected classes."""
    classes = again.filter("record = 'java_call'").select(F.col("e").alias("of")).unionByName(owners.filter(F.col("owner").startswith("class:")).select(F.substring("owner", 7, 1 << 30).alias("of"))).distinct()
    return new.filter("record = 'field'").join(small(materialize(classes, "delta-classes")), F.col("a") == F.col("of"), "left_semi")


def reparse(old: DataFrame, files: DataFrame, changes: DataFrame, records: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of all files as they are now, and the files (file) whose rows may differ from the old ones.

    old: rows of the files as they were, written; files: path, kind, content of all files as they are; changes: path, change.
    Parsed are files that were added or modified, and those that hold a package which a changed file holds as well, as a
    body's reading depends on its specification. Specifications in other files are known from the old rows.
    records: as of ingest.parse, with old rows of these only, nodes and items among them.
    """
    differs = changes.filter("change <> 'unchanged'").select(F.col("path").alias("file"))
    differs = materialize(differs, "delta-files")
    edited = files.join(small(differs.withColumnRenamed("file", "path")), "path", "left_semi")
    packages = old.filter("record = 'node' AND b = 'pkg'").select("file", bare(F.col("a")).alias("package"))
    packages = materialize(packages, "delta-packages")
    touched = packages.join(small(differs), "file", "left_semi").select("package").unionByName(heads(edited).select(bare(F.col("name")).alias("package"))).distinct()
    beside = packages.join(small(materialize(touched, "delta-touched")), "package", "left_semi").select("file")
    dirty = materialize(differs.unionByName(beside).distinct(), "delta-dirty")
    kept = old.join(small(dirty), "file", "left_anti")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "d"))), lambda x: x["d"]), " ; ")
    known = kept.filter("record = 'item' AND e = 'spec'").groupBy(F.substring_index("a", ":", -1).alias("name")).agg(said.alias("text"))
    fresh = parse(files.join(small(dirty.withColumnRenamed("file", "path")), "path", "left_semi"), known=materialize(known, "delta-specs"), records=records)
    return materialize(kept.unionByName(fresh), "delta-parsed"), dirty
