"""A few registered queries against DuckDB on the smallest tables; the others run the same way in the driver's check."""

import os

import duckdb
import pytest

from codeloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["conflicts", "access_labels", "degrees", "package_tables", "sql_fingerprints", "resolve_calls", "change_set", "merge_nodes", "parse_sources", "table_lineage", "lineage_children", "trace_both_ways", "export_dot", "object_access", "column_mappings", "source_filters", "statement_kinds", "java_graph"])
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_names_agree():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
