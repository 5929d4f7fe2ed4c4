"""The data model: schemas, type tags, access modes, lock levels and edge weights."""

from __future__ import annotations

from pyspark.sql import types as T

#: Version of the persisted layout; a store of another version is not read.
STORE_VERSION = 1

_s, _i, _b = T.StringType(), T.IntegerType(), T.BooleanType()
_f = lambda *names_types: T.StructType([T.StructField(n, t, True) for n, t in names_types])

COLUMN = _f(("name", _s), ("data_type", _s), ("nullable", _b), ("primary_key", _b), ("default", _s), ("comment", _s))
BODY_SQL = _f(("sql_text", _s), ("kind", _s), ("line", _i))

#: One row a code object. Groups of columns that only some kinds use are nullable structs and arrays.
NODES = _f(
    ("node_key", _s), ("type_tag", _s), ("kind", _s), ("schema_name", _s), ("package_name", _s), ("name", _s), ("file", _s), ("line", _i),
    ("explicit", _b), ("system", _b), ("partial", _b), ("sql", _s), ("columns", T.ArrayType(COLUMN)), ("body_sql", T.ArrayType(BODY_SQL)), ("properties", T.MapType(_s, _s)),
)

#: One row an edge; parallel edges are allowed.
EDGES = _f(
    ("src_key", _s), ("dst_key", _s), ("edge_type", _s), ("category", _s), ("modes", _i), ("write_kinds", T.ArrayType(_s)),
    ("flow_kind", _s), ("read_tables", T.ArrayType(_s)), ("scope", _s), ("file", _s), ("line", _i), ("detail", _s),
)

#: One row a source column of a written column.
COLUMN_MAPPINGS = _f(
    ("owner_key", _s), ("target_table", _s), ("target_column", _s), ("source_kind", _s), ("source_table", _s), ("source_column", _s), ("mapping_kind", _s), ("expression", _s), ("line", _i),
)

# Access-mode bits, and the lock level of each. The order of bits is not that of levels.
READ, WRITE, LOCK_READ, ACCESS_EXCLUSIVE, SHARE_UPDATE_EXCLUSIVE, SHARE, SHARE_ROW_EXCLUSIVE, EXCLUSIVE = 1, 2, 4, 8, 16, 32, 64, 128
LEVEL_OF_BIT = {1: 1, 4: 2, 2: 3, 16: 4, 32: 5, 64: 6, 128: 7, 8: 8}

# For each lock level, the levels that conflict with it.
CONFLICTS = {
    1: (8,),
    2: (7, 8),
    3: (5, 6, 7, 8),
    4: (4, 5, 6, 7, 8),
    5: (3, 4, 6, 7, 8),
    6: (3, 4, 5, 6, 7, 8),
    7: (2, 3, 4, 5, 6, 7, 8),
    8: (1, 2, 3, 4, 5, 6, 7, 8),
}

# Labels of write kinds; those of DDL and those of operations are told apart in labels.
DDL_KINDS = ("truncate", "alter", "drop", "create_index", "create_index_concurrent", "reindex", "cluster")
OPS_KINDS = ("lock_table", "vacuum", "vacuum_full", "analyze")

# Category of each edge type.
CATEGORY = {
    "DirectCall": "call", "DynamicCall": "call", "CallsProcedure": "call", "InvokesMapper": "call", "CallsJava": "call", "UsesBuiltinFunction": "call",
    "ContainsRoutine": "composition", "ContainsMethod": "composition", "ContainsSql": "composition",
    "TableAccess": "dataflow", "DependsOn": "dataflow",
    "TriggersRoutine": "reference", "TriggersTable": "reference", "ReferencesType": "reference", "UsesSequence": "reference", "IndexesTable": "reference", "AliasesObject": "reference", "AnchorsOn": "reference", "CustomEdge": "reference",
    "Extends": "inheritance", "Implements": "inheritance",
}

# Weights of edges in clustering; dynamic calls weigh less than others, anchors nothing.
CATEGORY_WEIGHT = {"inheritance": 1.5, "composition": 2.0, "call": 1.0, "dataflow": 0.3, "reference": 0.1}
DYNAMIC_WEIGHT = 0.5
