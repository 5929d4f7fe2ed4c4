"""Code-graph analytics on Spark: nodes and edges as DataFrames."""

__version__ = "0.1.0"
