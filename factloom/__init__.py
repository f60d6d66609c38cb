"""factloom: a document-to-knowledge-graph analytics engine built on Spark DataFrames."""

from factloom.session import get_spark, table

__all__ = ["get_spark", "table"]
