"""Views over the given tables and one registered query per operator."""

from .registry import REGISTRY, oracle_queries, spark_queries

__all__ = ["REGISTRY", "oracle_queries", "spark_queries"]
