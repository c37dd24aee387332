"""The registered queries: ``registry`` holds them all once these modules are imported."""

from . import column_queries, model_queries, registry, structure_queries

__all__ = ["column_queries", "model_queries", "registry", "structure_queries"]
