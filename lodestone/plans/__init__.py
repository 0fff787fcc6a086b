"""Registered queries of the library: one ``(spark, sf_dir) -> DataFrame`` and one SQL text a name."""

from . import corpus, evaluation, graphs, ordered, relational, retrieval, scalars, selections, statistics, streams, tasks  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
