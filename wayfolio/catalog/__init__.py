"""Every operator as a query over the driver's tables, with DuckDB SQL that checks it."""

from wayfolio.catalog import (  # noqa: F401
    aggregate_queries, corpus_queries, filter_queries, join_queries, ordering_queries, scalar_queries,
    sequence_queries, source_queries, stream_queries,
)
from wayfolio.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
