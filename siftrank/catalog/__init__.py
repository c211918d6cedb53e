"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects queries and the SQL they are checked against."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def full_catalog() -> Catalog:
    from siftrank.catalog import (
        analysis,
        documents,
        evaluation,
        files,
        indexing,
        recommendation,
        reranking,
        retrieval,
    )

    whole = Catalog()
    for part in (
        files, documents, analysis, indexing, retrieval, reranking, evaluation, recommendation,
    ):
        for name, query in part.CATALOG.queries.items():
            whole.add(name, part.CATALOG.sql.get(name))(query)
    return whole
