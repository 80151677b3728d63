"""Running queries whose last result outlives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stop_and_keep(spark: SparkSession, query: StreamingQuery, table: str) -> DataFrame | None:
    """Stops a query, whatever it is doing, and returns the rows that it has published under ``table`` so far; None if it
    published none. A query that failed is stopped already, and what it published still counts."""
    query.stop()
    if not spark.catalog.tableExists(table):
        return None
    rows = spark.table(table)
    return rows if rows.limit(1).count() else None
