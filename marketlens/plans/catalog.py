"""All queries of the analytics operators over the driver's tables, with their SQL."""

from . import forecast_queries, graph_queries, leadlag_queries, more_queries, source_queries, stream_queries

QUERIES: dict = {}
SQL: dict = {}
for part in (leadlag_queries, forecast_queries, graph_queries, stream_queries, source_queries, more_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
FLAGSHIP = "e16_stability"
