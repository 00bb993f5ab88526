"""All registered queries, by module."""

from . import (  # noqa: F401
    curation_queries,
    ingest_queries,
    mart_queries,
    metrics_queries,
    model_queries,
    ranking_queries,
    registry,
    relational_queries,
    stats_queries,
    streaming_queries,
    text_queries,
)

ENTRIES = registry.ENTRIES
