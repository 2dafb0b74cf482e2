"""Imports every query module, so that the registry is complete."""

from trendmill.plans import (  # noqa: F401
    clean_queries,
    column_queries,
    evaluation_queries,
    file_queries,
    metric_queries,
    model_queries,
    quality_queries,
    stream_queries,
    view_queries,
)
from trendmill.plans.registry import ORACLES, QUERIES  # noqa: F401
