"""Importing this package registers every query."""

from readlake.plans import (  # noqa: F401
    anchor_plans,
    cleaning_plans,
    layout_plans,
    library_plans,
    notebook_plans,
    page_view_plans,
    result_plans,
    retrieval_plans,
    search_plans,
    stream_plans,
    telemetry_plans,
    web_plans,
)
from readlake.plans.registry import ORACLE, QUERIES  # noqa: F401
