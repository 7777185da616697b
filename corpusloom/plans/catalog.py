"""Imports every module with registered queries."""

from corpusloom.plans import (  # noqa: F401
    chat_queries,
    merge_queries,
    metric_queries,
    plan_queries,
    question_queries,
    retrieval_queries,
    search_queries,
    source_queries,
    table_queries,
    text_queries,
)
from corpusloom.plans.registry import QUERIES, SQL  # noqa: F401
