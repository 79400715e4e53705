"""All named queries."""

from newsloom.plans import (  # noqa: F401
    article_queries,
    evaluation_queries,
    feature_queries,
    link_queries,
    model_queries,
    page_queries,
    profile_queries,
    schema_queries,
    text_queries,
)
from newsloom.plans.registry import ORACLES, QUERIES  # noqa: F401
from newsloom.plans.model_queries import flagship  # noqa: F401
