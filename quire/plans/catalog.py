"""All registered queries of the reference's operators."""

from quire.plans import layout_queries, output_queries, request_queries, term_queries, text_queries  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES  # noqa: F401
