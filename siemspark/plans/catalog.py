"""Imports every query module so that all queries are registered."""

from siemspark.plans import (contract_queries, detect_queries, invest_queries,  # noqa: F401
                             normalize_queries, parse_queries, raw_queries, reliability_queries,
                             search_queries, stream_queries)
from siemspark.plans.registry import ORACLES, QUERIES  # noqa: F401
