"""Imports every query module of this subpackage."""

from siemspark.llm import q_pages, q_pipeline, q_text, q_vectors  # noqa: F401
from siemspark.llm.registry import ORACLES, QUERIES  # noqa: F401
