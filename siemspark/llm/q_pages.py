"""Queries over web pages."""

from __future__ import annotations

from siemspark.llm import wrapper
from siemspark.llm.common import table
from siemspark.llm.registry import query


@query("op3_html_main_text")
def op3(spark, sf_dir):
    """The article of every page."""
    return wrapper.extract_text(table(spark, sf_dir, "pages"))
