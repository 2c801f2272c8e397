"""Collects the runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from siemspark.session import ensure_settings

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        from siemspark.plans.fixtures import Tables

        def run(spark, sf_dir):
            return fn(Tables(ensure_settings(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
