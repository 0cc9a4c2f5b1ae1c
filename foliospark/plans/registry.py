"""Named queries and their SQL twins. Modules of :mod:`foliospark.plans` register here."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its name, with its SQL."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


from . import container_queries, export_queries, image_queries, ledger_queries, page_queries, queue_queries, stream_queries, text_queries  # noqa: E402, F401
