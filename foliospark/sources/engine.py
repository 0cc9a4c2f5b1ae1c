"""Plug-in for recognition engines: anything with ``name`` and ``read(image) -> detections``.

Engines are made once per task; pages that fail give an error row, never invented text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from foliospark.arrow import map_batches


class Engine(Protocol):
    name: str

    def read(self, content: bytes) -> list[tuple[str, float, list[float]]]:
        """(text, confidence, [xmin, ymin, xmax, ymax]) of each detection."""


ENGINES: dict[str, Callable[[], Engine]] = {}


def register(name: str, factory: Callable[[], Engine]) -> None:
    ENGINES[name] = factory


def recognise(pages: DataFrame, name: str, least: float = 0.0) -> DataFrame:
    """Detections of ``page_id, content``: ``page_id, ord, text, confidence, bbox, error``."""
    if name not in ENGINES:
        raise ValueError(f"no engine {name!r}; known: {sorted(ENGINES)}")
    factory = ENGINES[name]

    def make():
        engine = factory()

        def run(ids, contents):
            rows = []
            for i, c in zip(ids, contents):
                try:
                    found = [d for d in engine.read(c) if d[1] >= least and d[0].strip()]
                    rows += [(i, k, t, conf, list(map(float, box)), None) for k, (t, conf, box) in enumerate(found)]
                except Exception as e:  # a page must not end the job
                    rows.append((i, None, None, None, None, f"{type(e).__name__}: {e}"))
            return rows

        return run

    return map_batches(pages.select("page_id", "content"), make, "page_id bigint, ord int, text string, confidence double, bbox array<double>, error string")
