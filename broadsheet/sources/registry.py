"""Registry of sources: name, category, reader and transform."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..fixed_values import CATEGORIES
from ..schemas import ITEMS, check_items

Reader = Callable[[SparkSession, str], DataFrame]
Transform = Callable[[DataFrame], DataFrame]
Render = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Source:
    name: str
    category: str
    reader: Reader
    transform: Transform
    render: Render | None = None


class SourceRegistry:
    """Sources per category in the order they were registered."""

    def __init__(self):
        self._sources: dict[str, Source] = {}

    def register(self, name: str, category: str, reader: Reader, transform: Transform,
                 render: Render | None = None) -> Source:
        if name in self._sources:
            raise ValueError(f"source {name!r} is already registered")
        self._sources[name] = Source(name, category, reader, transform, render)
        return self._sources[name]

    def categories(self) -> list[str]:
        extra = [s.category for s in self._sources.values() if s.category not in CATEGORIES]
        return [*CATEGORIES, *dict.fromkeys(extra)]

    def sources(self, category: str) -> list[Source]:
        return [s for s in self._sources.values() if s.category == category]

    def render(self, category: str) -> Render | None:
        """The first renderer of a category serves all its sources."""
        return next((s.render for s in self.sources(category) if s.render), None)

    def load(self, spark: SparkSession, category: str, paths: dict[str, str]) -> DataFrame:
        """Union of all sources of a category; a source whose path does not exist contributes nothing.

        Any other error of a reader is raised.
        """
        frames = []
        for source in self.sources(category):
            if source.name not in paths:
                continue
            try:
                raw = source.reader(spark, paths[source.name])
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                log.warning("source %s skipped: %s", source.name, error)
                continue
            frames.append(check_items(source.transform(raw), source.name))
        return union_sources(spark, frames)


def union_sources(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """Concatenate item frames by name; no frame gives an empty table."""
    if not frames:
        return spark.createDataFrame([], ITEMS)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
