"""Collects queries and their SQL under one name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Builder] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, build: Builder, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = build
        if sql is not None:
            self.sql[name] = sql


REGISTRY = Registry()


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Builder) -> Builder:
        REGISTRY.add(name or fn.__name__, fn, sql)
        return fn

    return register
