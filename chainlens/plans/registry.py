"""Query registry: a Spark callable and, where SQL can express it, the equivalent checking SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import BASE_TABLES, VIEWS, duck_text, sources_of, spark_text


class Tables:
    """Given tables and the views over them, by name, for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(self.path(name))
        text = spark_text(name)
        used = sources_of(text, set(BASE_TABLES) | set(VIEWS))
        for source in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{source}\b", rf"\1 {{{source}}}", text)
        return self.spark.sql(text, **{source: self[source] for source in used})


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}
COMMON: dict[str, str] = {}

_MODULES = (
    "source_queries",
    "relational_queries",
    "graph_queries",
    "walk_queries",
    "activity_queries",
    "evidence_queries",
    "traffic_queries",
    "flow_queries",
    "text_queries",
    "vector_queries",
    "metric_queries",
    "learning_queries",
)


def query(name: str, oracle: str | None = None):
    """Register ``build(tables)`` under ``name`` with its checking SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, oracle)
        return build

    return register


def common(name: str, text: str) -> None:
    """A named step shared by several checking queries."""
    COMMON[name] = text.strip()


def _text(name: str) -> str:
    return COMMON[name] if name in COMMON else duck_text(name)


def compose(body: str) -> str:
    """``body`` preceded by every view or shared step it reads, directly or not."""
    known = set(VIEWS) | set(COMMON)
    ordered: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in sources_of(text, known):
            if name not in seen:
                seen.add(name)
                visit(_text(name))
                ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    steps = ",\n".join(f"{name} AS ({_text(name)})" for name in ordered)
    recursive = "RECURSIVE " if any(name.startswith("walk_rec") for name in ordered) else ""
    return f"WITH {recursive}{steps}\n{body.strip()}"


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: bind(entry.build) for name, entry in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _load()
    return {name: compose(entry.oracle) for name, entry in REGISTRY.items() if entry.oracle}
