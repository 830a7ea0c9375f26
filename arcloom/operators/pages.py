"""Pages of nodes and edges by key, and by offset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.model import Graph

PAGE = 50


@dataclass(frozen=True)
class Page:
    """``cursor`` starts the next page; 0 at the end."""

    items: DataFrame
    cursor: int
    more: bool


def after(df: DataFrame, cursor: int, limit: int) -> DataFrame:
    """Rows with ids beyond the cursor, in order: the filter reaches the files' statistics and only ``limit`` rows are kept."""
    return df.where(F.col("id") > cursor).orderBy("id").limit(limit if limit > 0 else PAGE)


def page(df: DataFrame, cursor: int = 0, limit: int = PAGE) -> Page:
    limit = limit if limit > 0 else PAGE
    ids = [r[0] for r in after(df.select("id"), cursor, limit + 1).collect()]
    more = len(ids) > limit
    last = ids[:limit][-1] if ids else cursor
    return Page(df.where((F.col("id") > cursor) & (F.col("id") <= last)).orderBy("id"), last if more else 0, more)


def list_nodes(graph: Graph, cursor: int = 0, limit: int = PAGE, label: str | None = None) -> Page:
    return page(graph.nodes((label,) if label else ()), cursor, limit)


def list_edges(graph: Graph, cursor: int = 0, limit: int = PAGE, label: str | None = None) -> Page:
    return page(graph.edges(label), cursor, limit)


def by_offset(df: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    return df.orderBy("id").offset(offset).limit(limit if limit > 0 else PAGE)
