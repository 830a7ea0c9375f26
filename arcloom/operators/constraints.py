"""Unique values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.functions.compare import as_text
from arcloom.model import Graph


class UniqueViolation(ValueError):
    pass


def violations(graph: Graph, label: str, key: str, among: DataFrame | None = None) -> DataFrame:
    """``value, n`` of values that several nodes of a label share; values compare as text and nodes without one are exempt.
    With ``among``, a frame of one column, only its values are looked at."""
    df = graph.nodes((label,))
    if key not in df.columns:
        return graph.spark.createDataFrame([], "value string, n bigint")
    value = as_text(F.col(key), df.schema[key].dataType)
    values = df.where(F.col(key).isNotNull()).select(value.alias("value"))
    if among is not None:
        values = values.join(among.select(as_text(F.col(key), among.schema[key].dataType).alias("value")).distinct(), "value", "left_semi")
    return values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")


def check(graph: Graph, constraints: list[tuple[str, str]], among: DataFrame | None = None) -> None:
    for label, key in constraints:
        bad = violations(graph, label, key, among).limit(3).collect()
        if bad:
            raise UniqueViolation(f"{label}.{key}: {', '.join(f'{r.value!r} {r.n} times' for r in bad)}")
