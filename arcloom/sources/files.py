"""Node and edge tables from files of several formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from arcloom.model import Graph
from arcloom.sources.tables import OpenOnce

#: By the end of a path; ``options`` may say otherwise.
FORMATS = {"parquet": {}, "orc": {}, "json": {}, "ndjson": {}, "csv": {"header": "true"}, "tsv": {"header": "true", "sep": "\t"}}


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table of ``path``, whose format is ``kind`` or what the path ends with. Text formats should get a ``schema``: without one
    the whole input is read once to infer it."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    reader = spark.read.format({"ndjson": "json", "tsv": "csv"}.get(kind, kind)).options(**FORMATS[kind] | options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind in ("csv", "tsv"):
        reader = reader.option("inferSchema", "true")
    return reader.load(path)


def files_graph(spark: SparkSession, nodes: Mapping[str, str], edges: Mapping[str, str], schemas: Mapping[str, StructType | str] | None = None) -> Graph:
    """A graph of one file or folder for each label (several labels joined by ":"); node tables have ``id``, edge tables ``id, src, dst``. Opened when asked for."""
    of = schemas or {}
    return Graph(
        spark,
        OpenOnce({tuple(sorted(k.split(":"))): lambda k=k, p=p: read_table(spark, p, schema=of.get(k)) for k, p in nodes.items()}),
        OpenOnce({k: lambda k=k, p=p: read_table(spark, p, schema=of.get(k)) for k, p in edges.items()}),
    )
