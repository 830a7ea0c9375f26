"""The property graph over the relational tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcloom.model import Graph
from arcloom.operators.sized import dealt

#: An id is kind * KIND + key + 1 with a key below KIND, so ids of different tables never meet and all are positive 64-bit numbers.
KIND = 1 << 58
#: A pair's key is its supplier's times this and its part's; an order line's is its order's times ``LINES`` and its number.
PARTS, LINES = 1 << 32, 1000
NODE_KINDS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "SalesOrder": 5, "Part": 6, "User": 7, "Event": 8}
EDGE_KINDS = {"IN_REGION": 11, "LIVES_IN": 12, "BASED_IN": 13, "PLACED": 14, "CONTAINS": 15, "SUPPLIES": 16, "NEXT": 17, "DID": 18}


class OpenOnce(Mapping):
    """Frames by key, made when first asked for."""

    def __init__(self, makers: Mapping[Any, Callable[[], DataFrame]]):
        self.makers, self.made = dict(makers), {}

    def __getitem__(self, key: Any) -> DataFrame:
        if key not in self.made:
            self.made[key] = self.makers[key]()
        return self.made[key]

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def node_id(label: str, key: str):
    return (F.lit(NODE_KINDS[label] * KIND + 1) + F.col(key)).cast("bigint")


def edge_id(label: str, key):
    return (F.lit(EDGE_KINDS[label] * KIND + 1) + (F.col(key) if isinstance(key, str) else key)).cast("bigint")


def pair_key(high: str, low: Column, room: int) -> Column:
    """``high * room + low``; raises where the two would not keep apart or leave their kind's range."""
    a = F.col(high).cast("bigint")
    fits = a.between(0, KIND // room - 1) & low.between(0, room - 1)
    return F.when(a.isNull() | low.isNull() | fits, a * room + low).otherwise(F.raise_error(F.lit(f"a key of {high} is too large for an edge's id")).cast("bigint"))


def tables_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, orders, parts, users and events, and what links them. A table is opened when a query needs it."""
    opened: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    def named(name: str, label: str, key: str, prefix: str, **renamed: str) -> Callable[[], DataFrame]:
        def make() -> DataFrame:
            df = table(name)
            own = {c: renamed.get(c, c.removeprefix(prefix)) for c in df.columns}
            return df.select(node_id(label, key).alias("id"), *(F.col(c).alias(n) for c, n in own.items()))

        return make

    def link(name: str, label: str, key: str, source: tuple[str, str], target: tuple[str, str]) -> Callable[[], DataFrame]:
        return lambda: table(name).where(F.col(source[1]).isNotNull() & F.col(target[1]).isNotNull()).select(edge_id(label, key).alias("id"), node_id(*source).alias("src"), node_id(*target).alias("dst"))

    def contains() -> DataFrame:
        lines = table("lineitem")
        of_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", *(c for c in lines.columns if c not in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
        return lines.select(
            edge_id("CONTAINS", pair_key("l_orderkey", F.row_number().over(of_order).cast("bigint"), LINES)).alias("id"), node_id("SalesOrder", "l_orderkey").alias("src"), node_id("Part", "l_partkey").alias("dst"),
            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"),
        )

    def following() -> DataFrame:
        of_customer = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        after = table("orders").select("o_orderkey", F.col("o_orderdate").alias("day"), F.lead("o_orderkey").over(of_customer).alias("next"), F.lead("o_orderdate").over(of_customer).alias("next_day")).where("next IS NOT NULL")
        return after.select(edge_id("NEXT", "o_orderkey").alias("id"), node_id("SalesOrder", "o_orderkey").alias("src"), node_id("SalesOrder", "next").alias("dst"), F.datediff("next_day", "day").alias("gap_days"))

    def supplies() -> DataFrame:
        pairs = dealt(table("lineitem").select("l_suppkey", F.col("l_partkey").cast("bigint").alias("l_partkey")), "l_suppkey", "l_partkey").distinct()
        return pairs.select(edge_id("SUPPLIES", pair_key("l_suppkey", F.col("l_partkey"), PARTS)).alias("id"), node_id("Supplier", "l_suppkey").alias("src"), node_id("Part", "l_partkey").alias("dst"))

    nodes = {
        ("Region",): named("region", "Region", "r_regionkey", "r_"),
        ("Nation",): named("nation", "Nation", "n_nationkey", "n_"),
        ("Customer",): named("customer", "Customer", "c_custkey", "c_"),
        ("Supplier",): named("supplier", "Supplier", "s_suppkey", "s_"),
        ("SalesOrder",): named("orders", "SalesOrder", "o_orderkey", "o_"),
        ("Part",): named("part", "Part", "p_partkey", "p_", p_type="ptype"),
        ("User",): lambda: table("events").select("user_id").where("user_id IS NOT NULL").distinct().select(node_id("User", "user_id").alias("id"), "user_id"),
        ("Event",): lambda: table("events").select(node_id("Event", "event_id").alias("id"), "event_id", "ts", F.col("event_type").alias("kind"), "value"),
    }
    edges = {
        "IN_REGION": link("nation", "IN_REGION", "n_nationkey", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        "LIVES_IN": link("customer", "LIVES_IN", "c_custkey", ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
        "BASED_IN": link("supplier", "BASED_IN", "s_suppkey", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
        "PLACED": link("orders", "PLACED", "o_orderkey", ("Customer", "o_custkey"), ("SalesOrder", "o_orderkey")),
        "CONTAINS": contains,
        "SUPPLIES": supplies,
        "NEXT": following,
        "DID": link("events", "DID", "event_id", ("User", "user_id"), ("Event", "event_id")),
    }
    return Graph(spark, OpenOnce(nodes), OpenOnce(edges))
