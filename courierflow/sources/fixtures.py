"""Logical delivery tables derived from the benchmark parquet tables.

The binding (which raw column becomes which logical column) is fixed by the
project's fixture definition; the same definitions exist as SQL text in
:mod:`courierflow.plans.oracle_views` so both engines see identical inputs.

All tables are lazy DataFrames over ``spark.read.parquet``: projections and
filters of the queries built on top reach the parquet scan.  The only actions
are two row counts (supplier and embeddings tables, answered from parquet
footers) that fix the modulus of the synthetic foreign keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow.functions.geo import great_circle_m
from courierflow.functions.status import status_at
from courierflow.schema import VEHICLE_TYPES

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


def _k_of_props() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


class Tables:
    """Lazily built logical tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- sizes of the synthetic key spaces ---------------------------------
    @cached_property
    def n_suppliers(self) -> int:
        return self.raw("supplier").count()

    @cached_property
    def n_nodes(self) -> int:
        return self.raw("embeddings").count()

    # -- entities ------------------------------------------------------------
    @cached_property
    def region(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_name", "c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_regionkey")
        return (
            c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(
                F.col("c_custkey").alias("id"),
                F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lit("@example.com")).alias("email"),
                F.col("c_name").alias("name"),
                F.expr("CAST(-23.60 + (c_custkey % 1000) * 0.0001 AS DOUBLE)").alias("house_lat"),
                F.expr("CAST(-46.68 + (c_custkey % 997) * 0.0001 AS DOUBLE)").alias("house_lon"),
                F.col("n_regionkey").alias("region_id"),
            )
        )

    @cached_property
    def phones(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey").where(F.col("c_custkey") % 3 != 0)
        first = c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("+55"), F.col("c_custkey").cast("string")).alias("phone"))
        second = c.where(F.col("c_custkey") % 5 == 0).select(
            F.col("c_custkey").alias("user_id"), F.concat(F.lit("+56"), F.col("c_custkey").cast("string")).alias("phone"))
        return first.unionByName(second)

    @cached_property
    def kitchen_type(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("type"))

    @cached_property
    def node(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"),
            (F.lit(-23.55) + F.lit(0.05) * F.col("embedding")[0].cast("double")).alias("lat"),
            (F.lit(-46.63) + F.lit(0.05) * F.col("embedding")[1].cast("double")).alias("lon"),
        )

    @cached_property
    def edge(self) -> DataFrame:
        g = self.n_nodes
        u = self.node.select(F.col("id").alias("u"), F.col("lat").alias("u_lat"), F.col("lon").alias("u_lon"))
        v = self.node.select(F.col("id").alias("v"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
        targets = u.select(
            "u", "u_lat", "u_lon",
            F.explode(F.array((F.col("u") + 1) % g, (F.col("u") * 7 + 1) % g, (F.col("u") * 13 + 5) % g)).alias("v"),
        ).where(F.col("v") % 50 != 0)
        return targets.join(v, "v").select(
            "u", "v", F.round(great_circle_m("u_lat", "u_lon", "v_lat", "v_lon"), 3).alias("length"))

    def _supplier_region(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_regionkey")
        return s.join(n, s.s_nationkey == n.n_nationkey, "left")

    @cached_property
    def restaurant(self) -> DataFrame:
        g = self.n_nodes
        nd = self.node.select(F.col("id").alias("node_id"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
        s = self._supplier_region().withColumn("node_id", (F.col("s_suppkey") * 31 + 1) % g)
        return s.join(nd, "node_id", "left").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            (F.col("n_lat") + F.lit(0.00001)).alias("lat"),
            F.col("n_lon").alias("lon"),
            F.col("s_nationkey").alias("kitchen_type_id"),
            F.col("n_regionkey").alias("region_id"),
        )

    @cached_property
    def courier(self) -> DataFrame:
        g = self.n_nodes
        nd = self.node.select(F.col("id").alias("node_id"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
        s = self._supplier_region().withColumn("node_id", (F.col("s_suppkey") * 17 + 3) % g)
        vehicles = F.array(*[F.lit(v) for v in VEHICLE_TYPES])
        return s.join(nd, "node_id", "left").select(
            F.col("s_suppkey").alias("id"),
            F.concat(F.lit("Courier "), F.col("s_suppkey").cast("string")).alias("name"),
            F.element_at(vehicles, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("vehicle"),
            F.col("n_lat").alias("lat"),
            (F.col("n_lon") + F.lit(0.00001)).alias("lon"),
            F.col("n_regionkey").alias("region_id"),
        )

    @cached_property
    def item(self) -> DataFrame:
        n = self.n_suppliers
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            (F.col("p_partkey") % n).alias("restaurant_id"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        n = self.n_suppliers
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_orderkey") % n).alias("restaurant_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def order_item_lines(self) -> DataFrame:
        """Order lines as given, not numbered (for uses without line order)."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").cast("int").alias("quantity"))

    @cached_property
    def order_item_raw(self) -> DataFrame:
        """Order lines in payload order (``line_no`` 1..n within an order),
        numbered with the skew-safe per-key ranking."""
        from courierflow.operators.ranking import rank_within_key
        li = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
        ranked = rank_within_key(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                                      "l_extendedprice", "l_shipdate"], out="line_no")
        return ranked.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            "line_no",
        )

    @cached_property
    def order_item(self) -> DataFrame:
        li = self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id"),
            F.col("l_quantity").cast("int").alias("quantity"))
        return li.groupBy("order_id", "item_id").agg(F.sum("quantity").cast("int").alias("quantity"))

    @cached_property
    def delivery(self) -> DataFrame:
        e = self.raw("events").select("user_id").distinct()
        return e.select(
            F.col("user_id").alias("id"),
            F.col("user_id").alias("order_id"),
            F.expr("user_id div 2").alias("courier_id"),
        )

    @cached_property
    def event(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            status_at(_k_of_props() % 6).alias("status"),
            F.col("ts").alias("updated_at"),
            F.col("user_id").alias("delivery_id"),
        )

    @cached_property
    def status_request(self) -> DataFrame:
        """Status change requests (same rows as ``event``, read as requests)."""
        return self.event

    @cached_property
    def position(self) -> DataFrame:
        """Canonical courier positions plus the receive-batch number."""
        return self.raw("events").select(
            F.col("user_id").alias("courier_id"),
            F.col("ts"),
            F.col("user_id").cast("string").alias("delivery_id"),
            (F.lit(-23.5505) + F.col("value") / F.lit(50000.0)).alias("lat"),
            (F.lit(-46.6333) + _k_of_props().cast("double") / F.lit(10000.0)).alias("lon"),
            F.expr("event_id div 10").alias("batch_id"),
            F.col("event_id").alias("arrival_seq"),
        )

    @cached_property
    def position_message(self) -> DataFrame:
        """Positions as raw queue messages (``message_id``, JSON ``body``).

        Both accepted shapes occur: ``click`` events arrive in the API shape
        (delivery_id, lat_courier/lon_courier, ISO time), the others in the
        queue shape (lat/lng, epoch-millis time); ``error`` events arrive as
        truncated, unparseable bodies.
        """
        lat = F.lit(-23.5505) + F.col("value") / F.lit(50000.0)
        lon = F.lit(-46.6333) + _k_of_props().cast("double") / F.lit(10000.0)
        api = F.to_json(F.struct(
            F.col("user_id").alias("courier_id"), F.col("user_id").cast("string").alias("delivery_id"),
            lat.alias("lat_courier"), lon.alias("lon_courier"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")))
        queue = F.to_json(F.struct(
            F.col("user_id").alias("courier_id"), lat.alias("lat"), lon.alias("lng"),
            F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
            .alias("timestamp")))
        corrupt = F.concat(F.lit('{"courier_id": '), F.col("user_id").cast("string"), F.lit(', "lat": '))
        body = (F.when(F.col("event_type") == "error", corrupt)
                .when(F.col("event_type") == "click", api)
                .otherwise(queue))
        return self.raw("events").select(F.col("event_id").alias("message_id"), body.alias("body"))


_CACHE: dict[tuple[int, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """One ``Tables`` per (session, folder), so key-space counts run once."""
    key = (id(spark), sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = Tables(spark, sf_dir)
    return _CACHE[key]
