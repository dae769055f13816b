"""Latest delivery status and courier availability.

All of these are per-key reductions that Spark runs as a partial (map-side)
hash aggregate followed by one shuffle on the key, so a hot key never lands
whole in one task before being reduced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.schema import FINAL_STATUS


def latest_status(event: DataFrame) -> DataFrame:
    """A1: per delivery, the status of the newest event by (updated_at, id).

    ``max_by`` over a struct key is a declarative arg-max: one partial
    aggregate per input partition, one shuffle of at most one row per
    (partition, delivery).
    """
    latest = F.max_by(F.struct("status", "updated_at", "id"), F.struct("updated_at", "id"))
    return (
        event.groupBy("delivery_id")
        .agg(latest.alias("l"))
        .select(
            "delivery_id",
            F.col("l.status").alias("status"),
            F.col("l.updated_at").alias("status_updated_at"),
            F.col("l.id").alias("status_event_id"),
        )
    )


def delivery_with_status(delivery: DataFrame, event: DataFrame) -> DataFrame:
    """Every delivery with its latest status (null when it has no events)."""
    return delivery.join(latest_status(event), delivery.id == F.col("delivery_id"), "left").drop("delivery_id")


def active_deliveries(delivery: DataFrame, event: DataFrame) -> DataFrame:
    """Deliveries still occupying their courier: no events yet, or latest
    status other than DELIVERED (``IS DISTINCT FROM``)."""
    ds = delivery_with_status(delivery, event)
    return ds.where(~F.col("status").eqNullSafe(F.lit(FINAL_STATUS)))


def available_couriers(courier: DataFrame, delivery: DataFrame, event: DataFrame) -> DataFrame:
    """Couriers with no active delivery (no deliveries at all counts as
    available).  Anti-join on courier id; the active set is one row per
    delivery, shuffled on courier id once."""
    active = active_deliveries(delivery, event).select(F.col("courier_id"))
    return courier.join(active, courier.id == active.courier_id, "left_anti")


def courier_all_delivered(courier: DataFrame, delivery: DataFrame, event: DataFrame) -> DataFrame:
    """A3: per courier, whether every one of its deliveries is DELIVERED.

    Aggregate deliveries per courier first, then left-join couriers and
    default to true: a courier without deliveries is vacuously available
    (aggregating after the join would turn its null row into false).
    """
    ds = delivery_with_status(delivery, event)
    per_courier = ds.groupBy("courier_id").agg(
        F.bool_and(F.coalesce(F.col("status") == F.lit(FINAL_STATUS), F.lit(False))).alias("all_delivered"),
        F.count(F.lit(1)).alias("n_deliveries"),
    )
    return (
        courier.select(F.col("id").alias("courier_id"))
        .join(per_courier, "courier_id", "left")
        .select(
            "courier_id",
            F.coalesce("all_delivered", F.lit(True)).alias("all_delivered"),
            F.coalesce("n_deliveries", F.lit(0)).cast("bigint").alias("n_deliveries"),
        )
    )


def courier_busy(delivery: DataFrame, event: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """A4: per courier with deliveries, whether any is active.

    ``exclude`` optionally carries (courier_id, exclude_delivery_id) pairs:
    that delivery is ignored for that courier (re-pointing a delivery must
    not count the delivery itself).
    """
    ds = delivery_with_status(delivery, event)
    if exclude is not None:
        ex = exclude.select("courier_id", "exclude_delivery_id")
        ds = ds.join(ex, "courier_id", "left").where(~F.col("id").eqNullSafe(F.col("exclude_delivery_id")))
    return ds.groupBy("courier_id").agg(
        F.bool_or(~F.col("status").eqNullSafe(F.lit(FINAL_STATUS))).alias("busy"))
