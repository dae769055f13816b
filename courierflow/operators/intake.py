"""Batch intake of kitchens, restaurants, users with phones and orders with
lines (M1), and patches of items, kitchens and orders (M2).

Every function takes a batch of requests and gives the accepted rows, as they
go into the tables, and one outcome per request (``reject_reason`` null:
accepted).  A batch is one statement: requests compete in arrival order, only
requests that pass their own checks hold a unique value, and a value that
a patch gives up is free from the next batch on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.operators import merge as mg
from courierflow.operators import rules as ru
from courierflow.schema import (NAME_MAX_LEN, PHONE_MAX_LEN, REASON_CONFLICT, REASON_ITEM_NOT_FOUND, REASON_KITCHEN_MISSING,
                                REASON_KITCHEN_NOT_FOUND, REASON_RESTAURANT_NOT_FOUND)
from courierflow.session import written


def _accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def _first_valid(checked: DataFrame, existing: DataFrame, key: str, arrival: list[str], reason: str) -> DataFrame:
    """Uniqueness among the rows that are valid so far: the table's rows first, then by arrival."""
    unique = ru.unique_split(_accepted(checked), existing, [key], arrival, reason)
    return unique.unionByName(checked.where(F.col("reject_reason").isNotNull()))


def insert_kitchens(batch: DataFrame, kitchen: DataFrame, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """M1, kitchens (``type``): present, not too long, unique."""
    checked = _first_valid(ru.check_kitchen_row(batch), kitchen, "type", arrival, REASON_CONFLICT.format(entity="Kitchen"))
    return mg.assign_ids(_accepted(checked), arrival, kitchen), checked


def insert_restaurants(batch: DataFrame, restaurant: DataFrame, kitchen: DataFrame, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """M1, restaurants (``name, lat, lon, kitchen_type_id``): known kitchen type, then name and coordinates."""
    known = kitchen.select(F.col("id").alias("kitchen_type_id"), F.lit(True).alias("_known"))
    checked = batch.join(known, "kitchen_type_id", "left").withColumn("reject_reason", ru.first_failing([
        (F.col("_known").isNotNull(), REASON_KITCHEN_NOT_FOUND),
        (F.col("name").isNotNull() & (F.length("name") <= NAME_MAX_LEN), "Invalid name."),
        (F.col("lat").isNotNull() & F.col("lon").isNotNull(), "Missing coordinates."),
    ])).select(*batch.columns, "reject_reason")
    return mg.assign_ids(_accepted(checked), arrival, restaurant), checked


def _phones_ok(phones: Column) -> Column:
    """Phones are present, not too long and not repeated within the user."""
    whole = F.forall(phones, lambda p: p.isNotNull() & (F.length(p) <= PHONE_MAX_LEN))
    return whole & (F.size(F.array_distinct(phones)) == F.size(phones))


def insert_users(batch: DataFrame, users: DataFrame, arrival: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1, users with ``phones`` (array, null: none): a user and all its phones, or neither.
    Returns (new users, new phones, outcomes)."""
    conflict = REASON_CONFLICT.format(entity="User")
    listed = batch.withColumn("phones", F.coalesce("phones", F.array().cast("array<string>")))
    checked = ru.check_user_row(listed).withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(~_phones_ok(F.col("phones")), F.lit(conflict))))
    checked = _first_valid(checked, users, "email", arrival, conflict)
    fresh = mg.assign_ids(_accepted(checked), arrival, users)
    return fresh.drop("phones"), fresh.select(F.col("id").alias("user_id"), F.explode("phones").alias("phone")), checked


def insert_orders(requests: DataFrame, lines: DataFrame, orders: DataFrame, restaurant: DataFrame, users: DataFrame,
                  item: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1, orders with lines: a request (``order_id``, its arrival number, ``restaurant_id, user_id``)
    and all its lines (``order_id, line_no, item_id, quantity``), or neither; rules of V7.
    Returns (new orders with their ``request_id``, new lines, outcomes)."""
    checked = written(ru.validate_order_payload(requests, lines, restaurant, users, item), "checked-orders")
    fresh = mg.assign_ids(_accepted(checked), ["order_id"], orders).select(
        "id", F.col("order_id").alias("request_id"), "restaurant_id", "user_id")
    ids = fresh.select("request_id", F.col("id").alias("_id"))
    own = lines.join(ids, lines["order_id"] == F.col("request_id")).select(
        F.col("_id").alias("order_id"), "item_id", F.coalesce("quantity", F.lit(1)).alias("quantity"))
    return fresh, own, checked


def patch_items(patches: DataFrame, item: DataFrame, restaurant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2, items (``id, name, price, restaurant_id``, null: keep): item and restaurant known, name
    not too long, price not negative.  Returns (new table, rejected patches)."""
    return mg.apply_patches(
        item, patches, "id", ["name", "price", "restaurant_id"],
        fk_checks=[("restaurant_id", restaurant, REASON_RESTAURANT_NOT_FOUND)], not_found_reason=REASON_ITEM_NOT_FOUND,
        row_checks=[(F.coalesce(F.length("name") <= NAME_MAX_LEN, F.lit(True)) & F.coalesce(F.col("price") >= 0, F.lit(True)),
                     REASON_CONFLICT.format(entity="Item"))])


def patch_kitchens(patches: DataFrame, kitchen: DataFrame, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """M2, kitchens (``id, type``): kitchen known, type present and not too long, and neither
    another kitchen's nor asked for by an earlier valid patch; its own type may be sent
    again.  Returns (new table, outcomes)."""
    conflict = REASON_CONFLICT.format(entity="Kitchen")
    known = kitchen.select("id", F.lit(True).alias("_known"))
    holder = kitchen.select("type", F.col("id").alias("_holder"))
    checked = ru.check_kitchen_row(patches.join(known, "id", "left").join(holder, "type", "left"))
    checked = checked.withColumn("reject_reason", F.when(F.col("_known").isNull(), F.lit(REASON_KITCHEN_MISSING)).otherwise(
        F.coalesce("reject_reason", F.when(F.col("_holder") != F.col("id"), F.lit(conflict))))).select(*patches.columns, "reject_reason")
    checked = _first_valid(checked, kitchen.select("type").where("1 = 0"), "type", arrival, conflict)
    new, _ = mg.apply_patches(kitchen, _accepted(checked), "id", ["type"], not_found_reason=REASON_KITCHEN_MISSING)
    return new, checked


def patch_orders(patches: DataFrame, orders: DataFrame, order_item: DataFrame, restaurant: DataFrame, users: DataFrame,
                 item: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M2/M3, orders (``order_id, restaurant_id, user_id, items``, null: keep): items are checked
    against the restaurant that the order has after the patch; without items the stored lines
    stay, whatever the restaurant.  Returns (new orders, new lines, outcomes)."""
    checked = written(mg.check_order_patches(patches, orders, item, restaurant, users), "checked-patches")
    good = _accepted(checked)
    new, _ = mg.apply_patches(orders, good.select(F.col("order_id").alias("id"), "restaurant_id", "user_id"), "id", ["restaurant_id", "user_id"])
    return new, mg.replace_order_items(order_item, good.select("order_id", "items")), checked
