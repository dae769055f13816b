"""Read views over the delivery tables (P1-P8, C1-C8, C12, C14, C15, A7, A9,
T1-T4).

The web handlers answered these one row at a time with a query per
relationship hop (N+1).  Here each is one set-oriented plan: every
one-row-per-key input (latest status, last position, per-order aggregates) is
reduced *before* it is joined, so joins stay 1:1 or n:1 and never multiply
rows.  Join strategies are left to AQE, which broadcasts a side only after
measuring it below ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and
otherwise keeps the sort-merge join (skewed partitions are split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.functions.values import money_to_float
from courierflow.operators.availability import latest_status
from courierflow.operators.ranking import rank_within_key


# -- projections and filters --------------------------------------------------

def kitchen_list(kitchen_type: DataFrame) -> DataFrame:
    """P1."""
    return kitchen_type.select("id", "type")


def courier_list(courier: DataFrame) -> DataFrame:
    """P2."""
    return courier.select("id", "name", "vehicle", "lat", "lon")


def event_view(event: DataFrame) -> DataFrame:
    """P3."""
    return event.select("id", "status", "updated_at", "delivery_id")


def lookup_by_ids(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Batch form of get-or-404: every requested id with a ``found`` flag
    and the matching row's columns (null when missing)."""
    req = ids.select(F.col(id_col).alias("req_id")).distinct()
    t = table.withColumn("_found", F.lit(True))
    out = req.join(t, req.req_id == t[id_col], "left")
    return out.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found", id_col) \
        .withColumnRenamed("req_id", id_col)


def missing_ids(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Requested ids with no row (anti-join)."""
    req = ids.select(F.col(id_col)).distinct()
    return req.join(table.select(id_col), id_col, "left_anti")


def restaurants_by_kitchen(restaurant: DataFrame, kitchen_type_id: int | None = None) -> DataFrame:
    """P5: optional equality filter; ``None`` means no filter.  The predicate
    is a plain comparison so it reaches the parquet / JDBC scan."""
    if kitchen_type_id is not None:
        restaurant = restaurant.where(F.col("kitchen_type_id") == F.lit(kitchen_type_id))
    return restaurant.select("id", "name", "lat", "lon", "kitchen_type_id")


def orders_of_existing_users(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders whose user exists (the user lookup precedes the listing)."""
    return orders.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")


def user_order_lookup(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """(user_id, order_id) requests; an order of another user counts as
    not found.  Semi-join on both keys, flag via left join."""
    o = orders.select(F.col("id").alias("order_id"), "user_id", F.lit(True).alias("_hit"))
    return pairs.join(o, ["user_id", "order_id"], "left") \
        .select("user_id", "order_id", F.coalesce("_hit", F.lit(False)).alias("found"))


def deliveries_of_courier(delivery: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (courier_id, exclude_delivery_id), how many deliveries
    the courier has apart from the excluded one.  Counted per courier first,
    so no pairs of deliveries are ever formed."""
    per_courier = delivery.groupBy("courier_id").agg(F.count(F.lit(1)).alias("_n"))
    excluded_own = requests.join(
        delivery.select(F.col("id").alias("exclude_delivery_id"), F.col("courier_id").alias("_owner")),
        "exclude_delivery_id", "left")
    return excluded_own.join(per_courier, "courier_id", "left").select(
        "courier_id", "exclude_delivery_id",
        (F.coalesce("_n", F.lit(0)) - F.when(F.col("_owner") == F.col("courier_id"), 1).otherwise(0))
        .cast("bigint").alias("n_deliveries"))


def courier_delivery_list(delivery: DataFrame, requests: DataFrame) -> DataFrame:
    """P8 (listing): the deliveries of each request's courier apart from the
    excluded one.  Requests are one row per courier, so the result has at
    most one row per delivery."""
    d = delivery.select("courier_id", F.col("id").alias("delivery_id"), "order_id")
    return requests.join(d, "courier_id").where(~F.col("delivery_id").eqNullSafe(F.col("exclude_delivery_id"))) \
        .select("courier_id", "exclude_delivery_id", "delivery_id", "order_id")


# -- joins ------------------------------------------------------------------

def restaurant_kitchen(restaurant: DataFrame, kitchen_type: DataFrame, nested: bool = False) -> DataFrame:
    """Restaurant with its kitchen type."""
    k = kitchen_type.select(F.col("id").alias("kitchen_type_id"), F.col("type").alias("kitchen_type"))
    out = restaurant.join(k, "kitchen_type_id", "inner")
    if nested:
        return out.select("id", "name", "lat", "lon",
                          F.struct(F.col("kitchen_type_id").alias("id"), F.col("kitchen_type").alias("type"))
                          .alias("kitchen_type"))
    return out.select("id", "name", "lat", "lon", "kitchen_type_id", "kitchen_type")


def restaurant_menu(restaurant: DataFrame, item: DataFrame) -> DataFrame:
    """C2 (relational form): one row per (restaurant, menu item); a restaurant
    without items keeps one row with null item columns."""
    i = item.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"),
                    money_to_float("price").alias("item_price"), "restaurant_id")
    r = restaurant.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"))
    return r.join(i, "restaurant_id", "left")


def restaurant_menu_nested(restaurant: DataFrame, item: DataFrame) -> DataFrame:
    """C2 (document form): menu as an id-sorted array; ``[]`` when empty.
    The array is one output value per restaurant, so use it only where a
    menu is the requested payload."""
    menu = item.groupBy("restaurant_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("id"), F.col("name"), money_to_float("price").alias("price")))).alias("items"))
    return restaurant.join(menu, restaurant.id == menu.restaurant_id, "left") \
        .select(restaurant.id, restaurant.name, F.coalesce("items", F.array()).alias("items"))


def item_restaurant(item: DataFrame, restaurant: DataFrame) -> DataFrame:
    """Item with restaurant reference, price as float."""
    r = restaurant.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"))
    return item.join(r, "restaurant_id", "inner").select(
        "id", "name", money_to_float("price").alias("price"), "restaurant_id", "restaurant_name")


def delivery_courier(delivery: DataFrame, orders: DataFrame, courier: DataFrame) -> DataFrame:
    """C4: delivery with its order id and courier reference."""
    o = orders.select(F.col("id").alias("order_id"))
    c = courier.select(F.col("id").alias("courier_id"), F.col("name").alias("courier_name"),
                       F.col("vehicle").alias("courier_vehicle"))
    return delivery.join(o, "order_id", "inner").join(c, "courier_id", "inner") \
        .select("id", "order_id", "courier_id", "courier_name", "courier_vehicle")


def order_header(orders: DataFrame, restaurant: DataFrame, users: DataFrame) -> DataFrame:
    """Order with restaurant and user references (one row per order)."""
    r = restaurant.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"))
    u = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"),
                     F.col("name").alias("user_name"))
    return orders.join(r, "restaurant_id", "inner").join(u, "user_id", "inner")


def order_lines(orders: DataFrame, order_item: DataFrame, item: DataFrame,
                restaurant: DataFrame, users: DataFrame) -> DataFrame:
    """One row per order line with item, restaurant and user references."""
    i = item.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"),
                    money_to_float("price").alias("item_price"))
    lines = order_item.join(i, "item_id", "inner")
    h = order_header(orders, restaurant, users).withColumnRenamed("id", "order_id")
    return h.join(lines, "order_id", "inner").select(
        "order_id", "restaurant_id", "restaurant_name", "user_id", "user_email", "user_name",
        "created_at", "item_id", "item_name", "item_price", "quantity")


def order_line_totals(order_item: DataFrame, item: DataFrame) -> DataFrame:
    """Per order: number of lines, total quantity, total value.  Partial
    aggregation before the shuffle, so a huge order is reduced map-side."""
    i = item.select(F.col("id").alias("item_id"), F.col("price"))
    return order_item.join(i, "item_id", "left").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        F.sum(F.col("price") * F.col("quantity")).cast("double").alias("total_value"),
    )


def last_location(position: DataFrame) -> DataFrame:
    """Newest position per courier (later arrival wins a timestamp tie,
    as a second put under the same key overwrites the first)."""
    newest = F.max_by(F.struct("ts", "delivery_id", "lat", "lon"), F.struct("ts", "arrival_seq"))
    return position.groupBy("courier_id").agg(newest.alias("p")).select(
        "courier_id", F.col("p.ts").alias("ts"), F.col("p.delivery_id").alias("delivery_id"),
        F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def delivery_side(delivery: DataFrame, courier: DataFrame, event: DataFrame,
                  position: DataFrame | None = None, with_location: bool = True) -> DataFrame:
    """Everything the tracking view needs about an order's delivery, one row
    per order_id: delivery ⟕ latest status (on delivery id) ⟕ courier ⟕ last
    courier position (both fleet-sized, on courier id)."""
    d = delivery.select(F.col("id").alias("delivery_id"), "order_id", "courier_id")
    st = latest_status(event).select("delivery_id", "status")
    c = courier.select(F.col("id").alias("courier_id"), F.col("name").alias("courier_name"),
                       F.col("vehicle").alias("courier_vehicle"))
    out = d.join(st, "delivery_id", "left").join(c, "courier_id", "left")
    if with_location and position is not None:
        loc = last_location(position).select(
            "courier_id", F.col("ts").alias("location_ts"), F.col("delivery_id").alias("location_delivery_id"),
            F.col("lat").alias("location_lat"), F.col("lon").alias("location_lon"))
        return out.join(loc, "courier_id", "left")
    return (out.withColumn("location_ts", F.lit(None).cast("timestamp_ntz"))
            .withColumn("location_delivery_id", F.lit(None).cast("string"))
            .withColumn("location_lat", F.lit(None).cast("double"))
            .withColumn("location_lon", F.lit(None).cast("double")))


def order_tracking(orders: DataFrame, order_item: DataFrame, item: DataFrame, restaurant: DataFrame,
                   users: DataFrame, delivery: DataFrame, courier: DataFrame, event: DataFrame,
                   position: DataFrame | None = None, with_location: bool = True) -> DataFrame:
    """The full order view, one row per order.

    The delivery side (delivery, status, courier, last position) is
    assembled first and keyed by order id, so the wide order rows are joined
    to it and to the per-order line totals on one key: after the (n:1) user
    join, the order side is shuffled once by order id.  Every right side is
    already one row per join key, so no join multiplies rows.
    ``with_location=False`` leaves the location null (listing form).
    """
    h = order_header(orders, restaurant, users)
    totals = order_line_totals(order_item, item).withColumnRenamed("order_id", "id")
    ds = delivery_side(delivery, courier, event, position, with_location).withColumnRenamed("order_id", "id")
    out = h.join(totals, "id", "left").join(ds, "id", "left")
    return out.select(
        "id", "restaurant_id", "restaurant_name", "user_id", "user_email", "user_name", "created_at",
        F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("total_quantity", F.lit(0)).cast("bigint").alias("total_quantity"),
        F.coalesce("total_value", F.lit(0.0)).alias("total_value"),
        "delivery_id", "courier_id", "courier_name", "courier_vehicle", "status",
        "location_ts", "location_delivery_id", "location_lat", "location_lon")


def user_order_tracking(tracking: DataFrame) -> DataFrame:
    """C7 + T1: the tracking view keyed by user, newest first (rank 1 =
    newest; ties on created_at broken by higher order id)."""
    ranked = rank_within_key(tracking, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], out="recency_rank")
    return ranked.select(
        "user_id", F.col("id").alias("order_id"), "recency_rank", "restaurant_id", "restaurant_name",
        "created_at", "n_lines", "total_quantity", "total_value", "courier_id", "courier_name",
        "courier_vehicle", "status", "location_ts", "location_lat", "location_lon")


def user_phones(users: DataFrame, phones: DataFrame) -> DataFrame:
    """User with sorted phone list (empty list when none).  A user's
    phones are a handful of rows; the list is the response payload."""
    p = phones.groupBy("user_id").agg(F.array_sort(F.collect_list("phone")).alias("phones"))
    return users.join(p, users.id == p.user_id, "left").select(
        users.id, users.name, users.email, F.coalesce("phones", F.array().cast("array<string>")).alias("phones"))


def order_event_timeline(orders: DataFrame, delivery: DataFrame, event: DataFrame) -> DataFrame:
    """C12 + T2: events of each order's delivery, newest first (rank 1 =
    newest, ties on updated_at by higher event id).  Orders without a
    delivery yield no rows."""
    d = delivery.select(F.col("id").alias("delivery_id"), "order_id")
    o = orders.select(F.col("id").alias("order_id"))
    ev = event.join(d, "delivery_id", "inner").join(o, "order_id", "inner")
    ranked = rank_within_key(ev, ["order_id"], [F.col("updated_at").desc(), F.col("id").desc()], out="timeline_rank")
    return ranked.select("order_id", "timeline_rank", F.col("id").alias("event_id"), "status", "updated_at", "delivery_id")


def orders_without_delivery(orders: DataFrame, delivery: DataFrame) -> DataFrame:
    """C14."""
    return orders.join(delivery.select(F.col("order_id").alias("id")), "id", "left_anti")


def line_item_check(order_item_raw: DataFrame, orders: DataFrame, item: DataFrame) -> DataFrame:
    """Each payload line with whether its item exists and belongs to
    the order's restaurant (null-safe comparison)."""
    o = orders.select(F.col("id").alias("order_id"), F.col("restaurant_id").alias("order_restaurant_id"))
    i = item.select(F.col("id").alias("item_id"), F.col("restaurant_id").alias("item_restaurant_id"))
    return order_item_raw.join(o, "order_id", "left").join(i, "item_id", "left").select(
        "order_id", "line_no", "item_id",
        F.col("item_restaurant_id").isNotNull().alias("item_found"),
        F.col("item_restaurant_id").eqNullSafe(F.col("order_restaurant_id")).alias("in_restaurant"))


def order_items_nested(order_item: DataFrame, item: DataFrame) -> DataFrame:
    """Lines of each order as an item-id-sorted array of structs.  The
    array is the order's response payload (one value per order)."""
    i = item.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"),
                    money_to_float("price").alias("item_price"))
    return order_item.join(i, "item_id", "inner").groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("item_id", "item_name", "item_price", "quantity"))).alias("items"))


def duplicate_items(order_item_raw: DataFrame) -> DataFrame:
    """(order, item) pairs listed more than once in a payload."""
    return order_item_raw.groupBy("order_id", "item_id").agg(F.count(F.lit(1)).alias("n_lines")) \
        .where(F.col("n_lines") > 1)


def delivery_track(position: DataFrame) -> DataFrame:
    """T4: positions of each delivery in time order (secondary access path).
    Ranked with the skew-safe numbering, ties by arrival."""
    p = position.where(F.col("delivery_id").isNotNull())
    ranked = rank_within_key(p, ["delivery_id"], ["ts", "arrival_seq"], out="seq")
    return ranked.select("delivery_id", "seq", "ts", "courier_id", "lat", "lon")


# -- single-key lookups (the request-time forms of T3, T4, P6) ------------------

def last_location_of(position: DataFrame, courier_id: int) -> DataFrame:
    """T3 for one courier: descending range read with limit 1.  The filter
    reaches the scan; ordering + limit plan as a top-1 (TakeOrderedAndProject)."""
    return (position.where(F.col("courier_id") == F.lit(courier_id))
            .orderBy(F.col("ts").desc(), F.col("arrival_seq").desc()).limit(1)
            .select("courier_id", "ts", "delivery_id", "lat", "lon"))


def track_of(position: DataFrame, delivery_id: str) -> DataFrame:
    """T4 for one delivery: its positions in time order."""
    return (position.where(F.col("delivery_id") == F.lit(delivery_id))
            .orderBy("ts", "arrival_seq").select("delivery_id", "ts", "courier_id", "lat", "lon"))


def orders_of_user(orders: DataFrame, user_id: int) -> DataFrame:
    """P6 for one user: newest first (ties by higher id)."""
    return (orders.where(F.col("user_id") == F.lit(user_id))
            .orderBy(F.col("created_at").desc(), F.col("id").desc()))
