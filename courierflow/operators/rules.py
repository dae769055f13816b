"""Rule checks (V1-V10): each splits its input into accepted rows and
rejected rows with a reason.

Row-level rules are plain expressions (codegen, no UDF).  Cross-row rules
(existence, uniqueness, duplicates, busy couriers) are anti/semi joins or a
per-key aggregate joined back, so no rule ever forms pairs of rows.  When
several rules apply, the reason is the first failing rule in the original
handler's order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.functions.status import status_ordinal
from courierflow.operators.availability import courier_busy  # noqa: F401 (re-export)
from courierflow.schema import (EMAIL_MAX_LEN, KITCHEN_TYPE_MAX_LEN, NAME_MAX_LEN, PHONE_MAX_LEN,
                                REASON_BAD_QUANTITY, REASON_COURIER_BUSY, REASON_COURIER_NOT_FOUND,
                                REASON_DELIVERY_NOT_FOUND, REASON_DUP_ITEM, REASON_ITEM_NOT_IN_RESTAURANT,
                                REASON_NO_ITEMS, REASON_ORDER_HAS_DELIVERY, REASON_ORDER_NOT_FOUND,
                                REASON_RESTAURANT_NOT_FOUND, REASON_USER_NOT_FOUND, VEHICLE_TYPES)

# Simple structural e-mail pattern: local@domain.tld, no spaces.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def first_failing(rules: list[tuple[Column, str]]) -> Column:
    """Reason of the first rule whose ``ok`` condition is not true (null
    counts as failing); null when every rule passes."""
    expr = None
    for ok, reason in rules:
        expr = (F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) if expr is None
                else expr.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)))
    return expr


def split(df: DataFrame, reason_col: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason_col).isNull()).drop(reason_col), df.where(F.col(reason_col).isNotNull())


# -- V1 foreign keys -----------------------------------------------------------

def fk_violations(child: DataFrame, fk_col: str, parent: DataFrame, parent_col: str = "id") -> DataFrame:
    """Child rows whose non-null FK has no parent (anti-join)."""
    p = parent.select(F.col(parent_col).alias(fk_col))
    return child.where(F.col(fk_col).isNotNull()).join(p, fk_col, "left_anti")


def fk_summary(specs: list[tuple[str, DataFrame, str, DataFrame]]) -> DataFrame:
    """Per FK (name, child, fk column, parent): rows checked, violations."""
    parts = []
    for name, child, col, parent in specs:
        p = parent.select(F.col("id").alias(col)).distinct().withColumn("_hit", F.lit(True))
        c = child.select(col).join(p, col, "left")
        parts.append(c.agg(
            F.count(F.col(col)).alias("n_checked"),
            F.count(F.when(F.col(col).isNotNull() & F.col("_hit").isNull(), 1)).alias("n_violations"),
        ).select(F.lit(name).alias("fk"), "n_checked", "n_violations"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# -- V2 uniqueness -----------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once (partial aggregation, no window)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_split(batch: DataFrame, existing: DataFrame, keys: list[str], arrival: list[str],
                 reason: str = "Duplicate key.") -> DataFrame:
    """Intake uniqueness: a batch row is rejected when its key already
    exists in the table, or when an earlier row of the batch has the same key
    (first arrival wins).  Per-key minimum arrival, joined back (n:1)."""
    arr = F.struct(*[F.col(c) for c in arrival])
    first = batch.groupBy(*keys).agg(F.min(arr).alias("_first"))
    ex = existing.select(*keys).distinct().withColumn("_exists", F.lit(True))
    out = batch.join(first, keys, "left").join(ex, keys, "left")
    bad = F.coalesce(F.col("_exists"), F.lit(False)) | (arr != F.col("_first"))
    return out.withColumn("reject_reason", F.when(bad, F.lit(reason))).drop("_first", "_exists")


# -- V3-V6 row rules -----------------------------------------------------------

def check_price(item: DataFrame) -> DataFrame:
    """V3: price >= 0 (and present)."""
    return item.withColumn("reject_reason", first_failing([(F.col("price") >= 0, "Price must be non-negative.")]))


def check_quantity(lines: DataFrame) -> DataFrame:
    """V4: quantity defaults to 1 and must be > 0."""
    return lines.withColumn("quantity", F.coalesce("quantity", F.lit(1))).withColumn(
        "reject_reason", first_failing([(F.col("quantity") > 0, REASON_BAD_QUANTITY)]))


def check_courier_row(courier: DataFrame) -> DataFrame:
    """V5 for couriers: vehicle enum, name length, coordinates present."""
    return courier.withColumn("reject_reason", first_failing([
        (F.col("name").isNotNull() & (F.length("name") <= NAME_MAX_LEN), "Invalid name."),
        (F.col("vehicle").isin(*VEHICLE_TYPES), "Invalid vehicle."),
        (F.col("lat").isNotNull() & F.col("lon").isNotNull(), "Missing coordinates."),
    ]))


def check_user_row(users: DataFrame) -> DataFrame:
    """V5 + V6 for users: name and e-mail lengths, e-mail format."""
    return users.withColumn("reject_reason", first_failing([
        (F.col("name").isNotNull() & (F.length("name") <= NAME_MAX_LEN), "Invalid name."),
        (F.col("email").isNotNull() & (F.length("email") <= EMAIL_MAX_LEN), "Invalid email."),
        (F.col("email").rlike(EMAIL_PATTERN), "Invalid email."),
    ]))


def check_kitchen_row(kitchen: DataFrame) -> DataFrame:
    return kitchen.withColumn("reject_reason", first_failing([
        (F.col("type").isNotNull() & (F.length("type") <= KITCHEN_TYPE_MAX_LEN), "Invalid kitchen type.")]))


def check_name_row(rows: DataFrame) -> DataFrame:
    """V5 for restaurants, items and regions: name present and not too long."""
    return rows.withColumn("reject_reason", first_failing([
        (F.col("name").isNotNull() & (F.length("name") <= NAME_MAX_LEN), "Invalid name.")]))


def check_phone_row(phones: DataFrame) -> DataFrame:
    return phones.withColumn("reject_reason", first_failing([
        (F.col("phone").isNotNull() & (F.length("phone") <= PHONE_MAX_LEN), "Invalid phone.")]))


def check_status_row(event: DataFrame) -> DataFrame:
    return event.withColumn("reject_reason", first_failing([
        (status_ordinal("status").isNotNull(), "Invalid status.")]))


# -- V7 order intake -------------------------------------------------------------

def validate_order_payload(orders: DataFrame, lines: DataFrame, restaurant: DataFrame, users: DataFrame,
                           item: DataFrame) -> DataFrame:
    """V7: one row per order payload (order_id, restaurant_id, user_id) with
    its lines (order_id, line_no, item_id, quantity).  Rules, first failing
    wins: payload shape (>= 1 line, every quantity >= 1) -> restaurant exists
    -> user exists -> per line in payload order: not a repeat of an earlier
    line's item, then item exists in the order's restaurant."""
    first_line = lines.groupBy("order_id", "item_id").agg(F.min("line_no").alias("_first_line"))
    it = item.select(F.col("id").alias("item_id"), F.col("restaurant_id").alias("_item_rest"))
    o = orders.select("order_id", F.col("restaurant_id").alias("_order_rest"))
    ln = (lines.join(first_line, ["order_id", "item_id"], "left")
          .join(o, "order_id", "left").join(it, "item_id", "left"))
    # (line_no, check) keyed failures: check 0 duplicate, check 1 foreign item
    line_fail = F.when(F.col("line_no") > F.col("_first_line"), F.struct(
        F.col("line_no").alias("line_no"), F.lit(0).alias("check"), F.lit(REASON_DUP_ITEM).alias("reason"))) \
        .when(~F.col("_item_rest").eqNullSafe(F.col("_order_rest")), F.struct(
            F.col("line_no").alias("line_no"), F.lit(1).alias("check"),
            F.lit(REASON_ITEM_NOT_IN_RESTAURANT).alias("reason")))
    per_order = ln.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_and(F.coalesce(F.col("quantity"), F.lit(1)) >= 1).alias("qty_ok"),
        F.min(line_fail).alias("line_fail"),
    )
    r = restaurant.select(F.col("id").alias("restaurant_id"), F.lit(True).alias("_r_ok"))
    u = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_u_ok"))
    out = orders.join(per_order, "order_id", "left").join(r, "restaurant_id", "left").join(u, "user_id", "left")
    reason = (F.when(F.coalesce("n_lines", F.lit(0)) < 1, F.lit(REASON_NO_ITEMS))
              .when(~F.col("qty_ok"), F.lit(REASON_BAD_QUANTITY))
              .when(F.col("_r_ok").isNull(), F.lit(REASON_RESTAURANT_NOT_FOUND))
              .when(F.col("_u_ok").isNull(), F.lit(REASON_USER_NOT_FOUND))
              .otherwise(F.col("line_fail.reason")))
    return out.select("order_id", "restaurant_id", "user_id",
                      F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
                      reason.alias("reject_reason"),
                      F.col("line_fail.line_no").alias("failed_line"))


# -- V8 stored-order audit ---------------------------------------------------------

def audit_order_items(orders: DataFrame, order_item: DataFrame, item: DataFrame) -> DataFrame:
    """V8: stored orders with no lines, or with lines whose item belongs to
    another restaurant (possible after an order's restaurant is patched)."""
    it = item.select(F.col("id").alias("item_id"), F.col("restaurant_id").alias("_item_rest"))
    o = orders.select(F.col("id").alias("order_id"), F.col("restaurant_id").alias("_order_rest"))
    per = order_item.join(o, "order_id", "inner").join(it, "item_id", "left").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(~F.col("_item_rest").eqNullSafe(F.col("_order_rest")), 1)).alias("n_foreign"))
    out = orders.select(F.col("id").alias("order_id")).join(per, "order_id", "left").select(
        "order_id", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("n_foreign", F.lit(0)).cast("bigint").alias("n_foreign_items"))
    problem = F.when(F.col("n_lines") == 0, F.lit("no items")).when(F.col("n_foreign_items") > 0, F.lit("foreign items"))
    return out.withColumn("problem", problem).where(F.col("problem").isNotNull())


# -- V9 / V10 delivery intake -------------------------------------------------------

def _flags(requests: DataFrame, orders: DataFrame, courier: DataFrame, delivery: DataFrame) -> DataFrame:
    o = orders.select(F.col("id").alias("order_id"), F.lit(True).alias("_order_ok"))
    c = courier.select(F.col("id").alias("courier_id"), F.lit(True).alias("_courier_ok"))
    has = delivery.select(F.col("order_id"), F.lit(True).alias("_has_delivery")).dropDuplicates(["order_id"])
    return requests.join(o, "order_id", "left").join(c, "courier_id", "left").join(has, "order_id", "left")


def validate_delivery_request(requests: DataFrame, orders: DataFrame, courier: DataFrame,
                              delivery: DataFrame, event: DataFrame) -> DataFrame:
    """V9: (order_id, courier_id, ...) requests.  Order exists -> courier
    exists -> order has no delivery -> courier not busy."""
    busy = courier_busy(delivery, event)
    f = _flags(requests, orders, courier, delivery).join(busy, "courier_id", "left")
    reason = first_failing([
        (F.col("_order_ok"), REASON_ORDER_NOT_FOUND),
        (F.col("_courier_ok"), REASON_COURIER_NOT_FOUND),
        (F.col("_has_delivery").isNull(), REASON_ORDER_HAS_DELIVERY),
        (~F.coalesce(F.col("busy"), F.lit(False)), REASON_COURIER_BUSY),
    ])
    return f.withColumn("reject_reason", reason).drop("_order_ok", "_courier_ok", "_has_delivery", "busy")


def validate_delivery_update(patches: DataFrame, delivery: DataFrame, orders: DataFrame,
                             courier: DataFrame, event: DataFrame) -> DataFrame:
    """(delivery_id, order_id?, courier_id?) re-points.  Delivery exists
    -> new order exists (when given) -> new courier not busy, not counting
    this delivery (when given) -> new courier exists.  An unknown courier has
    no deliveries, so it passes the busy test and fails on existence."""
    d = delivery.select(F.col("id").alias("delivery_id"), F.lit(True).alias("_delivery_ok"))
    o = orders.select(F.col("id").alias("order_id"), F.lit(True).alias("_order_ok"))
    c = courier.select(F.col("id").alias("courier_id"), F.lit(True).alias("_courier_ok"))
    # the exclusion differs per patch, so "busy" is decided per (patch, courier)
    busy_pp = _busy_per_patch(patches, delivery, event)
    f = (patches.join(d, "delivery_id", "left").join(o, "order_id", "left")
         .join(c, "courier_id", "left").join(busy_pp, ["delivery_id", "courier_id"], "left"))
    reason = first_failing([
        (F.col("_delivery_ok"), REASON_DELIVERY_NOT_FOUND),
        (F.col("order_id").isNull() | F.col("_order_ok"), REASON_ORDER_NOT_FOUND),
        (F.col("courier_id").isNull() | ~F.coalesce(F.col("busy"), F.lit(False)), REASON_COURIER_BUSY),
        (F.col("courier_id").isNull() | F.col("_courier_ok"), REASON_COURIER_NOT_FOUND),
    ])
    return f.withColumn("reject_reason", reason).drop("_delivery_ok", "_order_ok", "_courier_ok", "busy")


def _busy_per_patch(patches: DataFrame, delivery: DataFrame, event: DataFrame) -> DataFrame:
    """busy(courier, excluding delivery) for each patch without pairing
    deliveries: per courier, count active deliveries; subtract the patch's own
    delivery when it is one of them."""
    from courierflow.operators.availability import active_deliveries
    active = active_deliveries(delivery, event).select(F.col("id").alias("active_id"), "courier_id")
    n_active = active.groupBy("courier_id").agg(F.count(F.lit(1)).alias("_n_active"))
    p = patches.where(F.col("courier_id").isNotNull()).select("delivery_id", "courier_id").distinct()
    own = p.join(active.withColumnRenamed("active_id", "delivery_id"), ["delivery_id", "courier_id"], "left_semi") \
        .withColumn("_own", F.lit(1))
    return (p.join(n_active, "courier_id", "left").join(own, ["delivery_id", "courier_id"], "left")
            .select("delivery_id", "courier_id",
                    ((F.coalesce("_n_active", F.lit(0)) - F.coalesce("_own", F.lit(0))) > 0).alias("busy")))
