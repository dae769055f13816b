"""Checked queries: rule checks V1-V10."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from courierflow.operators import rules as ru
from courierflow.plans.catalog import register
from courierflow.plans.oracle_views import oracle
from courierflow.sources.fixtures import tables

FKS = [  # (name, child, fk column, parent)
    ("users.region_id", "users", "region_id", "region"),
    ("phones.user_id", "phones", "user_id", "users"),
    ("restaurant.kitchen_type_id", "restaurant", "kitchen_type_id", "kitchen_type"),
    ("restaurant.region_id", "restaurant", "region_id", "region"),
    ("item.restaurant_id", "item", "restaurant_id", "restaurant"),
    ("courier.region_id", "courier", "region_id", "region"),
    ("orders.restaurant_id", "orders", "restaurant_id", "restaurant"),
    ("orders.user_id", "orders", "user_id", "users"),
    ("order_item.order_id", "order_item", "order_id", "orders"),
    ("order_item.item_id", "order_item", "item_id", "item"),
    ("delivery.order_id", "delivery", "order_id", "orders"),
    ("delivery.courier_id", "delivery", "courier_id", "courier"),
    ("event.delivery_id", "event", "delivery_id", "delivery"),
]


@register("check_foreign_keys", "V1", oracle(" UNION ALL ".join(
    f"SELECT '{n}' AS fk, count(c.{col}) AS n_checked, "
    f"count(*) FILTER (WHERE c.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_{p} p WHERE p.id = c.{col})) "
    f"AS n_violations FROM d_{ch} c" for n, ch, col, p in FKS)))
def q_check_foreign_keys(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ru.fk_summary([(n, getattr(t, ch), col, getattr(t, p)) for n, ch, col, p in FKS])


UNIQUES = [  # (constraint, table, key columns)
    ("users.email", "users", ["email"]),
    ("region.name", "region", ["name"]),
    ("kitchen_type.type", "kitchen_type", ["type"]),
    ("delivery.order_id", "delivery", ["order_id"]),
    ("phones.pk", "phones", ["user_id", "phone"]),
    ("order_item.pk", "order_item_raw", ["order_id", "item_id"]),
]


@register("check_unique", "V2", oracle(" UNION ALL ".join(
    f"SELECT '{n}' AS constraint_name, (SELECT count(*) FROM d_{tb}) AS n_rows, "
    f"(SELECT count(*) FROM (SELECT {', '.join(k)} FROM d_{tb} GROUP BY {', '.join(k)} HAVING count(*) > 1)) "
    f"AS n_duplicate_keys" for n, tb, k in UNIQUES)))
def q_check_unique(spark, sf_dir):
    t = tables(spark, sf_dir)
    parts = []
    for n, tb, k in UNIQUES:
        df = t.order_item_lines if tb == "order_item_raw" else getattr(t, tb)  # no line order needed
        per_key = df.groupBy(*k).agg(F.count(F.lit(1)).alias("c"))
        parts.append(per_key.agg(F.sum("c").alias("n_rows"), F.count(F.when(F.col("c") > 1, 1)).alias("n_duplicate_keys"))
                     .select(F.lit(n).alias("constraint_name"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
                             "n_duplicate_keys"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("check_price_nonneg", "V3", oracle("""
    SELECT id, CAST(price AS DOUBLE) AS price,
           CASE WHEN NOT coalesce(price >= 0, false) THEN 'Price must be non-negative.' END AS reject_reason
    FROM d_item"""))
def q_check_price_nonneg(spark, sf_dir):
    return ru.check_price(tables(spark, sf_dir).item).select(
        "id", F.col("price").cast("double").alias("price"), "reject_reason")


@register("check_quantity_pos", "V4", oracle("""
    SELECT order_id, line_no, coalesce(quantity, 1) AS quantity,
           CASE WHEN NOT coalesce(coalesce(quantity, 1) > 0, false) THEN 'Item quantity must be at least 1.' END
           AS reject_reason
    FROM d_order_item_raw"""))
def q_check_quantity_pos(spark, sf_dir):
    return ru.check_quantity(tables(spark, sf_dir).order_item_raw).select(
        "order_id", "line_no", "quantity", "reject_reason")


@register("check_enum_len", "V5", oracle("""
    SELECT 'courier' AS entity, CAST(id AS VARCHAR) AS key,
           CASE WHEN NOT coalesce(name IS NOT NULL AND length(name) <= 255, false) THEN 'Invalid name.'
                WHEN NOT coalesce(vehicle IN ('BIKE', 'MOTORCYCLE', 'CAR'), false) THEN 'Invalid vehicle.'
                WHEN NOT (lat IS NOT NULL AND lon IS NOT NULL) THEN 'Missing coordinates.' END AS reject_reason
    FROM d_courier
    UNION ALL
    SELECT 'kitchen_type', CAST(id AS VARCHAR),
           CASE WHEN NOT coalesce(type IS NOT NULL AND length(type) <= 100, false) THEN 'Invalid kitchen type.' END
    FROM d_kitchen_type
    UNION ALL
    SELECT 'phones', CAST(user_id AS VARCHAR) || '/' || phone,
           CASE WHEN NOT coalesce(phone IS NOT NULL AND length(phone) <= 20, false) THEN 'Invalid phone.' END
    FROM d_phones
    UNION ALL
    SELECT 'event', CAST(id AS VARCHAR),
           CASE WHEN status NOT IN ('CONFIRMED', 'PREPARING', 'READY_FOR_PICKUP', 'PICKED_UP', 'IN_TRANSIT',
                                    'DELIVERED') OR status IS NULL THEN 'Invalid status.' END
    FROM d_event
    UNION ALL
    SELECT entity, CAST(id AS VARCHAR),
           CASE WHEN NOT coalesce(name IS NOT NULL AND length(name) <= 255, false) THEN 'Invalid name.' END
    FROM (SELECT 'restaurant' AS entity, id, name FROM d_restaurant
          UNION ALL SELECT 'item', id, name FROM d_item UNION ALL SELECT 'region', id, name FROM d_region)"""))
def q_check_enum_len(spark, sf_dir):
    t = tables(spark, sf_dir)
    parts = [
        ru.check_courier_row(t.courier).select(F.lit("courier").alias("entity"), F.col("id").cast("string").alias("key"), "reject_reason"),
        ru.check_kitchen_row(t.kitchen_type).select(F.lit("kitchen_type").alias("entity"), F.col("id").cast("string").alias("key"), "reject_reason"),
        ru.check_phone_row(t.phones).select(F.lit("phones").alias("entity"),
                                            F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("phone")).alias("key"),
                                            "reject_reason"),
        ru.check_status_row(t.event).select(F.lit("event").alias("entity"), F.col("id").cast("string").alias("key"), "reject_reason"),
        *[ru.check_name_row(rows).select(F.lit(name).alias("entity"), F.col("id").cast("string").alias("key"), "reject_reason")
          for name, rows in (("restaurant", t.restaurant), ("item", t.item), ("region", t.region))],
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("check_email", "V6", oracle(f"""
    SELECT id, email,
           CASE WHEN NOT coalesce(name IS NOT NULL AND length(name) <= 255, false) THEN 'Invalid name.'
                WHEN NOT coalesce(email IS NOT NULL AND length(email) <= 255, false) THEN 'Invalid email.'
                WHEN NOT coalesce(regexp_matches(email, '{ru.EMAIL_PATTERN}'), false) THEN 'Invalid email.' END
           AS reject_reason
    FROM d_users"""))
def q_check_email(spark, sf_dir):
    return ru.check_user_row(tables(spark, sf_dir).users).select("id", "email", "reject_reason")


@register("validate_order_payload", "V7", oracle("""
    SELECT o.id AS order_id, o.restaurant_id, o.user_id, coalesce(p.n_lines, 0) AS n_lines,
           CASE WHEN coalesce(p.n_lines, 0) < 1 THEN 'Order must contain at least one item.'
                WHEN NOT p.qty_ok THEN 'Item quantity must be at least 1.'
                WHEN NOT EXISTS (SELECT 1 FROM d_restaurant r WHERE r.id = o.restaurant_id) THEN 'Restaurant not found.'
                WHEN NOT EXISTS (SELECT 1 FROM d_users u WHERE u.id = o.user_id) THEN 'User not found.'
                ELSE f.reason END AS reject_reason,
           f.line_no AS failed_line
    FROM d_orders o
    LEFT JOIN (SELECT order_id, count(*) AS n_lines, bool_and(coalesce(quantity, 1) >= 1) AS qty_ok
               FROM d_order_item_raw GROUP BY order_id) p ON p.order_id = o.id
    LEFT JOIN (SELECT order_id, line_no, reason FROM (
                 SELECT order_id, line_no, chk, reason,
                        row_number() OVER (PARTITION BY order_id ORDER BY line_no, chk) AS rn
                 FROM fails) WHERE rn = 1) f ON f.order_id = o.id""", [
    ("lines", """SELECT l.*, o.restaurant_id AS order_rest, i.restaurant_id AS item_rest,
                        min(l.line_no) OVER (PARTITION BY l.order_id, l.item_id) AS first_line
                 FROM d_order_item_raw l LEFT JOIN d_orders o ON o.id = l.order_id
                 LEFT JOIN d_item i ON i.id = l.item_id"""),
    ("fails", """SELECT order_id, line_no, 0 AS chk, 'Duplicated item in order payload.' AS reason
                 FROM lines WHERE line_no > first_line
                 UNION ALL
                 SELECT order_id, line_no, 1 AS chk, 'Item not found for the informed restaurant.' AS reason
                 FROM lines WHERE line_no = first_line AND item_rest IS DISTINCT FROM order_rest"""),
]))
def q_validate_order_payload(spark, sf_dir):
    """Every stored order re-submitted as an intake payload with its lines
    in line order."""
    t = tables(spark, sf_dir)
    payload = t.orders.select(F.col("id").alias("order_id"), "restaurant_id", "user_id")
    return ru.validate_order_payload(payload, t.order_item_raw, t.restaurant, t.users, t.item)


@register("audit_order_items", "V8", oracle("""
    SELECT o.id AS order_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_foreign, 0) AS n_foreign_items,
           CASE WHEN coalesce(a.n_lines, 0) = 0 THEN 'no items' ELSE 'foreign items' END AS problem
    FROM d_orders o
    LEFT JOIN (SELECT oi.order_id, count(*) AS n_lines,
                      count(*) FILTER (WHERE i.restaurant_id IS DISTINCT FROM o2.restaurant_id) AS n_foreign
               FROM d_order_item oi JOIN d_orders o2 ON o2.id = oi.order_id
               LEFT JOIN d_item i ON i.id = oi.item_id GROUP BY oi.order_id) a ON a.order_id = o.id
    WHERE coalesce(a.n_lines, 0) = 0 OR a.n_foreign > 0"""))
def q_audit_order_items(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ru.audit_order_items(t.orders, t.order_item, t.item)


BUSY_SQL = ("busy", """SELECT d.courier_id, bool_or(l.status IS DISTINCT FROM 'DELIVERED') AS busy
                     FROM d_delivery d LEFT JOIN d_latest l ON l.delivery_id = d.id GROUP BY d.courier_id""")


@register("validate_delivery_request", "V9", oracle("""
    SELECT r.order_id, r.courier_id,
           CASE WHEN NOT EXISTS (SELECT 1 FROM d_orders o WHERE o.id = r.order_id) THEN 'Order not found.'
                WHEN NOT EXISTS (SELECT 1 FROM d_courier c WHERE c.id = r.courier_id) THEN 'Courier not found.'
                WHEN EXISTS (SELECT 1 FROM d_delivery d WHERE d.order_id = r.order_id)
                     THEN 'Order already has an associated delivery.'
                WHEN coalesce(b.busy, false) THEN 'Courier is currently busy with another delivery.' END
           AS reject_reason
    FROM req r LEFT JOIN busy b ON b.courier_id = r.courier_id""", [
    ("req", "SELECT id AS order_id, restaurant_id AS courier_id FROM d_orders"), BUSY_SQL]))
def q_validate_delivery_request(spark, sf_dir):
    """Requests: every order asks for its restaurant's in-house courier
    (courier and restaurant ids share the supplier key space)."""
    t = tables(spark, sf_dir)
    req = t.orders.select(F.col("id").alias("order_id"), F.col("restaurant_id").alias("courier_id"))
    return ru.validate_delivery_request(req, t.orders, t.courier, t.delivery, t.event) \
        .select("order_id", "courier_id", "reject_reason")


V10_PATCHES = ("patches", "SELECT id AS delivery_id, CAST(NULL AS BIGINT) AS order_id, id AS courier_id FROM d_delivery")
V10_SQL_BODY = """
    SELECT p.delivery_id, p.order_id, p.courier_id,
           CASE WHEN NOT EXISTS (SELECT 1 FROM d_delivery d WHERE d.id = p.delivery_id) THEN 'Delivery not found.'
                WHEN p.order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_orders o WHERE o.id = p.order_id)
                     THEN 'Order not found.'
                WHEN p.courier_id IS NOT NULL AND EXISTS (SELECT 1 FROM d_active a
                        WHERE a.courier_id = p.courier_id AND a.id <> p.delivery_id)
                     THEN 'Courier is currently busy with another delivery.'
                WHEN p.courier_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_courier c WHERE c.id = p.courier_id)
                     THEN 'Courier not found.' END AS reject_reason
    FROM patches p"""


def v10_patches(t):
    """Re-point requests: delivery d moves to the courier whose id equals d's
    id; unknown couriers and busy ones occur among them."""
    return t.delivery.select(F.col("id").alias("delivery_id"), F.lit(None).cast("bigint").alias("order_id"),
                             F.col("id").alias("courier_id"))


@register("validate_delivery_update", "V10", oracle(V10_SQL_BODY, [V10_PATCHES]))
def q_validate_delivery_update(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ru.validate_delivery_update(v10_patches(t), t.delivery, t.orders, t.courier, t.event) \
        .select("delivery_id", "order_id", "courier_id", "reject_reason")
