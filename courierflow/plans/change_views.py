"""Checked queries: batch changes M1-M4 and the patch expression F5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from courierflow.operators import merge as mg
from courierflow.operators import rules as ru
from courierflow.operators.tracking import last_location
from courierflow.plans.catalog import register
from courierflow.plans.oracle_views import oracle
from courierflow.plans.rule_views import V10_PATCHES, V10_SQL_BODY, v10_patches
from courierflow.schema import (REASON_COURIER_NOT_FOUND, REASON_KITCHEN_NOT_FOUND, REASON_RESTAURANT_NOT_FOUND)
from courierflow.sources.fixtures import tables


@register("apply_inserts", "M1", oracle("""
    SELECT id, name, vehicle, lat, lon FROM d_courier
    UNION ALL
    SELECT (SELECT max(id) FROM d_courier) + row_number() OVER (ORDER BY first_ts, src_id) AS id,
           'Courier ' || CAST(src_id AS VARCHAR) AS name, 'BIKE' AS vehicle, lat, lon
    FROM (SELECT f.courier_id AS src_id, f.first_ts, p.lat, p.lon
          FROM (SELECT courier_id, min(ts) AS first_ts FROM d_position GROUP BY courier_id) f
          JOIN d_last_pos p ON p.courier_id = f.courier_id
          WHERE NOT EXISTS (SELECT 1 FROM d_courier c WHERE c.id = f.courier_id))"""))
def q_apply_inserts(spark, sf_dir):
    """Unknown couriers seen in GPS reports are registered as new couriers
    (standing at their last position); ids continue after the current max
    in order of first sighting."""
    t = tables(spark, sf_dir)
    first = t.position.groupBy("courier_id").agg(F.min("ts").alias("first_ts"))
    unknown = first.join(t.courier.select(F.col("id").alias("courier_id")), "courier_id", "left_anti")
    batch = unknown.join(last_location(t.position), "courier_id", "inner").select(
        F.col("courier_id").alias("src_id"), "first_ts",
        F.concat(F.lit("Courier "), F.col("courier_id").cast("string")).alias("name"),
        F.lit("BIKE").alias("vehicle"), "lat", "lon", F.lit(None).cast("int").alias("region_id"))
    checked = ru.check_courier_row(batch)
    table = t.courier.select("id", "name", "vehicle", "lat", "lon", "region_id")
    return mg.apply_inserts(table, checked, ["first_ts", "src_id"]).select("id", "name", "vehicle", "lat", "lon")


@register("apply_patches", "M2", oracle("""
    SELECT c.id, c.name, c.vehicle, coalesce(p.lat, c.lat) AS lat, coalesce(p.lon, c.lon) AS lon
    FROM d_courier c LEFT JOIN d_last_pos p ON p.courier_id = c.id"""))
def q_apply_patches(spark, sf_dir):
    """Each courier's stored location is patched from its last GPS position
    (name and vehicle patches are null: keep).  Patches for unknown couriers
    are rejected."""
    t = tables(spark, sf_dir)
    patches = last_location(t.position).select(
        F.col("courier_id").alias("id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("vehicle"), "lat", "lon")
    table = t.courier.select("id", "name", "vehicle", "lat", "lon")
    new, _rejected = mg.apply_patches(table, patches, "id", ["name", "vehicle", "lat", "lon"],
                                      not_found_reason=REASON_COURIER_NOT_FOUND)
    return new


@register("patch_rejects", "M2r", oracle("""
    SELECT p.courier_id AS id, 'Courier not found.' AS reject_reason
    FROM d_last_pos p WHERE NOT EXISTS (SELECT 1 FROM d_courier c WHERE c.id = p.courier_id)"""))
def q_patch_rejects(spark, sf_dir):
    t = tables(spark, sf_dir)
    patches = last_location(t.position).select(F.col("courier_id").alias("id"), "lat", "lon")
    _new, rejected = mg.apply_patches(t.courier.select("id", "lat", "lon"), patches, "id", ["lat", "lon"],
                                      not_found_reason=REASON_COURIER_NOT_FOUND)
    return rejected.select("id", "reject_reason")


@register("patch_coalesce", "F5", oracle(f"""
    SELECT d.id, coalesce(a.order_id, d.order_id) AS order_id, coalesce(a.courier_id, d.courier_id) AS courier_id
    FROM d_delivery d
    LEFT JOIN (SELECT * FROM ({V10_SQL_BODY}) WHERE reject_reason IS NULL) a ON a.delivery_id = d.id""",
    [V10_PATCHES]))
def q_patch_coalesce(spark, sf_dir):
    """Accepted delivery re-points (V10) applied: null order keeps the
    stored order, the new courier replaces the old one."""
    t = tables(spark, sf_dir)
    checked = ru.validate_delivery_update(v10_patches(t), t.delivery, t.orders, t.courier, t.event)
    accepted = checked.where(F.col("reject_reason").isNull()).select(
        F.col("delivery_id").alias("id"), "order_id", "courier_id")
    new, _ = mg.apply_patches(t.delivery.select("id", "order_id", "courier_id"), accepted, "id",
                              ["order_id", "courier_id"])
    return new


@register("replace_order_items", "M3", oracle("""
    SELECT oi.order_id, oi.item_id, oi.quantity
    FROM d_order_item oi JOIN d_orders o ON o.id = oi.order_id LEFT JOIN d_item i ON i.id = oi.item_id
    WHERE i.restaurant_id IS NOT DISTINCT FROM o.restaurant_id
       OR NOT EXISTS (SELECT 1 FROM d_order_item x JOIN d_item xi ON xi.id = x.item_id
                      WHERE x.order_id = oi.order_id AND xi.restaurant_id IS DISTINCT FROM o.restaurant_id)"""))
def q_replace_order_items(spark, sf_dir):
    """Repair job: orders holding items of another restaurant get their
    lines replaced by the valid ones (possibly an empty list); other orders
    send no items (null) and keep their lines."""
    t = tables(spark, sf_dir)
    o = t.orders.select(F.col("id").alias("order_id"), F.col("restaurant_id").alias("_rest"))
    it = t.item.select(F.col("id").alias("item_id"), F.col("restaurant_id").alias("_item_rest"))
    lines = t.order_item.join(o, "order_id", "inner").join(it, "item_id", "left") \
        .withColumn("_ok", F.col("_item_rest").eqNullSafe(F.col("_rest")))
    per = lines.groupBy("order_id").agg(
        F.bool_and("_ok").alias("_clean"),
        F.collect_list(F.when(F.col("_ok"), F.struct("item_id", "quantity"))).alias("_valid"))
    patches = per.select("order_id", F.when(~F.col("_clean"), F.col("_valid")).alias("items"))
    return mg.replace_order_items(t.order_item.join(o.select("order_id"), "order_id", "left_semi"), patches)


@register("apply_deletes", "M4", oracle("""
    SELECT 'item' AS entity, i.id,
           CASE WHEN EXISTS (SELECT 1 FROM d_order_item oi WHERE oi.item_id = i.id) THEN 'refused' ELSE 'deleted' END
           AS outcome, CAST(0 AS BIGINT) AS n_cascaded
    FROM d_item i
    UNION ALL
    SELECT 'courier', c.id,
           CASE WHEN EXISTS (SELECT 1 FROM d_delivery d WHERE d.courier_id = c.id) THEN 'refused' ELSE 'deleted' END,
           CAST(0 AS BIGINT)
    FROM d_courier c
    UNION ALL
    SELECT 'restaurant', r.id,
           CASE WHEN h.held THEN 'refused' ELSE 'deleted' END,
           CASE WHEN h.held THEN 0 ELSE (SELECT count(*) FROM d_item i WHERE i.restaurant_id = r.id) END
    FROM d_restaurant r JOIN (
        SELECT id, EXISTS (SELECT 1 FROM d_orders o WHERE o.restaurant_id = x.id)
                   OR EXISTS (SELECT 1 FROM d_item i JOIN d_order_item oi ON oi.item_id = i.id WHERE i.restaurant_id = x.id) AS held
        FROM d_restaurant x) h ON h.id = r.id"""))
def q_apply_deletes(spark, sf_dir):
    """Clean-up requests for every item, courier and restaurant: refused
    while referenced by orders / lines / deliveries; a deleted restaurant
    takes its menu items with it."""
    t = tables(spark, sf_dir)
    items = mg.apply_deletes(t.item.select("id"), t.item, [(t.order_item, "item_id")])
    couriers = mg.apply_deletes(t.courier.select("id"), t.courier, [(t.delivery, "courier_id")])
    rests = mg.apply_deletes(t.restaurant.select("id"), t.restaurant, [(t.orders, "restaurant_id")],
                             cascades=[(t.item, "restaurant_id", [(t.order_item, "item_id")])])
    parts = [items.select(F.lit("item").alias("entity"), "*"),
             couriers.select(F.lit("courier").alias("entity"), "*"),
             rests.select(F.lit("restaurant").alias("entity"), "*")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _user_deletes(t):
    return mg.apply_deletes(t.users.select("id"), t.users, [(t.orders, "user_id")], cascades=[(t.phones, "user_id")])


@register("delete_users", "M4u", oracle("""
    SELECT u.id, CASE WHEN o.user_id IS NOT NULL THEN 'refused' ELSE 'deleted' END AS outcome,
           CASE WHEN o.user_id IS NOT NULL THEN 0 ELSE (SELECT count(*) FROM d_phones p WHERE p.user_id = u.id) END AS n_cascaded
    FROM d_users u LEFT JOIN (SELECT DISTINCT user_id FROM d_orders) o ON o.user_id = u.id"""))
def q_delete_users(spark, sf_dir):
    """Clean-up of every user: those without orders go with their phones."""
    return _user_deletes(tables(spark, sf_dir))


@register("phones_after_deletes", "M4p", oracle("""
    SELECT p.user_id, p.phone FROM d_phones p WHERE EXISTS (SELECT 1 FROM d_orders o WHERE o.user_id = p.user_id)"""))
def q_phones_after_deletes(spark, sf_dir):
    """The phone table once the deleted users' phones are gone with them."""
    t = tables(spark, sf_dir)
    return mg.children_after_deletes(t.phones, "user_id", _user_deletes(t)).select("user_id", "phone")


@register("users_after_deletes", "M4t", oracle("""
    SELECT u.id, u.email FROM d_users u WHERE EXISTS (SELECT 1 FROM d_orders o WHERE o.user_id = u.id)"""))
def q_users_after_deletes(spark, sf_dir):
    t = tables(spark, sf_dir)
    return mg.table_after_deletes(t.users, _user_deletes(t)).select("id", "email")


@register("delete_orders", "M4o", oracle("""
    SELECT o.id, CASE WHEN d.order_id IS NOT NULL THEN 'refused' ELSE 'deleted' END AS outcome,
           CASE WHEN d.order_id IS NOT NULL THEN 0 ELSE coalesce(n.n, 0) END AS n_cascaded
    FROM d_orders o LEFT JOIN d_delivery d ON d.order_id = o.id
    LEFT JOIN (SELECT order_id, count(*) AS n FROM d_order_item GROUP BY order_id) n ON n.order_id = o.id"""))
def q_delete_orders(spark, sf_dir):
    """Every order asked to be deleted: refused while it has a delivery, else
    gone with its lines."""
    t = tables(spark, sf_dir)
    return mg.apply_deletes(t.orders.select("id"), t.orders, [(t.delivery, "order_id")], cascades=[(t.order_item, "order_id")])


def _order_patches(t):
    """Each order sends its payload lines again as the new list."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "item_id", "quantity")))
    sent = t.order_item_raw.groupBy("order_id").agg(lines.alias("l"))
    return sent.select("order_id", F.transform("l", lambda x: F.struct(x["item_id"].alias("item_id"), x["quantity"].alias("quantity"))).alias("items"))


@register("order_patch_check", "M2o", oracle("""
    SELECT p.order_id, CASE WHEN o.id IS NULL THEN 'Order not found.' ELSE f.reason END AS reject_reason
    FROM (SELECT DISTINCT order_id FROM d_order_item_raw) p LEFT JOIN d_orders o ON o.id = p.order_id
    LEFT JOIN (SELECT order_id, min(struct_pack(n := line_no, r := reason)).r AS reason
               FROM (SELECT l.order_id, l.line_no,
                            CASE WHEN l.line_no > min(l.line_no) OVER (PARTITION BY l.order_id, l.item_id) THEN 'Duplicated item in order payload.'
                                 WHEN i.restaurant_id IS DISTINCT FROM o.restaurant_id THEN 'Item not found for the informed restaurant.' END AS reason
                     FROM d_order_item_raw l LEFT JOIN d_orders o ON o.id = l.order_id LEFT JOIN d_item i ON i.id = l.item_id)
               WHERE reason IS NOT NULL GROUP BY order_id) f ON f.order_id = p.order_id"""))
def q_order_patch_check(spark, sf_dir):
    t = tables(spark, sf_dir)
    return mg.check_order_patches(_order_patches(t), t.orders, t.item).select("order_id", "reject_reason")


@register("restaurant_patches", "M2s", oracle("""
    SELECT r.id, r.name || ' (moved)' AS name, CASE WHEN r.id % 5 = 0 THEN r.kitchen_type_id ELSE (r.kitchen_type_id + 1) % 30 END AS kitchen_type_id,
           'accepted' AS outcome
    FROM d_restaurant r WHERE r.id % 5 = 0 OR (r.kitchen_type_id + 1) % 30 IN (SELECT id FROM d_kitchen_type)
    UNION ALL
    SELECT r.id, r.name, r.kitchen_type_id, 'Kitchen type not found.'
    FROM d_restaurant r WHERE r.id % 5 <> 0 AND (r.kitchen_type_id + 1) % 30 NOT IN (SELECT id FROM d_kitchen_type)"""))
def q_restaurant_patches(spark, sf_dir):
    """Every restaurant is renamed and moved to the next kitchen type (each
    fifth sends no type); a patch to an unknown type is rejected whole."""
    t = tables(spark, sf_dir)
    table = t.restaurant.select("id", "name", "kitchen_type_id")
    patches = table.select("id", F.concat("name", F.lit(" (moved)")).alias("name"),
                           F.when(F.col("id") % 5 != 0, (F.col("kitchen_type_id") + 1) % 30).cast("int").alias("kitchen_type_id"))
    new, rejected = mg.apply_patches(table, patches, "id", ["name", "kitchen_type_id"],
                                     fk_checks=[("kitchen_type_id", t.kitchen_type, REASON_KITCHEN_NOT_FOUND)],
                                     not_found_reason=REASON_RESTAURANT_NOT_FOUND)
    return new.join(rejected.select("id", "reject_reason"), "id", "left").select(
        "id", "name", "kitchen_type_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


@register("insert_items", "M1i", oracle("""
    SELECT row_number() OVER (ORDER BY r, s) + (SELECT max(id) FROM d_item) AS id, name, price, r AS restaurant_id
    FROM (SELECT i.id AS s, i.name, CAST(i.price AS DOUBLE) AS price, i.restaurant_id + 3 AS r FROM d_item i)
    WHERE r IN (SELECT id FROM d_restaurant)"""))
def q_insert_items(spark, sf_dir):
    """Every item is offered to the restaurant three ids on; where that
    restaurant does not exist the insert is rejected, the others get ids after
    the current maximum."""
    t = tables(spark, sf_dir)
    batch = t.item.select(F.col("id").alias("s"), "name", "price", (F.col("restaurant_id") + 3).alias("restaurant_id"))
    known = t.restaurant.select(F.col("id").alias("restaurant_id"), F.lit(True).alias("_ok"))
    checked = batch.join(known, "restaurant_id", "left").withColumn(
        "reject_reason", F.when(F.col("_ok").isNull(), F.lit(REASON_RESTAURANT_NOT_FOUND))).drop("_ok")
    fresh = mg.assign_ids(checked.where(F.col("reject_reason").isNull()), ["restaurant_id", "s"], t.item)
    return fresh.select("id", "name", F.col("price").cast("double").alias("price"), "restaurant_id")


@register("insert_users_unique", "M1u", oracle("""
    SELECT s, email, CASE WHEN EXISTS (SELECT 1 FROM d_users u WHERE u.email = b.email) OR s > min(s) OVER (PARTITION BY email)
                          THEN 'Duplicate key.' END AS reject_reason
    FROM (SELECT id AS s, CASE WHEN id % 3 = 0 THEN email WHEN id % 3 = 1 THEN 'new' || CAST(id // 6 AS VARCHAR) || '@example.com'
                               ELSE 'user' || CAST(id AS VARCHAR) || '@example.com' END AS email FROM d_users) b"""))
def q_insert_users_unique(spark, sf_dir):
    """A sign-up batch: a third repeats existing addresses, a third repeats
    addresses within the batch (first arrival wins), a third is new."""
    u = tables(spark, sf_dir).users
    sid = F.col("id")
    email = (F.when(sid % 3 == 0, F.col("email")).when(sid % 3 == 1, F.concat(F.lit("new"), F.expr("id div 6").cast("string"), F.lit("@example.com")))
             .otherwise(F.concat(F.lit("user"), sid.cast("string"), F.lit("@example.com"))))
    batch = u.select(sid.alias("s"), email.alias("email"))
    return ru.unique_split(batch, u, ["email"], ["s"]).select("s", "email", "reject_reason")
