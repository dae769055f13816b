"""Checked queries: sources, projections, joins, ordering (S1, P*, C*, A7,
A9, T*, F3, F4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from courierflow.functions.values import coordinate_text_round_trip, iso_utc_text, money_to_float
from courierflow.operators import tracking as tr
from courierflow.operators.ranking import rank_within_key
from courierflow.plans.catalog import register
from courierflow.plans.oracle_views import oracle
from courierflow.schema import ENTITY_DDL
from courierflow.sources.fixtures import tables
from courierflow.sources.tables import conform

ENTITIES = ["region", "users", "phones", "kitchen_type", "restaurant", "item", "courier", "orders",
            "order_item", "delivery", "event", "node", "edge"]


@register("scan_entities", "S1", oracle(" UNION ALL ".join(
    f"SELECT '{e}' AS entity, count(*) AS n_rows FROM d_{e}" for e in ENTITIES)))
def q_scan_entities(spark, sf_dir):
    t = tables(spark, sf_dir)
    parts = [getattr(t, e).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(e).alias("entity"), "n_rows")
             for e in ENTITIES]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _register_scan(entity: str) -> None:
    columns = [part.split()[0] for part in ENTITY_DDL[entity].replace("DECIMAL(10,2)", "DECIMAL").split(", ")]
    listed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c == "price" else c for c in columns)

    @register(f"scan_{entity}", f"S1_{entity}", oracle(f"SELECT {listed} FROM d_{entity}"))
    def scan(spark, sf_dir):
        df = conform(getattr(tables(spark, sf_dir), entity), entity)
        return df.withColumn("price", F.col("price").cast("double")) if "price" in columns else df


for _entity in ENTITIES:  # every table read out whole under its declared schema
    _register_scan(_entity)


@register("kitchen_list", "P1", oracle("SELECT id, type FROM d_kitchen_type"))
def q_kitchen_list(spark, sf_dir):
    return tr.kitchen_list(tables(spark, sf_dir).kitchen_type)


@register("courier_list", "P2", oracle("SELECT id, name, vehicle, lat, lon FROM d_courier"))
def q_courier_list(spark, sf_dir):
    return tr.courier_list(tables(spark, sf_dir).courier)


@register("event_view", "P3", oracle("SELECT id, status, updated_at, delivery_id FROM d_event"))
def q_event_view(spark, sf_dir):
    return tr.event_view(tables(spark, sf_dir).event)


@register("lookup_by_ids", "P4", oracle("""
    SELECT r.id, c.name, c.vehicle, c.id IS NOT NULL AS found
    FROM (SELECT DISTINCT courier_id AS id FROM d_position) r
    LEFT JOIN d_courier c ON c.id = r.id"""))
def q_lookup_by_ids(spark, sf_dir):
    """Couriers named by position reports, looked up in the courier table."""
    t = tables(spark, sf_dir)
    ids = t.position.select(F.col("courier_id").alias("id"))
    return tr.lookup_by_ids(t.courier.select("id", "name", "vehicle"), ids).select("id", "name", "vehicle", "found")


@register("restaurants_by_kitchen", "P5", oracle("SELECT id, name, lat, lon, kitchen_type_id FROM d_restaurant"))
def q_restaurants_by_kitchen(spark, sf_dir):
    return tr.restaurants_by_kitchen(tables(spark, sf_dir).restaurant, None)


@register("orders_by_user", "P6", oracle("""
    SELECT o.user_id, o.id, o.created_at FROM d_orders o
    WHERE EXISTS (SELECT 1 FROM d_users u WHERE u.id = o.user_id)"""))
def q_orders_by_user(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.orders_of_existing_users(t.orders, t.users).select("user_id", "id", "created_at")


@register("user_order_by_id", "P7", oracle("""
    SELECT r.user_id, r.order_id,
           EXISTS (SELECT 1 FROM d_orders o WHERE o.id = r.order_id AND o.user_id = r.user_id) AS found
    FROM req r""", [("req", """SELECT user_id, id AS order_id FROM d_orders
                 UNION ALL SELECT user_id + 1 AS user_id, id AS order_id FROM d_orders""")]))
def q_user_order_by_id(spark, sf_dir):
    """Requests: every order asked for by its owner and by the next user id."""
    o = tables(spark, sf_dir).orders
    pairs = o.select("user_id", F.col("id").alias("order_id")).unionByName(
        o.select((F.col("user_id") + 1).alias("user_id"), F.col("id").alias("order_id")))
    return tr.user_order_lookup(pairs, o)


@register("deliveries_of_courier", "P8", oracle("""
    SELECT r.courier_id, r.exclude_delivery_id,
           (SELECT count(*) FROM d_delivery d
            WHERE d.courier_id = r.courier_id AND d.id IS DISTINCT FROM r.exclude_delivery_id) AS n_deliveries
    FROM req r""", [("req", """SELECT courier_id, id AS exclude_delivery_id FROM d_delivery
                 UNION ALL SELECT id AS courier_id, CAST(NULL AS BIGINT) AS exclude_delivery_id FROM d_courier""")]))
def q_deliveries_of_courier(spark, sf_dir):
    """Requests: each delivery's courier excluding that delivery, and every
    courier with no exclusion."""
    t = tables(spark, sf_dir)
    req = t.delivery.select("courier_id", F.col("id").alias("exclude_delivery_id")).unionByName(
        t.courier.select(F.col("id").alias("courier_id"), F.lit(None).cast("bigint").alias("exclude_delivery_id")))
    return tr.deliveries_of_courier(t.delivery, req)


@register("restaurant_kitchen", "C1", oracle("""
    SELECT r.id, r.name, r.lat, r.lon, r.kitchen_type_id, k.type AS kitchen_type
    FROM d_restaurant r JOIN d_kitchen_type k ON k.id = r.kitchen_type_id"""))
def q_restaurant_kitchen(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.restaurant_kitchen(t.restaurant, t.kitchen_type)


@register("restaurant_menu", "C2", oracle("""
    SELECT r.id AS restaurant_id, r.name AS restaurant_name, i.id AS item_id, i.name AS item_name,
           CAST(i.price AS DOUBLE) AS item_price
    FROM d_restaurant r LEFT JOIN d_item i ON i.restaurant_id = r.id"""))
def q_restaurant_menu(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.restaurant_menu(t.restaurant, t.item)


@register("item_restaurant", "C3", oracle("""
    SELECT i.id, i.name, CAST(i.price AS DOUBLE) AS price, i.restaurant_id, r.name AS restaurant_name
    FROM d_item i JOIN d_restaurant r ON r.id = i.restaurant_id"""))
def q_item_restaurant(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.item_restaurant(t.item, t.restaurant)


@register("delivery_courier", "C4", oracle("""
    SELECT d.id, d.order_id, d.courier_id, c.name AS courier_name, c.vehicle AS courier_vehicle
    FROM d_delivery d JOIN d_orders o ON o.id = d.order_id JOIN d_courier c ON c.id = d.courier_id"""))
def q_delivery_courier(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.delivery_courier(t.delivery, t.orders, t.courier)


@register("order_lines", "C5", oracle("""
    SELECT o.id AS order_id, o.restaurant_id, r.name AS restaurant_name, o.user_id, u.email AS user_email,
           u.name AS user_name, o.created_at, i.id AS item_id, i.name AS item_name,
           CAST(i.price AS DOUBLE) AS item_price, oi.quantity
    FROM d_orders o JOIN d_restaurant r ON r.id = o.restaurant_id JOIN d_users u ON u.id = o.user_id
    JOIN d_order_item oi ON oi.order_id = o.id JOIN d_item i ON i.id = oi.item_id"""))
def q_order_lines(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.order_lines(t.orders, t.order_item, t.item, t.restaurant, t.users)


ORDER_TRACKING_SQL = """
    SELECT o.id, o.restaurant_id, r.name AS restaurant_name, o.user_id, u.email AS user_email,
           u.name AS user_name, o.created_at,
           coalesce(t.n_lines, 0) AS n_lines, coalesce(t.total_quantity, 0) AS total_quantity,
           coalesce(t.total_value, CAST(0 AS DOUBLE)) AS total_value,
           d.id AS delivery_id, d.courier_id, c.name AS courier_name, c.vehicle AS courier_vehicle, l.status,
           p.ts AS location_ts, p.delivery_id AS location_delivery_id, p.lat AS location_lat, p.lon AS location_lon
    FROM d_orders o
    JOIN d_restaurant r ON r.id = o.restaurant_id
    JOIN d_users u ON u.id = o.user_id
    LEFT JOIN (SELECT oi.order_id, count(*) AS n_lines, CAST(sum(oi.quantity) AS BIGINT) AS total_quantity,
                      CAST(sum(i.price * oi.quantity) AS DOUBLE) AS total_value
               FROM d_order_item oi LEFT JOIN d_item i ON i.id = oi.item_id GROUP BY oi.order_id) t
           ON t.order_id = o.id
    LEFT JOIN d_delivery d ON d.order_id = o.id
    LEFT JOIN d_courier c ON c.id = d.courier_id
    LEFT JOIN d_latest l ON l.delivery_id = d.id
    LEFT JOIN d_last_pos p ON p.courier_id = d.courier_id"""


def _tracking(spark, sf_dir, with_location=True):
    t = tables(spark, sf_dir)
    return tr.order_tracking(t.orders, t.order_item, t.item, t.restaurant, t.users, t.delivery,
                             t.courier, t.event, t.position, with_location=with_location)


@register("order_tracking", "C6", oracle(ORDER_TRACKING_SQL))
def q_order_tracking(spark, sf_dir):
    return _tracking(spark, sf_dir)


@register("user_order_tracking", "C7", oracle("""
    SELECT user_id, id AS order_id,
           row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS recency_rank,
           restaurant_id, restaurant_name, created_at, n_lines, total_quantity, total_value, courier_id,
           courier_name, courier_vehicle, status, location_ts, location_lat, location_lon
    FROM tracking""", [("tracking", ORDER_TRACKING_SQL)]))
def q_user_order_tracking(spark, sf_dir):
    return tr.user_order_tracking(_tracking(spark, sf_dir))


@register("user_phones", "C8", oracle("""
    SELECT u.id, u.name, u.email, coalesce(p.phones, '') AS phones, coalesce(p.n_phones, 0) AS n_phones
    FROM d_users u LEFT JOIN (SELECT user_id, string_agg(phone, ',' ORDER BY phone) AS phones,
                                     count(*) AS n_phones FROM d_phones GROUP BY user_id) p
    ON p.user_id = u.id"""))
def q_user_phones(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.user_phones(t.users, t.phones).select(
        "id", "name", "email", F.array_join("phones", ",").alias("phones"),
        F.size("phones").cast("bigint").alias("n_phones"))


@register("order_event_timeline", "C12", oracle("""
    SELECT o.id AS order_id,
           row_number() OVER (PARTITION BY o.id ORDER BY e.updated_at DESC, e.id DESC) AS timeline_rank,
           e.id AS event_id, e.status, e.updated_at, e.delivery_id
    FROM d_orders o JOIN d_delivery d ON d.order_id = o.id JOIN d_event e ON e.delivery_id = d.id"""))
def q_order_event_timeline(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.order_event_timeline(t.orders, t.delivery, t.event)


@register("event_timeline_desc", "T2", oracle("""
    SELECT delivery_id,
           row_number() OVER (PARTITION BY delivery_id ORDER BY updated_at DESC, id DESC) AS timeline_rank,
           id AS event_id, status, updated_at
    FROM d_event"""))
def q_event_timeline_desc(spark, sf_dir):
    ev = tables(spark, sf_dir).event
    ranked = rank_within_key(ev, ["delivery_id"], [F.col("updated_at").desc(), F.col("id").desc()], out="timeline_rank")
    return ranked.select("delivery_id", "timeline_rank", F.col("id").alias("event_id"), "status", "updated_at")


@register("user_orders_recent", "T1", oracle("""
    SELECT user_id, id AS order_id, created_at,
           row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS recency_rank
    FROM d_orders"""))
def q_user_orders_recent(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    ranked = rank_within_key(o, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], out="recency_rank")
    return ranked.select("user_id", F.col("id").alias("order_id"), "created_at", "recency_rank")


@register("orders_without_delivery", "C14", oracle("""
    SELECT o.id, o.restaurant_id, o.user_id, o.created_at FROM d_orders o
    WHERE NOT EXISTS (SELECT 1 FROM d_delivery d WHERE d.order_id = o.id)"""))
def q_orders_without_delivery(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.orders_without_delivery(t.orders, t.delivery).select("id", "restaurant_id", "user_id", "created_at")


@register("items_of_restaurant", "C15", oracle("""
    SELECT l.order_id, l.line_no, l.item_id, i.id IS NOT NULL AS item_found,
           coalesce(i.restaurant_id IS NOT DISTINCT FROM o.restaurant_id, false) AS in_restaurant
    FROM d_order_item_raw l LEFT JOIN d_orders o ON o.id = l.order_id LEFT JOIN d_item i ON i.id = l.item_id"""))
def q_items_of_restaurant(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.line_item_check(t.order_item_raw, t.orders, t.item)


@register("order_items_nested", "A7", oracle("""
    SELECT oi.order_id, count(*) AS n_lines,
           string_agg(CAST(oi.item_id AS VARCHAR) || 'x' || CAST(oi.quantity AS VARCHAR), ';' ORDER BY oi.item_id) AS items
    FROM d_order_item oi JOIN d_item i ON i.id = oi.item_id GROUP BY oi.order_id"""))
def q_order_items_nested(spark, sf_dir):
    t = tables(spark, sf_dir)
    nested = tr.order_items_nested(t.order_item, t.item)
    return nested.select(
        "order_id", F.size("items").cast("bigint").alias("n_lines"),
        F.array_join(F.transform("items", lambda x: F.concat(x["item_id"].cast("string"), F.lit("x"),
                                                             x["quantity"].cast("string"))), ";").alias("items"))


@register("duplicate_items", "A9", oracle("""
    SELECT order_id, item_id, count(*) AS n_lines FROM d_order_item_raw
    GROUP BY order_id, item_id HAVING count(*) > 1"""))
def q_duplicate_items(spark, sf_dir):
    return tr.duplicate_items(tables(spark, sf_dir).order_item_lines)


@register("last_courier_location", "T3", oracle("SELECT courier_id, ts, delivery_id, lat, lon FROM d_last_pos"))
def q_last_courier_location(spark, sf_dir):
    return tr.last_location(tables(spark, sf_dir).position)


@register("delivery_track", "T4", oracle("""
    SELECT delivery_id, row_number() OVER (PARTITION BY delivery_id ORDER BY ts, arrival_seq) AS seq,
           ts, courier_id, lat, lon
    FROM d_position"""))
def q_delivery_track(spark, sf_dir):
    return tr.delivery_track(tables(spark, sf_dir).position)


@register("money_cast", "F3", oracle("SELECT id, CAST(price AS DOUBLE) AS price FROM d_item"))
def q_money_cast(spark, sf_dir):
    return tables(spark, sf_dir).item.select("id", money_to_float("price").alias("price"))


@register("position_to_text", "F4", oracle("""
    SELECT CAST(courier_id AS BIGINT) AS courier_id, delivery_id,
           lat AS lat_courier, lon AS lon_courier,
           CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp
    FROM d_position"""))
def q_position_to_text(spark, sf_dir):
    p = tables(spark, sf_dir).position
    return p.select(
        F.col("courier_id").cast("bigint").alias("courier_id"), "delivery_id",
        coordinate_text_round_trip("lat").alias("lat_courier"),
        coordinate_text_round_trip("lon").alias("lon_courier"),
        iso_utc_text("ts").alias("timestamp"))


LOOKED_UP = ["region", "users", "kitchen_type", "restaurant", "item", "courier", "orders", "delivery"]


@register("lookup_entities", "P4a", oracle(" UNION ALL ".join(
    f"SELECT '{e}' AS entity, r.id, x.id IS NOT NULL AS found FROM (SELECT id FROM d_{e} UNION SELECT id * 2 + 1 FROM d_{e}) r "
    f"LEFT JOIN d_{e} x ON x.id = r.id" for e in LOOKED_UP)))
def q_lookup_entities(spark, sf_dir):
    """Each entity asked for every id it has and for twice each id plus one."""
    t = tables(spark, sf_dir)
    parts = []
    for e in LOOKED_UP:
        have = getattr(t, e).select(F.col("id").cast("bigint").alias("id"))
        asked = have.unionByName(have.select((F.col("id") * 2 + 1).alias("id")))
        parts.append(tr.lookup_by_ids(have, asked).select(F.lit(e).alias("entity"), "id", "found"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("missing_couriers", "P4m", oracle("""
    SELECT DISTINCT p.courier_id AS id FROM d_position p
    WHERE NOT EXISTS (SELECT 1 FROM d_courier c WHERE c.id = p.courier_id)"""))
def q_missing_couriers(spark, sf_dir):
    t = tables(spark, sf_dir)
    return tr.missing_ids(t.courier, t.position.select(F.col("courier_id").alias("id")))


@register("restaurants_of_kitchen", "P5v", oracle("""
    SELECT id, name, lat, lon, kitchen_type_id FROM d_restaurant WHERE kitchen_type_id = 7"""))
def q_restaurants_of_kitchen(spark, sf_dir):
    return tr.restaurants_by_kitchen(tables(spark, sf_dir).restaurant, 7)


@register("orders_by_user_recent", "P6r", oracle("""
    SELECT o.user_id, o.id, o.created_at,
           row_number() OVER (PARTITION BY o.user_id ORDER BY o.created_at DESC, o.id DESC) AS recency_rank
    FROM d_orders o WHERE EXISTS (SELECT 1 FROM d_users u WHERE u.id = o.user_id)"""))
def q_orders_by_user_recent(spark, sf_dir):
    """Each existing user's orders, newest first."""
    t = tables(spark, sf_dir)
    o = tr.orders_of_existing_users(t.orders, t.users).select("user_id", "id", "created_at")
    return rank_within_key(o, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], out="recency_rank")


@register("courier_delivery_list", "P8l", oracle("""
    SELECT r.courier_id, r.exclude_delivery_id, d.id AS delivery_id, d.order_id
    FROM (SELECT c.id AS courier_id, min(d.id) AS exclude_delivery_id
          FROM d_courier c LEFT JOIN d_delivery d ON d.courier_id = c.id AND c.id % 2 = 0 GROUP BY c.id) r
    JOIN d_delivery d ON d.courier_id = r.courier_id AND d.id IS DISTINCT FROM r.exclude_delivery_id"""))
def q_courier_delivery_list(spark, sf_dir):
    """One request per courier, every second one without its first delivery:
    the deliveries themselves."""
    t = tables(spark, sf_dir)
    first = t.delivery.where(F.col("courier_id") % 2 == 0).groupBy("courier_id").agg(F.min("id").alias("exclude_delivery_id"))
    req = t.courier.select(F.col("id").alias("courier_id")).join(first, "courier_id", "left")
    return tr.courier_delivery_list(t.delivery, req)


@register("restaurant_menu_nested", "C2n", oracle("""
    SELECT r.id, r.name, coalesce(m.items, '[]') AS items, coalesce(m.n, 0) AS n_items
    FROM d_restaurant r LEFT JOIN (
        SELECT restaurant_id, '[' || string_agg(CAST(id AS VARCHAR) || ':' || name || ':' || CAST(price AS VARCHAR), ';' ORDER BY id) || ']' AS items,
               count(*) AS n FROM d_item GROUP BY restaurant_id) m ON m.restaurant_id = r.id"""))
def q_restaurant_menu_nested(spark, sf_dir):
    """Each restaurant with its menu as one list, empty where it has none."""
    t = tables(spark, sf_dir)
    line = lambda x: F.concat_ws(":", x["id"].cast("string"), x["name"], x["price"].cast("decimal(10,2)").cast("string"))
    return tr.restaurant_menu_nested(t.restaurant, t.item).select(
        "id", "name", F.concat(F.lit("["), F.array_join(F.transform("items", line), ";"), F.lit("]")).alias("items"),
        F.size("items").cast("bigint").alias("n_items"))


ORDER_VIEW_ITEMS = ("order_view_items", """
    SELECT oi.order_id, string_agg(CAST(i.id AS VARCHAR) || ':' || i.name || ':' || CAST(i.price AS VARCHAR) || 'x' || CAST(oi.quantity AS VARCHAR), ';' ORDER BY i.id) AS items
    FROM d_order_item oi JOIN d_item i ON i.id = oi.item_id GROUP BY oi.order_id""")


def _with_items(spark, sf_dir, view):
    t = tables(spark, sf_dir)
    line = lambda x: F.concat(F.concat_ws(":", x["item_id"].cast("string"), x["item_name"], x["item_price"].cast("decimal(10,2)").cast("string")),
                              F.lit("x"), x["quantity"].cast("string"))
    items = tr.order_items_nested(t.order_item, t.item).select(F.col("order_id").alias("id"), F.array_join(F.transform("items", line), ";").alias("items"))
    return view.join(items, "id", "left").withColumn("items", F.coalesce("items", F.lit("")))


@register("order_view", "C6i", oracle("SELECT v.*, coalesce(x.items, '') AS items FROM tracking v LEFT JOIN order_view_items x ON x.order_id = v.id",
                                      [("tracking", ORDER_TRACKING_SQL), ORDER_VIEW_ITEMS]))
def q_order_view(spark, sf_dir):
    """The order view as it is returned: with every line of the order."""
    return _with_items(spark, sf_dir, _tracking(spark, sf_dir))


@register("order_listing", "C6l", oracle("""
    SELECT v.* REPLACE (CAST(NULL AS TIMESTAMP) AS location_ts, CAST(NULL AS VARCHAR) AS location_delivery_id,
                        CAST(NULL AS DOUBLE) AS location_lat, CAST(NULL AS DOUBLE) AS location_lon), coalesce(x.items, '') AS items
    FROM tracking v LEFT JOIN order_view_items x ON x.order_id = v.id""", [("tracking", ORDER_TRACKING_SQL), ORDER_VIEW_ITEMS]))
def q_order_listing(spark, sf_dir):
    """The listing form: lines, but no courier location."""
    return _with_items(spark, sf_dir, _tracking(spark, sf_dir, with_location=False))
