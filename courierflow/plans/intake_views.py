"""Checked queries: intake of kitchens, restaurants, users and orders (M1) and
patches of items, kitchens and orders (M2).  The request batches are derived
from the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierflow.operators import intake as ik
from courierflow.plans.catalog import register
from courierflow.plans.oracle_views import oracle
from courierflow.session import written
from courierflow.sources.fixtures import tables

# -- kitchens and restaurants ---------------------------------------------------

KITCHEN_BATCH = ("b_kitchen", """
    SELECT id AS seq, CASE id % 4 WHEN 0 THEN type WHEN 1 THEN 'CUISINE ' || CAST(id // 8 AS VARCHAR)
                                  WHEN 2 THEN repeat('x', 95 + id) ELSE type || ' 2' END AS type FROM d_kitchen_type""")
KITCHEN_CHECKED = ("c_kitchen", """
    SELECT seq, type, CASE WHEN length(type) > 100 THEN 'Invalid kitchen type.'
        WHEN type IN (SELECT type FROM d_kitchen_type) OR seq > min(seq) OVER (PARTITION BY type)
        THEN 'Kitchen already exists or payload violates constraints.' END AS reject_reason FROM b_kitchen""")


def _kitchen_batch(t):
    i = F.col("id")
    name = (F.when(i % 4 == 0, F.col("type")).when(i % 4 == 1, F.concat(F.lit("CUISINE "), F.expr("id div 8").cast("string")))
            .when(i % 4 == 2, F.expr("repeat('x', cast(95 + id as int))")).otherwise(F.concat("type", F.lit(" 2"))))
    return t.kitchen_type.select(i.alias("seq"), name.alias("type"))


@register("insert_kitchens", "M1k", oracle("""
    SELECT (SELECT max(id) FROM d_kitchen_type) + CASE WHEN reject_reason IS NULL THEN
               row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY seq) END AS id, seq, type, reject_reason
    FROM c_kitchen""", [KITCHEN_BATCH, KITCHEN_CHECKED]))
def q_insert_kitchens(spark, sf_dir):
    """Each stored kitchen sends a new one: its own type, a shared name, a long name or a new name."""
    t = tables(spark, sf_dir)
    fresh, checked = ik.insert_kitchens(_kitchen_batch(t), t.kitchen_type, ["seq"])
    return checked.join(fresh.select("id", "seq"), "seq", "left").select("id", "seq", "type", "reject_reason")


@register("insert_restaurants", "M1r", oracle("""
    SELECT CASE WHEN reject_reason IS NULL THEN (SELECT max(id) FROM d_restaurant)
               + row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY seq) END AS id, seq, name, kitchen_type_id, reject_reason
    FROM (SELECT *, CASE WHEN kitchen_type_id NOT IN (SELECT id FROM d_kitchen_type) THEN 'Kitchen type not found.'
                         WHEN length(name) > 255 THEN 'Invalid name.' END AS reject_reason
          FROM (SELECT id AS seq, CASE WHEN id % 7 = 0 THEN repeat(name, 20) ELSE name || ' branch' END AS name,
                       (kitchen_type_id + id) % 30 AS kitchen_type_id FROM d_restaurant))"""))
def q_insert_restaurants(spark, sf_dir):
    """Each restaurant opens a branch of another kitchen type, some of them with an unknown type or a long name."""
    t = tables(spark, sf_dir)
    name = F.when(F.col("id") % 7 == 0, F.expr("repeat(name, 20)")).otherwise(F.concat("name", F.lit(" branch")))
    batch = t.restaurant.select(F.col("id").alias("seq"), name.alias("name"), "lat", "lon",
                                ((F.col("kitchen_type_id") + F.col("id")) % 30).alias("kitchen_type_id"))
    fresh, checked = ik.insert_restaurants(batch, t.restaurant, t.kitchen_type, ["seq"])
    return checked.join(fresh.select("id", "seq"), "seq", "left").select("id", "seq", "name", "kitchen_type_id", "reject_reason")


# -- users with phones ------------------------------------------------------------

USER_BATCH = ("b_user", """
    SELECT id AS seq, CASE WHEN id % 5 = 0 THEN email ELSE 'guest' || CAST(id // 4 AS VARCHAR) || '@example.com' END AS email,
           CASE id % 3 WHEN 0 THEN [] WHEN 1 THEN ['+1' || CAST(id AS VARCHAR), '+2' || CAST(id AS VARCHAR)]
                       ELSE ['+3' || CAST(id AS VARCHAR), CASE WHEN id % 2 = 0 THEN '+3' || CAST(id AS VARCHAR) ELSE repeat('4', CAST(16 + id % 8 AS INTEGER)) END] END AS phones
    FROM d_users""")
USER_CHECKED = ("c_user", """
    SELECT *, CASE WHEN NOT valid OR email IN (SELECT email FROM d_users) OR seq > min(seq) OVER (PARTITION BY email, valid)
                   THEN 'User already exists or payload violates constraints.' END AS reject_reason
    FROM (SELECT *, len(list_distinct(phones)) = len(phones) AND len(list_filter(phones, lambda p: length(p) > 20)) = 0 AS valid FROM b_user)""")
USER_NEW = ("n_user", """
    SELECT (SELECT max(id) FROM d_users) + row_number() OVER (ORDER BY seq) AS id, seq, email, phones FROM c_user WHERE reject_reason IS NULL""")


def _insert_users(t):
    i, s = F.col("id"), F.col("id").cast("string")
    email = F.when(i % 5 == 0, F.col("email")).otherwise(F.concat(F.lit("guest"), F.expr("id div 4").cast("string"), F.lit("@example.com")))
    second = F.when(i % 2 == 0, F.concat(F.lit("+3"), s)).otherwise(F.expr("repeat('4', cast(16 + id % 8 as int))"))
    phones = (F.when(i % 3 == 0, F.lit(None).cast("array<string>")).when(i % 3 == 1, F.array(F.concat(F.lit("+1"), s), F.concat(F.lit("+2"), s)))
              .otherwise(F.array(F.concat(F.lit("+3"), s), second)))
    batch = t.users.select(i.alias("seq"), email.alias("email"), "name", "house_lat", "house_lon", phones.alias("phones"))
    return ik.insert_users(batch, t.users, ["seq"])


@register("insert_users_phones", "M1p", oracle("""
    SELECT n.id, n.seq, n.email, p.phone FROM n_user n LEFT JOIN (SELECT id, unnest(phones) AS phone FROM n_user) p ON p.id = n.id""",
    [USER_BATCH, USER_CHECKED, USER_NEW]))
def q_insert_users_phones(spark, sf_dir):
    """A sign-up batch with phone lists; one row per accepted user and phone (null: none)."""
    fresh, phones, _ = _insert_users(tables(spark, sf_dir))
    return fresh.join(phones, fresh["id"] == phones["user_id"], "left").select("id", "seq", "email", "phone")


@register("insert_users_rejects", "M1q", oracle("""
    SELECT seq, email, reject_reason FROM c_user WHERE reject_reason IS NOT NULL""", [USER_BATCH, USER_CHECKED]))
def q_insert_users_rejects(spark, sf_dir):
    """Addresses of stored users or of earlier valid requests, repeated or long phones."""
    return _insert_users(tables(spark, sf_dir))[2].where(F.col("reject_reason").isNotNull()).select("seq", "email", "reject_reason")


# -- orders with lines ------------------------------------------------------------

# Every stored payload comes again for the restaurant of its first item; three of
# four send that restaurant's lines only, each ninth an unknown user.
ORDER_BATCH = ("b_order", """
    SELECT o.id AS order_id, i.restaurant_id, CASE WHEN o.id % 9 = 0 THEN -1 ELSE o.user_id END AS user_id
    FROM d_orders o JOIN d_order_item_raw l ON l.order_id = o.id AND l.line_no = 1 JOIN d_item i ON i.id = l.item_id""")
ORDER_LINES = ("b_line", """
    SELECT l.order_id, l.line_no, l.item_id, CASE WHEN l.order_id % 11 = 0 THEN 0 WHEN l.line_no = 1 THEN NULL ELSE l.quantity END AS quantity
    FROM d_order_item_raw l JOIN b_order b ON b.order_id = l.order_id JOIN d_item i ON i.id = l.item_id
    WHERE l.order_id % 4 = 0 OR i.restaurant_id = b.restaurant_id""")
ORDER_CHECKED = ("c_order", """
    SELECT b.*, CASE WHEN q.low THEN 'Item quantity must be at least 1.'
                     WHEN b.restaurant_id NOT IN (SELECT id FROM d_restaurant) THEN 'Restaurant not found.'
                     WHEN b.user_id NOT IN (SELECT id FROM d_users) THEN 'User not found.' ELSE f.reason END AS reject_reason
    FROM b_order b JOIN (SELECT order_id, bool_or(coalesce(quantity, 1) < 1) AS low FROM b_line GROUP BY order_id) q ON q.order_id = b.order_id
    LEFT JOIN (SELECT order_id, min(struct_pack(n := line_no, r := reason)).r AS reason
               FROM (SELECT l.order_id, l.line_no,
                            CASE WHEN l.line_no > min(l.line_no) OVER (PARTITION BY l.order_id, l.item_id) THEN 'Duplicated item in order payload.'
                                 WHEN i.restaurant_id IS DISTINCT FROM b.restaurant_id THEN 'Item not found for the informed restaurant.' END AS reason
                     FROM b_line l JOIN b_order b ON b.order_id = l.order_id LEFT JOIN d_item i ON i.id = l.item_id)
               WHERE reason IS NOT NULL GROUP BY order_id) f ON f.order_id = b.order_id""")


def _lines_with_restaurant(t):
    """Numbered order lines with the restaurant of their item, written once: the branches below do not number them again."""
    i = t.item.select(F.col("id").alias("item_id"), F.col("restaurant_id").alias("_rest"))
    return written(t.order_item_raw.join(i, "item_id"), "order-lines")


def _insert_orders(t):
    lines = _lines_with_restaurant(t)
    first = lines.where("line_no = 1").select(F.col("order_id").alias("_o"), F.col("_rest").alias("_first"))
    requests = t.orders.join(first, F.col("id") == F.col("_o")).select(
        F.col("id").alias("order_id"), F.col("_first").alias("restaurant_id"),
        F.when(F.col("id") % 9 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id"))
    quantity = F.when(F.col("order_id") % 11 == 0, F.lit(0)).when(F.col("line_no") != 1, F.col("quantity"))
    sent = lines.join(first, F.col("order_id") == F.col("_o")).where((F.col("order_id") % 4 == 0) | (F.col("_rest") == F.col("_first"))).select(
        "order_id", "line_no", "item_id", quantity.alias("quantity"))
    return ik.insert_orders(written(requests, "order-requests"), written(sent, "sent-lines"), t.orders, t.restaurant, t.users, t.item)


@register("insert_orders", "M1o", oracle("""
    SELECT n.id, n.request_id, n.restaurant_id, n.user_id, l.item_id, coalesce(l.quantity, 1) AS quantity
    FROM (SELECT (SELECT max(id) FROM d_orders) + row_number() OVER (ORDER BY order_id) AS id, order_id AS request_id, restaurant_id, user_id
          FROM c_order WHERE reject_reason IS NULL) n JOIN b_line l ON l.order_id = n.request_id""", [ORDER_BATCH, ORDER_LINES, ORDER_CHECKED]))
def q_insert_orders(spark, sf_dir):
    """Accepted orders under new ids with their lines."""
    fresh, lines, _ = _insert_orders(tables(spark, sf_dir))
    return fresh.join(lines, F.col("id") == F.col("order_id")).select("id", "request_id", "restaurant_id", "user_id", "item_id", "quantity")


@register("insert_orders_rejects", "M1x", oracle("""
    SELECT order_id, reject_reason FROM c_order WHERE reject_reason IS NOT NULL""", [ORDER_BATCH, ORDER_LINES, ORDER_CHECKED]))
def q_insert_orders_rejects(spark, sf_dir):
    return _insert_orders(tables(spark, sf_dir))[2].where(F.col("reject_reason").isNotNull()).select("order_id", "reject_reason")


# -- patches ------------------------------------------------------------------------

@register("item_patches", "M2i", oracle("""
    SELECT i.id, CASE WHEN ok THEN i.name || ' (new)' ELSE i.name END AS name, CASE WHEN ok AND i.id % 3 <> 0 THEN CAST(i.price - 1000 AS DOUBLE) ELSE CAST(i.price AS DOUBLE) END AS price,
           CASE WHEN ok AND i.id % 2 = 0 THEN i.restaurant_id + 2 ELSE i.restaurant_id END AS restaurant_id,
           CASE WHEN ok THEN 'accepted' WHEN i.id % 2 = 0 AND r.id IS NULL THEN 'Restaurant not found.'
                ELSE 'Item already exists or payload violates constraints.' END AS outcome
    FROM (SELECT x.*, (x.id % 2 <> 0 OR x.restaurant_id + 2 IN (SELECT id FROM d_restaurant)) AND (x.id % 3 = 0 OR x.price >= 1000) AS ok FROM d_item x) i
    LEFT JOIN d_restaurant r ON r.id = i.restaurant_id + 2"""))
def q_item_patches(spark, sf_dir):
    """Every item is renamed; two of three become cheaper by 1000, every second moves two restaurants on."""
    t = tables(spark, sf_dir)
    item = t.item.select("id", "name", "price", "restaurant_id")
    patches = item.select("id", F.concat("name", F.lit(" (new)")).alias("name"),
                          F.when(F.col("id") % 3 != 0, (F.col("price") - 1000).cast("decimal(10,2)")).alias("price"),
                          F.when(F.col("id") % 2 == 0, F.col("restaurant_id") + 2).alias("restaurant_id"))
    new, rejected = ik.patch_items(patches, item, t.restaurant)
    return new.join(rejected.select("id", "reject_reason"), "id", "left").select(
        "id", "name", F.col("price").cast("double").alias("price"), "restaurant_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


@register("kitchen_patches", "M2k", oracle("""
    SELECT p.id, CASE WHEN reject_reason IS NULL THEN p.type ELSE k.type END AS type, coalesce(reject_reason, 'accepted') AS outcome
    FROM (SELECT id, type, CASE WHEN known IS NULL THEN 'Kitchen not found.' WHEN length(type) > 100 THEN 'Invalid kitchen type.'
                 WHEN held OR id > min(id) OVER (PARTITION BY type, held, known IS NULL, length(type) > 100)
                 THEN 'Kitchen already exists or payload violates constraints.' END AS reject_reason
          FROM (SELECT b.id, b.type, k.id AS known, EXISTS (SELECT 1 FROM d_kitchen_type h WHERE h.type = b.type AND h.id <> b.id) AS held
                FROM (SELECT seq + seq % 2 * 20 AS id, type FROM b_kitchen) b LEFT JOIN d_kitchen_type k ON k.id = b.id)) p
    LEFT JOIN d_kitchen_type k ON k.id = p.id""", [KITCHEN_BATCH]))
def q_kitchen_patches(spark, sf_dir):
    """The batch of ``insert_kitchens`` as patches; odd ones are sent to a kitchen 20 ids on."""
    t = tables(spark, sf_dir)
    kitchen = t.kitchen_type.select("id", "type")
    patches = _kitchen_batch(t).select((F.col("seq") + F.col("seq") % 2 * 20).alias("id"), "type")
    new, checked = ik.patch_kitchens(patches, kitchen, ["id"])
    stored = new.select("id", F.col("type").alias("_type"))
    return checked.join(stored, "id", "left").select("id", F.col("_type").alias("type"), F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


# Order patches: a fifth each to the restaurant of the first line with its lines, the
# same with the stored lines kept, to an unknown restaurant, to an unknown user, and
# with the lines of the payload for the restaurant that the order has.
ORDER_PATCHES = ("b_patch", """
    SELECT b.order_id, CASE b.order_id % 5 WHEN 2 THEN -1 WHEN 4 THEN NULL ELSE b.restaurant_id END AS restaurant_id,
           CASE WHEN b.order_id % 5 = 3 THEN -1 WHEN b.order_id % 2 = 0 THEN o.user_id + 1 END AS user_id, b.order_id % 5 <> 1 AS sends
    FROM b_order b JOIN d_orders o ON o.id = b.order_id""")
PATCH_CHECKED = ("c_patch", """
    SELECT p.*, CASE WHEN p.sends AND q.low THEN 'Item quantity must be at least 1.'
                     WHEN p.restaurant_id NOT IN (SELECT id FROM d_restaurant) THEN 'Restaurant not found.'
                     WHEN p.user_id NOT IN (SELECT id FROM d_users) THEN 'User not found.'
                     WHEN p.sends THEN f.reason END AS reject_reason
    FROM b_patch p LEFT JOIN (SELECT order_id, bool_or(coalesce(quantity, 1) < 1) AS low FROM b_line GROUP BY order_id) q ON q.order_id = p.order_id
    LEFT JOIN (SELECT order_id, min(struct_pack(n := line_no, r := reason)).r AS reason
               FROM (SELECT l.order_id, l.line_no,
                            CASE WHEN l.line_no > min(l.line_no) OVER (PARTITION BY l.order_id, l.item_id) THEN 'Duplicated item in order payload.'
                                 WHEN i.restaurant_id IS DISTINCT FROM coalesce(b.restaurant_id, o.restaurant_id) THEN 'Item not found for the informed restaurant.' END AS reason
                     FROM b_line l JOIN b_patch b ON b.order_id = l.order_id JOIN d_orders o ON o.id = l.order_id LEFT JOIN d_item i ON i.id = l.item_id)
               WHERE reason IS NOT NULL GROUP BY order_id) f ON f.order_id = p.order_id""")


def _patch_orders(t):
    lines = _lines_with_restaurant(t)
    first = lines.where("line_no = 1").select(F.col("order_id").alias("_o"), F.col("_rest").alias("_first"))
    quantity = F.when(F.col("order_id") % 11 == 0, F.lit(0)).when(F.col("line_no") != 1, F.col("quantity")).cast("int")
    sent = lines.join(first, F.col("order_id") == F.col("_o")).where((F.col("order_id") % 4 == 0) | (F.col("_rest") == F.col("_first"))).groupBy("order_id", "_first").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "item_id", quantity.alias("quantity")))).alias("l"))
    k = F.col("order_id") % 5
    items = F.transform("l", lambda x: F.struct(x["item_id"].alias("item_id"), x["quantity"].alias("quantity")))
    patches = sent.join(t.orders.select(F.col("id").alias("order_id"), F.col("user_id").alias("_user")), "order_id").select(
        "order_id", F.when(k == 2, F.lit(-1)).when(k != 4, F.col("_first")).cast("long").alias("restaurant_id"),
        F.when(k == 3, F.lit(-1)).when(F.col("order_id") % 2 == 0, F.col("_user") + 1).cast("long").alias("user_id"),
        F.when(k != 1, items).alias("items"))
    return ik.patch_orders(written(patches, "order-patches"), t.orders.select("id", "restaurant_id", "user_id"), t.order_item.select("order_id", "item_id", "quantity"),
                           t.restaurant, t.users, t.item)


@register("order_patches", "M2p", oracle("""
    SELECT o.id, CASE WHEN p.reject_reason IS NULL THEN coalesce(p.restaurant_id, o.restaurant_id) ELSE o.restaurant_id END AS restaurant_id,
           CASE WHEN p.reject_reason IS NULL THEN coalesce(p.user_id, o.user_id) ELSE o.user_id END AS user_id, p.reject_reason
    FROM d_orders o LEFT JOIN c_patch p ON p.order_id = o.id""", [ORDER_BATCH, ORDER_LINES, ORDER_PATCHES, PATCH_CHECKED]))
def q_order_patches(spark, sf_dir):
    """Orders after the patches, with the reason where one was rejected."""
    new, _, checked = _patch_orders(tables(spark, sf_dir))
    return new.join(checked.select(F.col("order_id").alias("id"), "reject_reason"), "id", "left").select("id", "restaurant_id", "user_id", "reject_reason")


@register("order_patch_lines", "M2l", oracle("""
    SELECT i.order_id, i.item_id, i.quantity FROM d_order_item i
    WHERE i.order_id NOT IN (SELECT order_id FROM c_patch WHERE reject_reason IS NULL AND sends)
    UNION ALL
    SELECT l.order_id, l.item_id, coalesce(l.quantity, 1) FROM b_line l JOIN c_patch p ON p.order_id = l.order_id
    WHERE p.reject_reason IS NULL AND p.sends""", [ORDER_BATCH, ORDER_LINES, ORDER_PATCHES, PATCH_CHECKED]))
def q_order_patch_lines(spark, sf_dir):
    """All order lines after the patches."""
    return _patch_orders(tables(spark, sf_dir))[1].select("order_id", "item_id", "quantity")
