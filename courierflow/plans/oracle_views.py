"""The logical tables as SQL CTEs over the raw parquet views (DuckDB dialect).

These are the oracle-side twin of :mod:`courierflow.sources.fixtures`.  Each
logical table ``x`` is the CTE ``d_x``; the prefix keeps ``d_orders`` and
``d_region`` apart from the raw ``orders`` and ``region`` views.
"""

from __future__ import annotations

from courierflow.functions.geo import great_circle_sql

N = "(SELECT count(*) FROM supplier)"
G = "(SELECT count(*) FROM embeddings)"
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

STATUS_CASE = (
    "CASE {x} WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'PREPARING' WHEN 2 THEN 'READY_FOR_PICKUP' "
    "WHEN 3 THEN 'PICKED_UP' WHEN 4 THEN 'IN_TRANSIT' WHEN 5 THEN 'DELIVERED' END"
)

VIEWS: list[tuple[str, str]] = [
    ("d_region", "SELECT r_regionkey AS id, r_name AS name FROM region"),
    ("d_users", """
        SELECT c.c_custkey AS id,
               lower(replace(c.c_name, '#', '_')) || '@example.com' AS email,
               c.c_name AS name,
               CAST(-23.60 + (c.c_custkey % 1000) * 0.0001 AS DOUBLE) AS house_lat,
               CAST(-46.68 + (c.c_custkey % 997) * 0.0001 AS DOUBLE) AS house_lon,
               n.n_regionkey AS region_id
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    ("d_phones", """
        SELECT c_custkey AS user_id, '+55' || CAST(c_custkey AS VARCHAR) AS phone
        FROM customer WHERE c_custkey % 3 <> 0
        UNION ALL
        SELECT c_custkey AS user_id, '+56' || CAST(c_custkey AS VARCHAR) AS phone
        FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 = 0"""),
    ("d_kitchen_type", "SELECT n_nationkey AS id, n_name AS type FROM nation"),
    ("d_node", """
        SELECT vec_id AS id,
               CAST(-23.55 AS DOUBLE) + CAST(0.05 AS DOUBLE) * CAST(embedding[1] AS DOUBLE) AS lat,
               CAST(-46.63 AS DOUBLE) + CAST(0.05 AS DOUBLE) * CAST(embedding[2] AS DOUBLE) AS lon
        FROM embeddings"""),
    ("d_edge", f"""
        SELECT t.u, t.v, round({great_circle_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS length
        FROM (SELECT id AS u, (id + 1) % {G} AS v FROM d_node
              UNION ALL SELECT id AS u, (id * 7 + 1) % {G} AS v FROM d_node
              UNION ALL SELECT id AS u, (id * 13 + 5) % {G} AS v FROM d_node) t
        JOIN d_node a ON a.id = t.u
        JOIN d_node b ON b.id = t.v
        WHERE t.v % 50 <> 0"""),
    ("d_restaurant", f"""
        SELECT s.s_suppkey AS id, s.s_name AS name,
               nd.lat + CAST(0.00001 AS DOUBLE) AS lat, nd.lon AS lon,
               s.s_nationkey AS kitchen_type_id, n.n_regionkey AS region_id
        FROM supplier s
        LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
        LEFT JOIN d_node nd ON nd.id = (s.s_suppkey * 31 + 1) % {G}"""),
    ("d_courier", f"""
        SELECT s.s_suppkey AS id, 'Courier ' || CAST(s.s_suppkey AS VARCHAR) AS name,
               CASE s.s_suppkey % 3 WHEN 0 THEN 'BIKE' WHEN 1 THEN 'MOTORCYCLE' ELSE 'CAR' END AS vehicle,
               nd.lat AS lat, nd.lon + CAST(0.00001 AS DOUBLE) AS lon,
               n.n_regionkey AS region_id
        FROM supplier s
        LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
        LEFT JOIN d_node nd ON nd.id = (s.s_suppkey * 17 + 3) % {G}"""),
    ("d_item", f"""
        SELECT p_partkey AS id, p_name AS name, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
               p_partkey % {N} AS restaurant_id
        FROM part"""),
    ("d_orders", f"""
        SELECT o_orderkey AS id, o_orderkey % {N} AS restaurant_id, o_custkey AS user_id,
               o_orderdate AS created_at
        FROM orders"""),
    ("d_order_item_raw", """
        SELECT l_orderkey AS order_id, l_partkey AS item_id, CAST(l_quantity AS INTEGER) AS quantity,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                  l_quantity, l_extendedprice, l_shipdate) AS line_no
        FROM lineitem"""),
    ("d_order_item", """
        SELECT l_orderkey AS order_id, l_partkey AS item_id,
               CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity
        FROM lineitem GROUP BY l_orderkey, l_partkey"""),
    ("d_delivery", """
        SELECT DISTINCT user_id AS id, user_id AS order_id, user_id // 2 AS courier_id FROM events"""),
    ("d_event", f"""
        SELECT event_id AS id, {STATUS_CASE.format(x=K + ' % 6')} AS status,
               ts AS updated_at, user_id AS delivery_id
        FROM events"""),
    ("d_position", f"""
        SELECT user_id AS courier_id, ts, CAST(user_id AS VARCHAR) AS delivery_id,
               CAST(-23.5505 AS DOUBLE) + value / CAST(50000.0 AS DOUBLE) AS lat,
               CAST(-46.6333 AS DOUBLE) + CAST({K} AS DOUBLE) / CAST(10000.0 AS DOUBLE) AS lon,
               event_id // 10 AS batch_id, event_id AS arrival_seq
        FROM events"""),
]

# Derived views shared by several oracles.
SHARED: list[tuple[str, str]] = [
    # latest status per delivery: arg-max by (updated_at, id)
    ("d_latest", """
        SELECT delivery_id, status, updated_at AS status_updated_at, id AS status_event_id
        FROM (SELECT e.*, row_number() OVER (PARTITION BY delivery_id ORDER BY updated_at DESC, id DESC) AS rn
              FROM d_event e) WHERE rn = 1"""),
    # deliveries still in progress: no events, or latest status not DELIVERED
    ("d_active", """
        SELECT d.id, d.order_id, d.courier_id
        FROM d_delivery d LEFT JOIN d_latest l ON l.delivery_id = d.id
        WHERE l.status IS DISTINCT FROM 'DELIVERED'"""),
    ("d_available", """
        SELECT c.* FROM d_courier c WHERE NOT EXISTS (SELECT 1 FROM d_active a WHERE a.courier_id = c.id)"""),
    # last known position per courier
    ("d_last_pos", """
        SELECT courier_id, ts, delivery_id, lat, lon
        FROM (SELECT p.*, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, arrival_seq DESC) AS rn
              FROM d_position p) WHERE rn = 1"""),
]


def oracle(select_sql: str, ctes: list[tuple[str, str]] | tuple = (), recursive: bool = False) -> str:
    """Full oracle statement: all logical views, shared views, extra CTEs, body."""
    parts = [f"{name} AS ({body.strip()})" for name, body in [*VIEWS, *SHARED, *ctes]]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + select_sql.strip()
