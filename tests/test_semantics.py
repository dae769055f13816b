"""Hand-made cases, one per semantic trap (inline DataFrames)."""

import datetime as dt

from pyspark.sql import functions as F

from courierflow.operators import availability as av
from courierflow.operators import merge as mg
from courierflow.operators import positions as po
from courierflow.operators import rules as ru
from courierflow.operators import status_machine as sm
from courierflow.schema import REASON_FINAL

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def ts(sec):
    return T0 + dt.timedelta(seconds=sec)


EVENT_SCHEMA = "id bigint, status string, updated_at timestamp_ntz, delivery_id bigint"
DELIVERY_SCHEMA = "id bigint, order_id bigint, courier_id bigint"
COURIER_SCHEMA = "id bigint, name string, vehicle string, lat double, lon double"


def test_status_tie_higher_id_wins(spark):
    ev = spark.createDataFrame([(1, "CONFIRMED", ts(0), 7), (2, "PREPARING", ts(0), 7)], EVENT_SCHEMA)
    row = av.latest_status(ev).collect()[0]
    assert row.status == "PREPARING" and row.status_event_id == 2


def test_availability_traps(spark):
    courier = spark.createDataFrame([(1, "a", "BIKE", 0.0, 0.0), (2, "b", "CAR", 0.0, 0.0),
                                     (3, "c", "CAR", 0.0, 0.0)], COURIER_SCHEMA)
    # courier 1: delivery without events (busy); courier 2: delivered; courier 3: none
    delivery = spark.createDataFrame([(10, 100, 1), (20, 200, 2)], DELIVERY_SCHEMA)
    ev = spark.createDataFrame([(5, "DELIVERED", ts(1), 20)], EVENT_SCHEMA)
    avail = {r.id for r in av.available_couriers(courier, delivery, ev).collect()}
    assert avail == {2, 3}
    flags = {r.courier_id: r.all_delivered for r in av.courier_all_delivered(courier, delivery, ev).collect()}
    assert flags == {1: False, 2: True, 3: True}
    busy = {r.courier_id: r.busy for r in av.courier_busy(delivery, ev).collect()}
    assert busy == {1: True, 2: False}


def _fold(spark, statuses):
    ev = spark.createDataFrame([(i + 1, s, ts(i), 1) for i, s in enumerate(statuses)], EVENT_SCHEMA)
    return [(r.accepted, r.reject_reason) for r in sm.status_transitions(ev).orderBy("id").collect()]


def test_status_fold_skip_and_recover(spark):
    out = _fold(spark, ["CONFIRMED", "READY_FOR_PICKUP", "PREPARING"])
    assert out[0] == (True, None)
    assert out[1] == (False, "Invalid delivery status transition. Expected PREPARING.")
    assert out[2] == (True, None)


def test_status_fold_after_final(spark):
    out = _fold(spark, ["CONFIRMED", "PREPARING", "READY_FOR_PICKUP", "PICKED_UP", "IN_TRANSIT", "DELIVERED",
                        "CONFIRMED"])
    assert all(a for a, _ in out[:6])
    assert out[6] == (False, REASON_FINAL)


def test_status_fold_first_request_must_confirm(spark):
    out = _fold(spark, ["PREPARING", "CONFIRMED"])
    assert out == [(False, "Invalid delivery status transition. Expected CONFIRMED."), (True, None)]


MSG = "message_id bigint, body string"


def test_message_parse_and_rejects(spark):
    raw = spark.createDataFrame([
        (1, '{"courier_id": 7, "lat": -23.5, "lng": -46.6, "timestamp": 1704110400000}'),
        (2, '{"courier_id": 7, "delivery_id": "9", "lat_courier": -23.4, "lon_courier": -46.5, '
            '"timestamp": "2024-01-01T12:00:01.250000"}'),
        (3, 'not json'),
        (4, '{"lat": 1.0, "lng": 2.0, "timestamp": 1704110400000}'),
        (5, '{"courier_id": 8, "lat": 1.0, "lng": 2.0, "timestamp": "yesterday"}'),
    ], MSG)
    parsed = {r.message_id: r for r in po.parse_messages(raw).collect()}
    assert parsed[1].reject_reason is None and parsed[1].ts == dt.datetime(2024, 1, 1, 12, 0, 0)
    assert parsed[2].reject_reason is None and parsed[2].delivery_id == "9" and parsed[2].lat == -23.4
    assert parsed[2].ts == dt.datetime(2024, 1, 1, 12, 0, 1, 250000)
    assert parsed[3].reject_reason == po.REASON_UNPARSEABLE
    assert parsed[4].reject_reason == po.REASON_NO_COURIER
    assert parsed[5].reject_reason == po.REASON_BAD_TIME


def test_in_batch_tie_first_received_wins(spark):
    pos = spark.createDataFrame([(0, 7, ts(5), None, 1.0, 1.0, 1), (0, 7, ts(5), None, 2.0, 2.0, 2),
                                 (0, 7, ts(3), None, 3.0, 3.0, 3)],
                                "batch_id bigint, courier_id bigint, ts timestamp_ntz, delivery_id string, "
                                "lat double, lon double, message_id bigint")
    r = po.dedup_latest_in_batch(pos).collect()
    assert len(r) == 1 and r[0].lat == 1.0 and r[0].message_id == 1


def test_patch_null_keeps_and_unknown_rejected(spark):
    table = spark.createDataFrame([(1, "a", "BIKE", 0.0, 0.0)], COURIER_SCHEMA)
    patches = spark.createDataFrame([(1, None, "CAR", None, 5.0), (9, "x", None, None, None)], COURIER_SCHEMA)
    new, rej = mg.apply_patches(table, patches, "id", ["name", "vehicle", "lat", "lon"], not_found_reason="nf")
    row = new.collect()[0]
    assert (row.name, row.vehicle, row.lat, row.lon) == ("a", "CAR", 0.0, 5.0)
    assert [r.id for r in rej.collect()] == [9]


def test_replace_items_null_empty_given(spark):
    lines = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (3, 30, 1)],
                                  "order_id bigint, item_id bigint, quantity int")
    patches = spark.createDataFrame(
        [(1, None), (2, []), (3, [(31, None)])],
        "order_id bigint, items array<struct<item_id:bigint,quantity:int>>")
    out = sorted(tuple(r) for r in mg.replace_order_items(lines, patches).collect())
    assert out == [(1, 10, 1), (1, 11, 2), (3, 31, 1)]


def test_deletes_refused_and_cascade(spark):
    rest = spark.createDataFrame([(1,), (2,)], "id bigint")
    orders = spark.createDataFrame([(100, 1)], "id bigint, restaurant_id bigint")
    items = spark.createDataFrame([(5, 2), (6, 2)], "id bigint, restaurant_id bigint")
    out = {r.id: (r.outcome, r.n_cascaded) for r in mg.apply_deletes(
        spark.createDataFrame([(1,), (2,), (3,)], "id bigint"), rest, [(orders, "restaurant_id")],
        cascades=[(items, "restaurant_id")]).collect()}
    assert out == {1: ("refused", 0), 2: ("deleted", 2), 3: ("not found", 0)}
    left = mg.children_after_deletes(items, "restaurant_id", mg.apply_deletes(
        spark.createDataFrame([(2,)], "id bigint"), rest, [(orders, "restaurant_id")]))
    assert left.count() == 0


def test_order_payload_reason_precedence(spark):
    orders = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 9, 1)], "order_id bigint, restaurant_id bigint, user_id bigint")
    # order 1: line 2 foreign item beats line 3 duplicate; order 2: duplicate at line 2 first
    lines = spark.createDataFrame([
        (1, 1, 10, 1), (1, 2, 99, 1), (1, 3, 10, 1),
        (2, 1, 10, 1), (2, 2, 10, 1), (2, 3, 99, 1),
        (3, 1, 10, 1)], "order_id bigint, line_no int, item_id bigint, quantity int")
    rest = spark.createDataFrame([(1,)], "id bigint")
    users = spark.createDataFrame([(1,)], "id bigint")
    item = spark.createDataFrame([(10, 1), (99, 2)], "id bigint, restaurant_id bigint")
    out = {r.order_id: r.reject_reason for r in ru.validate_order_payload(orders, lines, rest, users, item).collect()}
    assert out[1] == "Item not found for the informed restaurant."
    assert out[2] == "Duplicated item in order payload."
    assert out[3] == "Restaurant not found."


def test_intake_rows(spark):
    item = spark.createDataFrame([(1, -1.0), (2, 0.0)], "id bigint, price double")
    assert {r.id: r.reject_reason for r in ru.check_price(item).collect()} == {1: "Price must be non-negative.", 2: None}
    lines = spark.createDataFrame([(1, 0), (2, None)], "order_id bigint, quantity int")
    out = {r.order_id: (r.quantity, r.reject_reason) for r in ru.check_quantity(lines).collect()}
    assert out == {1: (0, "Item quantity must be at least 1."), 2: (1, None)}
    couriers = spark.createDataFrame([(1, "x" * 300, "BIKE", 0.0, 0.0), (2, "ok", "TRUCK", 0.0, 0.0)], COURIER_SCHEMA)
    assert {r.id: r.reject_reason for r in ru.check_courier_row(couriers).collect()} == {
        1: "Invalid name.", 2: "Invalid vehicle."}
    users = spark.createDataFrame([(1, "a", "a@x.com"), (2, "b", "a@x.com"), (3, "c", "new@x.com"), (4, "d", "bad")],
                                  "id bigint, name string, email string")
    existing = spark.createDataFrame([("new@x.com",)], "email string")
    u = {r.id: r.reject_reason for r in ru.unique_split(users, existing, ["email"], ["id"]).collect()}
    assert u == {1: None, 2: "Duplicate key.", 3: "Duplicate key.", 4: None}
    assert {r.id: r.reject_reason for r in ru.check_user_row(users).collect()}[4] == "Invalid email."


def test_delivery_update_unknown_courier_not_found(spark):
    delivery = spark.createDataFrame([(1, 10, 5), (2, 20, 6)], DELIVERY_SCHEMA)
    orders = spark.createDataFrame([(10,), (20,)], "id bigint")
    courier = spark.createDataFrame([(5, "a", "BIKE", 0.0, 0.0), (6, "b", "BIKE", 0.0, 0.0)], COURIER_SCHEMA)
    ev = spark.createDataFrame([], EVENT_SCHEMA)
    patches = spark.createDataFrame([(1, None, 99), (1, None, 6), (1, None, 5), (3, None, 5)],
                                    "delivery_id bigint, order_id bigint, courier_id bigint")
    out = sorted((r.delivery_id, r.courier_id, r.reject_reason) for r in
                 ru.validate_delivery_update(patches, delivery, orders, courier, ev).collect())
    assert out == [(1, 5, None), (1, 6, "Courier is currently busy with another delivery."),
                   (1, 99, "Courier not found."), (3, 5, "Delivery not found.")]


def test_iso_text_and_coordinate_round_trip(spark):
    from courierflow.functions.values import coordinate_text_round_trip, iso_utc_text
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12, 0, 0), -23.5505131),
                                (dt.datetime(2024, 1, 1, 12, 0, 0, 5), 0.1 + 0.2)], "ts timestamp_ntz, x double")
    out = df.select(iso_utc_text("ts").alias("t"), coordinate_text_round_trip("x").alias("y"), "x").collect()
    assert [r.t for r in out] == ["2024-01-01T12:00:00", "2024-01-01T12:00:00.000005"]
    assert all(r.y == r.x for r in out)


def test_server_time_is_utc_wall_clock(spark):
    before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.createDataFrame([(7,)], "courier_id bigint")
        got = po.stamp_server_time(df).first().ts
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    after = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert before - dt.timedelta(seconds=1) <= got <= after + dt.timedelta(seconds=1)


def test_name_length_of_restaurants_items_and_regions(spark):
    rows = spark.createDataFrame([(1, "x" * 255), (2, "x" * 256), (3, None), (4, "")], "id bigint, name string")
    assert {r.id: r.reject_reason for r in ru.check_name_row(rows).collect()} == {1: None, 2: "Invalid name.", 3: "Invalid name.", 4: None}
