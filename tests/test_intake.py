"""Hand-made cases of the intake operators (M1) and patches (M2)."""

from courierflow.operators import intake as ik

KITCHEN = "id bigint, type string"
USER = "seq bigint, email string, name string, phones array<string>"
ORDERS = "id bigint, restaurant_id bigint, user_id bigint"
PATCH = "order_id bigint, restaurant_id bigint, user_id bigint, items array<struct<item_id: bigint, quantity: int>>"


def test_a_rejected_user_does_not_hold_its_address(spark):
    users = spark.createDataFrame([(7, "old@example.com")], "id bigint, email string")
    batch = spark.createDataFrame([
        (1, "a@example.com", "A", ["1", "1"]), (2, "a@example.com", "A", ["1", "2"]), (3, "a@example.com", "A", None),
        (4, "old@example.com", "O", None), (5, "b@example.com", "B", None), (6, "c@example.com", "C", ["x" * 21]), (7, None, "N", None),
        (8, "d@example.com", "D", [None])], USER)
    fresh, phones, checked = ik.insert_users(batch, users, ["seq"])
    assert {(r.id, r.seq) for r in fresh.collect()} == {(8, 2), (9, 5)}
    assert {(r.user_id, r.phone) for r in phones.collect()} == {(8, "1"), (8, "2")}
    conflict = "User already exists or payload violates constraints."
    assert {r.seq: r.reject_reason for r in checked.collect()} == {1: conflict, 2: None, 3: conflict, 4: conflict, 5: None, 6: conflict, 7: "Invalid email.", 8: conflict}


def test_kitchens_are_unique_and_bounded(spark):
    kitchen = spark.createDataFrame([(1, "THAI"), (2, "GREEK")], KITCHEN)
    batch = spark.createDataFrame([(1, "THAI"), (2, "NEW"), (3, "NEW"), (4, None), (5, "x" * 101), (6, "x" * 100)], "seq bigint, type string")
    fresh, checked = ik.insert_kitchens(batch, kitchen, ["seq"])
    assert {(r.id, r.seq) for r in fresh.collect()} == {(3, 2), (4, 6)}
    assert checked.count() == 6
    fresh, checked = ik.insert_kitchens(batch.where("1 = 0"), kitchen, ["seq"])
    assert fresh.collect() == [] and checked.collect() == []


def test_kitchen_patches(spark):
    kitchen = spark.createDataFrame([(1, "THAI"), (2, "GREEK"), (3, "PERSIAN"), (4, "LAO")], KITCHEN)
    patches = spark.createDataFrame([(1, "THAI"), (2, "THAI"), (3, "NEW"), (4, "NEW"), (9, "NEW")], KITCHEN)
    new, checked = ik.patch_kitchens(patches, kitchen, ["id"])
    assert {(r.id, r.type) for r in new.collect()} == {(1, "THAI"), (2, "GREEK"), (3, "NEW"), (4, "LAO")}
    conflict = "Kitchen already exists or payload violates constraints."
    assert {r.id: r.reject_reason for r in checked.collect()} == {1: None, 2: conflict, 3: None, 4: conflict, 9: "Kitchen not found."}


def test_restaurant_needs_a_known_kitchen_first(spark):
    kitchen = spark.createDataFrame([(1, "THAI")], KITCHEN)
    table = spark.createDataFrame([(5, "r")], "id bigint, name string")
    batch = spark.createDataFrame([(1, "ok", 0.0, 0.0, 1), (2, "x" * 256, 0.0, 0.0, 9), (3, "x" * 256, 0.0, 0.0, 1), (4, "n", None, 0.0, 1), (5, "n", 0.0, 0.0, None)],
                                  "seq bigint, name string, lat double, lon double, kitchen_type_id bigint")
    fresh, checked = ik.insert_restaurants(batch, table, kitchen, ["seq"])
    assert [(r.id, r.seq) for r in fresh.collect()] == [(6, 1)]
    assert {r.seq: r.reject_reason for r in checked.collect()} == {
        1: None, 2: "Kitchen type not found.", 3: "Invalid name.", 4: "Missing coordinates.", 5: "Kitchen type not found."}


def order_tables(spark):
    return (spark.createDataFrame([(10, 1, 5), (11, 1, 5), (12, 2, 6)], ORDERS),
            spark.createDataFrame([(10, 100, 1), (11, 100, 2), (12, 200, 3)], "order_id bigint, item_id bigint, quantity int"),
            spark.createDataFrame([(1, ), (2, )], "id bigint"), spark.createDataFrame([(5, ), (6, )], "id bigint"),
            spark.createDataFrame([(100, 1), (101, 1), (200, 2)], "id bigint, restaurant_id bigint"))


def test_order_patch_checks_items_against_the_next_restaurant(spark):
    orders, lines, restaurant, users, item = order_tables(spark)

    def outcome(*patch):
        new, kept, checked = ik.patch_orders(spark.createDataFrame([patch], PATCH), orders, lines, restaurant, users, item)
        row = [tuple(r) for r in new.where(f"id = {patch[0]}").collect()]
        return checked.collect()[0].reject_reason, row, {tuple(r) for r in kept.where(f"order_id = {patch[0]}").collect()}

    assert outcome(10, 2, 6, [(200, None)]) == (None, [(10, 2, 6)], {(10, 200, 1)})
    assert outcome(10, 2, None, None) == (None, [(10, 2, 5)], {(10, 100, 1)})
    foreign = "Item not found for the informed restaurant."
    assert outcome(10, 2, None, [(100, 1)]) == (foreign, [(10, 1, 5)], {(10, 100, 1)})
    assert outcome(10, None, None, [(101, 4)]) == (None, [(10, 1, 5)], {(10, 101, 4)})
    assert outcome(10, None, None, []) == (None, [(10, 1, 5)], set())
    assert outcome(10, 9, 9, [(100, 1)])[0] == "Restaurant not found."
    assert outcome(10, None, 9, [(200, 1)])[0] == "User not found."
    assert outcome(99, 9, None, None)[0] == "Order not found."
    assert outcome(99, 9, None, [(100, 0)])[0] == "Item quantity must be at least 1."
    assert outcome(10, 1, None, [(100, 1), (100, 1)])[0] == "Duplicated item in order payload."


def test_orders_enter_with_all_their_lines_or_not(spark):
    orders, _, restaurant, users, item = order_tables(spark)
    requests = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 2, 6), (4, 1, 5), (5, 1, 9)], "order_id bigint, restaurant_id bigint, user_id bigint")
    lines = spark.createDataFrame([(1, 1, 100, None), (1, 2, 101, 3), (2, 1, 100, 1), (2, 2, 200, 1), (3, 1, 200, 2), (5, 1, 100, 1)],
                                  "order_id bigint, line_no int, item_id bigint, quantity int")
    fresh, own, checked = ik.insert_orders(requests, lines, orders, restaurant, users, item)
    assert {tuple(r) for r in fresh.collect()} == {(13, 1, 1, 5), (14, 3, 2, 6)}
    assert {tuple(r) for r in own.collect()} == {(13, 100, 1), (13, 101, 3), (14, 200, 2)}
    assert {r.order_id for r in checked.where("reject_reason IS NOT NULL").collect()} == {2, 4, 5}


def test_item_patches(spark):
    item = spark.createDataFrame([(1, "a", 5.0, 1), (2, "b", 5.0, 1)], "id bigint, name string, price double, restaurant_id bigint")
    restaurant = spark.createDataFrame([(1, ), (2, )], "id bigint")
    conflict = "Item already exists or payload violates constraints."
    for patch, reason, row in [((1, None, 0.0, 2), None, (1, "a", 0.0, 2)), ((1, None, -0.5, None), conflict, (1, "a", 5.0, 1)),
                               ((1, "x" * 256, None, None), conflict, (1, "a", 5.0, 1)), ((1, "z", -1.0, 9), "Restaurant not found.", (1, "a", 5.0, 1)),
                               ((1, None, None, None), None, (1, "a", 5.0, 1)), ((7, "z", None, None), "Item not found.", (1, "a", 5.0, 1))]:
        new, rejected = ik.patch_items(spark.createDataFrame([patch], item.schema), item, restaurant)
        assert [r.reject_reason for r in rejected.collect()] == ([reason] if reason else [])
        assert [tuple(r) for r in new.where("id = 1").collect()] == [row] and new.count() == 2


def test_order_intake_numbers_and_checks_lines_once(spark):
    """The plans of the results read written tables: lines are not numbered and payloads not checked again per branch."""
    from courierflow.plans import intake_views as iv
    from courierflow.sources.fixtures import tables

    t = tables(spark, "/root/testdata/sf0.001")
    rejects = iv._insert_orders(t)[2]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in rejects and "Join" not in rejects
    patched = iv._patch_orders(t)[2]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in patched and "Join" not in patched
