"""Cases that earlier checks missed: two jobs on one history, late first
deliveries, cascades of referenced children, rank passes without exchange
reuse, the antimeridian, null points, time offsets, Kafka partitions, shared
checkpoint folder."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from courierflow import session as se
from courierflow.operators import merge as mg
from courierflow.operators import positions as po
from courierflow.operators.geo import nearest_node
from courierflow.operators.ranking import rank_within_key
from courierflow.schema import RAW_MESSAGE
from courierflow.sources.messages import kafka_rows, read_message_stream
from courierflow.sources.tables import conform, jdbc_options
from courierflow.streaming import positions as sp

from test_streaming import _land, _msg

T0 = 1704110400000
DAY = 86_400_000


def _folders(n):
    root = tempfile.mkdtemp(prefix="cf-r2-")
    return [os.path.join(root, str(i)) for i in range(n)]


def test_two_jobs_on_one_history_keep_both(spark):
    a, b, hist, rej, ck1, ck2, into = _folders(7)
    for src, courier in ((a, 1), (b, 2)):
        os.makedirs(src)
        _land(spark, src, "x", [_msg(0, courier, T0, 1.0), _msg(1, courier, T0 + DAY, 2.0)])
    sp.start_condense(read_message_stream(spark, a + "/*"), hist, rej, ck1).awaitTermination()
    sp.start_condense(read_message_stream(spark, b + "/*"), hist, rej, ck2).awaitTermination()
    rows = sorted((r.courier_id, r.lat) for r in sp.read_history(spark, hist).collect())
    assert rows == [(1, 2.0), (2, 2.0)]  # one receive batch per job: the newest per courier
    # a batch put never replaces a stream's epoch 0
    extra = spark.createDataFrame([(0, 3, dt.datetime(2024, 1, 5), None, 5.0, 6.0, 9)],
                                  "batch_id bigint, courier_id bigint, ts timestamp_ntz, delivery_id string, lat double, lon double, message_id bigint")
    sp.write_history(extra, hist, 0)
    assert sp.read_history(spark, hist).count() == 3
    sp.compact_history(spark, hist, into)
    assert sorted(map(tuple, sp.read_history(spark, into).collect())) == sorted(map(tuple, sp.read_history(spark, hist).collect()))
    sp.write_history(extra.withColumn("lat", F.lit(7.5)), into, 0)
    assert {r.lat for r in sp.read_history(spark, into).where("courier_id = 3").collect()} == {7.5}
    assert {p.split("=")[0] for p in os.listdir(hist) if "=" in p} == {"date"}


def test_late_first_deliveries_survive_dedup(spark):
    src, out, ck = _folders(3)
    os.makedirs(src)
    for k, rows in enumerate([[_msg(0, 7, T0 + 30 * DAY, 1.0)], [_msg(1, 7, T0, 2.0)], [_msg(2, 7, T0 + 30 * DAY, 1.0), _msg(3, 8, T0 + DAY, 3.0)], [_msg(4, 7, T0, 2.0)]]):
        _land(spark, src, f"f{k}", rows)
        sp.start_append(sp.redelivery_dedup_stream(read_message_stream(spark, src + "/*", max_files_per_trigger=1)), out, ck).awaitTermination()
    assert sorted((r.courier_id, r.lat) for r in spark.read.parquet(out).collect()) == [(7, 1.0), (7, 2.0), (8, 3.0)]


def test_current_log_compacts_to_a_row_per_courier(spark):
    src, log, ck, into = _folders(4)
    os.makedirs(src)
    for k in range(3):
        _land(spark, src, f"f{k}", [_msg(k, 7, T0 + k * DAY, float(k))])
        sp.start_latest_position(read_message_stream(spark, src + "/*"), log, ck).awaitTermination()
    sp.compact_current_positions(spark, log, into)
    assert spark.read.parquet(into).count() == 1
    assert sp.read_current_positions(spark, into).collect() == sp.read_current_positions(spark, log).collect()


def test_cascade_is_refused_while_a_child_is_referenced(spark):
    rest = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    item = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "id bigint, restaurant_id bigint")
    line = spark.createDataFrame([(100, 10)], "order_id bigint, item_id bigint")
    orders = spark.createDataFrame([], "id bigint, restaurant_id bigint")
    out = mg.apply_deletes(spark.createDataFrame([(1,), (2,), (3,), (9,)], "id bigint"), rest, [(orders, "restaurant_id")],
                           cascades=[(item, "restaurant_id", [(line, "item_id")])])
    assert {r.id: (r.outcome, r.n_cascaded) for r in out.collect()} == {1: ("refused", 0), 2: ("deleted", 1), 3: ("deleted", 0), 9: ("not found", 0)}
    assert [r.id for r in mg.children_after_deletes(item, "restaurant_id", out).orderBy("id").collect()] == [10, 11]


def test_order_patches_are_checked_line_by_line(spark):
    orders = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5), (5, 5)], "id bigint, restaurant_id bigint")
    item = spark.createDataFrame([(10, 5), (11, 5), (12, 6)], "id bigint, restaurant_id bigint")
    rows = [(1, [(10, 1), (11, None)]), (2, [(10, 1), (12, 1), (10, 1)]), (3, [(10, 1), (10, 1), (12, 1)]), (4, [(10, 0)]), (5, None), (9, [(10, 1)])]
    patches = spark.createDataFrame(rows, "order_id bigint, items array<struct<item_id:bigint,quantity:int>>")
    got = {r.order_id: r.reject_reason for r in mg.check_order_patches(patches, orders, item).collect()}
    assert got == {1: None, 2: "Item not found for the informed restaurant.", 3: "Duplicated item in order payload.",
                   4: "Item quantity must be at least 1.", 5: None, 9: "Order not found."}


def test_ranks_do_not_depend_on_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(0, 200_000, 1, 8).select((F.col("id") % 3).alias("k"), F.rand(5).alias("v"), "id")
        df = df.select("k", F.round("v", 3).alias("v"), "id")
        got = rank_within_key(df, ["k"], ["v", "id"], num_partitions=8)
        stats = got.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.min("rn").alias("lo"), F.max("rn").alias("hi")).collect()
        assert all(r.n == r.d == r.hi and r.lo == 1 for r in stats)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_nearest_node_across_the_antimeridian_and_null_points(spark):
    nodes = spark.createDataFrame([(1, 0.0, 179.99), (10, 0.0, -179.9), (20, 40.0, 0.0)], "id bigint, lat double, lon double")
    pts = spark.createDataFrame([(1, 0.0, -179.99), (2, None, 5.0), (3, 0.0, 179.0), (4, 41.0, 1.0), (5, 10.0, None)], "p bigint, lat double, lon double")
    got = {r.p: (r.node_id, r.dist_m) for r in nearest_node(pts, nodes, ["p"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: None, 3: 1, 4: 20, 5: None}
    assert got[1][1] == pytest.approx(2224, rel=0.01)
    for cell in (0.01, 1.0, 200.0):
        again = {r.p: r.node_id for r in nearest_node(pts, nodes, ["p"], cell_deg=cell).collect()}
        assert again == {k: v[0] for k, v in got.items()}


def test_iso_offsets_become_utc(spark):
    texts = ["2024-01-01T10:00:00-03:00", "2024-01-01T10:00:00+0530", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00", "2024-01-01 10:00:00.25", "junk", "1704110400123"]
    body = lambda t: '{"courier_id": 1, "lat": 1, "lng": 2, "timestamp": "%s"}' % t
    raw = spark.createDataFrame([(i, body(t)) for i, t in enumerate(texts)], RAW_MESSAGE)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        got = {r.message_id: r.ts for r in po.parse_messages(raw).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    day = dt.datetime(2024, 1, 1)
    assert got == {0: day.replace(hour=13), 1: day.replace(hour=4, minute=30), 2: day.replace(hour=10), 3: day.replace(hour=10),
                   4: day.replace(hour=10, microsecond=250000), 5: None, 6: day.replace(hour=12, microsecond=123000)}


def test_kafka_ids_keep_partitions_apart(spark):
    raw = spark.createDataFrame([(p, o, bytearray(b"x")) for p in (0, 1, 5) for o in range(25)], "partition int, offset bigint, value binary")
    rows = kafka_rows(raw).select(F.expr("message_id div 10").alias("b"), "message_id", "body").collect()
    assert len({r.message_id for r in rows}) == 75 and {r.body for r in rows} == {"x"}
    per_batch = {}
    for r in rows:
        per_batch.setdefault(r.b, []).append(r.message_id)
    assert sorted(len(v) for v in per_batch.values()) == [5, 5, 5, 10, 10, 10, 10, 10, 10]


def test_unset_checkpoint_folder_is_an_error_off_local_masters():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        se.checkpoint_dir(Session())
    assert se._is_local("local") and se._is_local("local[8]") and not se._is_local("local-cluster[2,1,1024]") and not se._is_local("yarn")


def test_declared_schema_is_applied_on_read(spark):
    raw = spark.createDataFrame([("7", "a", 1.005, "3", "extra")], "id string, name string, price double, restaurant_id string, more string")
    df = conform(raw, "item")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("id", "bigint"), ("name", "string"), ("price", "decimal(10,2)"), ("restaurant_id", "bigint")]
    with pytest.raises(Exception, match="null in item.name"):
        conform(raw.withColumn("name", F.lit(None).cast("string")), "item").collect()
    options = jdbc_options("jdbc:x", "orders", "id", 0, 1000, 16)
    assert options["numPartitions"] == "16" and options["partitionColumn"] == "id"


def test_status_fold_splits_a_hot_delivery(spark):
    import random

    from courierflow.operators.status_machine import status_transitions
    from courierflow.schema import EVENT, ORDER_STATUSES
    from courierflow.streaming.status import fold_requests

    rng = random.Random(8)
    rows = []
    for i in range(4000):
        d = 7 if i % 3 else rng.randrange(20)
        # rare successes, so that the hot delivery's chain spans many partitions
        s = ORDER_STATUSES[0] if i < 2 else (rng.choice(ORDER_STATUSES) if rng.random() < 0.02 else "UNKNOWN")
        rows.append((i, s, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(3000)), d))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {r.id: (r.accepted, r.state_before, r.reject_reason) for r in status_transitions(spark.createDataFrame(rows, EVENT), num_partitions=16).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for d in {r[3] for r in rows}:
        mine = sorted((r for r in rows if r[3] == d), key=lambda r: (r[2], r[0]))
        want.update(zip([r[0] for r in mine], fold_requests(-1, [r[1] for r in mine])[1]))
    assert got == want
    assert len([1 for r in rows if r[3] == 7 and got[r[0]][0]]) > 2
