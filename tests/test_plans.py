"""Physical-plan properties: pushdown, pruning, no window over a raw key."""

import io
from contextlib import redirect_stdout

from courierflow.operators import tracking as tr
from courierflow.plans.catalog import load_all
from courierflow.sources.fixtures import tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_kitchen_filter_reaches_scan(spark):
    t = tables(spark, SF)
    plan = _plan(tr.restaurants_by_kitchen(t.restaurant, 7))
    assert "PushedFilters: [IsNotNull(s_nationkey), EqualTo(s_nationkey,7)]" in plan


def test_tracking_scans_are_pruned(spark):
    plan = _plan(load_all()["order_tracking"].build(spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    # events are read for status and position only: no unused columns
    assert "event_type" not in plan


def test_per_user_rank_has_no_window_over_orders(spark):
    plan = _plan(load_all()["user_orders_recent"].build(spark, SF))
    # the range-partitioned rows are materialised once and both passes read
    # them; the only window runs over the bounded offsets table (partitioned
    # by the key, fed by MapInPandas boundary rows), never over the orders scan
    assert "ExistingRDD" in plan and "o_orderkey" not in plan
    window_lines = [l for l in plan.splitlines() if l.strip().startswith("Window") or "Window (" in l]
    assert len(window_lines) <= 2


def test_single_key_lookups(spark):
    t = tables(spark, SF)
    one = tr.last_location_of(t.position, 7).collect()
    batch = {r.courier_id: r for r in tr.last_location(t.position).collect()}
    assert len(one) == 1 and one[0].ts == batch[7].ts and one[0].lat == batch[7].lat
    plan = _plan(tr.last_location_of(t.position, 7))
    assert "TakeOrderedAndProject" in plan and "EqualTo(user_id,7)" in plan
    track = [r.ts for r in tr.track_of(t.position, "7").collect()]
    assert track == sorted(track) and len(track) > 0
    mine = tr.orders_of_user(t.orders, 1).collect()
    assert all(a.created_at >= b.created_at for a, b in zip(mine, mine[1:]))
