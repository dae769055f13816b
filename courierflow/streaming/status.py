"""Streaming status state machine (W4, streaming form).

State per delivery is one integer: the ordinal of the accepted status (-1
before the first).  Deliveries are dealt to groups by a hash; a micro-batch hands the
function the new requests of one group, which it folds delivery by delivery in
(updated_at, id) order, and a call costs the same for one delivery or hundreds.  Requests are
expected to arrive in time order (the original system stamps them on
arrival); within a micro-batch they are sorted.

Requests that arrive out of order take :func:`ordered_status_stream`: they are
held in state until the watermark has passed them, so the result is that of the
batch however they are spread over micro-batches.  State is read and written
once per group and micro-batch; it holds no more requests than come within the
allowed delay.  Requests later than the allowed delay are dropped by Spark and
counted in the query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from courierflow.schema import FINAL_STATUS, ORDER_STATUSES, REASON_FINAL, REASON_TRANSITION

OUTPUT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("delivery_id", T.LongType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("state_before", T.StringType()),
    T.StructField("reject_reason", T.StringType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("deliveries", T.ArrayType(T.LongType())),
    T.StructField("ordinals", T.ArrayType(T.IntegerType())),
])
HELD_SCHEMA = T.StructType(STATE_SCHEMA.fields + [
    T.StructField("held", T.ArrayType(T.LongType())),
    T.StructField("ats", T.ArrayType(T.LongType())),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("statuses", T.ArrayType(T.StringType())),
])
#: Groups that deliveries are dealt to by a hash; each is one call and one state row a micro-batch.
BUCKETS = 1024


def fold_requests(ordinal: int, statuses) -> tuple[int, list]:
    """Pure fold used by the streaming function: returns the new ordinal and
    one (accepted, state_before, reject_reason) per request."""
    out = []
    for s in statuses:
        before = ORDER_STATUSES[ordinal] if ordinal >= 0 else None
        if before == FINAL_STATUS:
            out.append((False, before, REASON_FINAL))
            continue
        expected = ORDER_STATUSES[ordinal + 1]
        if s == expected:
            out.append((True, before, None))
            ordinal += 1
        else:
            out.append((False, before, REASON_TRANSITION.format(expected=expected)))
    return ordinal, out


def _fold_runs(ordinals: dict, deliveries: list, statuses: list) -> dict:
    """Labels of requests sorted by (delivery, time, id); ``ordinals`` (delivery -> accepted ordinal) moves on."""
    import numpy as np
    res, n = [], len(deliveries)
    ends = [i for i in range(1, n) if deliveries[i] != deliveries[i - 1]] + [n]
    begin = 0
    for end in ends:
        d = deliveries[begin]
        ordinals[d], out = fold_requests(ordinals.get(d, -1), statuses[begin:end])
        res += out
        begin = end
    cols = zip(*res)
    return {"accepted": np.array(next(cols), dtype=bool), "state_before": list(next(cols)), "reject_reason": list(next(cols))}


def _or_null(values, null):
    import pandas as pd
    return pd.arrays.IntegerArray(values, null)


def _apply(key, pdfs, state):
    import numpy as np
    import pandas as pd
    ordinals = dict(zip(*state.get)) if state.exists else {}
    parts = [p for p in pdfs if len(p)]
    if not parts:
        return
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    x = {c: pdf[c].to_numpy() for c in pdf.columns}
    order = np.lexsort((x["id"], x["no_id"], x["updated_at"], x["delivery_id"], x["no_delivery"]))
    x = {c: v[order] for c, v in x.items()}
    delivery = _or_null(x["delivery_id"], x["no_delivery"])
    labels = _fold_runs(ordinals, np.where(x["no_delivery"], None, x["delivery_id"]).tolist(), x["status"].tolist())
    state.update((list(ordinals), list(ordinals.values())))
    yield pd.DataFrame({"id": _or_null(x["id"], x["no_id"]), "delivery_id": delivery, "updated_at": x["updated_at"], "status": x["status"], **labels})


def _dealt(requests: DataFrame, buckets: int) -> DataFrame:
    """Requests with their group; null ids as 0 and a flag, so that no frame turns whole numbers into floats."""
    flagged = [x for c, no in (("id", "no_id"), ("delivery_id", "no_delivery")) for x in (F.coalesce(c, F.lit(0).cast("bigint")).alias(c), F.col(c).isNull().alias(no))]
    return requests.select(*[F.col(c) for c in requests.columns if c not in ("id", "delivery_id")], *flagged, F.pmod(F.xxhash64("delivery_id"), F.lit(buckets)).alias("bucket"))


def status_transition_stream(requests: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Labelled requests, appended as they are decided."""
    return _dealt(requests.select("id", "delivery_id", "updated_at", "status"), buckets).groupBy("bucket") \
        .applyInPandasWithState(_apply, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _apply_ordered(key, pdfs, state):
    """Holds requests and folds, in order, those that the watermark has passed."""
    import numpy as np
    import pandas as pd
    known, ordinals, held, ats, ids, statuses = state.get if state.exists else ((),) * 6
    ordinals, held, ats, ids, statuses = dict(zip(known, ordinals)), list(held), list(ats), list(ids), list(statuses)
    for pdf in pdfs:
        if pdf.empty:  # a timeout
            continue
        pdf = pdf[~pdf["no_id"]]  # heartbeats: they only move the watermark
        held += np.where(pdf["no_delivery"], None, pdf["delivery_id"]).tolist()
        ats += pdf["at"].tolist()
        ids += pdf["id"].tolist()
        statuses += pdf["status"].tolist()
    if not ats:
        return
    at, ident, status = np.array(ats, dtype="int64"), np.array(ids, dtype="int64"), np.array(statuses, dtype=object)
    none = np.array([d is None for d in held])
    delivery = np.array([0 if d is None else d for d in held], dtype="int64")
    due = at <= state.getCurrentWatermarkMs() * 1000
    left = np.flatnonzero(~due)
    take = np.flatnonzero(due)
    take = take[np.lexsort((ident[take], at[take], delivery[take], none[take]))]
    labels = _fold_runs(ordinals, [held[i] for i in take.tolist()], status[take].tolist()) if len(take) else {}
    state.update((list(ordinals), list(ordinals.values()), [held[i] for i in left.tolist()], at[left].tolist(), ident[left].tolist(), status[left].tolist()))
    if len(left):  # fires as soon as the watermark reaches the millisecond in which the next one ends
        state.setTimeoutTimestamp(max(1, -(-int(at[left].min()) // 1000) - 1))
    if len(take):
        yield pd.DataFrame({"id": ident[take], "delivery_id": _or_null(delivery[take], none[take]), "at": at[take], "status": status[take], **labels})


def ordered_status_stream(requests: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Labelled requests, appended once no earlier one can arrive within ``delay`` any more.

    A row without id is a heartbeat: its ``updated_at`` moves the watermark and it gives no result."""
    out = T.StructType([T.StructField("at", T.LongType()) if f.name == "updated_at" else f for f in OUTPUT_SCHEMA])
    at = F.coalesce(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, updated_at)"), F.raise_error(F.lit("request without updated_at")).cast("bigint"))
    timed = _dealt(requests.select("id", "delivery_id", "status", at.alias("at")), buckets).withColumn("moment", F.timestamp_micros("at")).withWatermark("moment", delay)
    labelled = timed.groupBy("bucket").applyInPandasWithState(_apply_ordered, out, HELD_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return labelled.select("id", "delivery_id", F.expr(f"timestampadd(MICROSECOND, at, {_EPOCH})").alias("updated_at"), "status", "accepted", "state_before", "reject_reason")


def start_on_rocksdb(spark: SparkSession, start) -> StreamingQuery:
    """``start()`` with the state store that keeps held requests off the heap; other queries keep theirs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
