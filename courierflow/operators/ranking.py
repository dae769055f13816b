"""Skew-safe row numbering within a key (``row_number() OVER (PARTITION BY
key ORDER BY ...)`` without sending a whole key to one task).

A window partitioned by ``key`` hash-shuffles every row of a key to one task;
a key holding a third of the table would then be a single straggler.  Here:

1. ``repartitionByRange(key, order...)`` + sort: a hot key is split across
   many range partitions (the order columns break it up);
2. per partition, a vectorised pass numbers rows within each key run
   (``local``), carrying the count across Arrow batches;
3. a second pass over the same sorted data emits, per partition, only its
   first and last key runs (the run's first row and its length): at most two
   rows per partition, so that table is bounded by ``2 * partitions`` and
   safe to broadcast;
4. a run's offset is the total length of the same key's runs that come
   earlier in the global order; runs are ordered with the caller's own sort
   expressions applied to each run's first row.

Partitions are identified by a tag derived from their first row, not by the
task's partition index (which shifts when the result is unioned with other
data).  One range shuffle of the data, as a window would need; no group is
ever collected in one place.  The order must be total (add a unique
tie-breaker) and keys non-null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierflow.session import checkpoint_dir

_TAG = "_rk_tag"
_LRN = "_rk_local"
_CNT = "_rk_cnt"
_OFF = "_rk_off"
_EDGE = "_rk_edge"


def _tag_of(pdf) -> str:
    return repr(tuple(str(v) for v in pdf.iloc[0].tolist()))


def _key_at(pdf, keys, i):
    return tuple(pdf[k].iat[i] for k in keys)


def _leading_run(pdf, keys, key) -> int:
    mask = None
    for k, v in zip(keys, key):
        m = (pdf[k] == v).to_numpy()
        mask = m if mask is None else (mask & m)
    return int(mask.sum())


def _local_numbering(keys: list[str]):
    def fn(batches):
        tag = None
        prev_key, prev_rn = None, 0
        first_key, in_first = None, True
        for pdf in batches:
            if pdf.empty:
                continue
            if tag is None:
                tag = _tag_of(pdf)
                first_key = _key_at(pdf, keys, 0)
            rn = pdf.groupby(keys, sort=False).cumcount().to_numpy(dtype="int64") + 1
            first = _key_at(pdf, keys, 0)
            if prev_key is not None and first == prev_key:
                rn[:_leading_run(pdf, keys, first)] += prev_rn
            prev_key, prev_rn = _key_at(pdf, keys, len(pdf) - 1), int(rn[-1])
            out = pdf.copy()
            out[_TAG] = tag
            out[_LRN] = rn
            in_first = in_first and first == first_key
            lead = _leading_run(pdf, keys, first_key) if in_first else 0
            in_first = in_first and lead == len(pdf)
            out[_EDGE] = [True] * lead + [False] * (len(pdf) - lead)
            yield out
    return fn


def _boundary_runs(keys: list[str]):
    """Per partition: the first row and length of its first and last key
    runs.  Only the two ends of each Arrow batch are inspected (vectorised
    run lengths), so the Python work per batch is constant."""
    def fn(batches):
        import pandas as pd
        tag = None
        first_key = last_key = None
        first_row = last_row = None
        first_cnt = last_cnt = 0
        first_closed = False
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            if tag is None:
                tag = _tag_of(pdf)
            k0, k1 = _key_at(pdf, keys, 0), _key_at(pdf, keys, n - 1)
            lead = _leading_run(pdf, keys, k0)
            trail = n if k0 == k1 else _leading_run(pdf, keys, k1)
            if first_key is None:
                first_key, first_cnt, first_row = k0, lead, pdf.iloc[0]
                last_key, last_cnt, last_row = k0, lead, pdf.iloc[0]
            elif k0 == last_key:
                last_cnt += lead
                if not first_closed:
                    first_cnt += lead
            else:
                first_closed = True
                last_key, last_cnt, last_row = k0, lead, pdf.iloc[0]
            if k0 != k1:
                first_closed = True
                last_key, last_cnt, last_row = k1, trail, pdf.iloc[n - trail]
        if first_key is None:
            return
        rows = [first_row.to_dict() | {_TAG: tag, _CNT: int(first_cnt)}]
        if first_closed:
            rows.append(last_row.to_dict() | {_TAG: tag, _CNT: int(last_cnt)})
        yield pd.DataFrame(rows)
    return fn


def rank_within_key(df: DataFrame, keys: list[str], order: list, out: str = "rn",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number of each row within its ``keys`` group
    in ``order`` (column names or sort ``Column``s over ``df``'s columns)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    sort_cols = [F.col(k) for k in keys] + order_cols
    # both passes must see the same partitions: materialise them once, not
    # trusting the optimizer to reuse one exchange
    checkpoint_dir(spark)
    base = df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols).checkpoint()

    local_schema = T.StructType(df.schema.fields + [
        T.StructField(_TAG, T.StringType()), T.StructField(_LRN, T.LongType()),
        T.StructField(_EDGE, T.BooleanType())])
    bound_schema = T.StructType(df.schema.fields + [
        T.StructField(_TAG, T.StringType()), T.StructField(_CNT, T.LongType())])

    local = base.mapInPandas(_local_numbering(keys), local_schema)
    bounds = base.mapInPandas(_boundary_runs(keys), bound_schema)
    earlier = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounds.select(_TAG, *keys, F.coalesce(F.sum(_CNT).over(earlier), F.lit(0)).alias(_OFF))
    # offsets has at most two rows per range partition: a proven size bound
    ranked = local.join(F.broadcast(offsets), on=[_TAG, *keys], how="left")
    # a run that is neither first nor last of its partition has no boundary row
    # and starts at 0; a boundary run without its offset is an error
    edge = F.coalesce(F.col(_OFF), F.when(F.col(_EDGE), F.raise_error(F.lit("rank offset missing")).cast("bigint")).otherwise(F.lit(0)))
    return ranked.withColumn(out, F.col(_LRN) + edge).drop(_TAG, _LRN, _OFF, _EDGE)
