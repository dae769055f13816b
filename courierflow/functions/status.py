"""Delivery status expressions: ordinals, successor map, reject messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierflow.schema import FINAL_STATUS, ORDER_STATUSES, REASON_FINAL, REASON_TRANSITION


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def status_ordinal(status) -> Column:
    """0..5 for the six statuses, null for null / unknown."""
    pos = F.array_position(F.array(*[F.lit(s) for s in ORDER_STATUSES]), _c(status)).cast("int")
    return F.when(pos > 0, pos - 1)


def status_at(ordinal) -> Column:
    """Status name at ordinal 0..5; null outside."""
    return F.try_element_at(F.array(*[F.lit(s) for s in ORDER_STATUSES]), _c(ordinal).cast("int") + 1)


def expected_next_status(current) -> Column:
    """Successor in the lifecycle: null -> CONFIRMED, ..., DELIVERED -> null."""
    successor = F.create_map(*[x for a, b in zip(ORDER_STATUSES, ORDER_STATUSES[1:] + [None])
                               for x in (F.lit(a), F.lit(b).cast("string"))])
    cur = _c(current)
    return F.when(cur.isNull(), F.lit(ORDER_STATUSES[0])).otherwise(F.try_element_at(successor, cur))


def transition_reason(current, requested) -> Column:
    """Reject reason of a status request against the current accepted status
    (null when the request is accepted)."""
    expected = expected_next_status(current)
    return (
        F.when(_c(current) == F.lit(FINAL_STATUS), F.lit(REASON_FINAL))
        .when(~_c(requested).eqNullSafe(expected),
              F.concat(F.lit(REASON_TRANSITION.split("{expected}")[0]), expected,
                       F.lit(REASON_TRANSITION.split("{expected}")[1])))
    )
