"""Small value expressions: money, position text round trip, patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_to_float(price) -> Column:
    """numeric(10,2) -> double, as the API responses do."""
    c = F.col(price) if isinstance(price, str) else price
    return c.cast("double")


def coordinate_text_round_trip(value) -> Column:
    """float -> shortest decimal text -> exact decimal -> float.

    Position coordinates are stored as exact decimals built from the
    float's text form (no rounding), then read back as float.
    """
    c = F.col(value) if isinstance(value, str) else value
    return c.cast("string").try_cast("decimal(38,18)").cast("double")


def iso_utc_text(ts) -> Column:
    """Naive-UTC timestamp as ISO-8601 text: microseconds when non-zero,
    none otherwise (the usual ``isoformat`` rendering)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.when(F.date_format(c, "SSSSSS") == F.lit("000000"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def patch_coalesce(patch_value, stored_value) -> Column:
    """partial update of one column - a non-null patch value replaces the
    stored value, a null keeps it."""
    p = F.col(patch_value) if isinstance(patch_value, str) else patch_value
    b = F.col(stored_value) if isinstance(stored_value, str) else stored_value
    return F.coalesce(p, b)
