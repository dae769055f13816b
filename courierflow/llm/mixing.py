"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the result divided by its share of the
input.  Each document draws its number of copies from a Poisson distribution
with that mean by inverting the distribution function at a number hashed from
(seed, doc_id), so the draw needs no order, no coordination and is the same on
every run.  A large rate is the sum of several independent draws with smaller
means, which keeps the inverted table short.  Documents are exploded by their
count and dealt to partitions and ordered in them by a hash of (seed, document,
copy): a global shuffle in one exchange that spreads hot sources and documents.

DataFrame expressions only.  Rates are one row per source; they are broadcast
if their number is within MAX_BROADCAST_SOURCES and joined by an exchange
otherwise.  One pass reads the narrow source column, a second the documents.

Defined cases: a null source is a source of its own; a source without a target
weight has rate 0 and all its rows go, a negative or null weight counts as 0;
null doc_id is hashed as an empty one; rows with one doc_id and source draw the
same count; an empty table gives an empty result; all columns of the input are
kept and ``copy`` (from 1), ``n_copies`` and ``rate`` are added, replacing
columns of these names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.llm.common import written

MAX_BROADCAST_SOURCES = 100_000
#: Largest mean that is inverted at once, and terms beyond which its tail is below 1e-17.
DRAW_MEAN, DRAW_TERMS = 8.0, 60


def source_counts(docs: DataFrame, source: str = "source") -> DataFrame:
    return docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def tempered_weights(counts: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights proportional to a power of the sources' sizes: below 1 lifts small sources."""
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def mixing_rates(counts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source: source, rate.  ``total`` is the expected number of rows (the input's if None)."""
    weighted = counts.join(targets.select(F.col("source").alias("_s"), F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0)).cast("double").alias("_w")),
                           F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    sums = weighted.agg(F.sum("_w").alias("w"), F.sum("n").alias("n")).first()
    scale = (total if total is not None else sums.n or 0) / sums.w if sums.w else 0.0
    return weighted.select("source", (F.lit(scale) * F.col("_w") / F.col("n")).alias("rate"))


def _inverse_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable with this mean."""
    zero = F.exp(-mean)
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(DRAW_TERMS)),
        F.struct(zero.alias("term"), zero.alias("sum"), F.array(zero).alias("table")),
        lambda s, k: F.struct(
            (s.term * mean / k).alias("term"), (s.sum + s.term * mean / k).alias("sum"),
            F.concat(s.table, F.array(s.sum + s.term * mean / k)).alias("table")))
    return state.getField("table")


def _uniform(seed: int, ident: Column, draw: Column) -> Column:
    """52 hashed bits as a number in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("")), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_mix(docs: DataFrame, rates: DataFrame, seed: int = 0, source: str = "source") -> DataFrame:
    """Replicate each document by its Poisson count and shuffle globally."""
    tag = f"_{uuid.uuid4().hex[:8]}"
    few = rates.select(F.col("source").alias(f"{tag}s"), F.col("rate").alias(f"{tag}r"))
    few = few.withColumn(f"{tag}m", F.greatest(F.ceil(F.col(f"{tag}r") / DRAW_MEAN), F.lit(1)).cast("int"))
    few = few.withColumn(f"{tag}t", _inverse_table(F.col(f"{tag}r") / F.col(f"{tag}m")))
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        few = F.broadcast(few)
    held = [c for c in docs.columns if c not in ("copy", "n_copies", "rate")]
    rated = docs.select(*held).join(few, F.col(source).eqNullSafe(F.col(f"{tag}s")), "inner")
    draws = F.transform(F.sequence(F.lit(1), F.col(f"{tag}m")), lambda j: _uniform(seed, F.col("doc_id"), j))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(f"{tag}t"), lambda c: c <= u)))
    counted = rated.withColumn("n_copies", drawn).where("n_copies > 0")
    copies = counted.select(*held, F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"), "n_copies", F.col(f"{tag}r").alias("rate"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"), *[F.col(c) for c in ("text", source) if c in held])
    return copies.withColumn(f"{tag}p", place).repartition(f"{tag}p").sortWithinPartitions(f"{tag}p").drop(f"{tag}p")


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, total: int | None = None, power: float = 0.5, seed: int = 0) -> DataFrame:
    """Documents replicated to the target weights (tempered by ``power`` if none are given)."""
    counts = written(source_counts(docs), "mix-counts")
    rates = written(mixing_rates(counts, targets if targets is not None else tempered_weights(counts, power), total), "mix-rates")
    return poisson_mix(docs, rates, seed)
