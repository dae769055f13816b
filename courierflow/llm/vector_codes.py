"""Vector code compression with an equal-average codebook search.

A vector becomes whole numbers (floor of SCALE times each component) and is cut
into equal consecutive parts; every part position has a codebook of its own, and
a part is stored as the index of its nearest entry.

* **Search.**  Entries are sorted by the sum of their components.  For a part
  of ``w`` components the search starts at its own sum and goes outward in both
  directions; by Cauchy-Schwarz the squared gap of two sums over ``w`` is at
  most the squared distance, so a direction ends as soon as it *strictly*
  exceeds the best distance so far.  All parts of a batch go through the sorted
  entries side by side, each until its own bound ends it; entries at equal
  distance are all seen, and the lower index wins.
* **Training.**  A codebook starts with its part of the first ``entries`` vectors
  by vec_id.  A round assigns all parts of all rows, sums them per (part, entry)
  inside each task, adds the tasks' sums in Spark (at most parts * entries rows
  a task) and replaces every used entry by the floor of its mean.
* Codebooks hold ``entries`` whole vectors whatever the table's size; they are
  the only thing that reaches the driver or is sent to the tasks.

Everything is integer arithmetic, so results do not depend on the partitioning.

Defined cases: a row whose vector is null, empty, holds a null or a non-finite
component, or differs in length from the first vector by vec_id that has none of
these, or is no multiple of ``parts`` long, is dropped; a null vec_id sorts last; repeated
vec_ids are ordered by their vectors and coded each; null labels are one label;
fewer rows than ``entries`` give smaller codebooks; an empty table gives an empty
result; other columns are ignored.  A component so large that a squared sum
could leave 64 bits (beyond 2^30 / part length after scaling) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_RANGE_BITS = 30
_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry (ties: lower index) of each row of ``parts``.

    Both are whole numbers with |x| * width below 2^30."""
    n, width = parts.shape
    sums = book.sum(axis=1)
    rank = np.argsort(sums, kind="stable")
    entries, sums = book[rank], sums[rank]
    own = parts.sum(axis=1)
    best, index = np.full(n, (1 << 62) // width, np.int64), np.full(n, len(book), np.int64)
    start = np.searchsorted(sums, own)
    ways = [(1, np.arange(n), start), (-1, np.arange(n), start - 1)]
    while any(len(rows) for _, rows, _ in ways):
        for k, (step, rows, at) in enumerate(ways):
            inside = (at >= 0) & (at < len(sums))
            rows, at = rows[inside], at[inside]
            gap = sums[at] - own[rows]
            open_ = gap * gap <= best[rows] * width
            rows, at = rows[open_], at[open_]
            diff = parts[rows] - entries[at]
            d = np.einsum("ij,ij->i", diff, diff)
            better = (d < best[rows]) | ((d == best[rows]) & (rank[at] < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], rank[at[better]]
            ways[k] = (step, rows, at + step)
    return index, best


def _cut(column: pa.Array, books: np.ndarray) -> np.ndarray:
    """(rows, parts, width) of an Arrow list column of whole numbers."""
    flat = np.asarray(column.flatten(), np.int64)
    return flat.reshape(-1, books.shape[0], books.shape[2])


def whole_vectors(rows: DataFrame, column: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the usable rows with their vectors as whole numbers, written once."""
    v = F.col(column).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = rows.where(F.col(column).isNotNull()).where((F.size(column) > 0) & (F.size(column) % parts == 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).where(~F.exists("v", bad))
    first = usable.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    size = len(first[0].v) if first else parts
    limit = (1 << _RANGE_BITS) // (size // parts)
    floor = lambda x: F.when(F.abs(x * scale) >= limit, F.raise_error(F.lit("vector component out of range")).cast("bigint")).otherwise(F.floor(x * scale))
    return written(usable.where(F.size("v") == size).select("vec_id", "label", F.transform("v", floor).alias("v")), "vector-whole")


def _sums(shared):
    """Per task: count and componentwise sums of the parts that each entry gets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        n_parts, n_entries, width = books.shape
        count, total = np.zeros((n_parts, n_entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            cut = _cut(batch.column(0), books)
            for p in range(n_parts):
                index, _ = nearest_entries(cut[:, p], books[p])
                count[p] += np.bincount(index, minlength=n_entries)
                np.add.at(total[p], index, cut[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "s"])

    return run


def fit_codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of a table of :func:`whole_vectors`."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    first = whole.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    start = np.array([r.v for r in first], np.int64)
    books = start.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = whole.sparkSession.sparkContext.broadcast(books)
        local = whole.select("v").mapInArrow(_sums(shared), "p long, e long, n long, s array<long>")
        added = local.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(books.shape[2])])
        books = books.copy()
        for r in added.collect():  # at most parts * entries rows
            books[r.p, r.e] = [r[f"s{i}"] // r.n for i in range(books.shape[2])]
    return books


def _coder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _cut(batch.column(2), books)
            codes, error = np.zeros(cut.shape[:2], np.uint8), np.zeros(len(cut), np.int64)
            for p in range(books.shape[0]):
                index, d = nearest_entries(cut[:, p], books[p])
                codes[:, p] = index
                error += d
            raw, step = codes.tobytes().hex(), 2 * codes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([raw[i:i + step] for i in range(0, len(raw), step)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): index of every part's nearest entry (two hex digits each) and the summed squared distance."""
    kind = whole.schema["label"].dataType.simpleString()
    shared = whole.sparkSession.sparkContext.broadcast(books)
    return whole.select("vec_id", "label", "v").mapInArrow(_coder(shared), f"vec_id long, label {kind}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))])


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per usable row: vec_id, code, error, label_error (error over all rows of its label) and codebooks_sha256."""
    whole = whole_vectors(rows, column, parts, scale)
    books = fit_codebooks(whole, parts, entries, rounds)
    if not books.size:
        return whole.sparkSession.createDataFrame([], _RESULT)
    coded = written(encode(whole, books), "vector-codes")
    # written, so that a label with many rows meets a sum that has an exchange of its own
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"), "vector-labels")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
