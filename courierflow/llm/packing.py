"""Packing along a space-filling curve.

1. A hashed document vector (signed word counts in DIMS buckets, damped and
   scaled to length one) is projected to four dimensions with a fixed random
   matrix, each axis is quantised to eight bits, and the Hilbert index of the
   cell is the document's key.
2. Rows are range-sorted by (key, doc_id): neighbours on the curve are
   neighbours in the table.  The second column lets many documents with one
   key (copies) spread over partitions.
3. Each partition tokenises its documents in curve order and lays the ids
   end to end into sequences of ``max_tokens``, cutting documents where a
   sequence is full.  The last sequence of a partition is re-cut into powers of
   two, which need no padding, so the result has no padding at all.

The text crosses one shuffle and is tokenised once, after it.  A partition's
content and order follow from its rows, so a retried task makes the same pieces.

Defined cases: null text is empty (its one id is the end id); null doc_id
is kept as null and sorts first; repeated rows are packed once each; texts of
any length are cut over as many sequences as needed; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierflow.llm.common import buffers, text_of, word_chunks
from courierflow.llm.tokens import TokenIds, byte_bpe_path

MAX_TOKENS = 1024
END_ID = 0
DIMS, AXES, BITS = 64, 4, 8
_SPLIT_BITS = 36


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows x axes), axes * bits <= 62."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert key of each text of an Arrow string column."""
    projection = np.random.default_rng(20).standard_normal((DIMS, AXES))
    out = np.zeros(len(texts), np.int64)
    for lo, hi, row, _, _, h in word_chunks(*buffers(texts)):
        sign = (h >> np.uint64(63)).astype(np.float64) * 2 - 1
        cell = (row - lo) * DIMS + (h % np.uint64(DIMS)).astype(np.int64)
        v = np.bincount(cell, sign, (hi - lo) * DIMS).reshape(hi - lo, DIMS)
        v = np.sign(v) * np.sqrt(np.abs(v))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        grid = np.clip((v @ projection + 3) / 6, 0, 1) * ((1 << BITS) - 1)
        out[lo:hi] = hilbert_index(np.rint(grid), BITS)
    return out


def _curve_key(texts: pd.Series) -> pd.Series:
    return pd.Series(curve_keys(pa.array(texts, pa.string())))


class _Layout:
    """Lays id runs into sequences; a held sequence is emitted when full."""

    def __init__(self, first: int, size: int, with_ids: bool) -> None:
        self.seq, self.size, self.with_ids = first, size, with_ids
        self.held: list[tuple] = []  # (doc_id, total, start, ids bytes)
        self.used = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, total, start, raw in pieces:
            n = len(raw) // 4
            self.rows.append((doc, start, n, zlib.crc32(raw), total, self.seq, at, *((raw,) if self.with_ids else ())))
            at += n
        self.seq += 1

    def add(self, doc: int | None, raw: bytes) -> None:
        total, start = len(raw) // 4, 0
        while start < total:
            n = min(self.size - self.used, total - start)
            self.held.append((doc, total, start, raw[4 * start:4 * (start + n)]))
            self.used += n
            start += n
            if self.used == self.size:
                self._emit(self.held)
                self.held, self.used = [], 0

    def close(self) -> None:
        """Cut what is held into powers of two, largest first."""
        pieces, left = self.held, self.used
        while left:
            room, group = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, total, start, raw = pieces.pop(0)
                n = min(room, len(raw) // 4)
                group.append((doc, total, start, raw[:4 * n]))
                if 4 * n < len(raw):
                    pieces.insert(0, (doc, total, start + n, raw[4 * n:]))
                room -= n
            self._emit(group)
        self.held, self.used = [], 0


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
_TYPES = [pa.int64()] * 7 + [pa.binary()]


def _packer(path: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end = np.array([END_ID], "<u4").tobytes()
        k = len(_NAMES) if with_ids else len(_NAMES) - 1
        tokens, out = None, _Layout(TaskContext.get().partitionId() << _SPLIT_BITS, size, with_ids)

        def ready() -> pa.RecordBatch:
            cols = zip(*out.rows)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES[:k])
            out.rows = []
            return batch

        for batch in batches:
            tokens = tokens or TokenIds(path)
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(*buffers(batch.column(1)))):
                out.add(doc, ids.tobytes() + end)
                if len(out.rows) >= 8192:
                    yield ready()
        out.close()
        if out.rows:
            yield ready()

    return run


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    unless ``with_ids`` is false, its ids (little-endian unsigned 32-bit)."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = rows.withColumn("_key", F.pandas_udf(_curve_key, T.LongType())("text"))
    curve = keyed.repartitionByRange("_key", "doc_id").sortWithinPartitions("_key", "doc_id").select("doc_id", "text")
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in _NAMES[:len(_NAMES) - (not with_ids)])
    return curve.mapInArrow(_packer(path or byte_bpe_path(), max_tokens, with_ids), schema)
