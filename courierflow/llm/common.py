"""Helpers shared by the corpus operators: tables, scratch storage, and a
vectorised word splitter over Arrow string buffers.

Words are maximal runs of ASCII letters and digits (A-Z folded to a-z) and
of bytes above 0x7F, i.e. of every non-ASCII character.  A word's 64-bit hash
is the difference of two prefix sums of ``byte * BASE**position``, shifted
back to position zero (BASE is odd, so it has an inverse modulo 2**64): a few
array operations per chunk of text and no Python call per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow.session import checkpoint_dir

CHUNK_BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = 0x9DDFEA08EB382D69


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The files stay until the owner of ``spark.checkpoint.dir`` clears it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (first is 0) of an Arrow string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offs, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def _fold_table() -> np.ndarray:
    fold = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or (c.isascii() and c.isalnum()):
            fold[b] = ord(c.lower()) if b < 0x80 else b
    return fold


FOLD = _fold_table()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            out = np.ones(size, _U)
            done = 1
            while done < size:  # doubling: powers done..2*done-1 from the first ones
                out[done:2 * done] = out[:done] * _U(pow(base, done, 1 << 64))
                done *= 2
            _POWERS[key] = out
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (fixed odd multipliers and shifts)."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _split(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of ``data``; no word crosses a break."""
    n = len(data)
    folded = FOLD[data]
    word = np.zeros(n + 2, bool)
    word[1:-1] = folded != 0
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | cut))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(folded.astype(_U) * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return starts, ends, mix(h + (ends - starts).astype(_U) * _U(_LENGTH))


def word_chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, row of each word, start, end, hash) per run of rows.

    Runs hold about CHUNK_BYTES of text.  A longer single row is split into
    pieces at separators, so scratch arrays stay small for any text length
    (one word longer than a chunk lengthens its piece).
    """
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * CHUNK_BYTES:
            s, e, h = _split(data[a:b], offsets[lo:hi + 1] - a)
        else:
            parts, at = [], a
            while at < b:
                end = min(b, at + CHUNK_BYTES)
                while end < b and FOLD[data[end]]:
                    end += 1
                s, e, h = _split(data[at:end], np.array([0, end - at]))
                parts.append((s + (at - a), e + (at - a), h))
                at = end
            s, e, h = (np.concatenate(x) for x in zip(*parts))
        yield lo, hi, np.searchsorted(offsets[lo:hi + 1] - a, s, "right") - 1 + lo, s + a, e + a, h
        lo = hi


def word_hash(word: str) -> int:
    """The hash :func:`word_chunks` gives to ``word`` (one word, any case)."""
    raw = [int(FOLD[b]) for b in word.encode()]
    if not raw or 0 in raw:
        raise ValueError(f"not one word: {word!r}")
    total = sum(b * pow(_BASE, i, 1 << 64) for i, b in enumerate(raw)) + len(raw) * _LENGTH
    return int(mix(np.array([total % (1 << 64)], _U))[0])
