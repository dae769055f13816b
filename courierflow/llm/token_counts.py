"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary becomes two byte tries (word-initial and continuing pieces).
Each node has a failure link and a popped count: when the node has no edge for
the next byte, the longest matches that its string begins with are popped, the
count says how many pieces that is, and the link is the node where the rest of
the string continues.  One pass over a word then gives the number of greedy
longest-match pieces in time linear in its bytes; no piece is ever built.

The text is cut into units before each space or line feed that follows another
byte (a unit carries its leading white space, as byte-level vocabularies do).
Distinct units of a chunk run through the automaton side by side as array
operations; counts are cached by unit.  A unit that cannot be matched whole
counts as one unknown token, as in word-piece.

The automaton depends on the vocabulary alone and is broadcast (a few MB for
50,000 pieces).  No shuffle.

Defined cases: null or empty text has zero units and tokens; repeated rows are
counted each; texts and units of any length are counted whole; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.common import buffers, text_of
from courierflow.llm.tokens import byte_bpe_path, cut_pieces, vocabulary

CACHE_ENTRIES = 600_000
CHUNK_BYTES = 1 << 19
LONG_UNIT = 512


class LongestMatch:
    """The automaton as flat arrays: sorted edge keys (node * 256 + byte; edge e
    leads to node e + 2), failure links and popped counts.  Node 0 is the
    word-initial root, node 1 the continuing root; a link of -1 has no way on."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]) -> None:
        children: list[dict[int, int]] = [{}, {}]
        final = {1}
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                v = root
                for b in piece:
                    nxt = children[v].get(b)
                    if nxt is None:
                        nxt = len(children)
                        children[v][b] = nxt
                        children.append({})
                    v = nxt
                if v != root:
                    final.add(v)
        order, at = [0, 1], 0  # breadth first, so that a node's number follows its edge's rank
        edges: list[int] = []
        while at < len(order):
            for b in sorted(children[order[at]]):
                edges.append(at * 256 + b)
                order.append(children[order[at]][b])
            at += 1
        n = len(order)
        go = dict(zip(edges, range(2, n)))
        self.edges = np.array(edges, np.int64)
        link, popped = [-1] * n, [0] * n
        for e, v in zip(edges, range(2, n)):
            if order[v] in final:
                link[v], popped[v] = 1, 1
                continue
            u, b = e >> 8, e & 255
            z, count = link[u], popped[u]
            while z != -1 and (z * 256 + b) not in go:
                count += popped[z]
                z = link[z]
            if z != -1:
                link[v], popped[v] = go[z * 256 + b], count
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)

    @classmethod
    def of_arrays(cls, edges: np.ndarray, link: np.ndarray, popped: np.ndarray) -> LongestMatch:
        out = cls.__new__(cls)
        out.edges, out.link, out.popped = edges, link, popped
        return out

    def _step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = nodes * 256 + symbols
        at = np.searchsorted(self.edges, key)
        hit = at < len(self.edges)
        hit[hit] = self.edges[at[hit]] == key[hit]
        return np.where(hit, at + 2, -1)

    def count_one(self, unit: bytes) -> int:
        """Pieces of one unit, -1 if it cannot be matched."""
        if not hasattr(self, "go"):  # one unit has one state at a time: a dictionary steps faster than a search
            self.go = dict(zip(self.edges.tolist(), range(2, len(self.edges) + 2)))
            self.steps = list(zip(self.link.tolist(), self.popped.tolist()))
        go, steps, v, total = self.go, self.steps, 0, 0
        for b in unit:
            nxt = go.get(v * 256 + b)
            while nxt is None:
                v, n = steps[v]
                if v < 0:
                    return -1
                total += n
                nxt = go.get(v * 256 + b)
            v = nxt
        while v > 1:
            v, n = steps[v]
            if v < 0:
                return -1
            total += n
        return total

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of the units data[start:end] (-1 where unmatched), all side by side."""
        total = np.zeros(len(start), np.int64)
        if not len(self.edges):
            return np.where(end > start, -1, 0)
        live = np.flatnonzero(end > start)
        v, at = np.zeros(len(live), np.int64), start[live].copy()
        stop = end[live]
        while len(live):
            ended = at >= stop
            nxt = np.where(ended, -1, self._step(v, data[np.minimum(at, len(data) - 1)].astype(np.int64)))
            moved = nxt >= 0
            at = at + moved
            done = ended & (v <= 1)
            lost = ~moved & ~done & (self.link[v] < 0)
            back = ~moved & ~done & ~lost
            total[live[back]] += self.popped[v[back]]
            total[live[lost]] = -1
            v = np.where(moved, nxt, np.where(back, self.link[v], v))
            keep = ~(done | lost)
            live, v, at, stop = live[keep], v[keep], at[keep], stop[keep]
        return total


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, breaks) runs of about CHUNK_BYTES; a longer row comes in pieces cut between units."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= 2 * CHUNK_BYTES:
            yield lo, data[a:b], offsets[lo:hi + 1] - a
        else:
            while a < b:
                end = min(b, a + CHUNK_BYTES)
                while end < b and not (data[end] in (32, 10) and data[end - 1] not in (32, 10)):
                    end += 1
                yield lo, data[a:end], np.array([0, end - a])
                a = end
        lo = hi


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = LongestMatch.of_arrays(*shared.value)
        cache: dict[int, int] = {}
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            rows = batch.num_rows
            units, tokens, unknown = (np.zeros(rows, np.int64) for _ in range(3))
            for lo, part, breaks in _segments(data, offsets):
                if not len(part):
                    continue
                s, e, h, _ = cut_pieces(part, breaks)
                back, keys = pd.factorize(h)
                where = np.zeros(len(keys), np.int64)
                where[back[::-1]] = np.arange(len(back) - 1, -1, -1)
                known = np.array([-2 if k is None else k for k in map(cache.get, keys.tolist())], np.int64)
                fresh = np.flatnonzero(known == -2)
                if len(fresh):
                    if len(cache) + len(fresh) > CACHE_ENTRIES:
                        cache.clear()
                    us, ue = s[where[fresh]], e[where[fresh]]
                    long = ue - us > LONG_UNIT
                    known[fresh[~long]] = match.count(part, us[~long], ue[~long])
                    for i, a, b in zip(fresh[long].tolist(), us[long].tolist(), ue[long].tolist()):
                        known[i] = match.count_one(part[a:b].tobytes())
                    cache.update(zip(keys[fresh].tolist(), known[fresh].tolist()))
                each = known[back]
                row = np.searchsorted(breaks, s, "right") - 1
                n = len(breaks) - 1
                hi = lo + n
                units[lo:hi] += np.bincount(row, minlength=n)
                tokens[lo:hi] += np.bincount(row, np.maximum(each, 0) + (each < 0), minlength=n).astype(np.int64)
                unknown[lo:hi] += np.bincount(row, each < 0, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(units), pa.array(tokens), pa.array(unknown)],
                ["doc_id", "n_bytes", "n_units", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, initial: Iterable[bytes] | None = None, continuing: Iterable[bytes] | None = None, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_units, n_tokens (unknown units count one) and n_unknown.

    Without explicit pieces, the byte-level vocabulary at ``path`` serves as both sets."""
    if initial is None:
        initial = continuing = list(vocabulary(path or byte_bpe_path()))
    match = LongestMatch(initial, continuing or ())
    shared = docs.sparkSession.sparkContext.broadcast((match.edges, match.link, match.popped))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_counter(shared), "doc_id long, n_bytes long, n_units long, n_tokens long, n_unknown long")
