"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` becomes
one space.  Full normalised byte strings are inserted into compressed radix
tries; a terminal node holds the smallest doc_id and the number of rows.

1. Each input partition builds a trie of its own rows.  A group of copies,
   however large, leaves a partition as one row, so a hot text is reduced
   before any shuffle.  When the trie holds more than ``memory_bytes`` of
   labels, its largest subtree is spilled: its terminals are emitted as
   partial rows and the subtree is dropped.
2. The partial rows are dealt by (byte length, content hash) and sorted by
   it.  The owner pass keeps the trie of one (length, hash) bucket at a time;
   its terminals are the owners.  Bytes decide, the hash only deals.
3. Every document finds its owner by the SHA-256 of its normalised text: an
   equi-join of narrow rows whose hot keys AQE can split.

Defined cases: null text counts as empty; null doc_id never wins against a
number, and a group of nulls only has a null keep_id; rows tied on the smallest
doc_id (the same row repeated) are all marked kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.common import text_of

#: Fixed by the contract: the characters that one space replaces.
WHITE = "[\\x20\\x09-\\x0D]+"
MEMORY_BYTES = 48 << 20

_PART = "_len int, _hash long, _text binary, _min long, _n long"
_OWNER = "text_sha256 string, keep_id long, group_size long"


def _diverge(a: bytes, b: bytes) -> int:
    """Length of the common prefix of a and b (bisection over slice compares)."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings; a node is [label, children, terminal].

    ``children`` maps the first byte of a child's label to the child;
    ``terminal`` is None or [smallest id or None, count, hash].
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.weight: dict[int, int] = {}

    def __len__(self) -> int:
        return sum(self.weight.values())

    def insert(self, key: bytes, ident: int | None, count: int, tag: int) -> None:
        node, at = self.root, 0
        branch = key[0] if key else -1
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.weight[branch] = self.weight.get(branch, 0) + len(child[0]) + 200
                node, at = child, len(key)
                break
            label = child[0]
            end = at + len(label)
            if key[at:end] == label:
                node, at = child, end
                continue
            same = _diverge(label, key[at:end])
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = upper
            self.weight[branch] += 200
            node, at = upper, at + same
        if node[2] is None:
            node[2] = [ident, count, tag]
            self.weight.setdefault(branch, 0)
        else:
            node[2][1] += count
            if ident is not None and (node[2][0] is None or ident < node[2][0]):
                node[2][0] = ident

    def _terminals(self, top: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if node[2] is not None:
                yield key, node[2]
            stack.extend((c, key) for c in node[1].values())

    def drain(self) -> Iterator[tuple[bytes, list]]:
        """All (key, terminal) pairs; the trie is empty afterwards."""
        root, self.root, self.weight = self.root, [b"", {}, None], {}
        yield from self._terminals(root, b"")

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Remove the heaviest subtree below the root and return its pairs."""
        branch = max(self.weight, key=self.weight.get)
        self.weight.pop(branch)
        if branch == -1:
            terminal, self.root[2] = self.root[2], None
            if terminal is not None:
                yield b"", terminal
        elif branch in self.root[1]:
            yield from self._terminals(self.root[1].pop(branch), b"")


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 64 + sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


_PART_NAMES = ["_len", "_hash", "_text", "_min", "_n"]
_PART_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def _local(memory_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = PatriciaTrie()
            out = lambda pairs: ((len(k), t[2], k, t[0], t[1]) for k, t in pairs)
            for batch in batches:
                ids, tags, texts = (batch.column(i) for i in range(3))
                for i in range(batch.num_rows):
                    trie.insert(texts[i].as_py(), ids[i].as_py(), 1, tags[i].as_py())
                    if len(trie) > memory_bytes:
                        yield from out(trie.spill())
            yield from out(trie.drain())

        return _batches(rows(), _PART_NAMES, _PART_TYPES)

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        trie, bucket = PatriciaTrie(), None
        out = lambda pairs: ((hashlib.sha256(k).hexdigest(), t[0], t[1]) for k, t in pairs)
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            lengths, tags = cols[0].to_pylist(), cols[1].to_pylist()
            for i in range(batch.num_rows):
                if bucket != (lengths[i], tags[i]):
                    yield from out(trie.drain())
                    bucket = (lengths[i], tags[i])
                trie.insert(cols[2][i].as_py(), cols[3][i].as_py(), cols[4][i].as_py(), tags[i])
        yield from out(trie.drain())

    return _batches(rows(), ["text_sha256", "keep_id", "group_size"], [pa.string(), pa.int64(), pa.int64()])


def text_owners(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size."""
    norm = F.regexp_replace(text_of(), WHITE, " ")
    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), norm.alias("_t"))
            .select("_id", F.xxhash64("_t").alias("_hash"), F.col("_t").cast("binary").alias("_text")))
    parts = rows.mapInArrow(_local(memory_bytes), _PART)
    return parts.repartition("_len", "_hash").sortWithinPartitions("_len", "_hash").mapInArrow(_owners, _OWNER)


def exact_dedup(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    sha = F.sha2(F.regexp_replace(text_of(), WHITE, " ").cast("binary"), 256)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("text_sha256"))
    return (narrow.join(text_owners(docs, memory_bytes), "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
