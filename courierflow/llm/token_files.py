"""Token ids in Arrow files of equal-length sequences and masks.

**Format.**  A shard is an Arrow IPC file of record batches with two fixed-size-list
columns: ``ids`` (SEQUENCE ids each, 16 bits where the vocabulary allows, else 32)
and ``mask`` (one bit per id, unset for padding).  Documents lie end to end, only
the last sequence of a shard is padded and every batch but the last holds BATCH
sequences, so sequence ``i`` of a shard is row ``i % BATCH`` of batch ``i // BATCH``.  Buffers are
not compressed: a memory-mapped shard gives ids and masks as views, without a
copy.  A second file lists the shard's documents (doc_id, start, n_tokens).

**Writing.**  Rows are range-sorted by doc_id; each task streams its range through
the tokenizer into one shard and holds one batch of sequences at a time.  A task
attempt writes under a name of its own and returns it; the manifest, written by
Spark, holds the files of the attempts that counted, so retries and speculative
copies do no harm.  Shards go to the shared folder through ``pyarrow.fs`` (local path or URI).

**Reading.**  Starts of the shards are sums over the manifest (one row per shard);
every task opens its shards and serves documents from them.

Defined cases: null text is empty (its one id is the end id); null doc_ids come
first; rows of one doc_id come in the order of a hash of their text, repeated rows
each count; texts of any length run over as many sequences as they need; an empty
table gives an empty manifest and result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow.llm.common import buffers, text_of, written
from courierflow.llm.tokens import TokenIds, byte_bpe_path, vocabulary
from courierflow.session import scratch_path

SEQUENCE, BATCH, END_ID = 1024, 256, 2
_MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_sequences long"
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _store(path: str):
    """File system and path of a local path, a file: path or another URI that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard; ``add`` takes a document's ids in order."""

    def __init__(self, path: str, kind: pa.DataType, size: int = SEQUENCE, batch: int = BATCH) -> None:
        self.fs, self.path = _store(path)
        self.schema = pa.schema([("ids", pa.list_(kind, size)), ("mask", pa.list_(pa.bool_(), size))])
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.files = [self.fs.open_output_stream(f"{self.path}.{end}") for end in ("arrow", "docs")]
        self.out = pa.ipc.new_file(self.files[0], self.schema)
        self.docs = pa.ipc.new_file(self.files[1], _DOCUMENTS)
        self.held = np.zeros(size * batch, kind.to_pandas_dtype())
        self.used, self.size, self.rows = 0, size, []
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def _flush(self) -> None:
        n = -(-self.used // self.size)
        self.held[self.used:] = 0
        ids = pa.array(self.held[:n * self.size])
        mask = pa.array(np.arange(n * self.size) < self.used)
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.size) for x in (ids, mask)], schema=self.schema))
        self.n_sequences, self.used = self.n_sequences + n, 0

    def _flush_docs(self) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=_DOCUMENTS))
        self.rows = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_tokens, len(ids)))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + len(ids)
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.held) - self.used)
            self.held[self.used:self.used + n] = ids[at:at + n]
            self.used, at = self.used + n, at + n
            if self.used == len(self.held):
                self._flush()
        if len(self.rows) >= 8192:
            self._flush_docs()

    def close(self) -> None:
        if self.used:
            self._flush()
        if self.rows:
            self._flush_docs()
        for x in (self.out, self.docs, *self.files):
            x.close()


class Shard:
    """Random access to a written shard; arrays are views of the mapped file."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, at = _store(path)
        local = isinstance(store, fs.LocalFileSystem)
        self.files = [pa.memory_map(f"{at}.{end}") if local else store.open_input_file(f"{at}.{end}") for end in ("arrow", "docs")]
        self.ids, self.docs = (pa.ipc.open_file(f) for f in self.files)
        self.size = self.ids.schema.field("ids").type.list_size
        self.batch_rows = self.ids.get_batch(0).num_rows if self.ids.num_record_batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of the sequence with this number."""
        batch = self.ids.get_batch(i // self.batch_rows)
        at = i % self.batch_rows
        return batch.column(0).values.slice(at * self.size, self.size).to_numpy(zero_copy_only=True), batch.column(1).values.slice(at * self.size, self.size)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as one view per batch that they reach into."""
        room = self.batch_rows * self.size
        while n > 0:
            at = start % room
            take = min(n, room - at)
            yield self.ids.get_batch(start // room).column(0).values.slice(at, take).to_numpy(zero_copy_only=True)
            start, n = start + take, n - take

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, start, n_tokens) in order."""
        for k in range(self.docs.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.docs.get_batch(k).columns))

    def close(self) -> None:
        for f in self.files:
            f.close()


def _write(path: str, folder: str, end_id: int, size: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), None
        name = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                tokens = TokenIds(path)
                last = max(max(vocabulary(path).values()), *tokens.whole.get_added_tokens_decoder(), end_id)
                out = ShardWriter(name, pa.uint16() if last < 1 << 16 else pa.uint32(), size, batch_rows)
                end = np.array([end_id], np.uint32)
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(*buffers(batch.column(1)))):
                out.add(doc, np.concatenate([ids, end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *[pa.array([x], pa.int64()) for x in (out.n_docs, out.n_tokens, out.n_sequences)]],
                                             ["shard", "file", "n_docs", "n_tokens", "n_sequences"])

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, size: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest has a row per shard: shard (its place in the order), file, n_docs, n_tokens, n_sequences."""
    if size < 1 or batch < 1:
        raise ValueError("size and batch must be positive")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", "tie", "at"]  # the last one splits rows that are alike in all
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("at"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ranged.mapInArrow(_write(path or byte_bpe_path(), folder, end_id, size, batch), _MANIFEST), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    ready = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard, rows = Shard(file), []
            for doc, start, n in shard.documents():
                crc = 0
                for ids in shard.tokens(start, n):
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                rows.append((doc, base + start, n, crc))
                if len(rows) >= 8192:
                    yield ready(rows)
                    rows = []
            if rows:
                yield ready(rows)
            shard.close()


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards, base = [], 0
    for r in manifest.select("shard", "file", "n_tokens").orderBy("shard").collect():  # one row per file
        shards.append((r.file, base))
        base += r.n_tokens
    listed = spark.createDataFrame(shards, "file string, base long")
    return listed.repartition(max(1, len(shards))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, size: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Write the documents (to a new scratch folder unless one is named) and read them back."""
    spark = docs.sparkSession
    manifest = write_token_files(docs, folder or scratch_path(spark, f"token-files-{uuid.uuid4().hex}"), path, end_id, size, batch)
    return read_token_files(spark, manifest)
