"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its word shingles (five words, 64-bit hashes; a
document of fewer words is one shingle).  Documents with one set are one node of
the join, so exact copies cost one row however many they are.

1. Every node gets ``trees`` paths of MAX_DEPTH one-byte MinHash labels; a path is
   one 64-bit number, so the sorted paths of a tree are its prefix trie in order.
   All (tree, path) rows are range-sorted once, and in one pass over them the
   rows that share a prefix with a neighbour become groups.
   A row's prefix starts at full depth and is shortened level by level until the
   row's recall bound holds: the least similarity that a different set can have to
   a set of its size without missing the threshold must be met in some tree with
   the target recall.  Sizes are whole, so a short text's partners lie above
   the threshold and its prefix stays longer; sets of three shingles have no partner
   at 0.8 and take no part.  A pair is matched at the longer of its rows' prefixes
   (the bound of either row covers it).  Groups of one fall out, and of groups with the same
   members only the first tree's is kept (compared by two hashes and their count).
2. The members' shingle sets are joined in, and every pair of a group is verified
   by its exact Jaccard similarity.  A pair is looked at only at its own level, in the
   first tree whose prefix it shares, so it counts once.  Groups above BLOCK members or
   BLOCK_BYTES of shingles are split by a hash into blocks and every pair of blocks is
   a task of its own.
   Tasks return, per member, how many links it has and the smallest node of its
   local component: never the pairs.
3. Components over those edges are the classes.

A near-copy group of m different texts takes m * m / 2 comparisons, as any
exact count of its links does; they are spread over block pairs, and a member
is sent to m / BLOCK of them.

Defined cases: words are as in :mod:`courierflow.llm.common`; null text is
empty, texts without words are copies of each other; repeated rows and null ids
are documents like others; a class has the smallest doc_id among its
documents as its id (null if all are null); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.common import buffers, mix, text_of, word_chunks, written
from courierflow.llm.components import connected

WIDTH = 5
THRESHOLD = (4, 5)
TREES, MAX_DEPTH = 32, 8
TARGET_RECALL = 0.9999
BLOCK, BLOCK_BYTES = 256, 1 << 25
_LAST = (1 << 63) - 1
_U = np.uint64


def forest_depth(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with this recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(size: int, threshold: tuple[int, int]) -> Fraction | None:
    """The least Jaccard similarity at or above the threshold that a set of this size can have to
    a different set; None if there is none.  Large sets get the threshold itself, a lower bound."""
    over, under = threshold
    if size > 256:
        return Fraction(over, under)
    best = None
    for other in range(-(-size * over // under), size * under // over + 1):
        both = -(-over * (size + other) // (over + under))
        if both <= min(size, other) and 0 < both < size + other - both:
            found = Fraction(both, size + other - both)
            best = found if best is None else min(best, found)
    return best


def stop_depth(size: int, threshold: tuple[int, int], trees: int, max_depth: int, recall: float) -> int:
    """The depth at which shortening ends for a set of this size; max_depth + 1 if it can have no partner."""
    least = least_similarity(size, threshold)
    return max_depth + 1 if least is None else forest_depth(float(least), trees, max_depth, recall)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in row order."""
    keys = [_U(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(width)]
    for lo, hi, row, _, _, h in word_chunks(*buffers(column)):
        n = max(0, len(h) - width + 1)
        rolled = mix(sum(h[i:n + i] * keys[i] for i in range(width))) if n else np.zeros(0, _U)
        own = row[:n] == row[width - 1:] if n else np.zeros(0, bool)
        rolled, at = rolled[own], row[:n][own]
        cuts = np.searchsorted(at, np.arange(lo, hi + 1))
        words = np.searchsorted(row, np.arange(lo, hi + 1))
        for i in range(hi - lo):
            if cuts[i] < cuts[i + 1]:
                yield np.unique(rolled[cuts[i]:cuts[i + 1]])
            else:
                few = h[words[i]:words[i + 1]]
                yield mix(np.array([sum(int(x) * int(k) for x, k in zip(few, keys)) % (1 << 64)], _U) + _U(len(few))) if len(few) else np.zeros(0, _U)


class MinHashForest:
    def __init__(self, trees: int, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, trees * depth).astype(_U) * _U(2) + _U(1)
        self.shape = trees, depth

    def paths(self, shingles: np.ndarray) -> np.ndarray:
        """The path of each tree: a byte of MinHash per level, first level highest."""
        if len(shingles) <= 1024:
            least = (shingles[None, :] * self.factors[:, None]).min(1)
        else:
            least = np.array([(shingles * a).min() for a in self.factors], _U)
        labels = (mix(least) >> _U(56)).reshape(self.shape)
        out = np.zeros(self.shape[0], _U)
        for level in range(self.shape[1]):
            out = (out << _U(8)) | labels[:, level]
        return out.view(np.int64)


def prefix(paths: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    """The first ``level`` labels of each path."""
    return paths >> (8 * (MAX_DEPTH - level))


def _sign(width: int, threshold: tuple[int, int], trees: int, recall: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forest = MinHashForest(trees, MAX_DEPTH, seed)
        stops: dict[int, int] = {}
        for batch in batches:
            nodes, paths, sizes, counts, depths = [], [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                n = min(len(s), 257)  # larger sets share one depth
                if n not in stops:
                    stops[n] = stop_depth(n, threshold, trees, MAX_DEPTH, recall) if n else MAX_DEPTH + 1
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()))
                paths.append(forest.paths(s) if stops[n] <= MAX_DEPTH else np.zeros(0, np.int64))
                sizes.append(len(paths[-1]))
                counts.append(len(s))
                depths.append(stops[n])
            flat = np.concatenate(paths) if paths else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()),
                                              pa.array(depths, pa.int32()), lists], ["doc_id", "tkey", "node", "size", "stop", "paths"])

    return run


def trie_runs(tree: np.ndarray, path: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, rows, prefixes) of the sorted rows that match a neighbour at that level.

    At a level the rows whose bound holds there or at a shorter prefix are open.  A run of open
    rows with one prefix is a match if shortening ends there for one of them.  The first
    and last run may go on in the next batch or partition and are always given.
    """
    for level in range(int(stop.min()), MAX_DEPTH + 1) if len(stop) else ():
        rows = np.flatnonzero(stop <= level)
        at = prefix(path[rows], level)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (tree[rows][1:] != tree[rows][:-1])])
        run = np.cumsum(new) - 1
        runs = int(run[-1]) + 1
        ends = np.bincount(run[stop[rows] == level], minlength=runs) > 0
        match = (np.bincount(run, minlength=runs) > 1) & ends
        match[[0, -1]] = True
        yield level, rows[match[run]], at[match[run]]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["level", "tree", "prefix", "node", "size", "stop"]
    for batch in batches:
        tree, path, stop = (batch.column(i).to_numpy() for i in (0, 1, 2))
        for level, rows, at in trie_runs(tree, path, stop):
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), level, np.int32)), taken.column(0), pa.array(at, pa.int64()),
                                              taken.column(3), taken.column(4), taken.column(2)], names)


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(2), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["node", "paths", "shingles"])

    return run


def _eligible(level: int, tree: int, paths: np.ndarray, stops: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Mask left x right of pairs of this level that share no prefix of it in an earlier tree."""
    at = prefix(paths[:, :tree], level)
    out = np.maximum(stops[left][:, None], stops[right][None, :]) == level
    for t in range(tree):
        out &= at[left, t][:, None] != at[right, t][None, :]
    return out


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """|A & B| for all pairs, by matrix products over the shingles that occur twice."""
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    owner, column = owner[keep], shared[code[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, step = int((count > 1).sum()), 4096
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, total, step):
        a, b = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        out += x[left] @ x[right].T
    return out.astype(np.int64)


def verify(level: int, tree: int, left: np.ndarray, right: np.ndarray, paths: np.ndarray, stops: np.ndarray, sets: list[np.ndarray],
           threshold: tuple[int, int]) -> np.ndarray:
    """Linked pairs (rows of two members) of left x right; a square block gives each pair once."""
    over, under = threshold
    size = np.array([len(s) for s in sets])
    mask = _eligible(level, tree, paths, stops, left, right)
    mask &= under * np.minimum(size[left][:, None], size[right]) >= over * np.maximum(size[left][:, None], size[right])
    if left is right:
        mask &= np.tri(len(left), k=-1, dtype=bool)
    i, j = np.nonzero(mask)
    if not len(i):
        return np.zeros((0, 2), np.int64)
    if len(i) > 200:
        both = _overlaps(sets, left, right)[i, j]
    else:
        both = np.array([len(np.intersect1d(sets[left[a]], sets[right[b]], assume_unique=True)) for a, b in zip(i, j)])
    i, j = left[i], right[j]
    linked = under * both >= over * (size[i] + size[j] - both)
    return np.stack([i[linked], j[linked]], 1)


def _local_roots(links: np.ndarray, members: int) -> list[int]:
    up = list(range(members))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links.tolist():
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [top(x) for x in range(members)]


def _verify_groups(threshold: tuple[int, int]):
    """Rows sorted by (level, tree, prefix, x, y): block x against block y of a group."""

    def one(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        level, tree, _, x, y = key
        rows.sort(key=lambda r: r[1])  # by node, so that a local root is the smallest node
        block = np.array([r[0] for r in rows])
        paths = np.stack([r[3] for r in rows])
        sets = [np.frombuffer(r[4], _U) for r in rows]
        stops = np.array([r[5] for r in rows])
        left = np.flatnonzero(block == x)
        right = left if x == y else np.flatnonzero(block == y)
        links = verify(level, tree, left, right, paths, stops, sets, threshold)
        if not len(links):
            return
        copies = np.array([r[2] for r in rows])
        texts = np.bincount(links.ravel(), minlength=len(rows))
        docs = np.bincount(links[:, 0], copies[links[:, 1]], len(rows)) + np.bincount(links[:, 1], copies[links[:, 0]], len(rows))
        roots = _local_roots(links, len(rows))
        for i in np.flatnonzero(texts).tolist():
            yield rows[i][1], rows[roots[i]][1], int(texts[i]), int(docs[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["node", "root", "texts", "docs"], [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        key, held, out = None, [], []

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            block, copies, stops = (batch.column(i).to_pylist() for i in (5, 7, 8))
            nodes, paths, sets = batch.column(6), batch.column(9), batch.column(10)
            for r, k in enumerate(keys):
                if k != key:
                    if held:
                        out.extend(one(key, held))
                    key, held = k, []
                    if len(out) >= 8192:
                        yield ready()
                        out = []
                held.append((block[r], nodes[r].as_py(), copies[r], paths[r].values.to_numpy(), sets[r].as_py(), stops[r]))
        if held:
            out.extend(one(key, held))
        if out:
            yield ready()

    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES,
                    recall: float = TARGET_RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, seed: int = 11) -> DataFrame:
    """Per document: doc_id, class_id, copy_id (smallest id with the same shingles), n_copies and
    n_links (other documents at or above the threshold, copies among them)."""
    signed, known = _linked(docs, width, threshold, trees, recall, block, block_bytes, seed)
    ids = known.groupBy("root").agg(F.min("copy_id").alias("class_id")).withColumnRenamed("root", "r")
    final = known.join(ids, F.col("root") == F.col("r")).select(
        F.col("node").alias("k_node"), "class_id", "copy_id", F.col("copies").alias("n_copies"), (F.col("docs") + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "node").join(final, F.col("node") == F.col("k_node")).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES,
                recall: float = TARGET_RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, seed: int = 11) -> DataFrame:
    """The first document (smallest doc_id, null last, then content) of each class, all its columns."""
    _, known = _linked(docs, width, threshold, trees, recall, block, block_bytes, seed)
    d, t, kd, kt = (f"{uuid.uuid4().hex}_{x}" for x in range(4))  # no column of the documents has such a name
    first = known.groupBy("root").agg(F.min(F.struct(F.coalesce("copy_id", F.lit(_LAST)).alias("d"), "tkey")).alias("f")).select(F.col("f.d").alias(kd), F.col("f.tkey").alias(kt))
    keyed = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(t, F.xxhash64(text_of()))
    kept = keyed.join(first, (F.col(d) == F.col(kd)) & (F.col(t) == F.col(kt)), "left_semi")
    return kept.dropDuplicates([d, t]).select(*[F.col(f"`{c}`") for c in docs.columns])  # the same row repeated


def _linked(docs: DataFrame, width: int, threshold: tuple[int, int], trees: int, recall: float, block: int, block_bytes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, node) per document, and per node its first document, copies, component root and links."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    signed = written(rows.mapInArrow(_sign(width, threshold, trees, recall, seed),
                                     "doc_id long, tkey long, node binary, size long, stop int, paths array<long>"), "near-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey"))
    nodes = signed.groupBy("node").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
                                       F.first("stop").alias("stop"), F.first("paths").alias("paths"))
    nodes = written(nodes.select("node", F.col("f.doc_id").alias("copy_id"), F.col("f.tkey").alias("tkey"), "copies", "size", "stop", "paths"), "near-nodes")

    key = ["level", "tree", "prefix"]
    trie = nodes.select(F.posexplode("paths").alias("tree", "path"), "stop", "node", "size").repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path")
    met = written(trie.mapInArrow(_match, "level int, tree int, prefix long, node binary, size long, stop int"), "near-met")
    groups = met.groupBy(*key).agg(
        F.count(F.lit(1)).alias("m"), F.sum(8 * F.col("size")).alias("bytes"), F.min(F.col("level") - F.col("stop")).alias("z"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("m > 1 AND z = 0")
    kept = groups.groupBy("m", "x", "y", "level", "bytes").agg(F.min(F.struct("tree", "prefix")).alias("g")).select(
        F.col("level").alias("g_level"), F.col("g.tree").alias("g_tree"), F.col("g.prefix").alias("g_prefix"),
        F.least("m", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("bytes") / block_bytes))).cast("int").alias("blocks"))
    same = (F.col("level") == F.col("g_level")) & (F.col("tree") == F.col("g_tree")) & (F.col("prefix") == F.col("g_prefix"))
    members = written(met.join(kept, same).select("node", *key, "blocks"), "near-members")

    asked = members.select(F.col("node").alias("n")).distinct()
    needed = nodes.join(asked, F.col("node") == F.col("n")).select("node", "paths", F.col("copy_id").alias("c_id"), F.col("tkey").alias("c_key"))
    texts = rows.join(needed, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tkey") == F.col("c_key")))
    sets = texts.select("node", "paths", "text").mapInArrow(_shingles(width), "node binary, paths array<long>, shingles binary")
    sets = written(sets.dropDuplicates(["node"]), "near-sets")
    counted = nodes.join(asked, F.col("node") == F.col("n")).select(F.col("node").alias("n2"), "copies", "stop")
    placed = (members.withColumn("blk", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select(*key, F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "blk", F.col("node").alias("n1")))
    full = (placed.join(counted, F.col("n1") == F.col("n2")).join(sets, F.col("n1") == F.col("node"))
            .select(*key, "x", "y", "blk", "node", "copies", "stop", "paths", "shingles"))
    found = full.repartition(*key, "x", "y").sortWithinPartitions(*key, "x", "y").mapInArrow(_verify_groups(threshold), "node binary, root binary, texts long, docs long")
    found = written(found, "near-links")

    classes = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    linked = (links.join(classes, "node").select(F.col("node").alias("l_node"), "root", "texts", "docs"))
    known = nodes.select("node", "copy_id", "tkey", "copies").join(linked, F.col("node") == F.col("l_node"), "left").withColumn("root", F.coalesce("root", "node"))
    known = known.select("node", "copy_id", "tkey", "copies", "root", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"))
    return signed, written(known, "near-known")
