"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each half is quantised by its own centroids
(k-means on a bounded sample), and a vector is filed under its pair of
centroids.  A query visits pairs by growing sum of the two squared distances
(a heap over the sorted centroid lists) until the visited pairs hold enough
vectors, and everything in them is reranked by the exact inner product in
double precision.

* Equal vectors are one entry that keeps its ``k + 1`` smallest ids.  That loses
  nothing (ties go to the smaller id) and a vector that fills a third of the
  table costs one entry.  Ids are reduced in two steps, salted, so no group is
  gathered whole.  Equal queries are searched once.
* How many entries are enough is measured, not guessed: for a bounded sample of
  queries the exact neighbours are found by one pass over all entries, and the
  visit length that reaches the target recall on them is used for every query.
* Entries are dealt by (first centroid, part), parts holding at most
  BLOCK_ENTRIES; queries are dealt in groups of QUERY_GROUP to the blocks
  they visit, and each (block, group) is one matrix product in one task.

Driver memory: two codebooks of at most MAX_CENTROIDS rows, the table of pair
sizes (at most MAX_CENTROIDS squared numbers) and the two samples.

Defined cases: vectors that are null, zero, hold null or non-finite components
or have another length than most take no part; fewer candidates than ``k`` give
fewer rows; repeated rows (same id, same vector) count once, an id with several
vectors counts with each; null ids take no part; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courierflow.llm.common import written

FIT_ROWS = 10_000
RECALL_QUERIES = 200
TARGET_RECALL = 0.97
MAX_CENTROIDS = 1024
ENTRIES_PER_PAIR = 48
BLOCK_ENTRIES = 8192
QUERY_GROUP = 4096
_RESULT = "query_id long, rank int, vec_id long, score double"


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)))
    size = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return held.where(F.size("v") == (size.n if size else 0))


def entries(vectors: DataFrame, k: int, rows: int) -> DataFrame:
    """(v, ids): distinct vectors with their k + 1 smallest ids."""
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    salts = rows // 20_000 + 1
    some = vectors.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    return some.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = x[rng.integers(len(x), size=int((~full).sum()))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def _file(first: np.ndarray, second: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = first.shape[1]
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                yield pdf.assign(i=_nearest(v[:, :half], first).astype(np.int32), j=_nearest(v[:, half:], second).astype(np.int32))

    return run


def visits(q: np.ndarray, first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, entries seen so far with this pair) by growing summed distance; empty pairs are passed over."""
    half = first.shape[1]
    d1 = ((q[:half] - first) ** 2).sum(1)
    d2 = ((q[half:] - second) ** 2).sum(1)
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, seen = [(s1[0] + s2[0], 0, 0)], 0
    while heap:
        _, a, b = heapq.heappop(heap)
        i, j = o1[a], o2[b]
        if sizes[i, j]:
            seen += int(sizes[i, j])
            yield i, j, seen
        if b + 1 < len(s2):  # the row's next pair; a row's first pair opens the next row
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(s1):
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))


def _best(v: np.ndarray, least: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of v with the k largest products with q (ties: smaller id), and the products.

    The matrix product only preselects, with room for its rounding; the
    scores are summed row by row, so equal vectors score alike everywhere."""
    rough = v @ q
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    else:
        near = np.arange(len(rough))
    score = (v[near] * q).sum(1)
    order = np.lexsort((least[near], -score))[:k]
    return near[order], score[order]


def _scan_all(queries: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v, least = np.stack(pdf["v"].to_numpy()), pdf["ids"].map(lambda x: x[0]).to_numpy()
                out = []
                for n, q in enumerate(queries):
                    at, score = _best(v, least, q, k)
                    out.append(pd.DataFrame({"q": n, "i": pdf["i"].to_numpy()[at], "j": pdf["j"].to_numpy()[at], "least": least[at], "score": score}))
                yield pd.concat(out)

    return run


def _route(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int, parts: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for qid, grp, v in zip(pdf["qid"], pdf["grp"], pdf["v"]):
                by: dict[int, list[int]] = {}
                for i, j, seen in visits(np.asarray(v), first, second, sizes):
                    by.setdefault(i, []).append(j)
                    if seen >= enough:
                        break
                rows.extend((i, p, grp, qid, v, js) for i, js in by.items() for p in range(parts[i]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["i", "part", "grp", "qid", "qv", "js"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["i", "part", "grp", "qid", "qv", "js"])

    return run


def _rerank(k: int):
    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            v, j = np.stack(block["v"].to_numpy()), block["j"].to_numpy()
            ids = block["ids"].to_numpy()
            least = np.array([x[0] for x in ids])
            for qid, q, js in zip(asked["qid"], asked["qv"], asked["js"]):
                rows = np.flatnonzero(np.isin(j, np.asarray(js)))
                if len(rows):
                    at, score = _best(v[rows], least[rows], np.asarray(q), k)
                    out.extend((qid, s, list(ids[rows[a]])) for a, s in zip(at.tolist(), score.tolist()))
        return pd.DataFrame(out, columns=["qid", "score", "ids"])

    return run


def nearest(rows: DataFrame, query_step: int = 20, k: int = 20, target_recall: float = TARGET_RECALL, fit_rows: int = FIT_ROWS, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every vec_id divisible by ``query_step``."""
    spark = rows.sparkSession
    vectors = written(usable_vectors(rows), "nearest-vectors")
    total = vectors.count()
    if total == 0:
        return spark.createDataFrame([], _RESULT)
    found = written(entries(vectors, k, total), "nearest-entries")
    n = found.count()
    share = min(1.0, 1.3 * fit_rows / n)
    draw = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 30))
    sample = np.array([r.v for r in found.where(draw < share * (1 << 30)).select("v").limit(fit_rows).collect()] or [found.first().v])
    half = max(1, sample.shape[1] // 2)
    centroids = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(n / ENTRIES_PER_PAIR)))), 1, min(MAX_CENTROIDS, len(sample))))
    first, second = _kmeans(sample[:, :half], centroids, seed), _kmeans(sample[:, half:], centroids, seed + 1)
    filed = written(found.mapInPandas(_file(first, second), "v array<double>, ids array<long>, i int, j int"), "nearest-index")
    sizes = np.zeros((centroids, centroids), np.int64)
    for r in filed.groupBy("i", "j").count().collect():  # at most centroids squared rows
        sizes[r.i, r.j] = r["count"]

    asked = vectors.where(F.pmod("vec_id", F.lit(query_step)) == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    distinct = written(asked.groupBy("v").agg(F.min("query_id").alias("qid")), "nearest-queries")
    n_queries = distinct.count()
    if n_queries == 0:
        return spark.createDataFrame([], _RESULT)

    # visit length: the one that reaches the target recall on a bounded sample of queries
    share = min(1.0, 1.5 * RECALL_QUERIES / n_queries)
    probe = distinct.where(F.pmod(F.xxhash64(F.lit(seed), "qid"), F.lit(1 << 30)) < share * (1 << 30)).select("v").limit(RECALL_QUERIES).collect()
    tried = np.array([r.v for r in probe] or [distinct.first().v])
    local = filed.mapInPandas(_scan_all(tried, k + 1), "q int, i int, j int, least long, score double")
    nearest_of = Window.partitionBy("q").orderBy(F.desc("score"), "least")  # at most RECALL_QUERIES * (k + 1) rows a batch
    true = local.withColumn("r", F.row_number().over(nearest_of)).where(F.col("r") <= k + 1).select("q", "i", "j").collect()
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in true:
        wanted.setdefault(r.q, []).append((r.i, r.j))
    need = []
    for q, cells in wanted.items():
        reach = {(i, j): seen for i, j, seen in visits(tried[q], first, second, sizes)}
        need.extend(reach[c] for c in cells)
    enough = int(np.quantile(need, target_recall, method="higher"))

    parts = np.maximum(1, -(-sizes.sum(1) // BLOCK_ENTRIES))
    groups = max(1, -(-n_queries // QUERY_GROUP))
    grp = F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("grp")  # ids may share a factor with the number of groups
    routed = written(distinct.select("qid", grp, "v").mapInPandas(
        _route(first, second, sizes, enough, parts), "i int, part int, grp long, qid long, qv array<double>, js array<int>"), "nearest-routes")
    of_part = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("i") + 1)
    blocks = filed.withColumn("part", F.pmod(F.xxhash64("v"), of_part).cast("int"))
    pairs = routed.select(F.col("i").alias("to_i"), F.col("part").alias("to_part"), F.col("grp").alias("to_grp")).distinct()
    dealt = blocks.join(pairs, (F.col("i") == F.col("to_i")) & (F.col("part") == F.col("to_part"))).select("v", "ids", "j", "to_i", "to_part", "to_grp")
    hits = (dealt.groupBy("to_i", "to_part", "to_grp").cogroup(routed.groupBy("i", "part", "grp"))
            .applyInPandas(_rerank(k + 1), "qid long, score double, ids array<long>"))

    # per distinct query its best (score, id) pairs, one more than asked for; then its own id goes
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    close = (hits.withColumn("vec_id", F.explode("ids")).withColumn("r", F.row_number().over(by_score))
             .where(F.col("r") <= k + 1).groupBy("qid").agg(F.collect_list(F.struct("r", "vec_id", "score")).alias("close")))
    owners = asked.join(distinct, "v").select("query_id", "qid")
    others = F.slice(F.filter(F.array_sort("close"), lambda c: c.vec_id != F.col("query_id")), 1, k)
    return (owners.join(close, "qid").select("query_id", F.posexplode(others).alias("pos", "c"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score")))
