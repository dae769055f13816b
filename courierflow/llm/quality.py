"""Quality classifier with hierarchical empirical-Bayes site priors.

A document's own evidence is the probability, from a logistic model over shape
features and hashed words and word beginnings, that it is bad (low quality or
toxic).  Sites add what their documents have in common: grouped sums of
evidence give each host and each path of a host a mean, and means of sparse
sites are shrunk, a path's towards its host's and a host's towards the
global one.  How strongly is estimated from the data (variance within against
variance between groups).  A document's posterior odds are its own odds times
the ratio of its path's odds to the global odds.

The model is fitted on the driver to at most ``fit_rows`` labelled documents
chosen by a hash; everything else covers all documents.  Evidence is computed
once per document and written to the shared folder; the priors are grouped sums
with map-side reduction, one row per path, broadcast if they are at most
MAX_BROADCAST_PATHS and joined by an exchange otherwise.

Defined cases: null text is empty; a text without words has evidence 1 (it is
rejected); null hosts and paths are sites of their own; labels that are null
in both columns are ignored, a document with several label rows is bad if
any says so; without labels of both kinds evidence is 0 for texts with words;
repeated rows are scored each; an empty table gives an empty result; the
columns of the input are kept, ``evidence``, ``prior``, ``posterior`` and
``kept`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierflow.llm.common import FOLD, buffers, mix, text_of, word_chunks, written

FIT_ROWS = 8000
BUCKETS = 1 << 16
CHOSEN = 1000
MAX_BROADCAST_PATHS = 200_000
_ADDED = ["evidence", "prior", "posterior", "kept"]
_SHAPES = ["log_words", "upper", "symbols", "digits", "repeats", "word_bytes", "lines", "no_words"]


def _classes() -> np.ndarray:
    out = np.zeros((4, 256), np.int64)
    for b in range(128):
        c = chr(b)
        out[0, b] = "A" <= c <= "Z"
        out[1, b] = not (c.isalnum() or c.isspace() or c in ".,;:'\"()-?") and b > 32
        out[2, b] = "0" <= c <= "9"
        out[3, b] = b == 10
    return out


_CLASS = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, shapes per row, row of each hashed feature, its bucket) per chunk; features may repeat."""
    for lo, hi, row, start, end, h in word_chunks(data, offsets):
        n = hi - lo
        a = int(offsets[lo])
        part, cuts = data[a:offsets[hi]], offsets[lo:hi + 1] - a
        sums = [np.diff(np.concatenate([[0], np.cumsum(table[part])])[cuts]) for table in _CLASS]
        size = np.maximum(np.diff(cuts), 1)
        words = np.bincount(row - lo, minlength=n)
        many = np.maximum(words, 1)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        shapes = np.stack([np.log1p(words), sums[0] / size, sums[1] / size, sums[2] / size, np.bincount(row - lo, again, n) / many,
                           np.bincount(row - lo, end - start, n) / many, sums[3] / size, words == 0], 1)
        folded = FOLD[part]
        long = np.flatnonzero(end - start >= 4)
        s = start[long] - a
        head = sum(folded[s + k].astype(np.uint64) << np.uint64(8 * k) for k in range(4)) if len(s) else np.zeros(0, np.uint64)
        half = np.uint64(BUCKETS // 2)
        yield (lo, hi, shapes, np.concatenate([row, row[long]]),
               np.concatenate([h % half, half + mix(head) % half]).astype(np.int64))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes, hashed = [], []
        for lo, hi, shape, row, bucket in features(*buffers(batch.column(1))):
            key = np.unique((row - lo) * BUCKETS + bucket)
            at = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS)
            small = (key % BUCKETS).astype("<u2")
            hashed.extend(small[x:y].tobytes() for x, y in zip(at[:-1], at[1:]))
            shapes.extend(shape.tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.list_(pa.float64())), pa.array(hashed, pa.binary())], ["bad", "shape", "hashed"])


class Model:
    """Logistic model: centre, scale and weights of the shapes, a weight per bucket, an intercept."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, shape: np.ndarray, bucket: np.ndarray, intercept: float) -> None:
        self.centre, self.scale, self.shape, self.bucket, self.intercept = centre, scale, shape, bucket, intercept

    def parts(self) -> tuple:
        return self.centre, self.scale, self.shape, self.bucket, self.intercept


def _evidence(parts: tuple, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    centre, scale, weights, bucket_weight, intercept = parts
    out = np.zeros(len(offsets) - 1)
    for lo, hi, shape, row, bucket in features(data, offsets):
        used = bucket_weight[bucket] != 0
        key = np.unique((row[used] - lo) * BUCKETS + bucket[used])
        logit = intercept + ((shape - centre) / scale) @ weights + np.bincount(key // BUCKETS, bucket_weight[key % BUCKETS], hi - lo)
        out[lo:hi] = np.where(shape[:, -1] > 0, 1.0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return out


def fit(bad: np.ndarray, shapes: np.ndarray, hashed: list[np.ndarray], l2: float = 2e-5, rounds: int = 800) -> Model:
    """Fit on the driver: the CHOSEN buckets whose log odds stand out most, then accelerated gradient descent."""
    y = bad.astype(np.float64)
    rows = np.repeat(np.arange(len(hashed)), [len(x) for x in hashed])
    cells = np.concatenate(hashed).astype(np.int64) if hashed else np.zeros(0, np.int64)
    in_bad = np.bincount(cells, y[rows], BUCKETS)
    in_good = np.bincount(cells, 1 - y[rows], BUCKETS)
    odds = np.log((in_bad + 0.5) / (y.sum() - in_bad + 0.5)) - np.log((in_good + 0.5) / ((1 - y).sum() - in_good + 0.5))
    sure = np.abs(odds) / np.sqrt(1 / (in_bad + 0.5) + 1 / (in_good + 0.5))
    chosen = np.argsort(-sure, kind="stable")[:CHOSEN]
    slot = np.full(BUCKETS, -1)
    slot[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(_SHAPES) + len(chosen)))
    centre, scale = shapes.mean(0), shapes.std(0) + 1e-6
    x[:, :len(_SHAPES)] = (shapes - centre) / scale
    used = slot[cells] >= 0
    x[rows[used], len(_SHAPES) + slot[cells[used]]] = 1
    w, b = np.zeros(x.shape[1]), 0.0
    look, look_b, speed = w.copy(), b, 1.0
    rate = 4.0 / max(1.0, np.linalg.norm(x.T @ x / len(y), 2) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look + look_b, -30, 30)))
        new = look - rate * (x.T @ (p - y) / len(y) + l2 * look)
        new_b = look_b - rate * float((p - y).mean())
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        look, look_b = new + (speed - 1) / faster * (new - w), new_b + (speed - 1) / faster * (new_b - b)
        w, b, speed = new, new_b, faster
    bucket = np.zeros(BUCKETS)
    bucket[chosen] = w[len(_SHAPES):]
    return Model(centre, scale, w[:len(_SHAPES)], bucket, b)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit to at most ``fit_rows`` labelled documents, chosen by a hash of their id."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), bad.alias("bad")).where("bad IS NOT NULL AND _id IS NOT NULL").groupBy("_id").agg(F.max("bad").alias("bad")))
    share = fit_rows / max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < min(1.0, share) * (1 << 30)).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    got = texts.select("bad", "text").mapInArrow(_collect, "bad int, shape array<double>, hashed binary").limit(2 * fit_rows).collect()
    got.sort(key=lambda r: (r.bad, bytes(r.hashed), r.shape))  # sums come out alike however the rows arrive
    y = np.array([r.bad for r in got])
    if len(set(y.tolist())) < 2:
        return None
    return fit(y, np.array([r.shape for r in got]), [np.frombuffer(bytes(r.hashed), "<u2") for r in got])


def _scorer(parts: tuple | None, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns - 1
            data, offsets = buffers(batch.column(width))
            if parts is None:
                words = np.zeros(batch.num_rows)
                for lo, hi, shape, _, _ in features(data, offsets):
                    words[lo:hi] = shape[:, -1]
                evidence = words
            else:
                evidence = _evidence(parts, data, offsets)
            cols, names = list(batch.columns[:width]), list(batch.schema.names[:width])
            if keep_text:
                cols.append(batch.column(width))
                names.append("text")
            yield pa.RecordBatch.from_arrays([*cols, pa.array(evidence)], [*names, "evidence"])

    return run


def score(docs: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """The documents with ``evidence``: the model's probability that the document is bad."""
    others = [f for f in docs.schema if f.name not in ("text", *_ADDED)]
    schema = T.StructType(others + [T.StructField("text", T.StringType())] * keep_text + [T.StructField("evidence", T.DoubleType())])
    rows = docs.select(*[F.col(f"`{f.name}`") for f in others], text_of().alias("text"))
    return rows.mapInArrow(_scorer(model.parts() if model else None, keep_text), schema)


def _shrinkage(groups: DataFrame, centre: Column) -> float:
    """Rows of prior weight: variance within groups over variance between them.

    ``groups`` has n, total and squares of evidence per group."""
    row = groups.select("n", "total", "squares", centre.alias("m")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("m"), 2)).alias("between")).first()
    if not row.n or row.n <= row.g or row.g < 2:
        return 1.0
    inside = max(row.within / (row.n - row.g), 1e-9)
    across = (row.between - (row.g - 1) * inside) / (row.n - row.nn / row.n)
    return float(np.clip(inside / max(across, 1e-9), 1.0, 1e6))


def site_priors(scored: DataFrame, host: str = "source", path: str = "lang") -> tuple[DataFrame, float]:
    """Shrunk mean evidence per (host, path) and the global mean."""
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")]
    paths = written(scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("total"), F.sum(F.col("evidence") * F.col("evidence")).alias("squares")), "site-paths")
    hosts = paths.groupBy(F.col("_host").alias("_h")).agg(*sums)
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = (whole.total / whole.n) if whole.n else 0.5
    weight = _shrinkage(hosts, F.lit(mean))
    hosts = written(hosts.select("_h", F.col("n").alias("h_n"), F.col("total").alias("h_total"),
                                 ((F.col("total") + weight * mean) / (F.col("n") + weight)).alias("host_prior")), "site-hosts")
    nested = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    weight = _shrinkage(nested, F.col("h_total") / F.col("h_n"))
    prior = (F.col("total") + weight * F.col("host_prior")) / (F.col("n") + weight)
    return written(nested.select("_host", "_path", prior.alias("prior")), "site-priors"), mean


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_text: bool = True, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents with evidence, prior, posterior and kept (posterior below one half)."""
    scored = written(score(docs, train(docs, labels, fit_rows), keep_text), "site-evidence")
    priors, mean = site_priors(scored, host, path)
    if priors.limit(MAX_BROADCAST_PATHS + 1).count() <= MAX_BROADCAST_PATHS:
        priors = F.broadcast(priors)
    joined = scored.join(priors, F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path"))).drop("_host", "_path")
    held = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda p: F.log(held(p) / (1 - held(p)))
    odds = logit(F.col("evidence")) + logit(F.col("prior")) - logit(F.lit(mean))
    posterior = F.when(F.col("evidence") >= 1.0, F.lit(1.0)).otherwise(1 / (1 + F.exp(-odds)))
    return joined.withColumn("posterior", posterior).withColumn("kept", F.col("posterior") < 0.5)
