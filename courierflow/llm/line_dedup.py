"""Line dedup: repeated line runs by distributed prefix doubling.

Every text is a sequence of line ids (two 64-bit hashes of the stripped line;
blank lines are not part of it).  Level 0 of the suffix array names each suffix by
its first line, level k + 1 by the pair of its level-k name and the level-k name
2**k lines further on.  A name is the position of the earliest suffix with the
same prefix, so equal names are equal prefixes and the suffixes with one name
are one longest-common-prefix interval together with its first member.  A
suffix whose prefix is unique leaves the rounds.

A run counts when it holds at least ``min_words`` words.  Any such run is the
union of its shortest windows of that many words, the one that begins at each
line and the one that ends at each line, and each window of a repeated run is
itself repeated.  An interval of prefix length L, 2**k <= L < 2**(k+1), is keyed by
L and two overlapping level-k names.  Where a window is not its interval's
earliest member, its lines are a later copy and are deleted; together the
windows delete every repeated run at its maximal extent.  Doubling ends at the
level that decides the longest window (at most ``min_words`` lines), because
deeper intervals lie within those.

Order of copies: doc_id (null last), then the row's content hash, then line.
Rounds aggregate before they join, names are written to the shared folder
after each round, and hot intervals are reduced map-side and joined by an
equi-join that AQE can split.

Defined cases: null text is empty; empty texts and texts of blank lines stay
as they are; rows alike in doc_id and text are copies of their first row (by a
hash of the other columns) and go through the rounds once; blank lines
stay; self-overlapping repeats keep their first window; an empty table
gives an empty result; all other columns are kept; ``n_lines`` (not blank) and
``n_removed`` are added, replacing columns of these names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierflow.llm.common import text_of, written

MIN_WORDS = 50
_LAST = (1 << 63) - 1
_POS = ["d", "k", "n"]
#: White space inside and around a line (ASCII, without the line feed).
_WHITE = " \t\r\x0b\x0c"


def _windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of the shortest windows of ``least`` words from and up to each line."""
    upto = np.cumsum(words)
    before = upto - words
    ends = np.searchsorted(upto, before + least)
    i = np.flatnonzero(ends < len(words))
    starts = np.searchsorted(before, upto - least, "right") - 1
    j = np.flatnonzero(starts >= 0)
    both = np.unique(np.stack([np.concatenate([i, starts[j]]), np.concatenate([ends[i] - i + 1, j - starts[j] + 1])], 1), axis=0)
    return both[:, 0], both[:, 1]


def _spread(least: int):
    """One row per line from a row per text (whether its rows repeat, word counts and hashes of its lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d", "k", "n", "again", "h1", "h2", "windows"]
        for batch in batches:
            held, size = [], 0

            def ready() -> pa.RecordBatch:
                d, k, n, again, h1, h2, offs, w = (np.concatenate(x) for x in zip(*held))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(offs)]), pa.int32()), pa.array(w, pa.int32()))
                return pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(n, pa.int32()), pa.array(again), pa.array(h1), pa.array(h2), lists], names)

            docs, tags, repeats = (batch.column(i).to_pylist() for i in (0, 1, 2))
            words, first, second = (batch.column(i) for i in (3, 4, 5))
            for r in range(batch.num_rows):
                count = words[r].values.to_numpy()
                m = len(count)
                if not m:
                    continue
                at, length = _windows(count.astype(np.int64), least)
                held.append((np.full(m, docs[r]), np.full(m, tags[r]), np.arange(m), np.full(m, repeats[r]), first[r].values.to_numpy(), second[r].values.to_numpy(),
                             np.bincount(at, minlength=m), length))
                size += m
                if size >= 1 << 16:
                    yield ready()
                    held, size = [], 0
            if held:
                yield ready()

    return run


def _line_rows(docs: DataFrame, least: int) -> DataFrame:
    """(d, k, n, again, h1, h2, windows) per line that is not blank; only counts and hashes leave the JVM.

    Rows alike in doc_id and text are one text here; ``again`` says that there are
    several and that the text is long enough to be a run."""
    d, k = _keys()
    stripped = F.transform(F.split(text_of(), "\n", -1), lambda x: F.btrim(x, F.lit(_WHITE)))
    lines = docs.select(d, k, F.filter(stripped, lambda x: x != "").alias("l"))
    counted = lines.select(
        "d", "k", F.transform("l", lambda x: F.size(F.split(x, f"[{_WHITE}]+", -1))).alias("w"),
        F.transform("l", lambda x: F.xxhash64(x)).alias("h1"), F.transform("l", lambda x: F.xxhash64(F.lit(1), x)).alias("h2"))
    texts = counted.where(F.size("w") > 0).groupBy("d", "k").agg(F.first(F.struct("w", "h1", "h2")).alias("x"), F.count(F.lit(1)).alias("c"))
    words = F.aggregate("x.w", F.lit(0).cast("long"), lambda a, w: a + w)
    texts = texts.select("d", "k", ((F.col("c") > 1) & (words >= least)).alias("again"), "x.w", "x.h1", "x.h2")
    return texts.mapInArrow(_spread(least), "d long, k long, n int, again boolean, h1 long, h2 long, windows array<int>")


def _first_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, with the earliest position under it (od, ok, on).

    ``rows`` is a written table.  The groups are written too, so that both sides of
    the join have exchanges of their own and a hot key's rows can be split."""
    pos = F.struct(*_POS)
    groups = rows.groupBy(*key).agg(F.min(pos).alias("o"), F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = groups.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("o.d").alias("od"), F.col("o.k").alias("ok"), F.col("o.n").alias("on"))
    groups = written(groups, "line-groups")
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    return rows.join(groups, same).drop(*[f"_{c}" for c in key])


def _named(names: DataFrame, prefix: str) -> DataFrame:
    return names.select(F.col("d").alias(f"{prefix}d"), F.col("k").alias(f"{prefix}k"), F.col("n").alias(f"{prefix}n"),
                        *[F.col(c).alias(f"{prefix}{c}") for c in ("od", "ok", "on")])


def repeated_windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies: (d, k, n, len), lines n .. n + len - 1 of the document with key (d, k).

    ``lines`` is the written table of :func:`_line_rows`."""
    spark = lines.sparkSession
    names = written(_first_of(lines.drop("again", "windows"), ["h1", "h2"]).select(*_POS, "od", "ok", "on"), "line-names")
    asked = lines.select(*_POS, F.explode("windows").alias("len"))
    later, level = [], 0
    while (1 << level) <= min_words and not names.isEmpty():
        step = 1 << level
        here = _named(names, "a")
        of_level = asked.where((F.col("len") >= step) & (F.col("len") < 2 * step))
        head = of_level.join(here, (F.col("d") == F.col("ad")) & (F.col("k") == F.col("ak")) & (F.col("n") == F.col("an"))).drop("ad", "ak", "an")
        if level == 0:
            found = head.where("(d, k, n) != (aod, aok, aon)").select(*_POS, "len")
        else:
            there = _named(names, "b")
            both = head.join(there, (F.col("d") == F.col("bd")) & (F.col("k") == F.col("bk")) & (F.col("n") + F.col("len") - step == F.col("bn")))
            both = written(both.select(*_POS, "len", "aod", "aok", "aon", "bod", "bok", "bon"), "line-windows")
            found = (_first_of(both, ["len", "aod", "aok", "aon", "bod", "bok", "bon"])
                     .where("(d, k, n) != (od, ok, on)").select(*_POS, "len"))
        later.append(written(found, "line-copies"))
        if (2 << level) <= min_words:
            there = _named(names, "b")
            pairs = names.join(there, (F.col("d") == F.col("bd")) & (F.col("k") == F.col("bk")) & (F.col("n") + step == F.col("bn")))
            pairs = written(pairs.select(*_POS, F.col("od").alias("aod"), F.col("ok").alias("aok"), F.col("on").alias("aon"), "bod", "bok", "bon"), "line-pairs")
            names = written(_first_of(pairs, ["aod", "aok", "aon", "bod", "bok", "bon"]).select(*_POS, "od", "ok", "on"), "line-names")
        level += 1
    if not later:
        return spark.createDataFrame([], "d long, k long, n int, len int")
    out = later[0]
    for more in later[1:]:
        out = out.unionByName(more)
    return out


def _keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(F.col("doc_id").cast("long"), text_of()).alias("k")]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the named lines of each text; the last four columns are text, starts, lengths and whether all lines go."""
    for batch in batches:
        width = batch.num_columns
        texts, starts, lengths, every = (batch.column(width - i) for i in (4, 3, 2, 1))
        out, n_lines, n_removed = [], [], []
        for r in range(batch.num_rows):
            text = texts[r].as_py()
            raw = text.split("\n")
            full = [i for i, s in enumerate(raw) if s.strip(_WHITE)]
            at = starts[r].as_py()
            drop = set()
            if every[r].as_py():
                drop = set(full)
            elif at:
                gone = np.zeros(len(full) + 1, np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, np.add(at, lengths[r].as_py()), -1)
                drop = {full[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] > 0)}
            if drop:
                text = "\n".join(s for i, s in enumerate(raw) if i not in drop)
            n_removed.append(len(drop))
            out.append(text)
            n_lines.append(len(full))
        yield pa.RecordBatch.from_arrays([*batch.columns[:width - 4], pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())],
                                         [*batch.schema.names[:width - 4], "text", "n_lines", "n_removed"])


def _first_rows(held: DataFrame, repeated: DataFrame, others: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """``held`` without the later ones of rows alike in doc_id and text, and these later rows.

    ``repeated`` is the written table of the keys that several rows have.  Their rows
    are written with a number each; the smallest is reduced map-side."""
    same = (F.col(f"{tag}0") == F.col(f"{tag}rd")) & (F.col(f"{tag}1") == F.col(f"{tag}rk"))
    rows = held.join(repeated, same, "left_semi")
    rows = written(rows.select("*", F.struct(F.xxhash64(F.to_json(F.struct(*others))).alias("h"), F.monotonically_increasing_id().alias("i")).alias(f"{tag}r")), "line-repeats")
    first = written(rows.groupBy(F.col(f"{tag}0").alias(f"{tag}rd"), F.col(f"{tag}1").alias(f"{tag}rk")).agg(F.min(f"{tag}r").alias(f"{tag}f")), "line-firsts")
    rows = rows.join(first, same).withColumn(f"{tag}a", F.col(f"{tag}r") != F.col(f"{tag}f")).select(*held.columns, f"{tag}a")
    kept = held.join(repeated, same, "left_anti").unionByName(rows.where(~F.col(f"{tag}a")).drop(f"{tag}a"))
    return kept, rows.where(f"{tag}a").drop(f"{tag}a")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated line runs; n_lines and n_removed are added."""
    if min_words < 1:
        raise ValueError("min_words must be positive")
    lines = written(_line_rows(docs, min_words), "lines")
    copies = repeated_windows(lines, min_words)
    repeated = written(lines.where("again AND n = 0").select("d", "k"), "line-repeated")
    per_doc = copies.groupBy("d", "k").agg(F.collect_list(F.struct("n", "len")).alias("w"))  # at most two windows a line
    tag = f"_{uuid.uuid4().hex[:8]}"
    per_doc = per_doc.select(F.col("d").alias(f"{tag}d"), F.col("k").alias(f"{tag}k"), F.col("w.n").alias(f"{tag}n"), F.col("w.len").alias(f"{tag}l"))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    d, k = _keys()
    held = docs.select(*others, text_of().alias(f"{tag}t"), d.alias(f"{tag}0"), k.alias(f"{tag}1"))
    again = None
    if not repeated.isEmpty():
        names = repeated.select(F.col("d").alias(f"{tag}rd"), F.col("k").alias(f"{tag}rk"))
        held, again = _first_rows(held, names, others, tag)
    joined = held.join(per_doc, (F.col(f"{tag}0") == F.col(f"{tag}d")) & (F.col(f"{tag}1") == F.col(f"{tag}k")), "left")
    joined = joined.select(*others, f"{tag}t", f"{tag}n", f"{tag}l", F.lit(False).alias(f"{tag}e"))
    if again is not None:  # a later row loses all its lines whatever its windows are
        none = F.lit(None).cast("array<int>")
        joined = joined.unionByName(again.select(*others, f"{tag}t", none.alias(f"{tag}n"), none.alias(f"{tag}l"), F.lit(True).alias(f"{tag}e")))
    schema = T.StructType([f for f in docs.schema if f.name in others] + [T.StructField("text", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")])
    return joined.mapInArrow(_cut, schema)
