"""Prefix trie of conversations by a van Emde Boas recursion.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that begin with it, and its name is (smallest member, depth).

**Down.**  A trie of height 2m is cut at half depth: what lies above the cut is one
trie of height m, and under every node at the cut hangs a forest of height m.
``K`` halvings cut every sequence into single turns.  All tries and forests of a
level are handled by one join: a piece that reaches past the cut takes the name
of its first half (the name of its own root and a 128-bit digest of the half's
turns) as the root of its second half.  Digests are grouped sums over aligned
blocks of turns, so a piece of a long conversation is one row at every level.

**Up.**  A node's totals first cover its own block of one turn.  Joining blocks of m
turns to blocks of 2m, the totals of the tries that hang below a cut node are
summed and grafted onto that node's m ancestors of the block above.  After K levels every node has the totals of
its subtree.  A turn takes part in K grafts at most: N log N rows for chains of any depth.

**Scale.**  Only 64-bit numbers are shuffled, never text.  Turns are numbered by
one range sort with per-partition counts, so a conversation with most of all rows is spread
over partitions; block and piece keys hold (conversation, block), which no hot
conversation or hot first turn piles up.  The member list of a node is hashed
from sorted pieces of bounded size, never collected.

Defined cases: rows with a null conv_id take no part; turns are ordered by
``turn`` (null first), rows alike in it by the SHA-256 of role and text; null role
and text are empty; repeated rows are turns each; a conversation without turns is
a member of the root only; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierflow.llm.common import written

#: Turns of a conversation's group head that may replace its own first ones, and conversations in a group.
HEAD_LIMIT, GROUP = 4, 20
PIECE_IDS = 8192
_RESULT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string")
_SEQ_BITS = 33  # row number within a partition in monotonically_increasing_id()


def _digest(*columns: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, o, n, t1, t2, words): place of each turn, turns of its conversation, hash and words of the turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    number = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    turns = (conversations.where("conv_id IS NOT NULL")
             .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("sha"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
             .select("conv_id", "turn", number(1).alias("t1"), number(16).alias("t2"), "words", F.monotonically_increasing_id().alias("at")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("at")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "words", F.monotonically_increasing_id().alias("seq"))
    ranged = written(ranged.withColumn("part", F.shiftright("seq", _SEQ_BITS)), "trie-turns")
    # a conversation has at most one row per partition here
    runs = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"))
    one = Window.partitionBy("conv_id")
    runs = runs.select(F.col("conv_id").alias("c"), F.col("part").alias("q"), "first", F.sum("rows").over(one).alias("n"),
                       (F.sum("rows").over(one.orderBy("part")) - F.col("rows")).alias("before"))
    return ranged.join(written(runs, "trie-runs"), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("q"))).select(
        "conv_id", (F.col("before") + F.col("seq") - F.col("first")).alias("o"), "n", "t1", "t2", "words")


def with_group_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that groups share their first turns: conversation c begins
    with the first h turns of conversation c - c % GROUP and goes on with its own turns
    after its first h, h being crc32(c) % HEAD_LIMIT.

    ``turns`` as of :func:`numbered_turns`; returns (conv_id, p, length, t1, t2, words) and (conv_id, length)."""
    c = F.col("conv_id")
    own = turns.where("o = 0").select("conv_id", "n", (F.crc32(c.cast("string").cast("binary")) % HEAD_LIMIT).alias("h"), (c - c % GROUP).alias("base"))
    head = own.select(F.col("conv_id").alias("b"), F.col("n").alias("bn"))
    taken = F.least(F.col("h"), F.coalesce("bn", F.lit(0)))
    convs = written(own.join(head, F.col("base") == F.col("b"), "left").select(
        "conv_id", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    plan = convs.select(F.col("conv_id").alias("c"), "h", "base", "taken", "length")
    rest = turns.join(plan, F.col("conv_id") == F.col("c")).where("o >= h").select("conv_id", (F.col("o") - F.col("h") + F.col("taken")).alias("p"), "length", "t1", "t2", "words")
    shared = turns.where((F.col("o") < HEAD_LIMIT - 1) & (c % GROUP == 0)).join(plan, F.col("conv_id") == F.col("base")).where("o < h").select(
        F.col("c").alias("conv_id"), F.col("o").alias("p"), "length", "t1", "t2", "words")
    return rest.unionByName(shared), convs.select("conv_id", "length")


def _named(rows: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """Every turn with the name (r1, r2) of the cut prefix before it: ``levels`` halvings of all sequences."""
    cut = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("j", F.expr("shiftright(p, k)"))
    cut = cut.where((F.col("j") % 2 == 0) & (F.col("length") > F.expr("shiftleft(j + 1, k)")))  # first halves with a second half
    x1, x2 = (F.bit_xor(x) for x in _digest("t1", "t2", "p"))
    blocks = written(cut.groupBy("conv_id", "k", "j").agg(x1.alias("b1"), x2.alias("b2")).withColumnRenamed("conv_id", "c"), "trie-blocks")
    pieces = convs.where("length > 0").select("conv_id", F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("r1"), F.lit(0).cast("long").alias("r2"))
    for done, k in enumerate(range(levels - 1, -1, -1), 1):
        half = blocks.where(F.col("k") == k).select("c", F.col("j").alias("i"), "b1", "b2")
        met = pieces.join(half, (F.col("conv_id") == F.col("c")) & (F.col("j") * 2 == F.col("i")), "left")
        n1, n2 = _digest("r1", "r2", "b1", "b2")
        upper = F.struct((F.col("j") * 2).alias("j"), "r1", "r2")
        lower = F.struct((F.col("j") * 2 + 1).alias("j"), n1.alias("r1"), n2.alias("r2"))
        pieces = met.select("conv_id", F.explode(F.when(F.col("b1").isNull(), F.array(upper)).otherwise(F.array(upper, lower))).alias("x")).select("conv_id", "x.*")
        if done % 4 == 0:
            pieces = written(pieces, "trie-pieces")
    roots = pieces.select(F.col("conv_id").alias("c"), F.col("j").alias("q"), "r1", "r2")
    return rows.join(roots, (F.col("conv_id") == F.col("c")) & (F.col("p") == F.col("q"))).select("conv_id", "p", "r1", "r2", "t1", "t2", "words")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (rep, depth, conv_id) as comma-joined texts of at most PIECE_IDS ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rep, depth, ids = (np.asarray(batch.column(i)) for i in range(3))
        new = np.concatenate([[0], np.flatnonzero((rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1])) + 1, [len(rep)]])
        starts = np.concatenate([np.arange(a, b, PIECE_IDS) for a, b in zip(new[:-1], new[1:])])
        ends = np.append(starts[1:], len(rep))
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(rep[starts]), pa.array(depth[starts]), pa.array(ids[starts]), pa.array(texts, pa.string())], ["rep", "depth", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come sorted; one piece is held at a time."""
    held, sha, done = None, None, []
    names = ["rep", "depth", "ends_sha256"]
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], names)
    for batch in batches:
        for rep, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (rep, depth) == held:
                sha.update(b",")
            else:
                if held:
                    done.append((*held, sha.hexdigest()))
                held, sha = (rep, depth), hashlib.sha256()
            sha.update(ids.encode())
        if len(done) >= 4096:
            yield out()
            done = []
    if held:
        done.append((*held, sha.hexdigest()))
        yield out()


def _ends(ended: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of (rep, depth, conv_id): ids in numeric order, joined by commas."""
    spread = ended.repartitionByRange("rep", "depth", "conv_id").sortWithinPartitions("rep", "depth", "conv_id")
    texts = spread.mapInArrow(_pieces, "rep long, depth long, first long, ids string")
    return texts.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(_hashed, "rep long, depth long, ends_sha256 string")


def _totals(base: DataFrame, places: DataFrame, levels: int) -> DataFrame:
    """(rep, p, leaves, saved) summed over subtrees: totals of hanging tries are grafted
    onto the ancestors in the block above, level by level."""
    values = base.select("rep", "p", "up", "leaves", "saved")
    for k in range(levels):
        m = 1 << k
        hang = (values.where(F.col("p") % (2 * m) == m).groupBy(F.col("up").alias("c"), "p").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
                .where("leaves != 0 OR saved != 0"))
        above = hang.select("c", F.explode(F.sequence(F.col("p") - m, F.col("p") - 1)).alias("q"), "leaves", "saved")
        graft = (above.join(places, (F.col("c") == F.col("conv_id")) & (F.col("q") == F.col("p")))
                 .groupBy("rep", "p", "up").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        values = values.unionByName(written(graft, "trie-graft"))
    return values.groupBy("rep", "p").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words of last texts that further members repeat, over the subtree) and
    ends_sha256 (of the members that end here).

    ``rows``: (conv_id, p, length, t1, t2, words) with p from 0 to length - 1; ``convs``: (conv_id, length)."""
    spark = rows.sparkSession
    convs = written(convs, "trie-members")
    top = convs.agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    if not top.n:
        return spark.createDataFrame([], _RESULT)
    levels = max(1, (top.longest - 1).bit_length())
    rows = written(rows, "trie-rows")
    names = written(_named(rows, convs, levels), "trie-names")
    key = ["p", "r1", "r2", "t1", "t2"]
    nodes = written(names.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words")), "trie-nodes")
    # written, so that a turn which many conversations share meets its node over exchanges of their own
    of = written(names.select("conv_id", *key).join(nodes.select(*key, "rep"), key).select("conv_id", "p", "rep"), "trie-of")
    before = of.select(F.col("conv_id").alias("c"), (F.col("p") + 1).alias("q"), F.col("rep").alias("up"))
    places = written(of.join(before, (F.col("conv_id") == F.col("c")) & (F.col("p") == F.col("q")), "left").select("conv_id", "p", "rep", "up"), "trie-places")

    own = nodes.select("rep", "p", "n", "words").join(places.where("conv_id = rep").select(F.col("rep").alias("c"), F.col("p").alias("q"), "up"), (F.col("rep") == F.col("c")) & (F.col("p") == F.col("q")))
    children = own.where("p > 0").groupBy(F.col("up").alias("c2"), (F.col("p") - 1).alias("q2")).agg(F.count(F.lit(1)).alias("n_children"))
    base = written(own.join(children, (F.col("rep") == F.col("c2")) & (F.col("p") == F.col("q2")), "left").select(
        "rep", "p", "up", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("words")).alias("saved")), "trie-base")
    totals = written(_totals(base, places, levels), "trie-totals")
    ended = of.join(convs.where("length > 0").select(F.col("conv_id").alias("c"), "length"), (F.col("conv_id") == F.col("c")) & (F.col("p") == F.col("length") - 1)).select(
        "rep", (F.col("p") + 1).alias("depth"), "conv_id")
    ended = ended.unionByName(convs.where("length = 0").select(F.lit(top.rep).cast("long").alias("rep"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    ends = _ends(ended).select(F.col("rep").alias("e_rep"), F.col("depth").alias("e_depth"), "ends_sha256")

    below = totals.select(F.col("rep").alias("c"), F.col("p").alias("q"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    inner = base.join(below, (F.col("rep") == F.col("c")) & (F.col("p") == F.col("q"))).select(
        F.col("rep").alias("conv_id"), (F.col("p") + 1).alias("depth"), F.when(F.col("p") == 0, F.lit(top.rep)).otherwise(F.col("up")).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    firsts = totals.where("p = 0").agg(F.count(F.lit(1)).alias("n_children"), F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    root = firsts.select(F.lit(top.rep).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                         F.lit(top.n).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    return inner.unionByName(root).join(ends, (F.col("conv_id") == F.col("e_rep")) & (F.col("depth") == F.col("e_depth")), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of the conversations with group heads."""
    turns = written(numbered_turns(conversations), "trie-numbered")
    return prefix_trie(*with_group_heads(turns))
