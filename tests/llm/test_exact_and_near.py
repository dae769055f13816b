import collections
import hashlib
import random
import re

import numpy as np
import pytest

from courierflow.llm.components import connected
from courierflow.llm.exact_dedup import PatriciaTrie, exact_dedup
from courierflow.llm.near_dup import MAX_DEPTH, _sign, forest_depth, least_similarity, near_duplicates, one_of_each, prefix, stop_depth, trie_runs

from .corpus_cases import ROWS, empty, table, words


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("memory", [1, 1 << 20])
def test_exact_dedup_matches_brute_force(spark, memory):
    rows = ROWS + [(10, "a \t b"), (11, "a b"), (12, "a\x0bb"), (13, "a b"), (0, "one two three  four five six seven")]
    got = exact_dedup(table(spark, rows, ("keep_id", "kept", "_len", "_hash")), memory_bytes=memory).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_exact(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup(empty(spark)).collect() == []


def test_trie_spills_by_subtree_without_losing_keys():
    random.seed(2)
    keys = [bytes(random.choice(b"ab\x00\xff") for _ in range(random.randint(0, 9))) for _ in range(400)]
    trie, seen = PatriciaTrie(), collections.defaultdict(lambda: [None, 0])

    def take(pairs):
        for k, (ident, n, _) in pairs:
            seen[k][0] = ident if seen[k][0] is None else min(seen[k][0], ident)
            seen[k][1] += n

    for n, k in enumerate(keys):
        trie.insert(k, n, 1, 0)
        if n % 37 == 0:
            take(trie.spill())
    take(trie.drain())
    assert {k: tuple(v) for k, v in seen.items()} == {k: (keys.index(k), keys.count(k)) for k in set(keys)}


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n = len(rows)
    link = [[i != j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and bool(sets[i] & sets[j])) for j in range(n)] for i in range(n)]
    up = list(range(n))
    for _ in range(n):
        for i in range(n):
            up[i] = min([up[i], *(up[j] for j in range(n) if link[i][j])])
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if up[j] == up[i] and rows[j][0] is not None]
        same = [rows[j][0] for j in range(n) if sets[j] == sets[i]]
        known = [x for x in same if x is not None]
        out.append((rows[i][0], min(ids) if ids else None, min(known) if known else None, len(same), sum(link[i])))
    return sorted(out, key=str)


def near_rows():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    rows = list(ROWS)
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(120)]
        for c in range(8):
            copy = list(base)
            for _ in range(c % 4 + (c == 7) * 20):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((100 + 10 * g + c, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block, block_bytes", [(256, 1 << 25), (3, 1 << 25), (256, 2000)])
def test_near_duplicates_match_brute_force(spark, block, block_bytes):
    rows = near_rows()
    got = near_duplicates(table(spark, rows, ("node", "class_id", "tree")), block=block, block_bytes=block_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_near(rows)


def test_one_of_each_keeps_the_first_of_each_class(spark):
    rows = near_rows()
    got = one_of_each(table(spark, rows, ("root", "tkey"))).select("doc_id", "text").collect()
    expected = collections.Counter((c, ) for c in {(r[1], r[2]) for r in brute_near(rows)} for c in [c[0]])
    assert len(got) == len({r[1] for r in brute_near(rows) if r[1] is not None}) + len({r[2:4] for r in brute_near(rows) if r[1] is None})
    assert {r.doc_id for r in got} == {r[1] for r in brute_near(rows)}
    assert expected


def test_near_duplicates_empty(spark):
    assert near_duplicates(empty(spark)).collect() == []


def test_forest_depth_reaches_recall():
    d = forest_depth(0.8, 32, 8, 0.9999)
    assert 1 - (1 - 0.8 ** d) ** 32 >= 0.9999 and 1 - (1 - 0.8 ** (d + 1)) ** 32 < 0.9999


def test_least_similarity_matches_all_partners():
    for size in range(1, 60):
        all_of = [k / (size + other - k) for other in range(1, 90) for k in range(1, min(size, other) + 1)
                  if 5 * k >= 4 * (size + other - k) and not k == size == other]
        least = least_similarity(size, (4, 5))
        assert (least is None and not all_of) or float(least) == min(all_of)


def stops_of(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["d", "t", "x"])
    return next(_sign(5, (4, 5), 32, 0.9999, 11)(iter([batch]))).column("stop").to_pylist()


def test_prefixes_of_short_texts_stay_longer():
    short = [" ".join(f"s{i}" for i in range(n)) for n in (10, 10, 11)]  # 6 and 7 shingles
    long = [" ".join(f"l{i}" for i in range(n)) for n in (100, 500)]
    assert stops_of(short) == [7, 7, 8] and stops_of(long) == [6, 6]
    assert stops_of(["", "one", "one two three four five six seven"]) == [MAX_DEPTH + 1] * 3
    for size in range(1, 300):
        least, depth = least_similarity(size, (4, 5)), stop_depth(size, (4, 5), 32, MAX_DEPTH, 0.9999)
        assert (least is None) == (depth > MAX_DEPTH)
        assert least is None or 1 - (1 - float(least) ** depth) ** 32 >= 0.9999


def test_short_texts_of_one_more_or_fewer_words_match_brute_force(spark):
    rows = []
    for g in range(30):
        full = [f"g{g}w{i}" for i in range(16)]
        rows += [(100 * g + n, " ".join(full[:n])) for n in range(1, 17)]
    got = near_duplicates(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_near(rows)


def test_trie_runs_match_pairs_at_the_longer_prefix():
    rng = np.random.default_rng(5)
    n = 400
    tree, stop = rng.integers(0, 2, n), rng.integers(5, 9, n)
    path = (rng.integers(0, 2, (n, 8)) << (8 * np.arange(7, -1, -1))).sum(1) - (1 << 62)
    order = np.lexsort((path, tree))
    tree, stop, path = tree[order], stop[order], path[order]
    got = set()
    for level, rows, at in trie_runs(tree, path, stop):
        for i, a in zip(rows, at):
            got |= {(i, j) for j, b in zip(rows, at) if i < j and a == b and tree[i] == tree[j] and max(stop[i], stop[j]) == level}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if tree[i] == tree[j]
                   and prefix(path[i], max(stop[i], stop[j])) == prefix(path[j], max(stop[i], stop[j]))}


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (400, 401)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in connected(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200, 202: 200, 400: 400, 401: 400}
