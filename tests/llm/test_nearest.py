import numpy as np
import pytest

from courierflow.llm import nearest as module
from courierflow.llm.nearest import nearest, visits


def brute(rows, step, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in ok}, key=[len(v) for _, v in ok].count) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == size]
    out = {}
    for q, qv in ok:
        if q % step == 0:
            out[q] = sorted([(-float((v * qv).sum()), i) for i, v in ok if i != q])[:k]
    return out


def rows_of(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 3
    return [(i, (centres[i % 6] + rng.normal(size=dims)).tolist()) for i in range(n)]


def test_recall_order_and_scores(spark):
    rows = rows_of(900, 12, 0)
    rows += [(2000 + i, rows[7][1]) for i in range(60)]
    rows += [(5000, None), (5020, [0.0] * 12), (5040, [None] + [1.0] * 11), (5060, [float("nan")] * 12), (5080, [float("inf")] + [0.0] * 11), (5100, [1.0, 2.0]), (None, rows[3][1]), (60, rows[60][1])]
    got = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    unique = list({(i, tuple(v) if v is not None else None): (i, v) for i, v in rows}.values())
    want = brute(unique, 20, 20)
    for r in nearest(frame, 20, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hit >= 0.9 * 20 * len(want)
    exact = {i: s for s, i in want[20]}
    for _, i, s in got[20]:
        assert i not in exact or s == pytest.approx(-exact[i], abs=1e-12)


def test_ties_go_to_the_smaller_id_and_small_tables_give_all(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 20).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20, 100)}
    assert by == {0: list(range(1, 21)), 20: [*range(0, 20)], 100: list(range(0, 20))}
    few = nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), 1, 20).collect()
    assert len(few) == 6


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, score double, v int")
    assert nearest(none).collect() == []
    assert nearest(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), 20).collect() == []


def test_pairs_come_by_growing_distance():
    rng = np.random.default_rng(3)
    first, second, q = rng.normal(size=(5, 2)), rng.normal(size=(4, 2)), rng.normal(size=4)
    sizes = rng.integers(0, 3, (5, 4))
    got = list(visits(q, first, second, sizes))
    cost = [((q[:2] - first[i]) ** 2).sum() + ((q[2:] - second[j]) ** 2).sum() for i, j, _ in got]
    assert cost == sorted(cost)
    assert {(i, j) for i, j, _ in got} == {(i, j) for i in range(5) for j in range(4) if sizes[i, j]}
    assert got[-1][2] == sizes.sum()


def test_queries_are_dealt_over_all_groups(spark, monkeypatch):
    """Every query id is a multiple of the step; the number of groups shares that factor."""
    kept = {}

    def written(df, name, was=module.written):
        kept[name] = was(df, name)
        return kept[name]

    monkeypatch.setattr(module, "written", written)
    monkeypatch.setattr(module, "QUERY_GROUP", 2)
    rows = rows_of(800, 8, 1)
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5).collect()
    assert len(got) == 40 * 5
    dealt = {r.qid: r.grp for r in kept["nearest-routes"].select("qid", "grp").distinct().collect()}
    assert len(dealt) == 40 and set(dealt.values()) <= set(range(20))
    assert max(list(dealt.values()).count(g) for g in set(dealt.values())) <= 8
