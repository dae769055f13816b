import collections
import hashlib
import math

import pytest

from courierflow.llm.line_dedup import line_dedup
from courierflow.llm.mixing import DRAW_MEAN, DRAW_TERMS, mix_sources, mixing_rates, source_counts

from .corpus_cases import LONG, ROWS, empty, table


def brute_lines(rows, least):
    """Straight over all runs of lines: later copies of any run of enough words go."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    full = {r: [(i, s.strip()) for i, s in enumerate((rows[r][1] or "").split("\n")) if s.strip()] for r in order}
    seen, gone = {}, collections.defaultdict(set)
    for r in order:
        for a in range(len(full[r])):
            total = 0
            for b in range(a, len(full[r])):
                total += len(full[r][b][1].split())
                run = tuple(s for _, s in full[r][a:b + 1])
                if total >= least:
                    if run in seen and seen[run] != (r, a):
                        gone[r].update(i for i, _ in full[r][a:b + 1])
                    seen.setdefault(run, (r, a))
    return {r: ("\n".join(s for i, s in enumerate((rows[r][1] or "").split("\n")) if i not in gone[r]), len(full[r]), len(gone[r])) for r in order}


@pytest.mark.parametrize("least", [1, 4, 9])
def test_line_dedup_matches_brute_force(spark, least):
    a, b, c = "the first shared line\nand the second one", "shared line of five words", "short"
    rows = [(1, f"{a}\n\nown text of one\n{b}"), (2, f"other start\n{a}\n{b}\n{c}"), (3, None), (4, ""), (5, f"{c}\n{c}\n{c}\n{c}\n{c}"),
            (6, f"  {b} \nnew words here\n{a}"), (7, "\n \n"), (None, f"{a}\nlast"), (8, "z " * 3000 + f"\n{a}"), (9, f"{b}\n{c}\n{b}\n{c}\n{b}")]
    got = line_dedup(table(spark, rows, ("n_lines", "d", "k", "n")), least).collect()
    want = brute_lines(rows, least)
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in got) == sorted((rows[r][0] or 0, *want[r]) for r in want)


def test_line_dedup_keeps_columns_and_takes_awkward_rows(spark):
    got = line_dedup(table(spark, ROWS, ("n_removed", "windows")))
    assert got.columns == ["doc_id", "lang", "source", "windows", "text", "n_lines", "n_removed"]
    assert len(got.collect()) == len(ROWS)
    twice = line_dedup(table(spark, [(1, LONG), (2, LONG)])).collect()
    assert {(r.doc_id, r.n_removed) for r in twice} == {(1, 2), (2, 3)}
    assert line_dedup(empty(spark)).collect() == []


def test_line_dedup_takes_repeated_rows_as_copies(spark):
    """Equal long rows, two and many, with and without an id: one keeps its lines, nothing grows with their number."""
    text = "\n".join(f"line {i} of a text that is repeated as a whole" for i in range(40))
    rows = [(1, text)] * 2 + [(2, text)] * 300 + [(None, text)] * 300 + [(None, "other " + text)] * 2 + [(3, "short row")] * 3
    want = brute_lines(rows, 50)
    got = line_dedup(table(spark, rows, ("d", "k", "n"))).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in got) == sorted((rows[r][0] or 0, *want[r]) for r in want)
    assert sorted(r.n_removed for r in got if r.doc_id == 1) == [0, 40]
    assert all(r.n_removed == 40 for r in got if r.doc_id == 2)
    alone = line_dedup(table(spark, [(None, text)] * 200)).collect()
    assert sorted(r.n_removed for r in alone) == [0] + [40] * 199


def poisson(seed, ident, rate):
    m = max(1, math.ceil(rate / DRAW_MEAN))
    mean, total = rate / m, 0
    for j in range(1, m + 1):
        u = int(hashlib.md5(f"{seed}:{'' if ident is None else ident}:{j}".encode()).hexdigest()[:13], 16) / 2 ** 52
        term = cum = math.exp(-mean)
        k = 0
        while k <= DRAW_TERMS and cum <= u:
            k += 1
            term = term * mean / k
            cum += term
        total += k
    return total


def test_mixing_copies_follow_the_inverted_distribution(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else ("small" if i % 2 else None)) for i in range(300)] + [(None, None, "big"), (5, "again", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    targets = spark.createDataFrame([("big", 1.0), ("small", 40.0), (None, 1.0), ("absent", 3.0)], "source string, weight double")
    counts = collections.Counter(r[2] for r in rows)
    got = mix_sources(docs, targets, total=900, seed=3).collect()
    have = collections.Counter((r.doc_id, r.text, r.source) for r in got)
    for i, t, s in rows:
        rate = 900 / 42.0 * {"big": 1.0, "small": 40.0, None: 1.0}[s] / counts[s]
        assert have[i, t, s] == poisson(3, i, rate)
    assert all(1 <= r.copy <= r.n_copies for r in got)
    assert len({(r.doc_id, r.text, r.copy) for r in got}) == len(got)


def test_mixing_without_target_drops_and_defaults_keep_size(spark):
    docs = table(spark, ROWS, ("copy", "rate"))
    assert mix_sources(docs, spark.createDataFrame([("other", 1.0)], "source string, weight double")).collect() == []
    assert mix_sources(empty(spark)).collect() == []
    counts = source_counts(spark.createDataFrame([("a",)] * 900 + [("b",)] * 100, "source string"))
    rates = {r.source: r.rate for r in mixing_rates(counts, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")).collect()}
    assert rates == {"a": pytest.approx(500 / 900), "b": pytest.approx(5.0)}


def test_mixing_runs_no_python(spark):
    plan = mix_sources(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
