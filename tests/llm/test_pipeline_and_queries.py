import importlib
import os

import pytest

from courierflow.llm.queries import ORACLES, QUERIES

from .corpus_cases import ROWS, SMALL, empty, table
from .test_exact_and_near import brute_near
from .test_lines_and_mixing import brute_lines, poisson
from .test_tokens_and_packing import check_packing


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    from courierflow.plans.verify import _rows

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLES[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in cur.description], cur.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_one_by_one(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = p.quality(spark, docs, SMALL)
    assert kept.columns == docs.columns
    kept = p.written(kept, "t")
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    assert 0 < len(rows) <= docs.count()
    want = [(rows[r][0], t) for r, (t, n, gone) in brute_lines(rows, 50).items() if gone == 0 or gone < n]
    cut = p.written(p.cut_lines(spark, kept, SMALL), "t")
    lines = sorted((r.doc_id, r.text) for r in cut.collect())
    assert cut.columns == docs.columns and lines == sorted(want) and all(r.n_chars == len(r.text) for r in cut.collect())
    firsts = {r[1] for r in brute_near(lines)}
    near = p.written(p.near_duplicates(spark, cut, SMALL), "t")
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == sorted(firsts)
    counts = {}
    for r in near.collect():
        counts[r.source] = counts.get(r.source, 0) + 1
    scale = sum(counts.values()) / sum(n ** 0.5 for n in counts.values())
    mixed = p.written(p.mixing(spark, near, SMALL), "t")
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in near.collect() for _ in range(poisson(p.MIX_SEED, r.doc_id, scale * counts[r.source] ** 0.5 / counts[r.source])))
    check_packing([(r.doc_id, r.text) for r in mixed.collect()], p.packing(spark, mixed, SMALL).collect(), 1024)


def test_pipeline_takes_awkward_and_empty_documents(spark):
    import corpus_pipeline as p

    for docs in (table(spark, ROWS, ("n_chars", "kept", "copy", "_d")), empty(spark)):
        for _, stage in p.STAGES[:-1]:
            before, docs = docs, p.written(stage(spark, docs, SMALL), "t")
            assert docs.columns == before.columns
        p.STAGES[-1][1](spark, docs, SMALL).collect()


def test_near_duplicate_stage_keeps_the_values_of_columns(spark):
    from pyspark.sql import functions as F

    from courierflow.llm.near_dup import one_of_each

    docs = table(spark).withColumn("_d", F.lit("mine")).withColumn("_kd", F.concat(F.lit("k"), "text")).withColumn("a.b", F.col("doc_id") + 1)
    got = one_of_each(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r["_d"] == "mine" and r["_kd"] == (None if r["text"] is None else "k" + r["text"]) and r["a.b"] == (None if r["doc_id"] is None else r["doc_id"] + 1) for r in rows)


def test_entry_registers_queries_and_pipeline():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(entry.oracle_sql())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
