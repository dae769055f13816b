import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from courierflow.llm.prefix_trie import conversation_trie
from courierflow.llm.token_files import Shard, ShardWriter, token_files, write_token_files
from courierflow.llm.tokens import TokenIds, byte_bpe_path
from courierflow.llm.vector_codes import codebooks_digest, decode, fit_codebooks, nearest_entries, vector_codes, whole_vectors

from .corpus_cases import LONG, ROWS, SMALL, empty, table

# token files


def check_files(rows, got):
    whole = TokenIds(byte_bpe_path()).whole
    ids = [e.ids + [2] for e in whole.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids))
    ordered = sorted(got, key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, (False, 0)
    for r in ordered:
        assert r.start == at and (r.doc_id is not None, r.doc_id or 0) >= last
        at, last = at + r.n_tokens, (r.doc_id is not None, r.doc_id or 0)


def test_token_files_round_trip(spark):
    check_files(ROWS, token_files(table(spark, ROWS, ("start", "text2", "tie", "at"))).collect())
    check_files(ROWS, token_files(table(spark), size=7, batch=3).collect())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_files([(r.doc_id, r.text) for r in docs.collect()], token_files(docs).collect())


def test_token_files_empty_table_and_repeated_rows(spark):
    assert token_files(empty(spark)).collect() == []
    rows = [(5, "same text")] * 300 + [(None, "x")] * 100 + [(4, "b"), (6, None)]
    check_files(rows, token_files(table(spark, rows)).collect())


def test_token_file_sequences_and_masks_are_views(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    manifest = write_token_files(docs, str(tmp_path / "files"), size=64, batch=8).orderBy("shard").collect()
    own, texts, total = TokenIds(byte_bpe_path()), dict(docs.select("doc_id", "text").collect()), 0
    for m in manifest:
        shard = Shard(m.file)
        listed = list(shard.documents())
        stream = np.concatenate([np.append(ids, 2) for ids in own.encode(*_buffers([texts[d] or "" for d, _, _ in listed]))])
        assert m.n_tokens == len(stream) and m.n_docs == len(listed) and m.n_sequences == -(-len(stream) // 64)
        for i in range(m.n_sequences):
            ids, mask = shard.sequence(i)
            part = stream[64 * i:64 * i + 64]
            assert len(ids) == 64 and ids[:len(part)].tolist() == part.tolist() and mask.to_pylist() == [k < len(part) for k in range(64)]
            assert not ids.flags.owndata
        total += m.n_docs
    assert total == docs.count()


def _buffers(texts):
    from courierflow.llm.common import buffers

    return buffers(pa.array(texts, pa.string()))


def test_wide_ids_take_32_bits(tmp_path):
    out = ShardWriter(str(tmp_path / "s"), pa.uint32(), 4, 2)
    out.add(1, np.array([70000, 5, 2], np.uint32))
    out.add(None, np.arange(20, dtype=np.uint32))
    out.close()
    shard = Shard(str(tmp_path / "s"))
    assert list(shard.documents()) == [(1, 0, 3), (None, 3, 20)]
    assert np.concatenate(list(shard.tokens(0, 3))).tolist() == [70000, 5, 2] and np.concatenate(list(shard.tokens(3, 20))).tolist() == list(range(20))


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_200_000 + "word", "a" * 1_000_000, "x \t" + " " * 1_500_000 + "　y  z", "go" + " " * 10_000 + "\n" * 5_000,
                                  "你好" * 200_000, " " * 9000 + "'s" + "\xa0" * 9000 + "1", "hi <|endoftext|>" + " " * 100_000 + "x"], ids=range(8))
def test_very_long_runs_equal_the_tokenizer(text):
    own = TokenIds(byte_bpe_path())
    assert next(own.encode(*_buffers([text]))).tolist() == own.whole.encode(text, add_special_tokens=False).ids
    mixed = ["before", text, "after " + text[:5000]]
    assert [x.tolist() for x in own.encode(*_buffers(mixed))] == [e.ids for e in own.whole.encode_batch(mixed, add_special_tokens=False)]


# vector codes


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5), st.integers(1, 12), st.integers(0, 30), st.integers(0, 10 ** 6))
def test_equal_average_search_equals_full_search(width, entries, rows, seed):
    rng = np.random.default_rng(seed)
    parts, book = rng.integers(-4, 5, (rows, width)), rng.integers(-4, 5, (entries, width))
    d = ((parts[:, None] - book[None]) ** 2).sum(2).reshape(rows, entries)
    index, best = nearest_entries(parts, book)
    assert index.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    finite = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(x is not None and np.isfinite(x) for x in r[1])]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    finite.sort(key=key)
    kept = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in finite if len(v) == len(finite[0][1])]
    kept.sort(key=key)
    if not kept:
        return []
    cut = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = [cut[:entries, p].copy() for p in range(parts)]
    assign = lambda p: ((cut[:, p, None] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            near = assign(p).argmin(1)
            for e in set(near.tolist()):
                mine = cut[near == e, p]
                books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    far = [assign(p) for p in range(parts)]
    codes = ["".join(f"{far[p][n].argmin():02x}" for p in range(parts)) for n in range(len(kept))]
    error = [int(sum(far[p][n].min() for p in range(parts))) for n in range(len(kept))]
    total = {}
    for (_, _, label), e in zip(kept, error):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, total[label], sha) for (i, _, label), c, e in zip(kept, codes, error)]


def vectors(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("error", F.lit("x")).repartition(3)


def test_vector_codes_equal_brute_force(spark):
    rng = random.Random(4)
    vec = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(32)]
    rows = [(i, vec(), rng.choice([1, 2, None])) for i in range(150)]
    rows += [(None, vec(), 1), (7, vec(), 2), (7, rows[7][1], 1), (200, None, 1), (201, [], 1), (202, [1.0] * 16, 1), (203, [float("nan")] * 32, 1), (204, [float("inf")] + [0.0] * 31, None),
             (205, [None] + [0.0] * 31, 1), (206, [0.0] * 32, None), (207, [1.5] * 30, 1)]
    got = vector_codes(vectors(spark, rows)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(brute_codes(rows), key=order)


def test_vector_codes_of_few_rows_and_none(spark):
    rows = [(3, [0.5] * 16, None), (1, [-0.001] * 16, 4), (1, [-0.001] * 16, 4)]
    assert sorted(map(tuple, vector_codes(vectors(spark, rows)).collect())) == sorted(brute_codes(rows))
    assert vector_codes(vectors(spark, rows).where("1 = 0")).collect() == []
    assert vector_codes(vectors(spark, [(1, None, 1), (2, [], 1)])).collect() == []


def test_vector_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="out of range"):
        vector_codes(vectors(spark, [(1, [1e30] * 16, 1)])).collect()


def test_codes_decode_to_near_vectors(spark):
    whole = whole_vectors(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    books = fit_codebooks(whole)
    got = {r.vec_id: r for r in vector_codes(spark.read.parquet(f"{SMALL}/embeddings.parquet")).collect()}
    for r in whole.collect():
        assert sum((np.array(r.v) - decode(got[r.vec_id].code, books)) ** 2) == got[r.vec_id].error
    assert {r.codebooks_sha256 for r in got.values()} == {codebooks_digest(books)}


# prefix trie


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    count = lambda text: len(text.translate({i: " " for i in range(9, 14)}).split(" ")) - text.translate({i: " " for i in range(9, 14)}).split(" ").count("")
    out = {}
    kids, leaves, saved = {}, {}, {}
    for t in sorted(nodes, key=len, reverse=True):
        kids.setdefault(t, 0)
        own_saved = (len(nodes[t]) - 1) * (count(t[-1][1]) if t else 0)
        leaves[t] = leaves.get(t, 0) or (kids[t] == 0)
        saved[t] = saved.get(t, 0) + own_saved
        if t:
            up = t[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[t]
            saved[up] = saved.get(up, 0) + saved[t]
        ends = ",".join(map(str, sorted(c for c in nodes[t] if len(built[c]) == len(t))))
        out[t] = (min(nodes[t]), len(t), min(nodes[t[:-1]]) if t else None, len(nodes[t]), kids[t], int(leaves[t]), saved[t], hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def talks(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("p", F.lit("clash")).withColumn("rep", F.lit(0)).withColumn("length", F.lit(None).cast("int")).repartition(3)


def trie_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[0]))


def test_trie_awkward_rows(spark):
    rows = [(0, 0, "user", "hello there"), (0, 1, None, "a b  c\td"), (0, None, "user", None), (1, 0, "user", "hello there"), (2, 5, "u", ""), (None, 0, "user", "lost"),
            (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "user", "y"), (-5, 1, "user", "neg"), (-25, 1, "user", "neg"), (45, 2, "user", "no base " * 3000), (45, 1, "a", "é 你好"), (60, 9, "z", "only one")]
    assert trie_rows(conversation_trie(talks(spark, rows))) == brute_trie(rows)
    assert conversation_trie(talks(spark, rows).where("1 = 0")).collect() == []
    assert conversation_trie(talks(spark, rows[5:6])).collect() == []


def test_trie_of_turnless_conversations_only(spark):
    import courierflow.llm.prefix_trie as m

    rows = spark.createDataFrame([], "conv_id long, p long, length long, t1 long, t2 long, words long")
    got = m.prefix_trie(rows, spark.createDataFrame([(4, 0), (2, 0)], "conv_id long, length long")).collect()
    assert list(map(tuple, got)) == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]


@pytest.mark.parametrize("seed", range(3))
def test_trie_random_chains(spark, seed, monkeypatch):
    import courierflow.llm.prefix_trie as m

    monkeypatch.setattr(m, "PIECE_IDS", 2)
    rng = random.Random(seed)
    rows = []
    for c in range(70):
        n = rng.choice([1, 2, 3, 5, 8, 33]) if c % 7 else 40
        same = rng.random() < 0.5
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"w{t if same else rng.randrange(3)} common") for t in range(n)]
    assert trie_rows(conversation_trie(talks(spark, rows))) == brute_trie(rows)


def test_trie_of_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert trie_rows(conversation_trie(df)) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_long_text_constant_is_long():
    assert len(LONG) > 100_000
