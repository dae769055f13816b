import collections
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from courierflow.llm.common import buffers, word_chunks, word_hash
from courierflow.llm.packing import hilbert_index, pack
from courierflow.llm.token_counts import LongestMatch, token_counts
from courierflow.llm.tokens import TokenIds, byte_bpe_path, vocabulary

from .corpus_cases import LONG, ROWS, SMALL, empty, table, words

ODD = ["", "  ", " a  b\n\nc \n d", "x\ty z", "a  b", "<|endoftext|> hi <|endoftext|>", "it's  'll \n\n", "　 x", "é \U0001F600 z\r\n q", "tab\x1c y", "q  r",
       "“quoted” text  x", "\n", LONG[:40000] * 40 + "z"]


def test_ids_equal_the_tokenizer(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    own = TokenIds(byte_bpe_path())
    whole = [e.ids for e in own.whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(*buffers(pa.array(texts)))] == whole


def test_ids_survive_cache_resets(monkeypatch):
    import courierflow.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 40)
    own = TokenIds(byte_bpe_path())
    texts = [t for t in ODD if len(t) < 100] * 3
    assert [x.tolist() for x in own.encode(*buffers(pa.array(texts)))] == [e.ids for e in own.whole.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9z -_.é你\n", max_size=25), max_size=8))
def test_words_equal_the_regular_expression(texts):
    column = pa.array(texts, pa.string())
    got = [[] for _ in texts]
    for _, _, row, _, _, h in word_chunks(*buffers(column)):
        for r, x in zip(row.tolist(), h.tolist()):
            got[r].append(x)
    assert got == [[word_hash(w) for w in words(t)] for t in texts]


def test_hilbert_neighbours_are_adjacent_cells():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    order = cells[np.argsort(hilbert_index(cells, 3))]
    assert len(set(hilbert_index(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def check_packing(rows, got, size):
    own = TokenIds(byte_bpe_path())
    ids = [e.ids + [0] for e in own.whole.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = collections.Counter()
    for (i, _), x in zip(rows, ids):
        want[i, len(x)] += len(x)
    have, seqs = collections.Counter(), collections.defaultdict(list)
    by_doc = collections.defaultdict(set)
    for (i, _), x in zip(rows, ids):
        by_doc[i].add(tuple(x))
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
        piece = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(piece) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        assert any(list(x[r.start:r.start + r.length]) == piece for x in by_doc[r.doc_id] if len(x) == r.doc_tokens)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)


def test_packing_covers_every_id_once_without_padding(spark):
    check_packing(ROWS, pack(table(spark, ROWS, ("ids", "offset", "_key"))).collect(), 1024)
    check_packing(ROWS[:9], pack(table(spark, ROWS[:9]), max_tokens=24).collect(), 24)


def test_packing_empty(spark):
    assert pack(empty(spark)).collect() == []


UNIT = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")


def greedy(unit, first, rest):
    at = n = 0
    while at < len(unit):
        pieces = first if at == 0 else rest
        for size in range(min(70, len(unit) - at), 0, -1):
            if unit[at:at + size] in pieces:
                break
        else:
            return -1
        at, n = at + size, n + 1
    return n


def test_token_counts_match_greedy_longest_match(spark):
    pieces = set(vocabulary(byte_bpe_path()))
    rows = [r for r in ROWS if r[0] not in (6, 9)] + [(20, "unbelievable tokenization\n\n  of words"), (21, "y" * 700)]
    for r in token_counts(table(spark, rows, ("n_tokens", "n_units"))).collect():
        options = [t for i, t in rows if i == r.doc_id]
        units = [UNIT.findall((t or "").encode()) for t in options]
        assert (r.n_bytes, r.n_units, r.n_tokens, r.n_unknown) in [(sum(map(len, u)), len(u), sum(greedy(x, pieces, pieces) for x in u), 0) for u in units]


def test_token_counts_unknown_units_count_one(spark):
    rows = [(1, "ab abc zz"), (2, None)]
    got = {r.doc_id: (r.n_units, r.n_tokens, r.n_unknown) for r in token_counts(table(spark, rows), [b"a", b"ab", b" a", b" ab"], [b"b"]).collect()}
    assert got == {1: (3, 3, 2), 2: (0, 0, 0)}
    assert token_counts(empty(spark)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=8), st.lists(st.text("abc", min_size=1, max_size=4), max_size=8), st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=8))
def test_automaton_equals_greedy(first, rest, units):
    first, rest, units = ([x.encode() for x in part] for part in (first, rest, units))
    match = LongestMatch(first, rest)
    ends = np.cumsum([len(u) for u in units])
    want = [greedy(u, set(first), set(rest)) for u in units]
    assert match.count(np.frombuffer(b"".join(units), np.uint8), ends - [len(u) for u in units], ends).tolist() == want
    assert [match.count_one(u) if match.edges.size else -1 for u in units] == want
