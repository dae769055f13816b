"""Token ids of whole texts with a public tokenizer, cached by piece.

Byte-level BPE never merges across the place where white space follows a
character that is not white space.  Texts are cut there, each distinct piece
is encoded once per task, and the ids of a text are its pieces' ids in order.
Pieces are found and hashed (64 bits and the length) by array operations over
the whole Arrow buffer; only unseen pieces reach the encoder.  Texts holding
white space other than space and line feed are encoded whole, and texts that
hold a special token's string go through the tokenizer file's own pipeline.
Tests compare with that pipeline's output.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

from courierflow.llm.common import _powers, mix

#: Distinct pieces a task keeps before it starts its cache anew (about 150 MB).
CACHE_ENTRIES = 600_000
CHUNK_BYTES = 1 << 19
_U = np.uint64
#: White space from which on a run is cut out before the pattern sees it, which backtracks over all of it.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary file and their ids, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held.get("added_tokens", [])}
    back = _byte_symbols()
    return {bytes(back[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece not in special}


def cut_pieces(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the pieces of ``data`` (not empty), and where it has space or line feed.

    A piece begins at a break and where a space or line feed follows another byte."""
    n = len(data)
    gap = (data == 32) | (data == 10)
    first = np.zeros(n + 1, bool)
    first[1:-1] = gap[1:] & ~gap[:-1]
    first[breaks] = True
    first[n] = True
    cuts = np.flatnonzero(first)
    s, e = cuts[:-1], cuts[1:]
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=total[1:])
    return s, e, mix((total[e] - total[s]) * inverse[s] + (e - s).astype(_U) * _U(0x9DDFEA08EB382D69)), gap


class TokenIds:
    """Encoder of one task; ids are unsigned 32-bit."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        ranks = vocabulary(path)
        self.piece = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(p) for p in ranks]
        self._clear()

    def _clear(self) -> None:
        self.entry: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.fill = 0

    def _room(self, entries: int, ids: int) -> None:
        while len(self.entry) + entries > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        while self.fill + ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])

    def _plain(self, raw: bytes) -> list[int]:
        """Ids of a text without special tokens.  Of a run of white space that a word follows, the
        pattern makes one piece of all but the last character; long runs are cut out by that rule."""
        text = raw.decode()
        if len(raw) < 4096:
            return self.piece.encode_ordinary(text)
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.piece.encode_ordinary(text[at:run.start()])
            out += self.piece._encode_single_piece(text[run.start():end])
            at = end
        return out + self.piece.encode_ordinary(text[at:])

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode unseen pieces in one call: joined, a piece still starts a new
        word, because it begins with white space and the one before does not end
        with it; the tokens' byte lengths then say where each piece's ids end."""
        ids = np.array(self._plain(b"".join(pieces)), np.uint32)
        reach = np.cumsum(self.bytes_of[ids])
        ends = np.searchsorted(reach, np.cumsum([len(p) for p in pieces])) + 1
        self._room(len(pieces), len(ids))
        at = len(self.entry)
        self.pool[self.fill:self.fill + len(ids)] = ids
        starts = np.concatenate([[0], ends[:-1]])
        self.start[at:at + len(pieces)] = starts + self.fill
        self.size[at:at + len(pieces)] = ends - starts
        self.fill += len(ids)
        self.entry.update(zip(keys.tolist(), range(at, at + len(pieces))))

    def _chunk(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``data`` and, for each break but the last, how many ids follow it up to the next."""
        s, e, h, gap = cut_pieces(data, breaks)
        back, keys = pd.factorize(h)
        where = np.zeros(len(keys), np.int64)
        where[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        known = np.array([-1 if k is None else k for k in map(self.entry.get, keys.tolist())], np.int64)
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            if len(self.entry) + len(fresh) > CACHE_ENTRIES:
                self._clear()
                fresh = np.arange(len(keys))
            raw, w = data.tobytes(), where[fresh]
            joins = gap[s[w]] & ~gap[e[w] - 1]
            together, alone = fresh[joins], fresh[~joins]
            if len(together):
                w = where[together]
                known[together] = len(self.entry) + np.arange(len(together))
                self._learn(keys[together], [raw[i:j] for i, j in zip(s[w].tolist(), e[w].tolist())])
            for i in alone.tolist():
                known[i] = len(self.entry)
                self._learn(keys[i:i + 1], [raw[s[where[i]]:e[where[i]]]])
        slot = known[back]
        size = self.size[slot]
        before = np.cumsum(size) - size
        ids = self.pool[np.repeat(self.start[slot] - before, size) + np.arange(int(size.sum()))]
        ends = np.concatenate([before, [len(ids)]])[np.searchsorted(s, breaks)]
        return ids, np.diff(ends)

    def _one(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text of any length, in segments cut between pieces."""
        out, at, n = [], 0, len(data)
        while at < n:
            end = at + CHUNK_BYTES
            while end < n and not (data[end] in (32, 10) and data[end - 1] not in (32, 10)):
                end += 1
            end = min(end, n)
            out.append(self._chunk(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _odd(self, data: np.ndarray) -> bool:
        """Whether white space other than space and line feed occurs (or may occur)."""
        low = (data < 32) & (data != 10) & (data > 8)
        if low.any():
            return True
        for lead, second, third in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
            at = np.flatnonzero(data[:-1] == lead) if len(data) else data
            at = at[np.isin(data[at + 1], second)] if len(at) else at
            if len(at) and (third is None or np.isin(data[np.minimum(at + 2, len(data) - 1)], third).any()):
                return True
        return False

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row of an Arrow string buffer, in row order."""
        lo, rows = 0, len(offsets) - 1
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
            a, b = int(offsets[lo]), int(offsets[hi])
            part = data[a:b]
            raw = part.tobytes()
            if self._odd(part) or any(t in raw for t in self.special):
                for r in range(lo, hi):
                    one = data[offsets[r]:offsets[r + 1]]
                    raw = one.tobytes()
                    if any(t in raw for t in self.special):
                        yield np.array(self.whole.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)
                    elif self._odd(one):
                        yield np.array(self._plain(raw), np.uint32)
                    else:
                        yield self._one(one)
            elif hi - lo == 1:
                yield self._one(part)
            else:
                ids, counts = self._chunk(part, offsets[lo:hi + 1] - a) if len(part) else (np.zeros(0, np.uint32), np.zeros(hi - lo, np.int64))
                ends = np.cumsum(counts)
                for end, n in zip(ends.tolist(), counts.tolist()):
                    yield ids[end - n:end]
            lo = hi
