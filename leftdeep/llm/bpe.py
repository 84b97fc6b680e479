"""Byte-level BPE by rank, as length-bucketed padded matrices.

A text is cut into pieces by a pattern; a piece is a row of byte tokens in a matrix of
rows of about its length. Each round every row merges its leftmost pair of least rank,
found through a hash table of pairs, and is compacted by one cell. Rows that have no
mergeable pair leave the matrix. Pieces over ``LONGEST_ROW`` bytes go through a heap that
merges in the same order, so that one endless piece costs n log n rather than n squared.

Null and empty texts have no tokens. Equal texts give equal tokens; rows are independent,
so repeated rows, ties and extra columns have no effect. An existing column with the
output's name is replaced. Decoding an id that the vocabulary lacks raises ValueError.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leftdeep.llm.hashing import ranges

#: Widest matrix, in bytes of a piece.
LONGEST_ROW = 192
#: Cells of a matrix that is worked on at once.
CELLS = 1 << 20
#: Pieces that a worker remembers, and characters of text it takes at once.
REMEMBERED, CHARACTERS = 200_000, 1 << 19
#: A rank file of more bytes is refused: it is sent to every worker.
LARGEST_FILE = 64 << 20
NONE = np.int32(2**31 - 1)
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, LONGEST_ROW)


class Vocabulary:
    """Tokens by rank, and a hash table from pairs of tokens to the rank of their union."""

    def __init__(self, data: bytes):
        self.tokens: dict[int, bytes] = {}
        for line in data.splitlines():
            if line:
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        ranks = {t: r for r, t in self.tokens.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (ranks[t[:i]] << 32 | ranks[t[i:]]): r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        size = max(self.tokens, default=-1) + 1
        self.length, self.start = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for i, t in self.tokens.items():
            self.length[i] = len(t)
        self.start[1:] = np.cumsum(np.maximum(self.length, 0))[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self._fill(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes one of the keys that want it; the rest try the next slot
            want = slot[left]
            free = self.keys[want] == -1
            self.keys[want[free]] = keys[left[free]]
            won = self.keys[want] == keys[left]
            self.ranks[want[won]] = ranks[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's union; NONE where there is none or a cell is padding (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        known = (ids >= 0) & (ids < len(self.length))
        length = np.where(known, self.length[np.where(known, ids, 0)], -1)
        if (length < 0).any():
            raise ValueError(f"no token has the id {ids[length < 0][0]}")
        return self.bytes[ranges(self.start[ids], length)].tobytes()

    def encode_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` bytes, as one matrix."""
        n = len(pieces)
        out = [b""] * n
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        number = np.arange(n)
        while len(number):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(number), np.int64)
            least = ranks[np.arange(len(number)), at] if ranks.shape[1] else np.full(len(number), NONE)
            going = least != NONE
            if not going.all():
                done = ids[~going]
                data, ends = done.tobytes(), (done >= 0).sum(1) * 4 + np.arange(len(done)) * done.shape[1] * 4
                for j, (i, end) in enumerate(zip(number[~going].tolist(), ends.tolist(), strict=True)):
                    out[i] = data[j * done.shape[1] * 4 : end]
                number, ids, ranks, at, least = number[going], ids[going], ranks[going], at[going], least[going]
                if not len(number):
                    break
            r, w = np.arange(len(number)), ids.shape[1]
            ids[r, at] = least
            keep = np.ones(ids.shape, bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(len(number), w - 1)
            keep = np.ones(ranks.shape, bool)
            keep[r, at] = False
            ranks = ranks[keep].reshape(len(number), w - 2)
            before, after = at > 0, at < w - 2
            ranks[r[before], at[before] - 1] = self.rank(ids[r[before], at[before] - 1], ids[r[before], at[before]])
            ranks[r[after], at[after]] = self.rank(ids[r[after], at[after]], ids[r[after], at[after] + 1])
        return out

    def encode_long(self, piece: bytes) -> bytes:
        """The same merges in the same order, from a heap over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.rank(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        now, after, before = ids.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        of = first.tolist() + [int(NONE)]

        def look(i: int) -> None:
            j = after[i]
            of[i] = int(self.rank(np.array([now[i]]), np.array([now[j]]))[0]) if j >= 0 else int(NONE)
            if of[i] != NONE:
                heapq.heappush(heap, (of[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] < 0 or of[i] != r:
                continue
            j = after[i]
            now[i], now[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([x for x in now if x >= 0], np.int32).tobytes()

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of 32-bit integers."""
        out = [b""] * len(pieces)
        rows: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONGEST_ROW:
                out[i] = self.encode_long(p)
            elif p:
                rows.setdefault(next(w for w in WIDTHS if len(p) <= w), []).append(i)
        for width, members in rows.items():
            step = CELLS // width
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self.encode_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out


@lru_cache(maxsize=2)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(LARGEST_FILE + 1)
    if len(data) > LARGEST_FILE:
        raise ValueError(f"{path} has more than {LARGEST_FILE} bytes")
    return data


def encode_texts(vocabulary: Vocabulary, pattern: regex.Pattern, texts: list[str], known: dict[str, bytes]) -> Iterator[np.ndarray]:
    """``known``: pieces met before; it is filled, and emptied when it has grown too large."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHARACTERS):
            size += len(texts[end])
            end += 1
        cut = [pattern.findall(t) for t in texts[at:end]]
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*cut) - known.keys())
        known.update(zip(new, vocabulary.encode([p.encode() for p in new]), strict=True))
        for pieces in cut:
            yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32)
        at = end


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``, the ids of each whole text. ``ranks``: what ``read_ranks`` returns."""
    data = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, compiled, known = _vocabulary(data.value), regex.compile(pattern), {}
        for part in texts:
            yield pd.Series(list(encode_texts(vocabulary, compiled, part.tolist(), known)), index=part.index, dtype=object)

    return df.withColumn(out_col, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(df: DataFrame, ranks: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the bytes that the ids stand for."""
    data = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _vocabulary(data.value)
        for part in ids:
            yield pd.Series([b"" if x is None else vocabulary.decode(x) for x in part], index=part.index, dtype=object)

    return df.withColumn(out_col, text(F.col(ids_col)))
