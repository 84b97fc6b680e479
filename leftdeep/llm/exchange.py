"""Questions that chunks of a corpus put to tables spread over parts by key.

A chunk is a run of a partition's rows with about ``chunk_bytes`` of text. Chunks are cut
once and written to the shared folder; all later steps read them there, so that no step
depends on the order in which a scan yields its rows. A chunk sorts the distinct keys it
needs; their ranges go to the parts as packed arrays; a part answers with one number for
each key, in the same order, so the keys need not travel back. Then chunks and answers
meet. A chunk's name is a hash of its content: chunks of equal content share their answers.

A chunk sends a part one array, or none if it has no key there. So there are never more
arrays than distinct keys of chunks, and what moves is in proportion to the corpus; while
a chunk has many more keys than there are parts, an array holds many keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leftdeep.shared import stored

#: Text of a chunk, and text whose keys a part takes.
CHUNK_BYTES, PART_BYTES = 8 << 20, 16 << 20
KEY_BITS = 56
#: Shuffle partitions at most: a task then works on several parts or chunks in turn.
TASKS = 20_000
ASKED = "level int, part int, chunk string, blob binary"
U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, without planes of zeros on top."""
    top = int(values.max()) if len(values) else 0
    planes = (top.bit_length() + 7) // 8
    return bytes([planes]) + len(values).to_bytes(8, "little") + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The integers packed at ``at``, and where they end."""
    planes, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
    out = np.zeros((n, 8), np.uint8)
    end = at + 9 + planes * n
    out[:, :planes] = np.frombuffer(data, np.uint8, planes * n, at + 9).reshape(planes, n).T
    return out.view("<u8").ravel(), end


def sealed(packed: bytes) -> bytes:
    """Packed integers as they are sent."""
    return zstandard.ZstdCompressor(level=1).compress(packed)


def opened(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def answered(values: np.ndarray) -> bytes:
    """A part's answers for one chunk."""
    return sealed(pack(values))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return pack(np.diff(keys, prepend=U(0)))


def bounds(parts: int) -> np.ndarray:
    """The least key of each part, and one past the last part's greatest."""
    return np.array([(p << KEY_BITS) // parts for p in range(parts)] + [1 << KEY_BITS], U)


def asked(level: int, chunk: str, keys: np.ndarray, parts: int, *columns: np.ndarray) -> pd.DataFrame:
    """Sorted distinct keys with columns of numbers, cut by part; parts without keys are left out."""
    cut = np.searchsorted(keys, bounds(parts))
    full = np.flatnonzero(np.diff(cut))
    blobs = [sealed(packed_keys(keys[cut[p] : cut[p + 1]]) + b"".join(pack(c[cut[p] : cut[p + 1]]) for c in columns)) for p in full]
    return pd.DataFrame({"level": np.full(len(full), level, np.int32), "part": full.astype(np.int32), "chunk": chunk, "blob": blobs})


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    """[keys, column, ...]"""
    out, at, blob = [], 0, opened(blob)
    for _ in range(columns + 1):
        values, at = unpack(blob, at)
        out.append(values)
    out[0] = np.cumsum(out[0], dtype=U)
    return out


def in_order(answers: pd.DataFrame, level: int) -> np.ndarray:
    """A chunk's answers of one level, aligned with its sorted keys."""
    own = answers[answers["level"] == level].drop_duplicates("part").sort_values("part")
    return np.concatenate([np.empty(0, U), *(unpack(opened(b))[0] for b in own["blob"])])


def chunks(rows: Iterator[pd.DataFrame], id_col: str, text_col: str, size: int) -> Iterator[tuple[str, list, list[bytes]]]:
    """(name, ids, texts as bytes); null texts count as empty."""
    ids, texts, held = [], [], 0

    def made() -> tuple[str, list, list[bytes]]:
        h = xxhash.xxh3_128(pickle.dumps((ids, [len(t) for t in texts])))
        for t in texts:
            h.update(t)
        return h.hexdigest(), ids, texts

    for part in rows:
        for i, t in zip(part[id_col].astype(object).where(part[id_col].notna(), None), part[text_col], strict=True):
            ids.append(None if i is None else int(i))
            texts.append((t or "").encode())
            held += len(texts[-1])
            if held >= size:
                yield made()
                ids, texts, held = [], [], 0
    if ids:
        yield made()


def parts_for(docs: DataFrame, text_col: str, part_bytes: int = PART_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, -(-total // part_bytes))


def held(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of ``docs``: (chunk, held)."""

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for name, ids, texts in chunks(rows, id_col, text_col, chunk_bytes):
            yield pd.DataFrame({"chunk": [name], "held": [squeeze.compress(pickle.dumps((ids, texts)))]})

    return stored(docs.select(F.col(id_col).cast("long"), text_col).mapInPandas(cut, "chunk string, held binary"), "chunks")


def _opened(blob: bytes) -> tuple[list, list[bytes]]:
    return pickle.loads(opened(blob))


def tasks(groups: int) -> int:
    """Shuffle partitions for so many groups."""
    return max(1, min(groups, TASKS))


def ask(chunked: DataFrame, of_chunk: Callable[[str, list, list[bytes]], Iterator[pd.DataFrame]]) -> DataFrame:
    """What ``of_chunk`` asks, for each distinct chunk's name, ids and texts."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            for name, blob in zip(part["chunk"], part["held"], strict=True):
                yield from of_chunk(name, *_opened(blob))

    return chunked.mapInPandas(run, ASKED)


def meet(chunked: DataFrame, answers: DataFrame, of_chunk: Callable[[str, list, list[bytes], pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``of_chunk`` of each chunk and its answers. One chunk at a time is held."""
    last = 1 << 30  # sorts a chunk behind its answers

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, own = None, []
        for part in rows:
            for i, (chunk, level) in enumerate(zip(part["chunk"], part["level"], strict=True)):
                if chunk != name:
                    name, own = chunk, []
                if level != last:
                    own.append((level, part["part"].iat[i], part["blob"].iat[i]))
                    continue
                yield from of_chunk(name, *_opened(part["blob"].iat[i]), pd.DataFrame(own, columns=["level", "part", "blob"]))

    texts = chunked.select(F.lit(last).alias("level"), F.lit(0).alias("part"), "chunk", F.col("held").alias("blob"))
    both = answers.select("level", "part", "chunk", "blob").unionByName(texts)
    return both.repartition(tasks(chunked.count()), "chunk").sortWithinPartitions("chunk", "level", "part").mapInPandas(run, schema)
