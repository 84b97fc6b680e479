"""Repeated substrings by longest-previous-factor arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in the same text or another; strings are judged on the input, all copies go.

No suffix array spans the corpus. Every window of LENGTH bytes has a minimizer, the k-gram
of least hash in it (the leftmost on ties); equal windows have equal minimizers at equal
places, so they meet under the minimizer's key. Consecutive windows with one minimizer
make a run. Chunks of texts ask the parts of a table, spread by key (see exchange), what
to do with each of their distinct runs:

- the key occurs once: no window of the run occurs elsewhere;
- the same run occurs elsewhere: all its windows do;
- only other runs have the key: the run's bytes, and one copy of each other run of the
  key, go to one place and are compared;
- over ``hot`` different runs have the key, as around a passage that many documents share:
  their windows are asked for like runs, by hashes of their own, in packed arrays, and are
  counted there. So no key is ever gathered whole beyond that number.

There the strings of a key are joined, and their windows sorted as suffixes by prefix
doubling. With the previous and the next smaller text position of each in suffix order,
and the least common prefix on the way there, the longest previous factor follows; the
same with greater positions gives the longest next factor. A window of which either
reaches LENGTH is repeated. So copies are compared once however many there are.

Runs (and the windows of hot keys) are told apart by 120 bits of hashes, strings compared
exactly. Ids are integers, null ones included. Null and empty texts have nothing to remove.
Repeated rows are copies of each other. Texts of any length are cut into overlapping
segments for hashing only. Only the two named columns are read, so that no other can clash.
An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leftdeep.llm import exchange
from leftdeep.llm.hashing import mix, prefix_sums, ranges
from leftdeep.shared import stored

U = np.uint64
LENGTH, GRAM = 200, 32
#: Window starts that are hashed at once, and bytes that are sorted at once.
SEGMENT, SORTED = 1 << 19, 1 << 20
PLACE = 20  # bits of a position in a segment
#: Different runs of a key beyond which its windows are asked for singly.
HOT = 1 << 12
#: Windows of hot keys that a chunk asks for at once, strings that it hands on at once, and
#: how many times finer the strings and windows are dealt out than the runs.
SLICE, HANDED, FINER = 1 << 20, 1 << 13, 8
ALONE, WHOLE, COMPARED, SHOWN, SPLIT, SPLIT_SHOWN = range(6)
#: Answers about strings; about the windows of slice i: level WINDOWS + i.
STRINGS_LEVEL, WINDOWS = 2, 8
#: A string with its key, and its number among the chunk's runs (-1 if no answer is wanted),
#: or (level >= WINDOWS) packed hashes of windows.
STRINGS = "level int, part int, key long, chunk string, number int, bytes binary"
RESULT = "doc_id long, n_bytes long, spans array<long>, kept binary"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from minima within blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends): some texts joined, and where each lies; pieces of long texts
    overlap by LENGTH - 1 bytes. Starts are relative to all texts' bytes."""
    base, part, at, held = 0, [], [], 0
    for t in texts:
        for i in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            piece = t[i : i + SEGMENT + LENGTH - 1]
            if held and held + len(piece) > SEGMENT + LENGTH:
                yield np.frombuffer(b"".join(part), np.uint8), np.array(at), np.array([len(p) for p in part])
                part, at, held = [], [], 0
            part.append(piece)
            at.append(base + i)
            held += len(piece)
        base += len(t)
    if part:
        yield np.frombuffer(b"".join(part), np.uint8), np.array(at), np.array([len(p) for p in part])


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All runs of windows with one minimizer: first and last window (relative to all
    texts' bytes), minimizer's key and the run's own hash."""
    out: list[tuple] = []
    for data, base, size in segments(texts):
        if len(data) < LENGTH:
            continue
        sums, inverse = prefix_sums(data)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])
        places = np.arange(len(grams), dtype=U)
        least = sliding_min((grams >> U(PLACE) << U(PLACE)) | places, LENGTH - GRAM + 1)
        place = (least & U((1 << PLACE) - 1)).astype(np.int64)
        piece = np.repeat(np.arange(len(size)), size)[: len(place)]
        ends = np.cumsum(size)
        fits = np.arange(len(place)) + LENGTH <= ends[piece]
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1]))) & fits
        first = np.flatnonzero(new)
        if not len(first):
            continue
        last = np.concatenate((first[1:], [len(place)])) - 1
        last = np.minimum(last, ends[piece[first]] - LENGTH)
        lead = place[first] - first
        own = mix((sums[last + LENGTH] - sums[first]) * inverse[first] + lead.astype(U) * U(0x632BE59BD9B4E019) + (last - first).astype(U) * U(0x85157AF5))
        shift = base[piece[first]] - (ends - size)[piece[first]]
        key = mix(grams[place[first]]) >> U(64 - exchange.KEY_BITS)  # minima are small: spread them again
        out.append((first + shift, last + shift, key, own))
    if not out:
        return {"first": np.empty(0, np.int64), "last": np.empty(0, np.int64), "key": np.empty(0, U), "own": np.empty(0, U)}
    return dict(zip(("first", "last", "key", "own"), map(np.concatenate, zip(*out, strict=True)), strict=True))


def entries(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's runs: their order by (key, own), where each distinct one begins in it,
    and for each run in that order the number of its distinct one."""
    order = np.lexsort((found["own"], found["key"]))
    key, own = found["key"][order], found["own"][order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(order) else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _ask(parts: int):
    def of_chunk(name: str, ids: list, texts: list[bytes]) -> Iterator[pd.DataFrame]:
        found = runs(texts)
        order, begins, _ = entries(found)
        count = np.diff(np.append(begins, len(order))).astype(U)
        yield exchange.asked(1, name, found["key"][order[begins]], parts, found["own"][order[begins]], count)

    return of_chunk


def _answer(group: tuple, rows: pd.DataFrame, hot: int) -> pd.DataFrame:
    """For each chunk's runs: ALONE, WHOLE, COMPARED or SHOWN (repeated, and compared with),
    or of a hot key SPLIT or SPLIT_SHOWN."""
    rows = rows.sort_values("chunk")
    given = [exchange.unpacked(b, 2) for b in rows["blob"]]
    key, own, count = (np.concatenate([g[i] for g in given]) for i in range(3))
    chunk = np.repeat(pd.factorize(rows["chunk"])[0], [len(g[0]) for g in given])
    order = np.lexsort((chunk, own, key))
    key, own, count, chunk = key[order], own[order], count[order].astype(np.int64), chunk[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new_own = new_key | np.concatenate(([True], own[1:] != own[:-1]))
    of_key, of_own = np.cumsum(new_key) - 1, np.cumsum(new_own) - 1
    kinds = np.bincount(of_key[new_own])[of_key]
    copies = np.bincount(of_own, count)[of_own]
    shows = chunk == chunk[np.flatnonzero(new_own)][of_own]
    state = np.where(kinds == 1, np.where(copies > 1, WHOLE, ALONE), np.where(copies == 1, COMPARED, np.where(shows, SHOWN, WHOLE)))
    state = state + np.where((kinds > hot) & np.isin(state, (COMPARED, SHOWN)), SPLIT - COMPARED, 0)
    back = np.empty(len(order), U)
    back[order] = state
    cut = np.cumsum([0, *(len(g[0]) for g in given)])
    return pd.DataFrame({"level": 1, "part": group[1], "chunk": rows["chunk"].tolist(), "blob": [exchange.answered(back[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]})


def _windows(text: bytes) -> np.ndarray:
    """Hashes of all windows."""
    data = np.frombuffer(text, np.uint8)
    sums, inverse = prefix_sums(data)
    return mix((sums[LENGTH:] - sums[:-LENGTH]) * inverse[: len(data) - LENGTH + 1])


def _slices(data: bytes, found: dict[str, np.ndarray], run: np.ndarray, shown: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the windows of these runs, about SLICE at once: (key, second hash) of the distinct
    ones in order, how often each occurs (a run that is ``shown`` counts twice), where they
    begin, and the number of each window among the distinct ones."""
    size = found["last"][run] - found["first"][run] + 1
    group = np.cumsum(size) // SLICE
    for members in np.split(np.arange(len(run)), np.flatnonzero(np.diff(group)) + 1) if len(run) else ():
        own, n = run[members], size[members]
        value = np.concatenate([_windows(data[a : b + LENGTH]) for a, b in zip(found["first"][own].tolist(), found["last"][own].tolist(), strict=True)])
        key = mix(value + np.repeat(found["key"][own], n)) >> U(64 - exchange.KEY_BITS)
        start, times = ranges(found["first"][own], n), np.repeat(1 + shown[members], n)
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])))
        number = np.cumsum(new) - 1
        yield key[new], value[new], np.bincount(number, times[order]).astype(U), start[order], number


def _strings(parts: int):
    """Hands on the strings that have to be compared, and asks for the windows of hot keys."""
    finer = parts * FINER

    def of_chunk(name: str, ids: list, texts: list[bytes], answers: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found = runs(texts)
        order, begins, _ = entries(found)
        state = _states(answers, begins)
        data = b"".join(texts)
        compared = np.flatnonzero(np.isin(state, (COMPARED, SHOWN)))
        for i in range(0, len(compared), HANDED):
            at = compared[i : i + HANDED]
            run = order[begins[at]]
            key = found["key"][run]
            yield pd.DataFrame(
                {
                    "level": np.int32(STRINGS_LEVEL),
                    "part": (np.searchsorted(exchange.bounds(finer), key, side="right") - 1).astype(np.int32),
                    "key": key.view(np.int64),
                    "chunk": name,
                    "number": np.where(state[at] == COMPARED, at, -1).astype(np.int32),
                    "bytes": pd.Series([data[a : b + LENGTH] for a, b in zip(found["first"][run].tolist(), found["last"][run].tolist(), strict=True)], dtype=object),
                }
            )
        run, shown = _split_runs(state, order, begins)
        for i, (key, value, times, _, _) in enumerate(_slices(data, found, run, shown)):
            asked = exchange.asked(WINDOWS + i, name, key, finer, value, times)
            yield asked.assign(key=np.int64(0), number=np.int32(-1)).rename(columns={"blob": "bytes"})[["level", "part", "key", "chunk", "number", "bytes"]]

    return of_chunk


def _split_runs(state: np.ndarray, order: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One run for each distinct one of a hot key, and whether it is known to be repeated."""
    at = np.flatnonzero(np.isin(state, (SPLIT, SPLIT_SHOWN)))
    return order[begins[at]], state[at] == SPLIT_SHOWN


def _states(answers: pd.DataFrame, begins: np.ndarray) -> np.ndarray:
    state = exchange.in_order(answers, 1)
    if len(state) != len(begins):
        raise RuntimeError("the answers don't fit the chunk")
    return state


def _ranked(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int32)


def prefix_ranks(data: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all positions by their first 8, 16, ... bytes, up to at least ``depth``."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(len(data), U)
    for i in range(8):
        word = (word << U(8)) | padded[i : i + len(data)]
    out, h = [_ranked(word)], 8
    while h < depth:
        both = out[-1].astype(np.int64) << 32
        both[: max(0, len(data) - h)] += out[-1][h:] + 1
        out.append(_ranked(both))
        h *= 2
    return out


def common_prefixes(ranks: list[np.ndarray], data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, up to about ``most``."""
    n, out = len(data), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        inside = np.maximum(x, y) + (8 << level) <= n
        out[inside] += (ranks[level][x[inside]] == ranks[level][y[inside]]) * (8 << level)
    for _ in range(7):
        x, y = a + out, b + out
        inside = np.maximum(x, y) < n
        more = np.zeros(len(a), bool)
        more[inside] = data[x[inside]] == data[y[inside]]
        out += more & (out < most)
    return out


def longest_previous(position: np.ndarray, common: np.ndarray, floor: int = 1) -> np.ndarray:
    """Longest previous factors of suffixes given in suffix order: ``position`` in the text,
    and ``common`` prefix with the suffix before. Each looks for its previous and its next
    smaller position by following those its neighbours have found so far, as long as the
    common prefix reaches ``floor``; factors below that are only known to be below."""
    n = len(position)
    best = np.zeros(n, np.int64)
    for turned in (False, True):
        p = position[::-1] if turned else position
        c = np.concatenate((common[1:], [0]))[::-1] if turned else common
        to, least = np.arange(-1, n - 1), c.copy()
        if n:
            least[0] = 0
        while len(open_ := np.flatnonzero((to >= 0) & (p[to] > p) & (least >= floor))):
            by = to[open_]
            least[open_] = np.minimum(least[open_], least[by])
            to[open_] = to[by]
        least[(to < 0) | ((p[to] > p) & (least < floor))] = 0
        best = np.maximum(best, least[::-1] if turned else least)
    return best


def repeated(strings: list[bytes]) -> list[np.ndarray]:
    """For each string: which of its windows of LENGTH bytes occur twice among all strings."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    begin = np.cumsum(size) - size
    ranks = prefix_ranks(data, LENGTH)
    windows = size - LENGTH + 1
    start = ranges(begin, windows)
    order = np.argsort(ranks[-1][start], kind="stable")
    position = start[order]
    common = np.zeros(len(position), np.int64)
    common[1:] = common_prefixes(ranks, data, position[1:], position[:-1], LENGTH)
    twice = (longest_previous(position, common, LENGTH) >= LENGTH) | (longest_previous(-position, common, LENGTH) >= LENGTH)
    out = np.empty(len(start), bool)
    out[order] = twice
    return np.split(out, np.cumsum(windows)[:-1])


def _compare(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Which windows of a part's strings are repeated; or how often its windows occur."""
    if group[0] >= WINDOWS:
        return _count_windows(group, rows)
    rows = rows.sort_values(["key", "chunk", "number"], kind="stable").reset_index(drop=True)
    key, size = rows["key"].to_numpy(), rows["bytes"].map(len).to_numpy(np.int64)
    out, at = [], 0
    while at < len(rows):  # whole keys, about SORTED bytes of them
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), SORTED)))
        while end < len(rows) and key[end] == key[end - 1]:
            end += 1
        out += [np.packbits(x).tobytes() for x in repeated(rows["bytes"][at:end].tolist())]
        at = end
    rows["hit"] = pd.Series(out, dtype=object)
    rows = rows[rows["number"] >= 0]
    made = [(c, pickle.dumps((g["number"].to_numpy(), g["hit"].tolist()))) for c, g in rows.groupby("chunk")]
    return pd.DataFrame({"level": group[0], "part": group[1], "chunk": pd.Series([c for c, _ in made], dtype=object), "blob": pd.Series([b for _, b in made], dtype=object)})


def _count_windows(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's windows 1 if they occur elsewhere, else 0."""
    given = [exchange.unpacked(b, 2) for b in rows["bytes"]]
    cut = np.cumsum([0, *(len(g[0]) for g in given)])
    key, value, times = (np.concatenate([g[i] for g in given]) for i in range(3))
    del given
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    of = np.cumsum(np.concatenate(([0], ((key[1:] != key[:-1]) | (value[1:] != value[:-1])).astype(np.int64))))
    twice = np.empty(len(order), U)
    twice[order] = (np.bincount(of, times[order]) > 1)[of]
    blobs = [exchange.answered(twice[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame({"level": rows["level"].to_numpy(), "part": group[1], "chunk": rows["chunk"].tolist(), "blob": blobs})


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [first, end), as disjoint ones in order that don't touch."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1]))) if len(first) else np.empty(0, np.int64)
    return first[new], np.append(reach[new[1:] - 1], reach[-1:])


def _remove(name: str, ids: list, texts: list[bytes], answers: pd.DataFrame) -> Iterator[pd.DataFrame]:
    found = runs(texts)
    order, begins, number = entries(found)
    state = _states(answers, begins)
    spans: list[tuple[np.ndarray, np.ndarray]] = []

    whole = order[np.isin(state, (WHOLE, SHOWN, SPLIT_SHOWN))[number]] if len(order) else order
    spans.append((found["first"][whole], found["last"][whole] + LENGTH))
    for blob in answers.loc[answers["level"] == STRINGS_LEVEL, "blob"].drop_duplicates():
        numbers, hits = pickle.loads(blob)
        for i, bits in zip(numbers.tolist(), hits, strict=True):
            run = order[begins[i]]
            a, n = found["first"][run], found["last"][run] - found["first"][run] + 1
            own = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
            turn = np.flatnonzero(np.diff(np.concatenate(([0], own, [0])).astype(np.int8)))
            spans.append((a + turn[::2], a + turn[1::2] - 1 + LENGTH))
    for i, (_, _, _, start, at) in enumerate(_slices(b"".join(texts), found, *_split_runs(state, order, begins))):
        hit = start[exchange.in_order(answers, WINDOWS + i)[at] > 0]
        spans.append(merged(hit, hit + LENGTH))
    first, end = merged(*map(np.concatenate, zip(*spans, strict=True)))
    bounds = np.cumsum([0, *map(len, texts)])
    # A span never leaves its text, but those of neighbouring texts may touch.
    inner = np.unique(bounds[1:-1])
    owner = np.searchsorted(first, inner, side="right") - 1
    split = inner[(owner >= 0) & (first[owner] < inner) & (end[owner] > inner)] if len(first) else inner[:0]
    first, end = np.sort(np.concatenate((first, split))), np.sort(np.concatenate((end, split)))
    cut = np.searchsorted(first, bounds)
    ids = pd.array(ids, dtype="Int64")
    at = 0
    while at < len(texts):  # some texts at once, so that the result isn't held twice
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SORTED)))
        upto = min(upto, len(texts))
        rows = []
        for i in range(at, upto):
            a, b = first[cut[i] : cut[i + 1]] - bounds[i], end[cut[i] : cut[i + 1]] - bounds[i]
            flat = np.stack((a, b), 1).ravel()
            edges = [0, *flat.tolist(), len(texts[i])]
            rows.append((flat, b"".join(texts[i][x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if len(a) else texts[i]))
        yield pd.DataFrame({"doc_id": ids[at:upto], "n_bytes": np.diff(bounds[at : upto + 1]), "spans": [x for x, _ in rows], "kept": [x for _, x in rows]})
        at = upto


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = exchange.CHUNK_BYTES, part_bytes: int = exchange.PART_BYTES, hot: int = HOT) -> DataFrame:
    """Returns doc_id, n_bytes, spans (removed, flattened pairs of byte offsets) and kept (the
    remaining bytes) for each row of ``docs``."""
    parts = exchange.parts_for(docs, text_col, part_bytes)
    chunked = exchange.held(docs, id_col, text_col, chunk_bytes)

    def answer(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _answer(group, rows, hot)

    asked = exchange.ask(chunked, _ask(parts))
    first = stored(asked.repartition(exchange.tasks(parts), "level", "part").groupBy("level", "part").applyInPandas(answer, exchange.ASKED), "runs")
    strings = exchange.meet(chunked, first, _strings(parts), STRINGS)
    # A part's windows of all slices meet; its strings are a group of their own.
    kind = F.when(F.col("level") < WINDOWS, F.col("level")).otherwise(WINDOWS).alias("kind")
    second = stored(strings.repartition(exchange.tasks(parts * FINER), kind, F.col("part")).groupBy(kind, "part").applyInPandas(_compare, exchange.ASKED), "compared")
    return exchange.meet(chunked, first.union(second), _remove, RESULT)
