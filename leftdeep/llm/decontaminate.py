"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item (all of them, if it has
fewer). Of the k-grams inside each window the one of least hash is its fingerprint, the
rightmost on ties. A document keeps the fingerprints of all its own windows; one that
is also in the benchmark is extended: the windows of the document that hold it are
looked up whole. Every shared window has a shared fingerprint, so none is missed.

A benchmark of at most ``block_words`` words goes to the workers whole, and the documents
are read once and not shuffled. Of a larger one the workers get a filter of its
fingerprints, of bounded size; the windows of documents whose fingerprint passes it are
joined with the benchmark's windows by hash, and what is found goes back to the texts by
two hashes of theirs, so that of the texts only those with hits are moved. The documents
are never rewritten, and the result is the same.

Null texts and texts without words have no windows; a text of any length is taken whole.
Windows of items without an id are hits like others; only the list of items lacks them.
Items that share an id count once. Document rows are independent of each other, so repeats
have no effect, and an empty table on either side gives no hits. Existing columns with an
output's name are replaced; all others, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leftdeep.llm.filters import hit, marks, may_hold
from leftdeep.llm.hashing import ALNUM, batches, ranges, shingles, word_hashes
from leftdeep.llm.session import unused
from leftdeep.shared import stored

SPAN, K = 10, 5
BLOCK_WORDS = 2_000_000
RESULT = "n_words long, hits array<int>, items array<string>"


def fingerprints(words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of the fingerprints of all windows in these words."""
    k = min(K, span)
    grams, width = shingles(words, k), span - k + 1
    if len(grams) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    seen = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.arange(len(seen)) + width - 1 - seen[:, ::-1].argmin(1)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, grams[at]


def windows_with(words: np.ndarray, text_of: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of all windows of n words of one text that hold the k-gram at one of
    these places."""
    low = np.maximum(at - (n - min(K, n)), 0)
    first = np.unique(ranges(low, np.minimum(at, len(words) - n) - low + 1))
    first = first[text_of[first] == text_of[first + n - 1]]
    runs = words[first[:, None] + np.arange(n)]
    return first, shingles(runs.ravel(), n)[::n] if len(first) else np.empty(0, np.uint64)


class Index:
    """The benchmark: fingerprints and windows by their length."""

    def __init__(self, items: list[tuple[str | None, str | None]], span: int = SPAN):
        self.items = [i for i, _ in items]
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for first, texts in batches([t for _, t in items]):
            words, begins = word_hashes(texts, ALNUM)
            for i in range(len(texts)):
                own = words[begins[i] : begins[i + 1]]
                if len(own):
                    n = min(span, len(own))
                    parts.setdefault(n, []).append((shingles(own, n), fingerprints(own, n)[1], first + i))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, found in parts.items():
            windows = np.concatenate([w for w, _, _ in found])
            owner = np.repeat([i for _, _, i in found], [len(w) for w, _, _ in found])
            order = np.argsort(windows, kind="stable")
            self.by_length[n] = np.unique(np.concatenate([f for _, f, _ in found])), windows[order], owner[order]

    def hits(self, words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window's first word, its length, item) of all windows found."""
        out = []
        text_of = np.searchsorted(begins, np.arange(len(words)), side="right")
        for n, (prints, windows, owner) in self.by_length.items():
            at, value = fingerprints(words, n)
            slot = np.searchsorted(prints, value)
            slot[slot == len(prints)] = 0
            first, value = windows_with(words, text_of, at[prints[slot] == value], n)
            left, right = np.searchsorted(windows, value), np.searchsorted(windows, value, side="right")
            out.append((np.repeat(first, right - left), np.repeat(n, (right - left).sum()), owner[ranges(left, right - left)]))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint spans, flattened."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find(index: Index, texts: list[str | None]) -> Iterator[tuple[int, list[int], list[str]]]:
    """Words, hit spans and items of each text."""
    for _, part in batches(texts):
        words, begins = word_hashes(part, ALNUM)
        at, n, item = index.hits(words, begins)
        text = np.searchsorted(begins, at, side="right") - 1
        order = np.argsort(text, kind="stable")
        cut = np.searchsorted(text[order], np.arange(len(part) + 1))
        for i in range(len(part)):
            own = order[cut[i] : cut[i + 1]]
            spans = set(zip((at[own] - begins[i]).tolist(), (at[own] + n[own] - begins[i]).tolist(), strict=True))
            items = {index.items[j] for j in np.unique(item[own])} - {None}
            yield int(begins[i + 1] - begins[i]), merged(list(spans)), sorted(items)


def _look_up(index):
    @F.pandas_udf(RESULT)
    def look(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = list(find(index.value, texts.tolist()))
            yield pd.DataFrame({k: pd.Series([f[j] for f in found], dtype=object if j else "int64") for j, k in enumerate(("n_words", "hits", "items"))})

    return look


def _benchmark_windows(items: DataFrame, span: int) -> DataFrame:
    """(item, n, value, print) of all windows (print null) and fingerprints (value null)."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first, texts in batches(part["t"].tolist()):
                words, begins = word_hashes(texts, ALNUM)
                for i in range(len(texts)):
                    own = words[begins[i] : begins[i + 1]]
                    if len(own):
                        n = min(span, len(own))
                        value, prints = np.unique(shingles(own, n)).view(np.int64), np.unique(fingerprints(own, n)[1]).view(np.int64)
                        frame = pd.DataFrame({"item": part["i"].iat[first + i], "n": np.int32(n), "value": pd.array(value, dtype="Int64")})
                        yield frame.assign(print=pd.array([None] * len(frame), dtype="Int64"))
                        yield pd.DataFrame({"item": None, "n": np.int32(n), "value": pd.array([None] * len(prints), dtype="Int64"), "print": pd.array(prints, dtype="Int64")})

    return items.mapInPandas(cut, "item string, n int, value long, print long")


def _by_join(texts: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """(t1, t2, hits, items) of the texts (t1, t2, t) that have hits."""
    bench = stored(_benchmark_windows(items, span), "benchmark-windows")
    sent = texts.sparkSession.sparkContext.broadcast((marks(bench.where("print IS NOT NULL").select("print")), sorted(r["n"] for r in bench.select("n").distinct().collect())))  # span lengths at most

    def candidates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, lengths = sent.value
        for part in parts:
            t1, t2 = part["t1"].to_numpy(), part["t2"].to_numpy()
            for base, some in batches(part["t"].tolist()):
                words, begins = word_hashes(some, ALNUM)
                text_of = np.searchsorted(begins, np.arange(len(words)), side="right") - 1
                for n in lengths:
                    at, value = fingerprints(words, n)
                    first, value = windows_with(words, text_of, at[hit(found, value)], n)
                    text = text_of[first]
                    yield pd.DataFrame({"t1": t1[base + text], "t2": t2[base + text], "n": np.int32(n), "first": (first - begins[text]).astype(np.int32), "value": value.view(np.int64)})

    windows = texts.mapInPandas(candidates, "t1 long, t2 long, n int, first int, value long")
    held = windows.join(bench.where("value IS NOT NULL").select("n", "value", "item").distinct(), ["n", "value"])
    spans = held.groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "n")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))

    @F.pandas_udf("array<int>")
    def union(spans: pd.Series) -> pd.Series:
        return pd.Series([merged([(s["first"], s["first"] + s["n"]) for s in x]) for x in spans], dtype=object)

    return stored(spans.select("t1", "t2", union("spans").alias("hits"), "items"), "contaminated")


def _count_words():
    @F.pandas_udf("long")
    def n_words(texts: pd.Series) -> pd.Series:
        return pd.Series([n for _, part in batches(texts.tolist()) for n in np.diff(word_hashes(part, ALNUM)[1]).tolist()])

    return n_words


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with n_words, hits (flattened spans of hit words), n_hit and items (ids as
    text, sorted)."""
    result, text = unused(docs, "decontaminated"), F.col(f"`{text_col}`")
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{item_text_col}`").alias("t"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)).cast("long")), F.count(F.lit(1))).first()
    if (size[0] or 0) // 2 + size[1] <= block_words:  # words at most
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in items.toLocalIterator()], span))
        out = docs.withColumn(result, _look_up(index)(text))
    else:
        one, two = unused(docs, "t1"), unused(docs, "t2")
        rows = docs.withColumns({one: F.xxhash64(text), two: F.xxhash64(F.lit("second"), text)})
        named = {"t1": one, "t2": two, "hits": unused(docs, "h"), "items": unused(docs, "i")}
        found = _by_join(rows.select(F.col(one).alias("t1"), F.col(two).alias("t2"), text.alias("t")), items, span).withColumnsRenamed(named)
        may = may_hold(docs, found.select(one))
        of = lambda hits, own: F.struct(_count_words()(text).alias("n_words"), hits.alias("hits"), own.alias("items"))
        none = of(F.array().cast("array<int>"), F.array().cast("array<string>"))
        hits, own = (F.coalesce(F.col(named[c]), F.array().cast(kind)) for c, kind in (("hits", "array<int>"), ("items", "array<string>")))
        moved = rows.where(may(F.col(one))).join(found, [one, two], "left").withColumn(result, of(hits, own))
        still = rows.where(~may(F.col(one))).withColumn(result, none)
        columns = [F.col(f"`{c}`") for c in (*docs.columns, result)]
        out = moved.select(*columns).union(still.select(*columns))
    hits = F.col(f"{result}.hits")
    n_hit = F.aggregate(hits, F.lit(0), lambda a, x: x - a)
    new = {"n_words": F.col(f"{result}.n_words"), "hits": hits, "n_hit": n_hit.cast("long"), "items": F.col(f"{result}.items")}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[c.alias(k) for k, c in new.items()])


def sql(span: int = SPAN) -> str:
    """The report over tables ``documents`` and ``benchmark`` as SQL."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
bw AS (SELECT item, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT item, w, least(len(w), {span}) AS n, unnest(range(1, len(w) - least(len(w), {span}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, x)),
h AS (SELECT doc_id, count(DISTINCT i + j) AS hit FROM m, range(0, {span}) q(j) WHERE j < n GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
