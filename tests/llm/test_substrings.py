from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leftdeep.llm import queries, substrings

from .util import corpus, frame

L = substrings.LENGTH


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + L] for _, t in texts for k in range(len(t) - L + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - L + 1):
            if seen[t[k : k + L]] > 1:
                gone[k : k + L] = True
        turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        out.append((i, len(t), turn.tolist(), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def cases():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b = text(150), text(90)
    rows = [t for _, t in corpus(20)]
    rows += [a, a[:300] + "!" + a[300:], text(30) + a[100:500] + text(20), a[:199], a[:200], b + b, text(40) + b[5:210] + text(9) + b[50:400]]
    rows += [a[i : i + 260] + text(5) for i in range(0, 500, 37)]
    rows += ["ab" * 300, "ab" * 101, "z" * 450, "z" * 200, "y" * 200, "y" * 201, ("q" * 57 + "r") * 12]
    return list(enumerate(rows))


def same(got, want):
    got = {r["doc_id"]: (r["n_bytes"], list(r["spans"]), bytes(r["kept"])) for r in got}
    for i, *w in want:
        assert got[i] == tuple(w), i


@pytest.mark.parametrize("size, hot", [(1 << 24, substrings.HOT), (700, substrings.HOT), (1500, 1), (1500, 2)])
def test_against_brute_force(spark, size, hot):
    rows = cases()
    same(substrings.remove_repeats(frame(spark, rows), chunk_bytes=size, part_bytes=size * 3, hot=hot).collect(), brute(rows))


def test_input_whose_order_changes(spark):
    rows = cases()
    df = frame(spark, rows).repartition(3).orderBy(F.rand())
    same(substrings.remove_repeats(df, chunk_bytes=9000, part_bytes=6000, hot=1).collect(), brute(rows))


def test_hot_windows_in_slices(monkeypatch):
    data = b"".join((t or "").encode() for _, t in cases())
    found = substrings.runs([data])
    run = np.arange(0, len(found["first"]), 2)
    shown = run % 4 == 0
    whole = list(substrings._slices(data, found, run, shown))
    monkeypatch.setattr(substrings, "SLICE", 500)
    some = list(substrings._slices(data, found, run, shown))
    assert len(whole) == 1 < len(some)
    count = lambda parts: sum((Counter(dict(zip(zip(k.tolist(), v.tolist(), strict=True), n.tolist(), strict=True))) for k, v, n, _, _ in parts), Counter())
    assert count(whole) == count(some)
    for k, _, _, start, at in some:
        assert all(data[a : a + L] == data[b : b + L] for a, b, i, j in zip(start, start[1:], at, at[1:], strict=False) if i == j) and at[-1] == len(k) - 1


def test_merged():
    first, end = substrings.merged(np.array([5, 0, 2, 9, 20]), np.array([9, 3, 4, 10, 21]))
    assert (first.tolist(), end.tolist()) == ([0, 5, 20], [4, 10, 21])
    assert [x.tolist() for x in substrings.merged(np.empty(0, np.int64), np.empty(0, np.int64))] == [[], []]


def test_long_texts_are_cut_for_hashing_only(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 301)
    texts = [(t or "").encode() for _, t in cases()]
    found = substrings.runs(texts)
    total = sum(max(0, len(t) - L + 1) for t in texts)
    assert (found["last"] - found["first"] + 1).sum() == total


def test_longest_previous_factors():
    rng = random.Random(2)
    for _ in range(20):
        s = bytes(rng.choice(b"ab") for _ in range(60))
        order = sorted(range(60), key=lambda i: s[i:])

        def common(i, j, s=s):
            k = 0
            while max(i, j) + k < 60 and s[i + k] == s[j + k]:
                k += 1
            return k

        got = substrings.longest_previous(np.array(order), np.array([0, *(common(x, y) for x, y in zip(order, order[1:], strict=False))]))
        assert [int(got[order.index(i)]) for i in range(60)] == [max([0, *(common(i, j) for j in range(i))]) for i in range(60)]


def test_awkward_tables(spark):
    df = spark.createDataFrame([(1, "k" * 250), (1, "k" * 250), (None, None), (2, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_bytes"], list(r["spans"]), bytes(r["kept"])) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 0, [], b""), (1, 250, [0, 250], b""), (1, 250, [0, 250], b""), (2, 0, [], b"")]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {tuple(r) for r in queries.repeated_substrings(spark, d).collect()}
    assert got == {(i, n, n - len(k), len(s) // 2, hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)}
