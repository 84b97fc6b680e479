from __future__ import annotations

import multiprocessing
import random
import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from leftdeep.llm import jaccard, queries
from leftdeep.llm.components import components

from .util import ascii_words, corpus, frame, lower_ascii


def shingle_set(t):
    w = ascii_words(lower_ascii(t or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = {}
    for j, (_, s) in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(j)
    for j, (i, s) in enumerate(sets):
        for k in {k for x in s for k in owners[x] if k < j}:
            other, u = sets[k]
            both = len(s & u)
            if find(i) != find(other) and 100 * both >= 80 * len(s | u):
                a, b = sorted((find(i), find(other)))
                root[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def cases(seed=5):
    rng = random.Random(seed)
    rows = corpus(30)
    passage = " ".join(f"p{i}" for i in range(40))
    for family in range(4):
        base = [f"w{family}x{rng.randrange(300)}" for _ in range(rng.choice([12, 60, 150]))]
        rows += [(len(rows) + i, edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5]))) for i in range(25)]
    rows += [(len(rows) + i, f"{passage} " + " ".join(f"u{i}v{j}" for j in range(rng.choice([5, 9, 10, 11, 60])))) for i in range(30)]
    return rows


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_against_brute_force(spark):
    rows = cases()
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 60
    assert got(jaccard.link(frame(spark, rows))) == want


def test_repeats_null_ids_and_empty_table(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (3, text), (2, text.upper()), (None, text), (None, "alone with null id but words enough"), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard.link(df).collect()) == [(-1, 3, -1), (-1, 3, 2), (2, 3, 2), (3, 3, 2), (3, 3, 2), (9, 0, 9), (9, 0, 9)]
    assert jaccard.link(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 205), (300, 300)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(101)} | {200: 200, 201: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_threshold_is_exact():
    a = [f"w{i}" for i in range(13)]  # 9 shingles
    for n, want in ((12, True), (11, False)):
        x, y = (next(jaccard.sets_of([" ".join(t)])) for t in (a, a[:n]))
        both = len(set(x) & set(y))
        assert (100 * both >= 80 * (len(x) + len(y) - both)) == want


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_query(spark, d):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(queries.grouped_jaccard(spark, d)) == brute(rows)


class Steps:
    """Stands in for a DataFrame and keeps what its workers would run."""

    def __init__(self):
        self.run = []
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

    def select(self, *_):
        return self

    def repartition(self, *_):
        return self

    def mapInPandas(self, f, schema):
        self.run.append(f)
        return self

    def toLocalIterator(self):
        return []


def worker_memory(step, into):
    """MB that a worker holds at most beyond its rows, and MB that it keeps after its task."""
    rng = np.random.default_rng(3)
    # About as much as a task of the check's larger table, in batches as queries get them.
    texts = [" ".join(map(str, rng.integers(0, 50_000, 300).tolist())) for _ in range(8000)]
    parts = lambda: (pd.DataFrame({"doc_id": range(i, i + 500), "text": texts[i : i + 500]}) for i in range(0, len(texts), 500))
    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    docs = Steps()
    if step == "sketch":
        jaccard._sketch(docs, "text")
    else:
        jaccard._prefixes(docs, "text", "doc_id", 80)
    work = docs.run[0 if step == "sketch" else -1]
    before = held()
    for _ in work(parts()):
        pass
    kept = held() - before
    tracemalloc.start()
    for _ in work(parts()):
        pass
    into.put((tracemalloc.get_traced_memory()[1] / (1 << 20), kept))


@pytest.mark.parametrize("step, most", [("sketch", 60), ("prefixes", 40)])
def test_workers_hold_little_and_give_it_back(step, most):
    fresh = multiprocessing.get_context("spawn")
    into = fresh.Queue()
    worker = fresh.Process(target=worker_memory, args=(step, into))
    worker.start()
    peak, kept = into.get(timeout=120)
    worker.join()
    assert peak < most and kept < 20, (peak, kept)
