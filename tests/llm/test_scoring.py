from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leftdeep.llm import exchange, queries, scoring

from .util import ascii_words, corpus, frame, lower_ascii


def toks(t):
    return [*ascii_words(lower_ascii(t or "")), "</s>"]


def brute(rows, order=scoring.ORDER):
    """Straight from the definition, over tuples of words."""
    seen = Counter()
    for i, t in rows:
        if not scoring.is_held_out(i):
            w = ["<s>", *toks(t)]
            seen[("<s>",)] += 1
            seen.update(tuple(w[max(0, j - n + 1) : j + 1]) for j in range(1, len(w)) for n in range(1, order + 1) if j - n + 1 >= 0)
    n = sum(c for g, c in seen.items() if len(g) == 1 and g != ("<s>",))
    v = sum(len(g) == 1 and g != ("<s>",) for g in seen)

    def p(history, x):
        if not history:
            return (seen[(x,)] - scoring.DISCOUNT if seen[(x,)] else scoring.DISCOUNT * v) / n
        c = seen[history]
        b = max(scoring.LEAST_BACKOFF, scoring.RARE / (c + scoring.RARE)) if c else 1
        return (1 - b) * seen[(*history, x)] / max(c, 1) + b * p(history[1:], x)

    out = []
    for i, t in rows:
        w = ["<s>", *toks(t)]
        base = sum(math.log10((seen[(x,)] + 0.5) / (n + 0.5 * (v + 1))) for x in w[1:])
        score = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w)))
        out.append((i, scoring.is_held_out(i), len(w) - 1, sum(seen[(x,)] > 0 for x in w[1:]), n, base, score))
    return out


def same(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("size, order", [(1 << 24, 3), (300, 3), (1 << 24, 1), (1 << 24, 2), (700, 4)])
def test_against_brute_force(spark, size, order):
    rows = corpus(60)
    same(scoring.score(frame(spark, rows), order=order, chunk_bytes=size, part_bytes=size * 2).collect(), brute(rows, order))


def test_input_whose_order_changes(spark):
    rows = corpus(60)
    df = frame(spark, rows).repartition(3).orderBy(F.rand())
    same(scoring.score(df, chunk_bytes=400, part_bytes=900).collect(), brute(rows))


def test_arrays_sent_follow_the_corpus(spark):
    """Never more arrays than distinct keys of chunks, whatever the number of chunks."""
    texts = [" ".join(f"w{(i * 7 + j) % 500}" for j in range(40)) for i in range(320)]
    sent = {}
    for times in (2, 8, 32):
        df = spark.createDataFrame(list(enumerate(texts[: 10 * times])), "doc_id long, text string").coalesce(1)
        size = sum(map(len, texts[:10]))
        chunked = exchange.held(df, "doc_id", "text", size)
        asked = exchange.ask(chunked, scoring._ask(times, 3)).collect()
        keys = sum(len(exchange.unpacked(bytes(r["blob"]), 1)[0]) for r in asked)
        assert len(asked) <= min(keys, 3 * times * chunked.count())
        sent[times] = keys / times
    assert sent[32] <= 1.1 * sent[2]


def test_awkward_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (7, None)], "doc_id long, text string")
    same(scoring.score(df).collect(), brute([(None, "a b"), (3, "a b"), (3, "a b"), (7, None)]))
    held = [(i, "x y") for i in range(40) if scoring.is_held_out(i)]
    assert {(r["score"], r["base_score"], r["n_known"]) for r in scoring.score(spark.createDataFrame(held, "doc_id long, text string")).collect()} == {(0.0, 0.0, 0)}
    assert scoring.score(df.limit(0)).count() == 0


def test_probabilities_add_up():
    a = scoring.Automaton(n=10, v=4, starts=3)
    words, bigrams, trigrams = np.array([4.0, 3, 2, 1, 0]), np.array([2.0, 1, 0, 0, 0]), np.array([0.0, 1, 0, 0, 0])
    full = np.full(5, 1.0)
    for order in (1, 2, 3):
        counts, states = [words, bigrams, trigrams][:order], [3 * full, full][: order - 1]
        assert (10 ** a.traverse(counts, states)).sum() == pytest.approx(1), order
    assert (10 ** a.traverse([words, bigrams, 0 * full], [3 * full, 0 * full])).sum() == pytest.approx(1)
    assert a.root(words).sum() == pytest.approx(1)


def test_packing():
    rng = np.random.default_rng(1)
    for a in (np.empty(0), np.zeros(3), rng.integers(0, 2**63, 50), np.array([1, 255, 256])):
        assert (exchange.unpack(exchange.pack(a.astype(np.uint64)))[0] == a.astype(np.uint64)).all()
    keys = np.unique(rng.integers(0, 2**56, 100)).astype(np.uint64)
    cut = exchange.asked(1, "c", keys, 7, keys)
    assert (np.concatenate([exchange.unpacked(b, 1)[0] for b in cut["blob"]]) == keys).all()
    assert all(len(x) == 2 for x in (exchange.unpacked(b, 1) for b in cut["blob"]))


def test_query_scores_held_out_texts_better_than_base(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.backoff_scores(spark, d).collect()
    same(got, brute(rows))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
