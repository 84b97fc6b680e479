from __future__ import annotations

import re

import numpy as np

from leftdeep.llm import decontaminate
from leftdeep.llm.decontaminate import Index, find, fingerprints, merged

from .util import corpus, frame, lower_ascii

ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"),
    (2, "short item of five words"),
    (3, "one"),
    (4, None),
    (5, "... !!"),
    (None, "alpha beta"),
    (6, "a a a a a a a a a a a a"),
    (7, "Über die Größe, 12 Öl-Fässer; naïve état: fin de la très longue phrase"),
    (7, "Über die Größe, 12 Öl-Fässer; naïve état: fin de la très longue phrase"),
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))


def brute(rows, items):
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for j, u in items:
            v = words(u)
            n = min(10, len(v))
            if not n:
                continue
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= set() if j is None else {str(j)}
        out.append((i, len(w), len(hit), sorted(ids)))
    return out


def rows():
    a, g = ITEMS[0][1], ITEMS[7][1]
    return [
        *corpus(),
        (500, f"x {a.upper()} y one, z"),
        (501, " ".join(a.split()[:9])),
        (502, " ".join(a.split()[:10])),
        (503, f"{g}! {g}? " + a[20:]),
        (504, "a " * 30),
        (505, "short item-of five\nwords"),
        (506, "one"),
    ]


def test_against_brute_force_in_one_block_and_in_several(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(rows(), ITEMS)
    for limit in (10_000, 30):
        df = frame(spark, rows())
        got = decontaminate.contamination(df, bench, block_words=limit)
        assert got.columns.count("n_words") == 1
        found = sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect())
        assert found == sorted(want)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, ITEMS[0][1], 7, 8, 9)], "doc_id long, text string, _decontaminated int, _t1 int, _h int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (10_000, 30):
        row = decontaminate.contamination(df, bench, block_words=limit).first()
        assert (row["_decontaminated"], row["_t1"], row["_h"], row["items"], row["n_hit"]) == (7, 8, 9, ["1"], 13)


def test_empty_tables(spark):
    docs, bench = frame(spark, corpus()), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(corpus()) and all(r["n_hit"] == 0 for r in none)
    assert decontaminate.contamination(docs.limit(0), bench, block_words=1).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0), block_words=-1).where("n_hit > 0").count() == 0


def test_every_window_has_its_fingerprint():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, 400).astype(np.uint64)
    for n in (1, 3, 5, 10):
        at, _ = fingerprints(w, n)
        k = min(5, n)
        for i in range(len(w) - n + 1):
            assert ((at >= i) & (at + k <= i + n)).any()


def test_hits_stay_inside_texts():
    index = Index([("1", ITEMS[0][1])])
    a = ITEMS[0][1].split()
    assert [n for _, n, _ in find(index, [" ".join(a[:6]), " ".join(a[6:])])] == [[], []]


def test_merged():
    assert merged([(5, 9), (0, 3), (2, 4), (9, 10)]) == [0, 4, 5, 10]
