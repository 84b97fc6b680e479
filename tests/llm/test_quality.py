from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from leftdeep.llm import quality, queries

from .util import ascii_words, corpus, frame


def base(text):
    w = ascii_words(text)
    text = text or ""
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    hit = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if ascii_words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def failed(b):
    return b[0] < 20 or 100 * b[4] > 30 * b[0]


def bins(text):
    listed = sorted({w for v in quality.COMMON_WORDS.values() for w in v.split()})
    w = ascii_words(text)
    c = Counter(x.lower() for x in w)
    words = [c[x] for x in listed]
    words.append(len(w) - sum(words))
    text = text or ""
    chars = [sum(ch in set_ for ch in text) for set_ in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#*$%&|<>", " \t\n\x0b\x0c\r")]
    chars.append(sum(ord(ch) > 127 for ch in text))
    chars.append(len(text) - sum(chars))
    share = lambda a, n: [math.floor(x * 1_000_000 / max(n, 1)) for x in a]
    return share(chars, len(text)), share(words, len(w))


def distance(p, q):
    p, q = ([x / max(sum(a), 1) for x in a] for a in (p, q))
    kl = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))


def brute(rows, limits):
    refs, n = {}, Counter()
    for _, t, lang in rows:
        k = len(ascii_words(t))
        if k >= limits.min_words:
            key = lang if lang in quality.LANGUAGES else "other"
            n[key] += k
            old = refs.setdefault(key, [[0] * 8, [0] * 200])
            for a, b in zip(old, bins(t), strict=True):
                for i, x in enumerate(b):
                    a[i] += x
    out = {}
    for i, t, lang in rows:
        key = lang if lang in quality.LANGUAGES else "other"
        b, (c, w) = base(t), bins(t)
        far = b[0] >= limits.min_words and n[key] >= limits.min_reference_words
        if far:
            far = distance(c, refs[key][0]) > limits.max_class_distance
            far |= b[0] >= limits.min_words_common and distance(w, refs[key][1][: len(w)]) > limits.max_word_distance
        out[i] = (*b, failed(b), not failed(b) and not far)
    return out


def test_against_brute_force(spark):
    rows = corpus(60)
    rows += [(1000 + i, "#|<>" * k + " ".join(f"*#{i}{j}$$|" for j in range(60 + i))) for i, k in enumerate((1, 9))]
    limits = quality.Limits(min_words=25, min_words_common=40, min_reference_words=100, max_class_distance=0.3)
    df = frame(spark, rows)
    got = quality.judge(df, limits)
    assert sorted(got.columns) == sorted({*df.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"})
    langs = {r["doc_id"]: r["lang"] for r in df.collect()}
    want = brute([(i, t, langs[i]) for i, t in rows], limits)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in got.collect()}
    assert found == want
    assert any(not v[-1] and not v[-2] for v in want.values()) and any(v[-1] for v in want.values())


def test_empty_table(spark):
    assert quality.judge(frame(spark, []).limit(0)).count() == 0


def test_query_against_sql_and_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(docs, quality.Limits())
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.quality_js_divergence(spark, d).collect()} == want


def test_no_python_in_the_plan(spark):
    plan = queries.quality_js_divergence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_helper_names_are_free(spark):
    df = frame(spark, corpus()).selectExpr("*", "1 AS _q_lang", "2 AS `__q_text`", "3 AS _Q_words")
    got = quality.judge(df).collect()
    assert len(got) == len(corpus()) and {(r["_q_lang"], r["__q_text"], r["_Q_words"]) for r in got} == {(1, 2, 3)}
    assert {r["doc_id"]: r["kept"] for r in got} == {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, corpus())).collect()}
