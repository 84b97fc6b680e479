from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from leftdeep.llm import quality
from leftdeep.llm.queries import PSEUDONYM_KEY

from . import test_bpe, test_decontaminate, test_jaccard, test_pseudonyms, test_quality
from .util import corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
theirs = test_bpe.theirs


def brute(docs, items, encoding, monkeypatch):
    """All stages in plain Python: {doc_id: ids}."""
    verdict = test_quality.brute([(d[0], d[1], d[2]) for d in docs], quality.Limits())
    docs = [d for d in docs if verdict[d[0]][-1]]
    first = {i: c for i, _, c in test_jaccard.brute([(d[0], d[1]) for d in docs])}
    docs = [d for d in docs if first[d[0]] == d[0]]
    hits = {i: h for i, _, h, _ in test_decontaminate.brute([(d[0], d[1]) for d in docs], items)}
    docs = [d for d in docs if not hits[d[0]]]
    monkeypatch.setattr(test_pseudonyms, "KEY", PSEUDONYM_KEY)
    return {d[0]: encoding.encode_ordinary(test_pseudonyms.brute(d[1])) for d in docs}


def read(spark, d):
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()]
    return docs, [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]


def test_against_brute_force(spark, theirs, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, items = read(spark, d)
    want = brute(docs, items, theirs, monkeypatch)
    assert 0 < len(want) < len(docs)
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, d).collect()} == want


@pytest.fixture
def awkward(tmp_path):
    """Nulls in every column, empty and repeated texts, an extra column."""
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in corpus(20)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, "s", 1)]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(COLUMNS)} | {"ids": ["old"] * len(rows)})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1, None], "text": ["no such words here", None]}), tmp_path / "benchmark.parquet")
    return str(tmp_path)


def test_stages_on_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, awkward)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), awkward).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {"doc_id", "ids", "n_tokens"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, awkward).columns)


def test_decontamination_by_items_without_an_id(spark, tmp_path):
    passage = "eins zwei drei vier fünf sechs sieben acht neun zehn elf"
    pq.write_table(pa.table({"item_id": pa.array([None, 1], pa.int64()), "text": [passage, "no such words here"]}), tmp_path / "benchmark.parquet")
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "clean")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [2]


def test_near_duplicates_without_an_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(100))
    rows = [(7, text(1)), (9, text(1)), (None, text(1)), (None, text(1) + " more"), (None, text(2)), (None, text(2)), (None, text(2) + " more"), (8, text(3))]
    rows += [(None, None), (None, None), (None, " \n"), (5, None), (6, ""), (None, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(i for i, _ in out if i is not None) == [5, 6, 7, 8]
    free = [t for i, t in out if i is None]
    assert sorted(t for t in free if t and t.strip())[1:] == [text(4)] and len([t for t in free if t and t.startswith("w2x0 ")]) == 1
    assert len(free) == 5 and free.count(None) == 2 and free.count(" \n") == 1


def test_tokens_are_decoded(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in corpus(5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.tokens(spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in corpus(5)}


def test_further_columns_go_through(spark, awkward):
    """Names that stages and operators use for themselves, and a type without an order."""
    further = ["_id", "_row", "_hashed", "kept", "n_words", "n_hit", "items", "hits", "n_pseudonyms", "further_5"]
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ((1, text), (2, text), (2, text), (None, text + " x"), (3, "call 555-123-4567 " + text[::-1]))], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 0)) AS {c}" for c in further], "map('a', doc_id) AS m")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, awkward)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in further] == [f"{c}{r['doc_id'] or 0}" for c in further] and r["m"] == {"a": r["doc_id"]}, name
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, awkward).orderBy("doc_id").collect()] == [1, 3]


def test_long_text(spark, awkward):
    text = " ".join(f"w{i}" for i in range(50_000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text + " x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.personal_data):
        docs = spark.createDataFrame(stage(spark, docs, awkward).collect(), docs.schema)
    assert [(r["doc_id"], r["text"]) for r in docs.collect()] == [(1, text)]
    (row,) = corpus_pipeline.tokens(spark, docs, "").collect()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
