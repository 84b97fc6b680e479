from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from leftdeep.llm import bpe, queries

from .util import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_tiktoken(spark, theirs):
    rows = [*corpus(), (900, " " * 700), (901, "ab" * 900 + "\n" * 300), (902, "<|endoftext|> it's we'll")]
    df = bpe.encode(frame(spark, rows), bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    assert df.columns.count("ids") == 1
    got = {r["doc_id"]: r for r in bpe.decode(df, bpe.read_ranks(PATH)).select("doc_id", "ids", "decoded").collect()}
    for i, t in rows:
        assert got[i]["ids"] == theirs.encode_ordinary(t or ""), i
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def test_rows_and_heap_agree(vocabulary):
    rng = random.Random(3)
    pieces = [bytes(rng.choices(b"abethingor \xc3\xa9", k=rng.randint(1, bpe.LONGEST_ROW))) for _ in range(300)]
    assert vocabulary.encode(pieces) == [vocabulary.encode_long(p) for p in pieces]


def test_forgetting_pieces_changes_nothing(vocabulary, monkeypatch, theirs):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "CHARACTERS", 50)
    texts = [t or "" for _, t in corpus()]
    got = [x.tolist() for x in bpe.encode_texts(vocabulary, regex.compile(public_tokenizers.PATTERN), texts, {})]
    assert got == [theirs.encode_ordinary(t) for t in texts]


def test_empty_table_unknown_id_and_large_file(spark, tmp_path):
    ranks = bpe.read_ranks(PATH)
    empty = spark.createDataFrame([], "text string")
    assert bpe.decode(bpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks).count() == 0
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode(spark.range(1).select(F.array(F.lit(77777777)).alias("ids")), ranks).collect()
    assert bpe.decode(spark.range(1).select(F.lit(None).cast("array<int>").alias("ids")), ranks).first()["decoded"] == b""
    (tmp_path / "big").write_bytes(b"x" * (bpe.LARGEST_FILE + 1))
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "big"))


def test_query(spark, theirs):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.byte_bpe(spark, d).collect():
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
