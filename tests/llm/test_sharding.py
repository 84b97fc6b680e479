from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from leftdeep.llm import queries, sharding

from .util import corpus, frame


def checked(rows, got, shards):
    texts = dict(rows)
    load, slots, home = [0] * shards, defaultdict(list), {}
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        assert home.setdefault(t, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return load


def test_groups_slots_and_balance(spark):
    rows = corpus(200)
    rows += [(i + len(rows), "the same text again " * 3) for i in range(60)]
    got = sharding.shard(frame(spark, rows), 4).collect()
    assert len(got) == len(rows)
    load = checked(rows, got, 4)
    assert max(load) - min(load) <= 20_000  # the longest text
    coarse = sharding.shard(frame(spark, rows), 4, buckets=3).collect()
    assert sorted(load) == sorted(checked(rows, coarse, 4)) == sorted(plain(rows, 4))


def plain(rows, shards):
    """The loads that scheduling group by group gives."""
    size = Counter()
    for _, t in rows:
        size[t or ""] += len((t or "").encode()) + 1
    load = [0] * shards
    for n in sorted(size.values(), reverse=True):
        load[load.index(min(load))] += n
    return load


def test_quotas_against_one_group_at_a_time():
    rng = random.Random(8)
    for _ in range(200):
        shards = rng.randint(1, 6)
        sizes = [(n, rng.choice([1, 2, 7, 40])) for n in rng.sample(range(1, 60), rng.randint(0, 9))]
        load, took = [0] * shards, {n: [0] * shards for n, _ in sizes}
        for n, count in sorted(sizes, reverse=True):
            for _ in range(count):
                s = load.index(min(load))
                load[s] += n
                took[n][s] += 1
        assert dict(zip([n for n, _ in sizes], sharding.quotas(sizes, shards), strict=True)) == took


def test_quotas_of_many_small_groups():
    (took, few) = sharding.quotas([(1, 10**12 + 1), (10**6, 3)], 4)
    assert sum(took) == 10**12 + 1 and sum(few) == 3
    load = [a + 10**6 * b for a, b in zip(took, few, strict=True)]
    assert max(load) - min(load) <= 1


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "b")], "doc_id long, text string")
    got = sharding.shard(df, 2).collect()
    assert len(got) == 4 and len({(r["shard"], r["slot"]) for r in got}) == 4
    assert sharding.shard(df.limit(0), 2).count() == 0
    words = df.selectExpr("CAST(doc_id AS STRING) AS name", "text AS `the text`", "1 AS size", "2 AS _group", "3 AS shard")
    assert len({(r["shard"], r["slot"]) for r in sharding.shard(words, 2, "name", "the text").collect()}) == 4


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    load = checked(rows, queries.lpt_sharding(spark, d).collect(), 8)
    assert sorted(load) == sorted(plain(rows, 8))
