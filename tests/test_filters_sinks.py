from __future__ import annotations

import datetime as dt
import decimal
from types import SimpleNamespace

import pytest

from leftdeep import Condition, JoinPlan, TableRef, col, read_json_lines, shared
from leftdeep.operators.bucketed import save_bucketed
from leftdeep.sources.json_lines import write_json_lines
from leftdeep.streaming.sink import stream_json

D = "/root/testdata/sf0.001"


def one(spark, data, schema):
    """A chain that leaves table ``t`` as it is."""
    df = spark.createDataFrame(data, schema)
    ids = spark.createDataFrame([(i,) for i in range(9)], "i int")
    return JoinPlan(spark, {"t": df, "ids": ids}).join(TableRef("t", "i"), TableRef("ids"))


def ids(plan):
    return sorted(r["t__i"] for r in plan.to_df().collect())


def test_not_keeps_nulls_and_polarity(spark):
    p = one(spark, [(0, 1), (1, None), (2, 9)], "i int, a int")
    assert ids(p.filter_by(~(col("t.a") > 5))) == [0, 1]
    assert ids(p.filter_by(~~(col("t.a") > 5))) == [2]
    assert ids(p.filter_by(~((col("t.a") > 5) | (col("t.a") == 1)))) == [1]
    assert ids(p.filter_by(col("t.a") != 9)) == [0, 1]
    assert ids(p.filter_by(~col("t.a").isin([1]))) == [1, 2]
    assert ids(p.filter_by(col("t.a") >= 1).filter_by(col("t.a") < 9)) == [0]


def test_contains_by_type(spark):
    data = [(0, "hit", [1, 2], {"k": 1}), (1, "miss", [None, 3], {"q": 1}), (2, None, None, None)]
    p = one(spark, data, "i int, s string, arr array<int>, m map<string,int>")
    assert ids(p.filter_by(col("t.s").contains("it"))) == [0]
    assert ids(p.filter_by(col("t.arr").contains(2))) == [0]
    assert ids(p.filter_by(~col("t.arr").contains(2))) == [1, 2]
    assert ids(p.filter_by(col("t.m").contains("k"))) == [0]
    with pytest.raises(ValueError):
        p.filter_by(col("t.i").contains(1)).to_df()


def test_bad_conditions(spark):
    for f in (
        lambda: Condition(col("a.b"), "!=", 1),
        lambda: col("a.b") == None,  # noqa: E711
        lambda: col("a.b").isin("text"),
        lambda: col("a.b").isin([None]),
        lambda: col("ab"),
        lambda: Condition(1, "AND", 2),
    ):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(TypeError):
        bool(col("a.b") == 1)
    p = one(spark, [(0, 1)], "i int, a int")
    for name in ("t.zz", "zz.a"):
        with pytest.raises(ValueError):
            p.filter_by(col(name) == 1).to_df()
    c = (col("a.b") > 1) & ~(col("a.c") == "x")
    assert repr(c) == "(a.b > 1) AND (NOT (a.c = 'x'))" and not c.is_conjunctive() and c.columns() == {"a.b", "a.c"}


def test_pushdown_and_pruning_reach_the_scan(spark):
    p = JoinPlan(spark, D).join(TableRef("orders", "o_custkey"), TableRef("customer", "c_custkey"))
    p = p.select("orders", ["o_custkey"]).select("customer", ["c_custkey"]).filter_by(col("orders.o_totalprice") > 1000)
    plan = p.to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000" in plan and "o_orderpriority" not in plan and "c_name" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_json_lines_keep_types_and_nulls(spark, tmp_path):
    row = (1, decimal.Decimal("1.10"), dt.datetime(2020, 1, 2, 3, 4, 5), dt.date(2020, 1, 2), None)
    df = spark.createDataFrame([row, (2, None, None, None, None)], "a__i int, a__d decimal(10,2), a__ts timestamp, b__dt date, b__i string")
    write_json_lines(df, str(tmp_path / "j"))
    text = sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert '"i":{"a":1,"b":null}' in text[0] and '"d":{"a":"1.10"}' in text[0]
    assert sorted(map(tuple, read_json_lines(spark, str(tmp_path / "j"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert read_json_lines(spark, str(tmp_path / "j")).count() == 2


def test_display_and_timings(spark):
    p = one(spark, [(0, 1), (1, None)], "i int, a int")
    said = []
    p.display(batch=1, out=said.append)
    assert len(said) == 2 and "a [t]" in said[0]
    said.clear()
    p.filter_by(col("t.a") > 50).display(out=said.append)
    assert said == ["EMPTY RESULT SET"]
    t = p.timings()
    assert t.total >= t.join >= 0
    t = JoinPlan(spark, D).join(TableRef("lineitem", "l_orderkey"), TableRef("orders", "o_orderkey")).timings()
    assert 0 < t.scan <= t.total


def test_columns_with_dots_and_cancelled_nots(spark):
    t = spark.createDataFrame([(1, 5), (2, None)], "i int, `a.b` int")
    p = JoinPlan(spark, {"t": t, "u": t}).join(TableRef("t", "i"), TableRef("u", "i"))
    assert [r["t__i"] for r in p.filter_by(col("t.a.b") > 4).to_df().collect()] == [1]
    twice = JoinPlan(spark, D).join(TableRef("orders", "o_custkey"), TableRef("customer", "c_custkey")).filter_by(~~(col("orders.o_totalprice") > 9e4))
    assert "GreaterThan(o_totalprice" in twice.to_df()._jdf.queryExecution().executedPlan().toString()


def test_folder_for_intermediate_tables(spark, tmp_path, monkeypatch):
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://somewhere:7077", getConf=dict, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session)
    session.sparkContext.master = "local[2]"
    assert shared.shared_dir(session) == shared.LOCAL_DEFAULT
    session.sparkContext.getCheckpointDir = lambda: "/given"
    assert shared.shared_dir(session) == "/given"
    session.conf = {"spark.checkpoint.dir": "/set/"}
    assert shared.shared_dir(session) == "/set"
    monkeypatch.setattr(shared, "shared_dir", lambda s: str(tmp_path))
    df = shared.stored(spark.range(3), "numbers")
    assert df.count() == 3 and list(tmp_path.rglob("*.parquet"))
    shared.remove_all(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name, key in (("b_orders", "o_custkey"), ("b_customer", "c_custkey")):
        save_bucketed(spark.read.parquet(f"{D}/{name[2:]}.parquet"), name, key, 4)
    try:
        df = JoinPlan(spark).join(TableRef("b_orders", "o_custkey"), TableRef("b_customer", "c_custkey"), strategy="merge").to_df()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 1500
    finally:
        for name in ("b_orders", "b_customer"):
            spark.sql(f"DROP TABLE {name}")


def test_a_stream_joined_with_a_table(spark, tmp_path):
    static = spark.read.parquet(f"{D}/customer.parquet")
    schema = spark.read.parquet(f"{D}/orders.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{D}/orders.parq*")
    df = JoinPlan(spark, {"o": stream, "c": static}).join(TableRef("o", "o_custkey"), TableRef("c", "c_custkey")).to_df()
    q = stream_json(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(90)
    assert spark.read.text(str(tmp_path / "out")).count() == 1500
