"""Join semantics on small inputs with nulls, duplicates and unmatched rows."""

from __future__ import annotations

import itertools
import operator
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leftdeep import JoinPlan, col
from leftdeep import TableRef as T
from leftdeep.operators import strategy as strategies

OPS = {"=": operator.eq, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "!=": operator.ne}
HOWS = {"inner": "join", "left": "left_join", "right": "right_join", "full": "full_outer_join"}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def brute(left, right, op, how, null_safe=False):
    def match(a, b):
        if null_safe and op in ("=", "!="):
            return (a == b) == (op == "=")
        return a is not None and b is not None and OPS[op](a, b)

    pairs = [(i, j) for i, j in itertools.product(range(len(left)), range(len(right))) if match(left[i][0], right[j][0])]
    out = [(*left[i], *right[j]) for i, j in pairs]
    if how in ("left", "full"):
        out += [(*r, None, None) for i, r in enumerate(left) if i not in {p[0] for p in pairs}]
    if how in ("right", "full"):
        out += [(None, None, *r) for j, r in enumerate(right) if j not in {p[1] for p in pairs}]
    return Counter(out)


def tables(spark, left, right, kind="int"):
    return {
        "l": spark.createDataFrame(left, f"k {kind}, v string"),
        "r": spark.createDataFrame(right, f"k {kind}, w string"),
    }


LEFT = [(1, "a"), (1, "b"), (7, "c"), (7, "d"), (None, "e"), (None, "f")]
RIGHT = [(1, "x"), (1, "y"), (3, "z"), (None, "n")]


@pytest.mark.parametrize("how, op", [(h, o) for i, h in enumerate(HOWS) for j, o in enumerate(OPS) if o == "=" or (i + j) % 2])
def test_every_type_and_operator(spark, how, op):
    plan = getattr(JoinPlan(spark, tables(spark, LEFT, RIGHT)), HOWS[how])(T("l", "k"), T("r"), op)
    assert rows(plan.to_df()) == brute(LEFT, RIGHT, op, how)


@pytest.mark.parametrize("how", ["left", "full"])
@pytest.mark.parametrize("op, null_safe", [("<", False), (">=", False), ("!=", False), ("!=", True)])
def test_theta_without_broadcast(spark, monkeypatch, how, op, null_safe):
    monkeypatch.setattr(strategies, "small_enough", lambda df: False)
    for left, right in ((LEFT, RIGHT), (LEFT, []), (LEFT, [(None, "n")])):
        plan = getattr(JoinPlan(spark, tables(spark, left, right)), HOWS[how])(T("l", "k"), T("r"), op, null_safe=null_safe)
        assert rows(plan.to_df()) == brute(left, right, op, how, null_safe)


def test_outer_theta_plan_has_no_table_broadcast(spark, monkeypatch):
    monkeypatch.setattr(strategies, "small_enough", lambda df: False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = JoinPlan(spark, tables(spark, LEFT, RIGHT)).full_outer_join(T("l", "k"), T("r"), "<").to_df()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" in plan and "FullOuter" not in plan


@pytest.fixture
def dealt(monkeypatch):
    """Every side counts as one that has to be dealt out."""
    monkeypatch.setattr(strategies, "MANY_PAIRS", 0)
    monkeypatch.setattr(strategies, "PIECE", 1)


def stored_tables(spark, folder, **dfs):
    for name, df in dfs.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def partitions(df):
    return df.select(F.spark_partition_id()).distinct().count()


def test_inner_theta_of_one_row_group_is_dealt_out_and_meets_by_block(spark, dealt, tmp_path):
    n = 400
    left = [(float(i * 7 % n), f"a{i}") for i in range(n)] + [(None, "n"), (float("nan"), "nan")]
    right = [(float(i * 3 % 50), f"x{i}") for i in range(60)] + [(None, "n"), (float("nan"), "nan")]
    d = stored_tables(spark, tmp_path, l=spark.createDataFrame(left, "k double, v string"), r=spark.createDataFrame(right, "k double, w string"))
    over = lambda a, b: a is not None and b is not None and (a != a and b == b or a > b)  # noqa: E731  NaN is the greatest
    for op, match in (("<", lambda a, b: over(b, a)), (">", over)):
        df = JoinPlan(spark, d).join(T("l", "k"), T("r"), op).to_df()
        assert sorted((r["l__v"], r["r__w"]) for r in df.collect()) == sorted((v, w) for a, v in left for b, w in right if match(a, b))
        assert partitions(df) > 1
        assert "[_block" in df._jdf.queryExecution().executedPlan().toString()


def test_inner_theta_meets_few_rows_beyond_the_other_sides_ends(spark, dealt, tmp_path):
    sizes, keys = spark.range(300).selectExpr("int(id % 50 + 1) s"), spark.range(1, 2001).selectExpr("id k")
    assert strategies._with_partner(keys, F.col("k"), sizes, F.col("s"), "<").count() == 49
    d = stored_tables(spark, tmp_path, l=sizes, r=keys)
    df = JoinPlan(spark, d).join(T("l", "s"), T("r", "k"), ">").to_df()
    assert df.count() == sum(i % 50 for i in range(300))
    assert "_least" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_ranged_join_gives_the_same_rows(spark, dealt, monkeypatch, tmp_path, op, broadcast):
    monkeypatch.setattr(strategies, "SMALL_SIDE", (32 << 20) * broadcast)
    monkeypatch.setattr(strategies, "BLOCK_STEPS", 3)
    left = [(i % 9, str(i)) for i in range(40)] + [(None, "n")]
    for right in ([(i % 14 - 2, str(i)) for i in range(25)] + [(None, "n")], [(4, "x")] * 5, [(None, "n")]):
        a, b = spark.createDataFrame(left, "k int, v string"), spark.createDataFrame(right, "k bigint, w string")
        d = stored_tables(spark, tmp_path / f"{len(right)}", l=a, r=b)
        assert rows(JoinPlan(spark, d).join(T("l", "k"), T("r"), op).to_df()) == brute(left, right, op, "inner")
        turned = JoinPlan(spark, d).join(T("r", "k"), T("l"), op).to_df()
        assert rows(turned) == brute(right, left, op, "inner")


def test_ranged_join_in_a_chain_and_by_other_types(spark, dealt):
    small = [(i,) for i in range(6)]
    src = {n: spark.createDataFrame(small, "k int") for n in "abc"}
    df = JoinPlan(spark, src).join(T("a", "k"), T("b"), "<").join(T("b", "k"), T("c"), ">=").to_df()
    assert rows(df) == Counter((a, b, c) for a, b, c in itertools.product(range(6), repeat=3) if a < b >= c)
    for kind in ("date", "timestamp", "timestamp_ntz", "decimal(9,2)", "string"):
        days = lambda n: spark.range(n).selectExpr(f"cast(date_add(date'2020-01-01', int(id)) as {kind}) k" if kind[0] != "d" or kind == "date" else f"cast(id as {kind}) k")
        assert JoinPlan(spark, {"l": days(9), "r": days(7)}).join(T("l", "k"), T("r"), "<").to_df().count() == 21


def test_equal_keys_with_a_comparing_filter_are_dealt_out(spark, dealt, tmp_path):
    left, right = [(i % 2, i) for i in range(60)], [(i % 2, 2 * i) for i in range(20)]
    d = stored_tables(spark, tmp_path, l=spark.createDataFrame(left, "k int, v int"), r=spark.createDataFrame(right, "k int, w int"))
    for a, b, one, two in (("l", "r", left, right), ("r", "l", right, left)):
        df = JoinPlan(spark, d).join(T(a, "k"), T(b)).filter_by(col("l.v") > col("r.w")).to_df()
        assert rows(df) == Counter((*x, *y) for x in one for y in two if x[0] == y[0] and (x if a == "l" else y)[1] > (y if a == "l" else x)[1])
        assert partitions(df) > 1


def test_chains_of_outer_theta_joins_double_no_work(spark):
    d = "/root/testdata/sf0.001"

    def scans(how, steps):
        plan = JoinPlan(spark, d)
        for i in range(steps):
            left = T("nation", "n_nationkey", "t0") if not i else T("region", "r_regionkey", f"t{i}")
            plan = getattr(plan, HOWS[how])(left, T("region", "r_regionkey", f"t{i + 1}"), "<", strategy="nested_loop")
        return plan.to_df()._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    assert [scans("left", n) for n in (1, 2, 3, 4)] == [3, 5, 7, 9]
    assert scans("full", 2) == scans("full", 3) == scans("full", 4)


def test_coerced_outer_theta_broadcasts_no_table(spark):
    src = {"l": spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c"), ("5", "d")], "k string, v string"), "r": spark.createDataFrame([(2, "p"), (0, "q")], "k int, w string")}
    df = JoinPlan(spark, src).full_outer_join(T("l", "k"), T("r"), ">", coerce_numeric=True, strategy="nested_loop").to_df()
    assert "FullOuter" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["l__v"] or "", r["r__w"] or "") for r in df.collect()) == [("a", "q"), ("b", ""), ("c", ""), ("d", "p"), ("d", "q")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.sampled_from("ab")), max_size=6),
    st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.sampled_from("xy")), max_size=6),
    st.sampled_from(sorted(OPS)),
    st.sampled_from(sorted(HOWS)),
    st.booleans(),
)
def test_random_tables(spark, left, right, op, how, null_safe):
    plan = getattr(JoinPlan(spark, tables(spark, left, right)), HOWS[how])(T("l", "k"), T("r"), op, null_safe=null_safe)
    assert rows(plan.to_df()) == brute(left, right, op, how, null_safe and op in ("=", "!="))


@pytest.mark.parametrize("how", HOWS)
def test_strategies_give_the_same_rows(spark, how):
    for s in ("broadcast", "merge", "shuffle_hash"):
        plan = getattr(JoinPlan(spark, tables(spark, LEFT, RIGHT)), HOWS[how])(T("l", "k"), T("r"), strategy=s)
        assert rows(plan.to_df()) == brute(LEFT, RIGHT, "=", how), s


def test_composite_nulls(spark):
    data = [(1, None, "p"), (1, 2, "q"), (None, None, "s")]
    src = {"l": spark.createDataFrame(data, "a int, b int, v string"), "r": spark.createDataFrame(data, "a int, b int, w string")}
    plan = JoinPlan(spark, src)
    assert plan.join(T("l", ("a", "b")), T("r")).to_df().count() == 1
    assert plan.join(T("l", ("a", "b")), T("r"), null_safe=True).to_df().count() == 3


def test_null_words_are_ordinary_text(spark):
    src = tables(spark, [("null", "a"), ("None", "b"), (None, "c")], [("null", "x"), ("None", "y"), (None, "z")], "string")
    assert rows(JoinPlan(spark, src).join(T("l", "k"), T("r")).to_df()) == Counter([("null", "a", "null", "x"), ("None", "b", "None", "y")])


def test_numeric_text(spark):
    src = tables(spark, [("10", ""), ("9", ""), ("abc", "")], [("9", ""), ("abc", "")], "string")
    pick = lambda df: sorted((r[0], r[2]) for r in df.collect())
    j = lambda op, **o: pick(JoinPlan(spark, src).join(T("l", "k"), T("r"), op, **o).to_df())
    assert j(">") == [("abc", "9")]
    assert j(">", coerce_numeric=True) == [("10", "9")]
    assert j("=", coerce_numeric=True) == [("9", "9"), ("abc", "abc")]


def test_numbers_of_different_types(spark):
    src = {"l": spark.createDataFrame([(1,)], "k int"), "r": spark.createDataFrame([(1.0,)], "k double")}
    assert JoinPlan(spark, src).join(T("l", "k"), T("r")).to_df().count() == 1
    big = tables(spark, [(9007199254740992, "")], [(9007199254740993, "")], "bigint")
    assert JoinPlan(spark, big).join(T("l", "k"), T("r")).to_df().count() == 0
    mixed = {"l": spark.createDataFrame([(1,)], "k int"), "r": spark.createDataFrame([("1.0",)], "k string")}
    with pytest.raises(ValueError, match="coerce_numeric"):
        JoinPlan(spark, mixed).join(T("l", "k"), T("r")).to_df()
    assert JoinPlan(spark, mixed).join(T("l", "k"), T("r"), coerce_numeric=True).to_df().count() == 1


def test_chain_null_extends_every_column(spark):
    src = {
        "a": spark.createDataFrame([(1,), (2,)], "k int"),
        "b": spark.createDataFrame([(1, 10)], "k int, j int"),
        "c": spark.createDataFrame([(10,), (99,)], "j int"),
    }
    df = JoinPlan(spark, src).left_join(T("a", "k"), T("b")).full_outer_join(T("b", "j"), T("c")).to_df()
    assert df.columns == ["a__k", "b__k", "b__j", "c__j"]
    assert rows(df) == Counter([(1, 1, 10, 10), (2, None, None, None), (None, None, None, 99)])
    nothing = JoinPlan(spark, src | {"a": src["a"].where("k > 5")}).join(T("a", "k"), T("b"))
    assert nothing.right_join(T("b", "j"), T("c")).to_df().count() == 2


def test_self_join_and_reuse(spark):
    emp = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "id int, mgr int")
    plan = JoinPlan(spark, {"emp": emp}).left_join(T("emp", "mgr", "e"), T("emp", "id", "m"))
    want = Counter([(1, None, None, None), (2, 1, 1, None), (3, 1, 1, None)])
    assert rows(plan.to_df()) == want and rows(plan.to_df()) == want


def test_bad_plans(spark):
    p = JoinPlan(spark, tables(spark, LEFT, RIGHT))
    bad = [
        lambda: p.join(T("l", "k"), T("nope")).to_df(),
        lambda: p.join(T("l", "nope"), T("r", "k")).to_df(),
        lambda: p.join(T("l", "k"), T("r"), "~"),
        lambda: p.join(T("l", ("k", "v")), T("r", ("k", "w")), "<"),
        lambda: p.join(T("l", ("k", "v")), T("r", "k")),
        lambda: p.join(T("l", "k"), T("l")),
        lambda: p.join(T("l", "k"), T("r")).join(T("x", "k"), T("r", "k", "r2")),
        lambda: p.join(T("l", "k"), T("r")).select("l", ["v"]).to_df(),
        lambda: p.join(T("l", "k"), T("r")).select("q", ["v"]).to_df(),
        lambda: p.join(T("l", "k"), T("r"), strategy="magic"),
        lambda: p.to_df(),
        lambda: T("a__b", "k"),
        lambda: JoinPlan(spark, "/nowhere").join(T("l", "k"), T("r")).to_df(),
        lambda: JoinPlan(spark).join(T("no_such_table", "k"), T("r")).to_df(),
    ]
    for f in bad:
        with pytest.raises(ValueError):
            f()
