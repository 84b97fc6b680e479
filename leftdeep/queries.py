"""The engine's own query set, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leftdeep.functions.conditions import Condition, col
from leftdeep.plans.model import TableRef as T
from leftdeep.plans.plan import JoinPlan
from leftdeep.shared import scratch_path
from leftdeep.sources.json_lines import read_json_lines, write_json_lines

Query = Callable[[SparkSession, str], DataFrame]

COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "labels": "doc_id quality toxic",
}


def _cols(*tables: str) -> str:
    """``alias=table`` (or just a table) to the select list of its renamed columns."""
    out = []
    for t in tables:
        alias, _, table = t.partition("=")
        out += [f"{alias}.{c} AS {alias}__{c}" for c in COLUMNS[table or alias].split()]
    return ", ".join(out)


def _sql(tables: list[str], body: str) -> str:
    return f"SELECT {_cols(*tables)} FROM {body}"


def _with_null_keys(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The star schema's small tables, where region 2 has become null."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    null2 = lambda c: F.when(F.col(c) != 2, F.col(c))
    return {
        "part": read("part"),
        "nation": read("nation"),
        "region_n": read("region").withColumn("r_regionkey", null2("r_regionkey")),
        "nation_n": read("nation").withColumn("n_regionkey", null2("n_regionkey")),
    }


def _as_text(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    return {
        "nation": read("nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string")),
        "supplier": read("supplier").withColumn("s_suppkey", F.col("s_suppkey").cast("string")),
    }


def _with_collections(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    digit = lambda i: F.substring("n_name", i, 1)
    nation = spark.read.parquet(f"{d}/nation.parquet").withColumns({"n_digits": F.array(digit(8), digit(9)), "n_first": F.create_map(digit(8), F.col("n_regionkey"))})
    return {"nation": nation, "region": spark.read.parquet(f"{d}/region.parquet")}


def _contains(column: str, value: str) -> Query:
    plan = lambda s, d: JoinPlan(s, _with_collections(s, d)).join(NATION, REGION).select("nation", ["n_name", "n_regionkey"])
    return lambda s, d: plan(s, d).filter_by(col(f"nation.{column}").contains(value)).to_df()


def _json_inferred(spark: SparkSession, d: str) -> DataFrame:
    df = part_nation(spark, d, "full_outer_join").select("part", ["p_partkey", "p_size"]).select("nation", ["n_nationkey", "n_name"]).to_df()
    path = scratch_path(spark, "json")
    write_json_lines(df, path)
    return read_json_lines(spark, path)


def _json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    df = part_nation(spark, d, "full_outer_join").to_df()
    path = scratch_path(spark, "json")
    write_json_lines(df, path)
    return read_json_lines(spark, path, df.schema)


def part_nation(spark: SparkSession, d: str, how: str, **options) -> JoinPlan:
    return getattr(JoinPlan(spark, d), how)(T("part", "p_size"), T("nation", "n_nationkey"), **options)


def orders_customer(spark: SparkSession, d: str) -> JoinPlan:
    return JoinPlan(spark, d).join(T("orders", "o_custkey"), T("customer", "c_custkey"))


def theta(left: T, right: T, op: str, how: str = "join") -> Query:
    return lambda s, d: getattr(JoinPlan(s, d), how)(left, right, op).to_df()


def _filtered(condition: Condition) -> Query:
    return lambda s, d: orders_customer(s, d).filter_by(condition).to_df()


NATION, REGION = T("nation", "n_regionkey"), T("region", "r_regionkey")
NATION_ID, SUPPLIER = T("nation", "n_nationkey"), T("supplier", "s_suppkey")
LINES = ("l_orderkey", "l_linenumber")

QUERIES: dict[str, Query] = {
    "inner_join": lambda s, d: orders_customer(s, d).to_df(),
    "left_join": lambda s, d: part_nation(s, d, "left_join").to_df(),
    "right_join": lambda s, d: part_nation(s, d, "right_join").to_df(),
    "full_outer_join": lambda s, d: part_nation(s, d, "full_outer_join").to_df(),
    "chain_inner": lambda s, d: JoinPlan(s, d)
    .join(T("lineitem", "l_orderkey"), T("orders", "o_orderkey"))
    .join(T("orders", "o_custkey"), T("customer", "c_custkey"))
    .to_df(),
    "chain_full": lambda s, d: part_nation(s, d, "full_outer_join").full_outer_join(NATION, REGION).to_df(),
    "chain_mixed": lambda s, d: JoinPlan(s, d)
    .join(T("nation", "n_regionkey"), T("region", "r_regionkey"), "<")
    .full_outer_join(T("nation", "n_nationkey"), T("supplier", "s_nationkey"))
    .to_df(),
    "chain_null_safe": lambda s, d: JoinPlan(s, _with_null_keys(s, d))
    .left_join(T("part", "p_size"), T("nation", "n_nationkey"))
    .join(NATION, T("region_n", "r_regionkey", "region"), null_safe=True)
    .to_df(),
    "self_join": lambda s, d: JoinPlan(s, d).join(T("nation", "n_regionkey", "a"), T("nation", "n_regionkey", "b")).to_df(),
    "composite_key": lambda s, d: JoinPlan(s, d).join(T("lineitem", LINES, "a"), T("lineitem", LINES, "b")).to_df(),
    "composite_null_sql": lambda s, d: JoinPlan(s, _with_null_keys(s, d))
    .join(T("nation_n", ("n_nationkey", "n_regionkey"), "a"), T("nation_n", alias="b"))
    .to_df(),
    "composite_null_safe": lambda s, d: JoinPlan(s, _with_null_keys(s, d))
    .join(T("nation_n", ("n_nationkey", "n_regionkey"), "a"), T("nation_n", alias="b"), "<=>")
    .to_df(),
    "theta_lt": theta(NATION, REGION, "<"),
    "theta_gt": theta(T("part", "p_size"), SUPPLIER, ">"),
    "theta_le": theta(NATION, REGION, "<="),
    "theta_ge_right": theta(NATION_ID, SUPPLIER, ">=", "right_join"),
    "theta_ne": theta(NATION, REGION, "!="),
    "theta_gt_left": theta(NATION_ID, SUPPLIER, ">", "left_join"),
    "theta_gt_full": theta(NATION_ID, SUPPLIER, ">", "full_outer_join"),
    "theta_lt_acctbal": theta(T("customer", "c_acctbal"), T("supplier", "s_acctbal"), "<"),
    "theta_coerced": lambda s, d: JoinPlan(s, _as_text(s, d)).join(NATION_ID, SUPPLIER, ">", coerce_numeric=True).to_df(),
    "theta_uncoerced": lambda s, d: JoinPlan(s, _as_text(s, d)).join(NATION_ID, SUPPLIER, ">").to_df(),
    "coerced_equal": lambda s, d: JoinPlan(s, _as_text(s, d) | {"customer": s.read.parquet(f"{d}/customer.parquet")})
    .join(NATION_ID, T("customer", "c_nationkey"), coerce_numeric=True)
    .to_df(),
    "theta_coerced_left": lambda s, d: JoinPlan(s, _as_text(s, d)).left_join(NATION_ID, SUPPLIER, ">", coerce_numeric=True, strategy="nested_loop").to_df(),
    "theta_chain_left": lambda s, d: JoinPlan(s, d)
    .left_join(T("nation", "n_nationkey", "first"), SUPPLIER, ">", strategy="nested_loop")
    .left_join(T("supplier", "s_nationkey"), T("region", "r_regionkey"), "<=", strategy="nested_loop")
    .left_join(T("region", "r_regionkey"), T("nation", "n_regionkey", "other"), "<", strategy="nested_loop")
    .to_df(),
    "theta_chain_full": lambda s, d: JoinPlan(s, d)
    .full_outer_join(NATION_ID, SUPPLIER, ">", strategy="nested_loop")
    .full_outer_join(T("supplier", "s_nationkey"), T("region", "r_regionkey"), "<", strategy="nested_loop")
    .to_df(),
    "composite_full": lambda s, d: JoinPlan(s, _with_null_keys(s, d))
    .full_outer_join(T("nation_n", ("n_nationkey", "n_regionkey"), "a"), T("nation", alias="b"))
    .to_df(),
    "join_merge": lambda s, d: JoinPlan(s, d).join(T("orders", "o_custkey"), T("customer", "c_custkey"), strategy="merge").to_df(),
    "join_shuffle_hash": lambda s, d: JoinPlan(s, d).left_join(T("orders", "o_custkey"), T("customer", "c_custkey"), strategy="shuffle_hash").to_df(),
    "join_broadcast": lambda s, d: JoinPlan(s, d).join(T("lineitem", "l_suppkey"), T("supplier", "s_suppkey"), strategy="broadcast").to_df(),
    "contains_array": _contains("n_digits", "1"),
    "contains_map": _contains("n_first", "2"),
    "filter_not_not": _filtered(~~(col("orders.o_totalprice") > 100000)),
    "json_inferred": _json_inferred,
    "filter_range": _filtered((col("orders.o_totalprice") > 100000) & (col("customer.c_acctbal") <= 5000)),
    "filter_between": _filtered((col("orders.o_totalprice") < 50000) & (col("customer.c_acctbal") >= 1000)),
    "filter_eq": _filtered(col("orders.o_orderstatus") == "F"),
    "filter_in": _filtered(col("orders.o_orderstatus").isin(["F", "P"])),
    "filter_contains": _filtered(col("orders.o_orderpriority").contains("URGENT")),
    "filter_literal_left": _filtered(Condition(100000, "<", col("orders.o_totalprice"))),
    "filter_not_null": lambda s, d: part_nation(s, d, "left_join").filter_by(~(col("nation.n_regionkey") > 1)).to_df(),
    "filter_and_or_not": lambda s, d: part_nation(s, d, "left_join")
    .filter_by(((col("part.p_size") > 10) & ~(col("nation.n_regionkey") > 1)) | (col("part.p_brand") == "Brand#13"))
    .to_df(),
    "filter_col_vs_col": lambda s, d: JoinPlan(s, d)
    .join(T("customer", "c_nationkey"), T("supplier", "s_nationkey"))
    .filter_by(col("customer.c_acctbal") > col("supplier.s_acctbal"))
    .to_df(),
    "filter_hidden_column": lambda s, d: orders_customer(s, d)
    .select("orders", ["o_orderkey", "o_custkey"])
    .select("customer", ["c_custkey", "c_name"])
    .filter_by(col("orders.o_orderdate") >= datetime(2000, 1, 1))
    .to_df(),
    "select_columns": lambda s, d: orders_customer(s, d)
    .select("orders", ["o_custkey", "o_totalprice"])
    .select("orders", ["o_orderkey"])
    .select("customer", ["c_custkey"])
    .to_df(),
    "docs_labels_left": lambda s, d: JoinPlan(s, d)
    .left_join(T("documents", "doc_id"), T("labels"))
    .select("documents", ["doc_id", "lang", "source", "n_chars"])
    .to_df(),
    "json_sink_roundtrip": _json_roundtrip,
}

PART_NATION = "part {} JOIN nation ON p_size = n_nationkey"
ORDERS_CUSTOMER = "orders JOIN customer ON o_custkey = c_custkey"
NATION_NULL = "(SELECT n_nationkey, n_name, nullif(n_regionkey, 2) AS n_regionkey FROM nation)"
REGION_NULL = "(SELECT nullif(r_regionkey, 2) AS r_regionkey, r_name FROM region)"
NATION_TEXT = "(SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey FROM nation) nation"
SUPPLIER_TEXT = "(SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier) supplier"


def _on(left: str, right: str, cond: str, how: str = "") -> str:
    return _sql([left, right], f"{left} {how} JOIN {right} ON {cond}")


def _where(cond: str) -> str:
    return _sql(["orders", "customer"], f"{ORDERS_CUSTOMER} WHERE {cond}")


def _left_where(cond: str) -> str:
    return _sql(["part", "nation"], f"{PART_NATION.format('LEFT')} WHERE {cond}")


def _digits(cond: str) -> str:
    columns = "n_name AS nation__n_name, n_regionkey AS nation__n_regionkey"
    return f"SELECT {columns}, {_cols('region')} FROM nation JOIN region ON n_regionkey = r_regionkey WHERE {cond}"


ORACLE: dict[str, str] = {
    "inner_join": _sql(["orders", "customer"], ORDERS_CUSTOMER),
    "left_join": _sql(["part", "nation"], PART_NATION.format("LEFT")),
    "right_join": _sql(["part", "nation"], PART_NATION.format("RIGHT")),
    "full_outer_join": _sql(["part", "nation"], PART_NATION.format("FULL")),
    "chain_inner": _sql(["lineitem", "orders", "customer"], "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"),
    "chain_full": _sql(["part", "nation", "region"], PART_NATION.format("FULL") + " FULL JOIN region ON n_regionkey = r_regionkey"),
    "chain_mixed": _sql(["nation", "region", "supplier"], "nation JOIN region ON n_regionkey < r_regionkey FULL JOIN supplier ON n_nationkey = s_nationkey"),
    "chain_null_safe": _sql(["part", "nation", "region"], PART_NATION.format("LEFT") + f" JOIN {REGION_NULL} region ON n_regionkey IS NOT DISTINCT FROM r_regionkey"),
    "self_join": _sql(["a=nation", "b=nation"], "nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"),
    "composite_key": _sql(["a=lineitem", "b=lineitem"], "lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"),
    "composite_null_sql": _sql(["a=nation", "b=nation"], f"{NATION_NULL} a JOIN {NATION_NULL} b ON a.n_nationkey = b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "composite_null_safe": _sql(["a=nation", "b=nation"], f"{NATION_NULL} a JOIN {NATION_NULL} b ON a.n_nationkey = b.n_nationkey AND a.n_regionkey IS NOT DISTINCT FROM b.n_regionkey"),
    "theta_lt": _on("nation", "region", "n_regionkey < r_regionkey"),
    "theta_gt": _on("part", "supplier", "p_size > s_suppkey"),
    "theta_le": _on("nation", "region", "n_regionkey <= r_regionkey"),
    "theta_ge_right": _on("nation", "supplier", "n_nationkey >= s_suppkey", "RIGHT"),
    "theta_ne": _on("nation", "region", "n_regionkey <> r_regionkey"),
    "theta_gt_left": _on("nation", "supplier", "n_nationkey > s_suppkey", "LEFT"),
    "theta_gt_full": _on("nation", "supplier", "n_nationkey > s_suppkey", "FULL"),
    "theta_lt_acctbal": _on("customer", "supplier", "c_acctbal < s_acctbal"),
    "theta_coerced": _sql(["nation", "supplier"], f"{NATION_TEXT} JOIN {SUPPLIER_TEXT} ON TRY_CAST(n_nationkey AS DOUBLE) > TRY_CAST(s_suppkey AS DOUBLE)"),
    "theta_uncoerced": _sql(["nation", "supplier"], f"{NATION_TEXT} JOIN {SUPPLIER_TEXT} ON n_nationkey > s_suppkey"),
    "coerced_equal": _sql(["nation", "customer"], f"{NATION_TEXT} JOIN customer ON TRY_CAST(n_nationkey AS DOUBLE) = c_nationkey"),
    "theta_coerced_left": _sql(["nation", "supplier"], f"{NATION_TEXT} LEFT JOIN {SUPPLIER_TEXT} ON TRY_CAST(n_nationkey AS DOUBLE) > TRY_CAST(s_suppkey AS DOUBLE)"),
    "theta_chain_left": _sql(["first=nation", "supplier", "region", "other=nation"], "nation first LEFT JOIN supplier ON first.n_nationkey > s_suppkey LEFT JOIN region ON s_nationkey <= r_regionkey LEFT JOIN nation other ON r_regionkey < other.n_regionkey"),
    "theta_chain_full": _sql(["nation", "supplier", "region"], "nation FULL JOIN supplier ON n_nationkey > s_suppkey FULL JOIN region ON s_nationkey < r_regionkey"),
    "composite_full": _sql(["a=nation", "b=nation"], f"{NATION_NULL} a FULL JOIN nation b ON a.n_nationkey = b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "join_merge": _sql(["orders", "customer"], ORDERS_CUSTOMER),
    "join_shuffle_hash": _on("orders", "customer", "o_custkey = c_custkey", "LEFT"),
    "join_broadcast": _on("lineitem", "supplier", "l_suppkey = s_suppkey"),
    "contains_array": _digits("substr(n_name, 8, 1) = '1' OR substr(n_name, 9, 1) = '1'"),
    "contains_map": _digits("substr(n_name, 8, 1) = '2'"),
    "filter_not_not": _where("o_totalprice > 100000"),
    "json_inferred": f"SELECT p_partkey AS part__p_partkey, p_size AS part__p_size, n_nationkey AS nation__n_nationkey, n_name AS nation__n_name FROM {PART_NATION.format('FULL')}",
    "filter_range": _where("o_totalprice > 100000 AND c_acctbal <= 5000"),
    "filter_between": _where("o_totalprice < 50000 AND c_acctbal >= 1000"),
    "filter_eq": _where("o_orderstatus = 'F'"),
    "filter_in": _where("o_orderstatus IN ('F', 'P')"),
    "filter_contains": _where("o_orderpriority LIKE '%URGENT%'"),
    "filter_literal_left": _where("100000 < o_totalprice"),
    "filter_not_null": _left_where("NOT coalesce(n_regionkey > 1, false)"),
    "filter_and_or_not": _left_where("(p_size > 10 AND NOT coalesce(n_regionkey > 1, false)) OR p_brand = 'Brand#13'"),
    "filter_col_vs_col": _sql(["customer", "supplier"], "customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > s_acctbal"),
    "filter_hidden_column": f"SELECT o_orderkey AS orders__o_orderkey, o_custkey AS orders__o_custkey, c_custkey AS customer__c_custkey, c_name AS customer__c_name FROM {ORDERS_CUSTOMER} WHERE o_orderdate >= TIMESTAMP '2000-01-01'",
    "select_columns": f"SELECT o_custkey AS orders__o_custkey, o_totalprice AS orders__o_totalprice, o_orderkey AS orders__o_orderkey, c_custkey AS customer__c_custkey FROM {ORDERS_CUSTOMER}",
    "docs_labels_left": "SELECT documents.doc_id AS documents__doc_id, lang AS documents__lang, source AS documents__source, n_chars AS documents__n_chars, "
    + _cols("labels")
    + " FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id",
    "json_sink_roundtrip": _sql(["part", "nation"], PART_NATION.format("FULL")),
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their nation and region."""
    plan = JoinPlan(spark, d).join(T("customer", "c_nationkey"), T("nation", "n_nationkey"))
    return plan.join(NATION, REGION).to_df()
