"""One query per operator over the driver's tables, with DuckDB SQL of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ring import Ring
from tessera.operators import aggregate as agg
from tessera.operators import change, cte, join, scan, sort, window
from tessera.operators import predicate as p
from tessera.plans.lower import Lowering, Table
from tessera.plans.parser import parse
from tessera.session import shared_folder
from tessera.sources.result_text import as_lines
from tessera.sources.tables import table
from tessera.store.session import Engine, Session
from tessera.streaming.replica import replicate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def added(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return added


# Scans, projections, filters


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all(spark, d):
    return scan.seq_scan(table(spark, d, "nation"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def project_cols(spark, d):
    return p.project(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")


@query("SELECT n_name, n_nationkey FROM nation")
def project_by_position(spark, d):
    return p.project_at(table(spark, d, "nation"), 1, 0)


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@query(f"{_ORDERS} WHERE o_orderstatus = 'F'")
def filter_eq(spark, d):
    return p.filter_rows(_orders(spark, d), p.compare("o_orderstatus", "=", "F"))


@query(f"{_ORDERS} WHERE o_orderstatus != 'F'")
def filter_neq(spark, d):
    return p.filter_rows(_orders(spark, d), p.compare("o_orderstatus", "!=", "F"))


@query(f"{_ORDERS} WHERE o_totalprice > 100000")
def filter_gt(spark, d):
    return p.filter_rows(_orders(spark, d), p.compare("o_totalprice", ">", 100000))


@query(f"{_ORDERS} WHERE o_orderstatus >= 'O'")
def filter_gte(spark, d):
    return p.filter_rows(_orders(spark, d), p.compare("o_orderstatus", ">=", "O"))


@query(f"{_ORDERS} WHERE o_custkey < 100")
def filter_lt(spark, d):
    return p.filter_rows(_orders(spark, d), p.compare("o_custkey", "<", 100))


@query(f"{_ORDERS} WHERE o_totalprice <= 50000.5")
def filter_lte(spark, d):
    return p.filter_rows(_orders(spark, d), p.compare("o_totalprice", "<=", 50000.5))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R'")
def filter_and(spark, d):
    rows = p.filter_rows(table(spark, d, "lineitem"), p.compare("l_quantity", ">=", 30), p.compare("l_returnflag", "=", "R"))
    return p.project(rows, "l_orderkey", "l_quantity")


@query(f"{_ORDERS} WHERE o_custkey > o_orderkey")
def filter_col_col(spark, d):
    return p.filter_rows(_orders(spark, d), p.compare("o_custkey", ">", F.col("o_orderkey")))


@query(f"{_ORDERS} WHERE (o_orderstatus = 'F' OR o_custkey < 10) AND NOT o_totalprice < 1000")
def filter_or_not(spark, d):
    either = p.any_of(p.compare("o_orderstatus", "=", "F"), p.compare("o_custkey", "<", 10))
    return p.filter_rows(_orders(spark, d), either, ~p.compare("o_totalprice", "<", 1000))


@query(f"{_ORDERS} WHERE o_custkey IN (1, 5, 7, 11) OR o_totalprice BETWEEN 1000 AND 20000")
def filter_in_between(spark, d):
    return p.filter_rows(_orders(spark, d), F.col("o_custkey").isin(1, 5, 7, 11) | F.col("o_totalprice").between(1000, 20000))


@query("SELECT o_orderkey, ROUND(o_totalprice * 2 + 1, 4) AS twice, o_orderkey % 7 AS day FROM orders")
def project_arithmetic(spark, d):
    return p.project(_orders(spark, d), "o_orderkey", F.round(F.col("o_totalprice") * 2 + 1, 4).alias("twice"), (F.col("o_orderkey") % 7).alias("day"))


@query(f"{_ORDERS} WHERE o_orderkey = 42")
def pk_point_lookup(spark, d):
    return scan.index_scan_eq(_orders(spark, d), "o_orderkey", 42)


@query(f"{_ORDERS} WHERE o_orderkey BETWEEN 100 AND 200")
def pk_range_scan(spark, d):
    return scan.index_scan_range(_orders(spark, d), "o_orderkey", 100, 200)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def secondary_index_lookup(spark, d):
    return scan.index_scan_eq(table(spark, d, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100 AND 2000")
def secondary_index_range(spark, d):
    return scan.index_scan_range(table(spark, d, "customer"), "c_acctbal", 100, 2000).select("c_custkey", "c_acctbal")


@query(f"{_ORDERS} WHERE o_orderkey = 7 LIMIT 1")
def table_search(spark, d):
    return scan.search(_orders(spark, d), "o_orderkey", 7)


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def in_memory_scan(spark, d):
    return scan.in_memory_scan(table(spark, d, "nation"), "tessera_memory").filter("n_regionkey = 1").select("n_name")


@query("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = 1")
def in_memory_insert(spark, d):
    """The rows of a query go to a named temporary table; the answer is how many there are."""
    return scan.in_memory_insert(table(spark, d, "nation").filter("n_regionkey = 1"), "tessera_inserted")


@query("SELECT CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def result_sink_lines(spark, d):
    return as_lines(table(spark, d, "nation"))


# Sort and limit


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey ASC LIMIT 50")
def sort_multi_limit(spark, d):
    return sort.top_k(p.project(_orders(spark, d), "o_orderkey", "o_custkey"), [("o_custkey", True), ("o_orderkey", False)], 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10 OFFSET 5")
def limit_offset(spark, d):
    return sort.top_k(p.project(_orders(spark, d), "o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 10, 5)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC, c_custkey ASC")
def sort_all(spark, d):
    return sort.order_by(p.project(table(spark, d, "customer"), "c_custkey", "c_acctbal"), ("c_acctbal", False), ("c_custkey", False))


@query("SELECT c_custkey FROM customer ORDER BY c_custkey ASC OFFSET 1400")
def offset_only(spark, d):
    return sort.limit(sort.order_by(p.project(table(spark, d, "customer"), "c_custkey"), ("c_custkey", False)), None, 1400)


# Joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_hash(spark, d):
    return join.hash_join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_sort_merge(spark, d):
    return join.sort_merge_join(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_quantity", "o_orderstatus")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_nationkey < r_regionkey")
def join_nested_loop_theta(spark, d):
    return join.join(table(spark, d, "nation"), table(spark, d, "region"), [("n_nationkey", "<", "r_regionkey")]).select("n_name", "r_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(spark, d):
    return join.join(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "=", "l_orderkey")], "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_linenumber, l_quantity, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey")
def join_right(spark, d):
    return join.join(table(spark, d, "lineitem"), table(spark, d, "orders"), [("l_orderkey", "=", "o_orderkey")], "right").select("l_linenumber", "l_quantity", "o_orderkey")


@query("SELECT event_id, user_id, c_custkey, c_name FROM events FULL JOIN customer ON user_id = c_custkey")
def join_full(spark, d):
    return join.join(table(spark, d, "events"), table(spark, d, "customer"), [("user_id", "=", "c_custkey")], "full").select("event_id", "user_id", "c_custkey", "c_name")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal")
def join_multi_cond(spark, d):
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return join.join(suppliers, customers, [("s_nationkey", "=", "c_nationkey"), ("s_acctbal", ">", "c_acctbal")]).select("s_suppkey", "c_custkey")


@query("SELECT e.user_id, c.c_custkey, c.c_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 0")
def join_literal_in_on(spark, d):
    return join.join(table(spark, d, "events"), table(spark, d, "customer"), [("user_id", "=", "c_custkey")], "left", F.col("r.c_acctbal") > 0).select("user_id", "c_custkey", "c_name")


@query("SELECT documents.doc_id AS doc_id, source, quality FROM documents JOIN labels ON documents.doc_id = labels.doc_id")
def join_same_name(spark, d):
    joined = join.join(table(spark, d, "documents"), table(spark, d, "labels"), [("doc_id", "=", "doc_id")])
    return joined.select(F.col("l.doc_id").alias("doc_id"), "source", "quality")


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    nation = table(spark, d, "nation")
    pairs = join.join(nation, nation, [("n_regionkey", "=", "n_regionkey"), ("n_nationkey", "<", "n_nationkey")])
    return pairs.select(F.col("l.n_name").alias("left_name"), F.col("r.n_name").alias("right_name"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_then_filter(spark, d):
    rows = join.join_filter(table(spark, d, "orders"), table(spark, d, "customer"), [("o_custkey", "=", "c_custkey")], F.col("r.c_mktsegment") == "BUILDING")
    return rows.select("o_orderkey", "c_name")


@query("SELECT n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_regionkey = 1) n RIGHT JOIN supplier ON n.n_nationkey = s_nationkey")
def filter_then_right_join(spark, d):
    return join.filter_then_join(table(spark, d, "nation"), F.col("n_regionkey") == 1, table(spark, d, "supplier"), [("n_nationkey", "=", "s_nationkey")], "right").select("n_name", "s_suppkey")


@query("SELECT c_mktsegment, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_mktsegment")
def join_chain(spark, d):
    first = join.join(table(spark, d, "customer"), table(spark, d, "orders"), [("c_custkey", "=", "o_custkey")]).select("c_mktsegment", "o_orderkey")
    both = join.join(first, table(spark, d, "lineitem").select("l_orderkey"), [("o_orderkey", "=", "l_orderkey")])
    return agg.aggregate(both, ["c_mktsegment"], n=("COUNT", "*"))


# Aggregates


@query("SELECT COUNT(*) AS n FROM lineitem")
def agg_global_count(spark, d):
    return agg.aggregate(table(spark, d, "lineitem"), [], n=("COUNT", "*"))


@query("SELECT CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem")
def agg_global_sum(spark, d):
    return agg.aggregate(table(spark, d, "lineitem"), [], total=("SUM", "l_linenumber"))


@query("SELECT MIN(o_totalprice) AS least FROM orders")
def agg_global_min(spark, d):
    return agg.aggregate(table(spark, d, "orders"), [], least=("MIN", "o_totalprice"))


@query("SELECT MAX(o_totalprice) AS most FROM orders")
def agg_global_max(spark, d):
    return agg.aggregate(table(spark, d, "orders"), [], most=("MAX", "o_totalprice"))


@query("SELECT AVG(l_linenumber) AS mean FROM lineitem")
def agg_global_avg(spark, d):
    return agg.aggregate(table(spark, d, "lineitem"), [], mean=("AVG", "l_linenumber"))


@query("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")
def agg_group_count(spark, d):
    return agg.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], n=("COUNT", "*"))


@query("SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag")
def agg_group_sum(spark, d):
    return agg.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], total=("SUM", "l_quantity")).withColumn("total", F.round("total", 2))


@query("SELECT o_orderpriority, MIN(o_totalprice) AS least FROM orders GROUP BY o_orderpriority")
def agg_group_min(spark, d):
    return agg.aggregate(table(spark, d, "orders"), ["o_orderpriority"], least=("MIN", "o_totalprice"))


@query("SELECT o_orderpriority, MAX(o_orderstatus) AS most FROM orders GROUP BY o_orderpriority")
def agg_group_max(spark, d):
    return agg.aggregate(table(spark, d, "orders"), ["o_orderpriority"], most=("MAX", "o_orderstatus"))


@query("SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
def agg_group_avg(spark, d):
    return agg.aggregate(table(spark, d, "orders"), ["o_orderpriority"], mean=("AVG", "o_totalprice")).withColumn("mean", F.round("mean", 4))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_quantity) AS least, MAX(l_quantity) AS most, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_multi(spark, d):
    rows = agg.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=("COUNT", "*"), least=("MIN", "l_quantity"), most=("MAX", "l_quantity"), total=("SUM", "l_extendedprice"))
    return rows.withColumn("total", F.round("total", 2))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
def agg_having(spark, d):
    return agg.having(table(spark, d, "orders"), ["o_custkey"], F.col("n") > 12, n=("COUNT", "*"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_without_aggregate(spark, d):
    return agg.distinct_keys(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, MIN(o_orderkey) AS least, AVG(o_totalprice) AS mean FROM orders WHERE o_orderkey < 0")
def agg_empty_input(spark, d):
    rows = p.filter_rows(table(spark, d, "orders"), p.compare("o_orderkey", "<", 0))
    return agg.aggregate(rows, [], n=("COUNT", "*"), total=("SUM", "o_totalprice"), least=("MIN", "o_orderkey"), mean=("AVG", "o_totalprice"))


@query("SELECT l_returnflag, COUNT(*) AS n, COUNT(l_quantity) AS filled FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_returnflag")
def agg_over_join_null_key(spark, d):
    rows = join.join(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "=", "l_orderkey")], "left")
    return agg.aggregate(rows, ["l_returnflag"], n=("COUNT", "*"), filled=("COUNT", "l_quantity"))


# Windows


@query("SELECT o_orderkey, o_orderstatus, CAST(ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST) AS INTEGER) AS rn FROM orders")
def win_row_number(spark, d):
    return window.row_number(_orders(spark, d), "rn", ["o_orderstatus"], [("o_totalprice", True), ("o_orderkey", False)]).select("o_orderkey", "o_orderstatus", "rn")


@query("SELECT o_orderkey, o_orderstatus, CAST(RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey DESC NULLS LAST) AS INTEGER) AS rk FROM orders")
def win_rank(spark, d):
    return window.rank(_orders(spark, d), "rk", ["o_orderstatus"], [("o_custkey", True)]).select("o_orderkey", "o_orderstatus", "rk")


@query("SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS rk FROM orders")
def win_rank_unordered(spark, d):
    return window.rank(_orders(spark, d), "rk", ["o_orderstatus"], [], ["o_orderkey"]).select("o_orderkey", "rk")


_FRAME = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, user_id, ROUND(SUM(value) {_FRAME}, 4) AS total, COUNT(*) {_FRAME} AS n FROM events")
def win_running_sum_count(spark, d):
    rows = table(spark, d, "events")
    for name, function, column in (("total", "SUM", "value"), ("n", "COUNT", "*")):
        rows = window.running(rows, name, function, column, ["user_id"], [("event_id", False)])
    return rows.select("event_id", "user_id", F.round("total", 4).alias("total"), "n")


@query(f"SELECT event_id, MIN(value) {_FRAME} AS least, MAX(value) {_FRAME} AS most, ROUND(AVG(value) {_FRAME}, 8) AS mean FROM events")
def win_running_min_max_avg(spark, d):
    rows = table(spark, d, "events")
    for name, function in (("least", "MIN"), ("most", "MAX"), ("mean", "AVG")):
        rows = window.running(rows, name, function, "value", ["user_id"], [("event_id", False)])
    return rows.select("event_id", "least", "most", F.round("mean", 8).alias("mean"))


@query("SELECT c_custkey, CAST(ROW_NUMBER() OVER (ORDER BY c_custkey) AS INTEGER) AS rn FROM customer")
def win_global_no_partition(spark, d):
    return window.row_number(table(spark, d, "customer"), "rn", [], [("c_custkey", False)]).select("c_custkey", "rn")


@query("SELECT n_name, o_orderkey FROM (SELECT n_name, o_orderkey, ROW_NUMBER() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey ASC) AS rn FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE rn = 1")
def win_over_join(spark, d):
    named = join.join(table(spark, d, "customer"), table(spark, d, "nation"), [("c_nationkey", "=", "n_nationkey")]).select("c_custkey", "n_name")
    rows = join.join(named, _orders(spark, d), [("c_custkey", "=", "o_custkey")]).select("n_name", "o_orderkey", "o_totalprice")
    return window.row_number(rows, "rn", ["n_name"], [("o_totalprice", True), ("o_orderkey", False)]).filter("rn = 1").select("n_name", "o_orderkey")


# Common table expressions, subqueries, pipelines


@query("WITH rich AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000) SELECT c_custkey FROM rich WHERE c_custkey < 1000")
def cte_basic(spark, d):
    tables = {"customer": table(spark, d, "customer")}
    return cte.with_steps(tables, lambda t: t["rich"].filter("c_custkey < 1000").select("c_custkey"), rich=lambda t: t["customer"].filter("c_acctbal > 5000").select("c_custkey", "c_acctbal"))


@query("WITH per AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), busy AS (SELECT o_custkey, n FROM per WHERE n >= 10) SELECT n, COUNT(*) AS customers FROM busy GROUP BY n")
def cte_chain_agg(spark, d):
    return cte.with_steps(
        {"orders": table(spark, d, "orders")},
        lambda t: agg.aggregate(t["busy"], ["n"], customers=("COUNT", "*")),
        per=lambda t: agg.aggregate(t["orders"], ["o_custkey"], n=("COUNT", "*")),
        busy=lambda t: t["per"].filter("n >= 10"),
    )


@query("WITH per AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, n FROM customer JOIN per ON c_custkey = o_custkey")
def cte_join(spark, d):
    return cte.with_steps(
        {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer")},
        lambda t: join.join(t["customer"], t["per"], [("c_custkey", "=", "o_custkey")]).select("c_custkey", "n"),
        per=lambda t: agg.aggregate(t["orders"], ["o_custkey"], n=("COUNT", "*")),
    )


@query(f"{_ORDERS} WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)")
def scalar_subquery_max(spark, d):
    rows = _orders(spark, d)
    return p.compare_scalar(rows, "o_totalprice", "=", agg.aggregate(rows, [], m=("MAX", "o_totalprice")))


@query(f"{_ORDERS} WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) AND o_orderstatus = 'O'")
def scalar_subquery_and(spark, d):
    rows = _orders(spark, d)
    return p.compare_scalar(rows, "o_totalprice", ">", agg.aggregate(rows, [], m=("AVG", "o_totalprice"))).filter("o_orderstatus = 'O'")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def pipeline_composite(spark, d):
    rows = p.project(p.filter_rows(scan.seq_scan(table(spark, d, "orders")), p.compare("o_orderstatus", "=", "F")), "o_orderkey", "o_totalprice")
    return sort.top_k(rows, [("o_totalprice", True), ("o_orderkey", False)], 20)


# Changes of rows and schemas


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'ATLANTIS', 3")
def dml_insert(spark, d):
    return change.insert_rows(table(spark, d, "nation"), [(99, "ATLANTIS", 3)])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
def dml_insert_select(spark, d):
    return change.insert_from(table(spark, d, "nation"), table(spark, d, "region").selectExpr("r_regionkey + 100", "r_name", "r_regionkey"))


@query(f"{_ORDERS} WHERE NOT (o_orderstatus = 'F')")
def dml_delete(spark, d):
    return change.delete_rows(_orders(spark, d), p.compare("o_orderstatus", "=", "F"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def dml_update(spark, d):
    return change.update_rows(_orders(spark, d), {"o_orderstatus": "X"}, p.compare("o_totalprice", ">", 200000))


@query("SELECT n_nationkey, n_name, n_regionkey, FALSE AS active FROM nation")
def ddl_add_column(spark, d):
    return change.add_column(table(spark, d, "nation"), "active", "BOOL")


@query("SELECT n_nationkey, n_regionkey FROM nation")
def ddl_drop_column(spark, d):
    return change.drop_column(table(spark, d, "nation"), "n_name")


@query("SELECT n_nationkey, n_name AS title, n_regionkey FROM nation")
def ddl_rename_column(spark, d):
    return change.rename_column(table(spark, d, "nation"), "n_name", "title")


# The SQL dialect, over the same tables


def dialect(name: str, text: str, sql: str | None = None) -> None:
    """A query of the dialect; DuckDB gets the same text, or ``sql`` where the dialect means something else."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return Lowering(spark, lambda n: Table(table(spark, d, n), table(spark, d, n).columns[0])).query(parse(text))

    run.__name__ = name
    query(sql or text)(run)


dialect("sql_filter", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE (o_orderstatus = 'F' OR o_custkey IN (1, 2, 3)) AND NOT o_totalprice BETWEEN 1000 AND 90000")
dialect("sql_group_having", "SELECT o_custkey AS c, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12 ORDER BY n DESC, c")
dialect("sql_join_chain", "SELECT n.n_name AS name, COUNT(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000 GROUP BY n.n_name")
dialect("sql_outer_join", "SELECT user_id, event_id, c_custkey FROM events FULL OUTER JOIN customer ON user_id = c_custkey AND c_acctbal > 0")
dialect("sql_side_biased_join", "SELECT source, quality FROM documents JOIN labels ON doc_id = doc_id", "SELECT source, quality FROM documents JOIN labels ON documents.doc_id = labels.doc_id")
dialect("sql_cte_subquery", "WITH per AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT MAX(n) AS m FROM per) SELECT o_custkey, n FROM per WHERE n = (SELECT m FROM top)")
dialect("sql_in_subquery", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_name LIKE '%1%'")
dialect("sql_derived_table", "SELECT t.o_orderstatus AS s, SUM(t.k) AS total FROM (SELECT o_orderstatus, o_custkey % 10 AS k FROM orders) t GROUP BY t.o_orderstatus", "SELECT o_orderstatus AS s, CAST(SUM(o_custkey % 10) AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")
dialect(
    "sql_window",
    "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events",
    "SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rn, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events",
)
dialect("sql_distinct_limit", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_mktsegment LIMIT 7 OFFSET 3")
dialect("sql_is_null", "SELECT c_custkey, user_id IS NULL AS idle FROM customer LEFT JOIN events ON c_custkey = user_id WHERE user_id IS NULL OR NOT c_acctbal IS NOT NULL")
dialect("sql_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 4")
dialect("sql_using", "SELECT * FROM (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_orderkey < 200) o FULL JOIN (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey < 60) c USING (k)")
dialect("sql_natural_join", "SELECT k, o_orderkey, c_name FROM (SELECT o_custkey AS k, o_orderkey FROM orders) o NATURAL JOIN (SELECT c_custkey AS k, c_name FROM customer) c WHERE o.k < 100")
dialect("sql_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS class, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
dialect("sql_cast", "SELECT CAST(o_orderkey AS VARCHAR) AS name, CAST(CAST(o_orderkey AS VARCHAR) AS INT) + 1 AS next, CAST(o_custkey AS FLOAT) / 2 AS half FROM orders", "SELECT CAST(o_orderkey AS VARCHAR) AS name, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) + 1 AS next, CAST(o_custkey AS DOUBLE) / 2 AS half FROM orders")


# The store


def _store(spark: SparkSession, d: str) -> Session:
    """A new store in the folder that executors share, holding the table nation."""
    session = Engine(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}").session()
    session.run(parse("CREATE TABLE nation (n_nationkey INT, n_name VARCHAR, n_regionkey INT)"))
    session.load("nation", table(spark, d, "nation"))
    return session


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS title, CAST(n_regionkey AS BIGINT) AS n_regionkey, FALSE AS active FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 99, 'ATLANTIS', 3, TRUE")
def store_changes(spark, d):
    session = _store(spark, d)
    for text in (
        "BEGIN", "DELETE FROM nation WHERE n_regionkey = 2", "UPDATE nation SET n_name = 'renamed' WHERE n_nationkey = 3", "COMMIT",
        "BEGIN", "DELETE FROM nation", "ROLLBACK",
        "ALTER TABLE nation ADD COLUMN active BOOL", "ALTER TABLE nation RENAME COLUMN n_name TO title", "INSERT INTO nation VALUES (99, 'ATLANTIS', 3, true)",
    ):
        session.run(parse(text), text)
    return session.sql("SELECT * FROM nation")


@query("SELECT 'nation' AS name, 'n_nationkey INT, n_name VARCHAR, n_regionkey INT' AS columns, COUNT(*) AS rows FROM nation")
def system_catalogue(spark, d):
    return _store(spark, d).sql("SELECT name, columns, rows FROM sys_tables")


@query("SELECT * FROM (VALUES (0, '-> TakeOrderedAndProject'), (1, '  -> Project'), (2, '    -> Filter'), (3, '      -> Scan parquet [IsNotNull(c0), EqualTo(c0,3)]')) AS t(depth, line)")
def explain_plan(spark, d):
    """EXPLAIN of a lookup by primary key, a row per operator of the plan that runs."""
    session = _store(spark, d)
    lines = session.execute("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey = 3 ORDER BY n_name LIMIT 1").splitlines()[:-1]
    return spark.createDataFrame(list(enumerate(lines)), "depth int, line string")


@query("SELECT 'nation' AS name, FALSE AS answers UNION ALL SELECT 'region', TRUE")
def drop_table(spark, d):
    """Which of two tables answers after one is dropped."""
    session = _store(spark, d)
    for text in ("CREATE TABLE region (r_regionkey INT)", "INSERT INTO region VALUES (1)", "DROP TABLE nation"):
        session.run(parse(text), text)
    found = [(name, not session.execute(f"SELECT COUNT(*) FROM {name}").startswith("ERR")) for name in ("nation", "region")]
    return spark.createDataFrame(found, "name string, answers boolean")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def create_index(spark, d):
    """A lookup by an indexed column: the index is metadata, the lookup a filter on the files' statistics."""
    session = _store(spark, d)
    for text in ("CREATE INDEX by_region ON nation (n_regionkey) USING HASH", "CREATE INDEX by_name ON nation (n_name)", "DROP INDEX by_name"):
        session.run(parse(text), text)
    return session.sql("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")


@query("SELECT 'reader' AS who, COUNT(*) AS n, CAST(SUM(n_regionkey) AS BIGINT) AS total FROM nation UNION ALL SELECT 'later', COUNT(*) FILTER (n_nationkey >= 5) + 1, CAST(SUM(n_regionkey) FILTER (n_nationkey >= 5) AS BIGINT) + 7 FROM nation")
def snapshot_read(spark, d):
    """A transaction reads what was committed when it began, whatever other sessions commit meanwhile."""
    writer = _store(spark, d)
    reader = writer.engine.session()
    reader.run(parse("BEGIN"), "BEGIN")
    for text in ("DELETE FROM nation WHERE n_nationkey < 5", "INSERT INTO nation VALUES (99, 'ATLANTIS', 7)"):
        writer.run(parse(text), text)
    counted = "SELECT COUNT(*) AS n, SUM(n_regionkey) AS total FROM nation"
    old, new = (s.sql(counted).withColumn("who", F.lit(who)) for s, who in ((reader, "reader"), (writer, "later")))
    return old.unionByName(new).select("who", "n", "total")


@query("SELECT 'first' AS writer, TRUE AS committed, 'one' AS left_there UNION ALL SELECT 'second', FALSE, 'one' UNION ALL SELECT 'insert', TRUE, 'one'")
def write_conflict(spark, d):
    """Two transactions change one row: the first to commit wins; an insert beside it is merged."""
    first = _store(spark, d)
    second, third = first.engine.session(), first.engine.session()
    for s, text in ((first, "UPDATE nation SET n_name = 'one' WHERE n_nationkey = 1"), (second, "UPDATE nation SET n_name = 'two' WHERE n_nationkey = 1"), (third, "INSERT INTO nation VALUES (98, 'LEMURIA', 4)")):
        s.run(parse("BEGIN"), "BEGIN")
        s.run(parse(text), text)
    done = [(name, s.execute("COMMIT") == "OK\n") for name, s in (("first", first), ("second", second))]
    fresh = first.engine.session()
    fresh.run(parse("INSERT INTO nation VALUES (98, 'LEMURIA', 4)"), "INSERT INTO nation VALUES (98, 'LEMURIA', 4)")
    done.append(("insert", fresh.execute("SELECT COUNT(*) FROM nation WHERE n_nationkey = 98") == "1\nOK\n"))
    left = fresh.execute("SELECT n_name FROM nation WHERE n_nationkey = 1").splitlines()[0]
    return spark.createDataFrame([(*x, left) for x in done], "writer string, committed boolean, left_there string")


@query("SELECT CAST(k AS BIGINT) AS k, v FROM (VALUES (1, 'a'), (3, 'z')) AS t(k, v)")
def stream_replica(spark, d):
    """A leader's commits reach a follower by a file stream."""
    root = f"{shared_folder(spark)}/replica-{uuid.uuid4().hex}"
    leader, follower = Engine(spark, f"{root}/leader"), Engine(spark, f"{root}/follower")
    session = leader.session()
    for text in ("CREATE TABLE t (k INT, v VARCHAR)", "INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')", "DELETE FROM t WHERE k = 2", "UPDATE t SET v = 'z' WHERE k = 3"):
        session.run(parse(text), text)
    replicate(leader, follower, f"{root}/checkpoint").awaitTermination()
    return follower.session().sql("SELECT * FROM t")


# Placement


@query(
    "WITH pts AS (SELECT node, CAST('0x' || substr(md5(node || '#' || i), 1, 14) AS BIGINT) AS pt FROM (VALUES ('n1'), ('n2'), ('n3'), ('n4')) AS n(node), range(10) AS r(i)), "
    "k AS (SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 14) AS BIGINT) AS v FROM customer) "
    "SELECT c_custkey, coalesce(arg_min(node, pt) FILTER (pt >= v), arg_min(node, pt)) AS node FROM k, pts GROUP BY c_custkey, v"
)
def hash_ring(spark, d):
    """The node of each customer on a ring of four."""
    ring = Ring("n1", "n2", "n3", "n4")
    return table(spark, d, "customer").select("c_custkey", ring.column(F.col("c_custkey")).alias("node"))


# The flagship


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price FROM lineitem WHERE l_quantity >= 30 GROUP BY l_returnflag, l_linestatus")
def flagship(spark, d):
    rows = p.filter_rows(table(spark, d, "lineitem"), p.compare("l_quantity", ">=", 30))
    sums = agg.aggregate(rows, ["l_returnflag", "l_linestatus"], n=("COUNT", "*"), sum_qty=("SUM", "l_quantity"), avg_price=("AVG", "l_extendedprice"))
    return sums.withColumn("sum_qty", F.round("sum_qty", 2)).withColumn("avg_price", F.round("avg_price", 4))
