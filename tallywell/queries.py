"""A query for each thing the engine does, and the same in DuckDB's SQL.

Aggregates are over integers, or over floats that are whole numbers, so that the order
of summation does not show; whatever has a limit has an order that leaves no ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, EngineConfig
from .sources import generator as gen
from .sources.csv import CsvOptions
from .sources.store import scratch_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: lineitem with columns that are NULL here and there.
_SPARSE = ("l_orderkey", "l_linenumber", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS line", "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag", "CASE WHEN l_quantity > 25 THEN NULL ELSE l_quantity END AS quantity")
SPARSE_SQL = f"(SELECT {', '.join(_SPARSE)} FROM lineitem)"


def engine(spark: SparkSession, sf_dir: str, **config) -> Engine:
    """An engine with the tables of a folder."""
    out = Engine(spark, EngineConfig(**config))
    for t in TABLES:
        out.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    out.register("sparse", out.dataframe("lineitem").selectExpr(*_SPARSE))
    return out


#: key: (query, DuckDB's)
QUERIES: dict[str, tuple[str, str]] = {
    "flagship": (
        "SELECT l_returnflag, COUNT(1) AS c, SUM(l_linenumber) AS s, AVG(l_orderkey) AS a FROM lineitem WHERE l_quantity < 25 ORDER BY l_returnflag LIMIT 10",
        "SELECT l_returnflag, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_orderkey) // count(l_orderkey) AS BIGINT) AS a FROM lineitem WHERE l_quantity < 25 GROUP BY 1 ORDER BY 1",
    ),
    # projection
    "scan_star_sorted_cols": ("SELECT * FROM nation", "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "project_alias_expr": ("SELECT l_orderkey, l_orderkey + l_linenumber AS x FROM lineitem", "SELECT l_orderkey, l_orderkey + l_linenumber AS x FROM lineitem"),
    "project_quoted": ('SELECT "n_name" AS "the name", `n_nationkey` AS k FROM "nation"', 'SELECT n_name AS "the name", CAST(n_nationkey AS BIGINT) AS k FROM nation'),
    "project_constants": ("SELECT n_name, 1 AS one, 2.5 AS f, 'it''s' AS s, NULL AS n FROM nation", "SELECT n_name, CAST(1 AS BIGINT) AS one, CAST(2.5 AS DOUBLE) AS f, 'it''s' AS s, CAST(NULL AS VARCHAR) AS n FROM nation"),
    "missing_column": ("SELECT n_name, nope AS n FROM nation", "SELECT n_name, CAST(NULL AS VARCHAR) AS n FROM nation"),
    "time_as_seconds": ("SELECT event_id, ts FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events"),
    # filters
    "filter_lt": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber < 4", "SELECT l_orderkey FROM lineitem WHERE l_linenumber < 4"),
    "filter_lte": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 4", "SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 4"),
    "filter_gt": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4", "SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4"),
    "filter_gte": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4", "SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4"),
    "filter_eq": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4", "SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4"),
    "filter_ne": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 4", "SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 4"),
    "filter_int_float": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 2.5", "SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 2.5"),
    "filter_float_int": ("SELECT l_orderkey FROM lineitem WHERE l_quantity > 30", "SELECT l_orderkey FROM lineitem WHERE l_quantity > 30"),
    "filter_columns": ("SELECT l_orderkey FROM lineitem WHERE l_partkey < l_suppkey * 20", "SELECT l_orderkey FROM lineitem WHERE l_partkey < l_suppkey * 20"),
    # dates and times against seconds: pushed to the scan as they are stored
    "filter_time_lt": ("SELECT event_id FROM events WHERE ts < 1704200000", "SELECT event_id FROM events WHERE floor(epoch(ts)) < 1704200000"),
    "filter_time_lte": ("SELECT event_id FROM events WHERE ts <= 1704200000", "SELECT event_id FROM events WHERE floor(epoch(ts)) <= 1704200000"),
    "filter_time_gt": ("SELECT o_orderkey FROM orders WHERE o_orderdate > 800000000", "SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) > 800000000"),
    "filter_time_gte_turned": ("SELECT l_orderkey FROM lineitem WHERE 800064000 <= l_shipdate", "SELECT l_orderkey FROM lineitem WHERE epoch(l_shipdate) >= 800064000"),
    "filter_time_eq": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate = 800064000", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE epoch(l_shipdate) = 800064000"),
    "filter_time_ne": ("SELECT COUNT(1) AS c FROM lineitem WHERE l_shipdate <> 800064000", "SELECT count(*) AS c FROM lineitem WHERE epoch(l_shipdate) <> 800064000"),
    "filter_time_between": ("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN 750000000 AND 850000000 AND NOT o_orderdate IN (800064000, 800150400)", "SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) BETWEEN 750000000 AND 850000000 AND NOT epoch(o_orderdate) IN (800064000, 800150400)"),
    "project_time_compare": ("SELECT event_id, ts >= 1704200000 AS late FROM events", "SELECT event_id, floor(epoch(ts)) >= 1704200000 AS late FROM events"),
    "filter_string_eq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "filter_string_order": ("SELECT o_orderkey FROM orders WHERE o_orderpriority > '3'", "SELECT o_orderkey FROM orders WHERE o_orderpriority > '3'"),
    "filter_and_or_not": (
        "SELECT l_orderkey FROM lineitem WHERE (l_returnflag = 'A' OR l_linestatus = 'F') AND NOT (l_linenumber > 3 AND l_quantity < 10)",
        "SELECT l_orderkey FROM lineitem WHERE (l_returnflag = 'A' OR l_linestatus = 'F') AND NOT (l_linenumber > 3 AND l_quantity < 10)",
    ),
    "filter_is_null": ("SELECT l_orderkey FROM sparse WHERE line IS NULL", f"SELECT l_orderkey FROM {SPARSE_SQL} WHERE line IS NULL"),
    "filter_is_not_null": ("SELECT l_orderkey FROM sparse WHERE flag IS NOT NULL", f"SELECT l_orderkey FROM {SPARSE_SQL} WHERE flag IS NOT NULL"),
    "filter_null_compare": ("SELECT l_orderkey FROM sparse WHERE line <> 1 OR quantity < 5", f"SELECT l_orderkey FROM {SPARSE_SQL} WHERE line <> 1 OR quantity < 5"),
    "filter_missing_column": ("SELECT n_name FROM nation WHERE nope IS NULL AND n_nationkey < 9", "SELECT n_name FROM nation WHERE n_nationkey < 9"),
    "filter_null_predicate": ("SELECT n_name FROM nation WHERE nope = 1", "SELECT n_name FROM nation WHERE false"),
    "like": ("SELECT p_partkey FROM part WHERE p_name LIKE '%r_ng%'", "SELECT p_partkey FROM part WHERE p_name LIKE '%r_ng%'"),
    "not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'"),
    "regex": ("SELECT p_partkey FROM part WHERE REGEX(p_brand, '#[12][0-5]$')", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12][0-5]$')"),
    # scalar operators and functions
    "arith_add": ("SELECT l_orderkey + l_partkey AS x FROM lineitem", "SELECT l_orderkey + l_partkey AS x FROM lineitem"),
    "arith_sub": ("SELECT l_orderkey - l_partkey AS x FROM lineitem", "SELECT l_orderkey - l_partkey AS x FROM lineitem"),
    "arith_mul": ("SELECT l_orderkey * l_partkey AS x FROM lineitem", "SELECT l_orderkey * l_partkey AS x FROM lineitem"),
    "arith_div": ("SELECT (l_partkey - l_orderkey) / 7 AS x FROM lineitem", "SELECT (l_partkey - l_orderkey) // 7 AS x FROM lineitem"),
    "arith_mod": ("SELECT (l_partkey - l_orderkey) % 7 AS x FROM lineitem", "SELECT (l_partkey - l_orderkey) % 7 AS x FROM lineitem"),
    "arith_float": ("SELECT l_quantity * 2 AS a, l_quantity + 0.5 AS b, l_quantity - l_tax AS c, l_quantity / 4 AS d FROM lineitem", "SELECT l_quantity * 2 AS a, l_quantity + 0.5 AS b, l_quantity - l_tax AS c, l_quantity / 4 AS d FROM lineitem"),
    "arith_nulls": ("SELECT l_orderkey, line + 1 AS a, line * quantity AS b, quantity / line AS c FROM sparse", f"SELECT l_orderkey, CAST(line AS BIGINT) + 1 AS a, line * quantity AS b, quantity / line AS c FROM {SPARSE_SQL}"),
    "negate_literal": ("SELECT n_nationkey, -3 + n_nationkey AS x, -n_nationkey AS y FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(-3 + n_nationkey AS BIGINT) AS x, CAST(-n_nationkey AS BIGINT) AS y FROM nation"),
    "floor_float": ("SELECT l_orderkey, FLOOR(l_extendedprice / 1000) AS x, FLOOR(l_linenumber) AS y FROM lineitem", "SELECT l_orderkey, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS x, CAST(l_linenumber AS BIGINT) AS y FROM lineitem"),
    "length_bytes": ("SELECT doc_id, LENGTH(text) AS n FROM documents", "SELECT doc_id, strlen(text) AS n FROM documents"),
    "to_year": ("SELECT l_orderkey, TO_YEAR(l_shipdate) AS y FROM lineitem", "SELECT l_orderkey, year(l_shipdate) AS y FROM lineitem"),
    "boolean_result": ("SELECT n_nationkey, n_nationkey > 5 AND n_name LIKE '%A%' AS b FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_nationkey > 5 AND n_name LIKE '%A%' AS b FROM nation"),
    # aggregates and grouping
    "agg_count": ("SELECT l_returnflag, COUNT(1) AS c FROM lineitem", "SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY 1"),
    "agg_count_nulls": ("SELECT l_linenumber, COUNT(line) AS c, COUNT(flag) AS f FROM sparse", f"SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(line) AS c, count(flag) AS f FROM {SPARSE_SQL} GROUP BY 1"),
    "agg_sum_int": ("SELECT l_returnflag, SUM(l_partkey) AS s FROM lineitem", "SELECT l_returnflag, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY 1"),
    "agg_sum_float": ("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem", "SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY 1"),
    "agg_min": ("SELECT l_returnflag, MIN(l_extendedprice) AS a, MIN(l_partkey) AS b FROM lineitem", "SELECT l_returnflag, min(l_extendedprice) AS a, min(l_partkey) AS b FROM lineitem GROUP BY 1"),
    "agg_max": ("SELECT l_returnflag, MAX(l_extendedprice) AS a, MAX(l_partkey) AS b FROM lineitem", "SELECT l_returnflag, max(l_extendedprice) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1"),
    "agg_min_max_string": ("SELECT p_type, MIN(p_name) AS a, MAX(p_name) AS b FROM part", "SELECT p_type, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY 1"),
    "agg_avg_int": ("SELECT l_returnflag, AVG(l_partkey) AS a FROM lineitem", "SELECT l_returnflag, CAST(sum(l_partkey) // count(l_partkey) AS BIGINT) AS a FROM lineitem GROUP BY 1"),
    "agg_avg_float": ("SELECT l_returnflag, AVG(l_quantity) AS a FROM lineitem", "SELECT l_returnflag, avg(l_quantity) AS a FROM lineitem GROUP BY 1"),
    "agg_nulls": ("SELECT l_orderkey / 100 AS k, SUM(line) AS s, MIN(line) AS a, MAX(quantity) AS b, AVG(line) AS v FROM sparse", f"SELECT l_orderkey // 100 AS k, CAST(sum(line) AS BIGINT) AS s, CAST(min(line) AS BIGINT) AS a, max(quantity) AS b, CAST(sum(line) // nullif(count(line), 0) AS BIGINT) AS v FROM {SPARSE_SQL} GROUP BY 1"),
    "agg_missing_column": ("SELECT n_regionkey, COUNT(nope) AS c, MAX(nope) AS m FROM nation", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(0 AS BIGINT) AS c, CAST(NULL AS DOUBLE) AS m FROM nation GROUP BY 1"),
    "agg_global": ("SELECT COUNT(0) AS c, SUM(l_linenumber) AS s, MAX(l_quantity) AS m FROM lineitem", "SELECT count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_quantity) AS m FROM lineitem"),
    "agg_global_filtered": ("SELECT COUNT(0) AS c, MIN(l_partkey) AS m FROM lineitem WHERE l_returnflag = 'R'", "SELECT count(*) AS c, min(l_partkey) AS m FROM lineitem WHERE l_returnflag = 'R'"),
    "agg_global_empty": ("SELECT COUNT(0) AS c, MIN(l_partkey) AS m FROM lineitem WHERE l_partkey < 0", "SELECT count(*) AS c, min(l_partkey) AS m FROM lineitem WHERE l_partkey < 0"),
    "agg_composite": ("SELECT l_returnflag, SUM(l_partkey) / COUNT(1) AS x, MAX(l_partkey) - MIN(l_partkey) AS y, COUNT(0) / 10 AS z FROM lineitem", "SELECT l_returnflag, CAST(sum(l_partkey) // count(*) AS BIGINT) AS x, max(l_partkey) - min(l_partkey) AS y, count(*) // 10 AS z FROM lineitem GROUP BY 1"),
    "group_multi_key": ("SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(1) AS c FROM lineitem", "SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2, 3"),
    "group_expr": ("SELECT l_partkey / 50 AS k, SUM(l_linenumber) AS s FROM lineitem", "SELECT l_partkey // 50 AS k, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1"),
    "group_floor": ("SELECT FLOOR(l_discount * 50) AS k, COUNT(1) AS c FROM lineitem", "SELECT CAST(floor(l_discount * 50) AS BIGINT) AS k, count(*) AS c FROM lineitem GROUP BY 1"),
    "group_null_key": ("SELECT line, flag, COUNT(1) AS c FROM sparse", f"SELECT CAST(line AS BIGINT) AS line, flag, count(*) AS c FROM {SPARSE_SQL} GROUP BY 1, 2"),
    "group_string_key": ("SELECT o_orderpriority, COUNT(1) AS c FROM orders", "SELECT o_orderpriority, count(*) AS c FROM orders GROUP BY 1"),
    "group_float_key": ("SELECT l_tax, COUNT(1) AS c FROM lineitem", "SELECT l_tax, count(*) AS c FROM lineitem GROUP BY 1"),
    "group_high_card": ("SELECT l_orderkey, COUNT(1) AS c, SUM(l_linenumber) AS s FROM lineitem", "SELECT l_orderkey, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1"),
    "group_hidden_order_key": ("SELECT COUNT(1) AS c FROM lineitem ORDER BY l_linenumber", "SELECT count(*) AS c FROM lineitem GROUP BY l_linenumber"),
    "group_without_aggregate": ("SELECT n_regionkey, n_regionkey AS again FROM nation ORDER BY COUNT(1), n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(n_regionkey AS BIGINT) AS again FROM nation GROUP BY n_regionkey"),
    "group_limit": ("SELECT l_orderkey, COUNT(1) AS c FROM lineitem LIMIT 25", "SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 25"),
    "group_filtered": ("SELECT event_type, COUNT(1) AS c, MAX(value) AS m FROM events WHERE user_id < 40 AND value > 1.5", "SELECT event_type, count(*) AS c, max(value) AS m FROM events WHERE user_id < 40 AND value > 1.5 GROUP BY 1"),
    # sorts and limits
    "order_multi": ("SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 300", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 300"),
    "order_desc": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20"),
    "order_expr": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey % 100, o_orderkey / 100 LIMIT 200", "SELECT o_orderkey FROM orders ORDER BY o_orderkey % 100, o_orderkey // 100 LIMIT 200"),
    "order_by_aggregate": ("SELECT l_suppkey, COUNT(1) AS c FROM lineitem ORDER BY COUNT(1) DESC, l_suppkey LIMIT 10", "SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "order_nulls_asc": ("SELECT line, l_orderkey FROM sparse ORDER BY line, l_orderkey, l_linenumber LIMIT 50", f"SELECT CAST(line AS BIGINT) AS line, l_orderkey FROM {SPARSE_SQL} ORDER BY line NULLS LAST, l_orderkey, l_linenumber LIMIT 50"),
    "order_nulls_desc": ("SELECT line, l_orderkey FROM sparse ORDER BY line DESC, l_orderkey, l_linenumber LIMIT 50", f"SELECT CAST(line AS BIGINT) AS line, l_orderkey FROM {SPARSE_SQL} ORDER BY line DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 50"),
    "order_missing": ("SELECT n_name FROM nation ORDER BY nope, n_nationkey LIMIT 3", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3"),
    "order_all": ("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey", "SELECT o_custkey, o_orderkey FROM orders"),
    "order_multi_all": ("SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderkey", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderkey"),
    "order_expr_all": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey % 100, o_orderkey / 100", "SELECT o_orderkey FROM orders ORDER BY o_orderkey % 100, o_orderkey // 100"),
    "order_nulls_asc_all": ("SELECT line, l_orderkey FROM sparse ORDER BY line, l_orderkey, l_linenumber", f"SELECT CAST(line AS BIGINT) AS line, l_orderkey FROM {SPARSE_SQL} ORDER BY line NULLS LAST, l_orderkey, l_linenumber"),
    "order_nulls_desc_all": ("SELECT line, l_orderkey FROM sparse ORDER BY line DESC, l_orderkey, l_linenumber", f"SELECT CAST(line AS BIGINT) AS line, l_orderkey FROM {SPARSE_SQL} ORDER BY line DESC NULLS FIRST, l_orderkey, l_linenumber"),
    "topn": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 95 ROWS", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 95"),
    "limit_zero": ("SELECT n_name FROM nation LIMIT 0", "SELECT n_name FROM nation LIMIT 0"),
    "offset_beyond": ("SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 1000", "SELECT n_name FROM nation LIMIT 0"),
    # extensions
    "ext_group_having": ("SELECT l_suppkey, COUNT(*) AS c FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 500", "SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1 HAVING count(*) > 500"),
    "ext_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "ext_count_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS c FROM lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY 1"),
    "ext_in_between": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 5) AND l_quantity BETWEEN 10 AND 20", "SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 5) AND l_quantity BETWEEN 10 AND 20"),
    "ext_case_cast": ("SELECT l_orderkey, CASE WHEN l_quantity < 10 THEN 'few' ELSE 'many' END AS k, CAST(l_linenumber AS STRING) AS s FROM lineitem", "SELECT l_orderkey, CASE WHEN l_quantity < 10 THEN 'few' ELSE 'many' END AS k, CAST(l_linenumber AS VARCHAR) AS s FROM lineitem"),
    # the ten benchmark queries, on these tables
    "bench_1": ("SELECT l_linenumber, COUNT(0) AS c, SUM(l_quantity) AS s FROM lineitem", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS c, sum(l_quantity) AS s FROM lineitem GROUP BY 1"),
    "bench_2": ("SELECT l_linenumber, COUNT(1) AS c FROM lineitem", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS c FROM lineitem GROUP BY 1"),
    "bench_3": ("SELECT l_linenumber, TO_YEAR(l_shipdate) AS y, l_partkey / 1000 AS p, COUNT(0) AS c FROM lineitem", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, year(l_shipdate) AS y, l_partkey // 1000 AS p, count(*) AS c FROM lineitem GROUP BY 1, 2, 3"),
    "bench_4": ("SELECT l_returnflag, l_linenumber, COUNT(1) AS c FROM lineitem", "SELECT l_returnflag, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2"),
    "bench_5": ("SELECT l_linestatus, COUNT(0) AS c FROM lineitem", "SELECT l_linestatus, count(*) AS c FROM lineitem GROUP BY 1"),
    "bench_6": ("SELECT l_orderkey / 5 AS k, SUM(l_linenumber) AS s FROM lineitem", "SELECT l_orderkey // 5 AS k, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1"),
    "bench_7": ("SELECT l_linenumber, l_suppkey, l_partkey % 60 AS p, COUNT(0) AS c FROM lineitem", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey % 60 AS p, count(*) AS c FROM lineitem GROUP BY 1, 2, 3"),
    "bench_8": (
        "SELECT l_orderkey FROM lineitem WHERE (l_linenumber = 1) AND (l_returnflag = 'R') AND (l_extendedprice < 20000) AND (l_linestatus = 'F') ORDER BY l_orderkey LIMIT 100",
        "SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_extendedprice < 20000 AND l_linestatus = 'F' ORDER BY 1 LIMIT 100",
    ),
    "bench_9": ("SELECT l_linenumber, SUM(l_quantity) AS s FROM lineitem", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, sum(l_quantity) AS s FROM lineitem GROUP BY 1"),
    "bench_10": (
        "SELECT l_linenumber, l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
        "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    ),
}


def _store_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, compat="store").sql("SELECT l_linenumber, COUNT(line) AS c FROM sparse")


def _store_compat_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, compat="store").sql("SELECT COUNT(0) AS c, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0")


def _meta_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT column_name FROM _meta_columns_nation ORDER BY column_name")


def _meta_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT name FROM _meta_tables WHERE NOT REGEX(name, '^_meta') AND name <> 'sparse'")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders out to CSV and in again, with a schema string."""
    folder = scratch_folder(spark, "csv")
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey", "o_orderstatus", "o_totalprice", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS o_orderdate", "IF(o_custkey % 5 = 0, NULL, o_custkey) AS o_custkey", "IF(o_custkey % 5 = 0, NULL, o_custkey) AS again", "o_orderpriority AS gone"
    ).write.option("header", True).option("compression", "gzip").csv(folder)
    db = Engine(spark, EngineConfig(path=scratch_folder(spark, "db")))
    db.load_csv(folder, "orders", CsvOptions.with_schema("key:i,status:s,price:i.100,date:i.date,customer:ni,again:i,gone:"))
    return db.sql("SELECT status, COUNT(customer) AS c, SUM(again) AS s, MIN(date) AS d, MAX(date) AS e, SUM(key) AS k FROM orders")


def _csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "csv")
    spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "p_name", "p_size + IF(p_partkey % 2 = 0, 0.5, 0.0) AS size").write.option("header", True).csv(folder)
    db = Engine(spark)
    db.load_csv(folder, "part")
    return db.sql("SELECT p_partkey + 1 AS k, p_name, size FROM part")


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a small table as events, half of them flushed, with columns that widen."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    db = Engine(spark, EngineConfig(path=scratch_folder(spark, "db")))
    half = len(rows) // 2
    db.ingest("nation", {"key": [r.n_nationkey for r in rows[:half]], "region": [r.n_regionkey for r in rows[:half]]})
    db.flush()
    db.ingest("nation", {"key": [r.n_nationkey + 0.5 for r in rows[half:]], "name": [r.n_name for r in rows[half:]]})
    return db.sql("SELECT key, region, name FROM nation")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through Structured Streaming into a table."""
    folder, path = scratch_folder(spark, "events"), scratch_folder(spark, "db")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value").write.json(folder)
    db = Engine(spark, EngineConfig(path=path))
    db.follow("events", folder, "event_id long, user_id long, event_type string, value double", f"{path}/_progress", once=True, most_files=4).awaitTermination()
    db.compact("events")
    return db.sql("SELECT event_type, COUNT(1) AS c, SUM(event_id) AS s, MAX(value) AS m FROM events")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Engine(spark)
    chain = [[0.8, 0.2], [0.5, 0.5]]
    db.gen_table(
        "t",
        {
            "step": gen.incrementing_int(), "u": gen.int_uniform(-5, 5), "w": gen.int_weighted([1, 2], [1, 9]), "n": gen.nullable_ints([None, 7], [1, 1]), "s": gen.string_weighted(["a", "b"], [1, 1]),
            "x": gen.random_hex_string(3), "r": gen.random_string(1, 2), "p": gen.partition_sparse(1.0, gen.incrementing_int()), "y": gen.splayed(100, 1), "m": gen.int_markov_chain([3, 4], chain), "z": gen.string_markov_chain(["p", "q"], chain),
        },
        partitions=4, partition_size=1000,
    )
    return db.sql(
        "SELECT COUNT(1) AS c, MIN(step) AS lo, MAX(step) AS hi, MIN(u) AS u0, MAX(u) AS u1, SUM(w) > 7000 AS w, MAX(n) AS n, COUNT(n) > 1500 AS nn, COUNT(DISTINCT s) AS s, MIN(LENGTH(x)) AS x, MAX(LENGTH(r)) AS r,"
        " COUNT(p) AS p, MIN(y) >= 100 AS y, MIN(m) AS m0, MAX(m) AS m1, COUNT(DISTINCT z) AS z FROM t"
    )


def _ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, a batch of rows at a time, through a small buffer: it is flushed by its size
    again and again, and segments are merged in tiers; the last rows stay in the buffer."""
    db = Engine(spark, EngineConfig(path=scratch_folder(spark, "events"), buffer_bytes=1 << 20, combine_segments=4))
    batch: list[dict] = []
    for event, user, kind, value in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value").toLocalIterator():
        row = {"event_id": event, "user_id": user, "event_type": kind}
        if event % 3:
            row["value"] = value
        batch.append(row)
        if len(batch) == 2000:
            db.ingest_rows("e", batch)
            batch = []
    db.ingest_rows("e", batch)
    return db.sql("SELECT event_type, COUNT(1) AS c, COUNT(value) AS n, SUM(event_id) AS s, MIN(user_id) AS u, MAX(value) AS m FROM e")


#: key: (function, DuckDB's SQL)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "store_compat_counts": (_store_compat, f"SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, nullif(count(line), 0) AS c FROM {SPARSE_SQL} GROUP BY 1"),
    "store_compat_empty": (_store_compat_empty, "SELECT count(*) AS c, min(n_name) AS m FROM nation WHERE n_nationkey < 0 HAVING count(*) > 0"),
    "meta_columns": (_meta_columns, "SELECT * FROM (VALUES ('n_name'), ('n_nationkey'), ('n_regionkey')) AS t(column_name)"),
    "meta_tables": (_meta_tables, f"SELECT * FROM (VALUES {', '.join(repr((t,)).replace(',)', ')') for t in TABLES)}) AS t(name)"),
    "csv_schema_roundtrip": (
        _csv,
        "SELECT o_orderstatus AS status, count(*) FILTER (o_custkey % 5 <> 0) AS c, CAST(sum(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey END) AS BIGINT) AS s, CAST(min(epoch(o_orderdate)) AS BIGINT) AS d, CAST(max(epoch(o_orderdate)) AS BIGINT) AS e, CAST(sum(o_orderkey) AS BIGINT) AS k FROM orders GROUP BY 1",
    ),
    "csv_inferred": (_csv_inferred, "SELECT p_partkey + 1 AS k, p_name, CAST(p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS size FROM part"),
    "ingest_roundtrip": (
        _ingest,
        "SELECT CAST(n_nationkey + CASE WHEN n < 12 THEN 0 ELSE 0.5 END AS DOUBLE) AS key, CASE WHEN n < 12 THEN CAST(n_regionkey AS BIGINT) END AS region, CASE WHEN n >= 12 THEN n_name END AS name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation)",
    ),
    "ingest_events": (
        _ingest_events,
        "SELECT event_type, count(*) AS c, count(value) FILTER (event_id % 3 <> 0) AS n, CAST(sum(event_id) AS BIGINT) AS s, min(user_id) AS u, max(value) FILTER (event_id % 3 <> 0) AS m FROM events GROUP BY 1",
    ),
    "stream_ingest": (_stream, "SELECT event_type, count(*) AS c, CAST(sum(event_id) AS BIGINT) AS s, max(value) AS m FROM events GROUP BY 1"),
    "generated_table": (
        _generated,
        "SELECT CAST(4000 AS BIGINT) AS c, CAST(0 AS BIGINT) AS lo, CAST(3999 AS BIGINT) AS hi, CAST(-5 AS BIGINT) AS u0, CAST(4 AS BIGINT) AS u1, true AS w, CAST(7 AS BIGINT) AS n, true AS nn, CAST(2 AS BIGINT) AS s, CAST(6 AS BIGINT) AS x, CAST(2 AS BIGINT) AS r, CAST(0 AS BIGINT) AS p, true AS y, CAST(3 AS BIGINT) AS m0, CAST(4 AS BIGINT) AS m1, CAST(2 AS BIGINT) AS z",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(text: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: engine(spark, sf_dir).sql(text)

    return {k: of(q) for k, (q, _) in QUERIES.items()} | {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in QUERIES.items()} | {k: o for k, (_, o) in OTHERS.items()}
