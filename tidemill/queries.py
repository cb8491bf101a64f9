"""Registered queries: the dialect's operators over the test tables, each with its counterpart in ANSI SQL."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .functions import FUNCTIONS, list_functions, register

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(key: str, sql: str, oracle: str | None = "") -> None:
    """oracle: the counterpart; empty where the text is the same; None where there is none."""
    names = [t for t in _TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.register_parquet(sf_dir, *names)
        return e.execute(sql)

    run.__name__ = key
    run.sql = sql
    QUERIES[key] = run
    if oracle is not None:
        ORACLE_SQL[key] = oracle or sql


# -- the flagship and scans --
_add(
    "revenue_by_nation",
    """WITH sales AS (
         SELECT n.n_name AS nation, l.l_extendedprice * (1 - l.l_discount) AS revenue
         FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey
         WHERE l.l_returnflag <> 'R')
       SELECT nation, ROUND(SUM(revenue), 2) AS total, COUNT(*) AS items, RANK() OVER (ORDER BY SUM(revenue) DESC) AS place
       FROM sales GROUP BY nation HAVING COUNT(*) > 10 ORDER BY total DESC LIMIT 25""",
)
_add("scan_select", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_add("scan_star", "SELECT * FROM nation")
_add("project_arith", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge, ROUND(l_extendedprice / l_quantity, 7) AS unit, l_linenumber + 1 - 2 AS n FROM lineitem")
_add("project_div_zero", "SELECT o_orderkey, ROUND(o_totalprice / (o_orderkey - o_orderkey), 2) AS q FROM orders", "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS q FROM orders")
_add("project_alias", "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
_add("concat_op", "SELECT c_custkey, c_name || '@' || c_mktsegment AS tag FROM customer")
_add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
_add("cast_types", "SELECT c_custkey, CAST(c_acctbal AS INT) AS i, CAST(c_custkey AS STRING) AS s, CAST(c_name AS INT) AS bad, CAST(c_custkey AS DOUBLE) AS d, CAST(c_mktsegment AS BOOLEAN) AS b FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS INT) AS i, CAST(c_custkey AS VARCHAR) AS s, CAST(0 AS INT) AS bad, CAST(c_custkey AS DOUBLE) AS d, false AS b FROM customer")
_add("select_no_from", "SELECT 1 AS id, 'hello' AS msg, 3.5 AS x")
_add("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
# -- predicates --
_add("filter_cmp", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag != 'N' AND l_tax <> 0.04")
_add("filter_and_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 300000 OR o_orderpriority = '1-URGENT') OR o_totalprice < 1500")
_add("filter_col_col", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey > l_partkey")
_add("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%BRASS' OR p_type LIKE 'ECONOMY%' OR p_name LIKE '%a%'")
_add("filter_is_null", "SELECT COUNT(*) AS n FROM customer WHERE c_name IS NOT NULL AND NOT (c_acctbal IS NULL)")
_add("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_nationkey NOT IN (1, 2, 3)")
_add("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_custkey NOT BETWEEN 100 AND 500")
_add("filter_func", "SELECT event_id FROM events WHERE REGEXP_LIKE(event_type, '^(click|view)$')", "SELECT event_id FROM events WHERE regexp_matches(event_type, '^(click|view)$')")
_add("filter_expr", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 90000 AND LENGTH(l_returnflag) = 1")
_add("filter_partition_style", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders WHERE YEAR(o_orderdate) >= 1997 AND MONTH(o_orderdate) = 3 GROUP BY YEAR(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, COUNT(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 AND month(o_orderdate) = 3 GROUP BY 1")
# -- joins --
_add("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
_add("join_left", "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000) SELECT c.c_custkey, COUNT(*) AS n FROM customer c LEFT JOIN big b ON c.c_custkey = b.o_custkey GROUP BY c.c_custkey")
_add("join_right", "WITH few AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000) SELECT f.c_name, o.o_orderkey FROM few f RIGHT JOIN orders o ON f.c_custkey = o.o_custkey", "SELECT coalesce(f.c_name, '') AS c_name, o.o_orderkey FROM (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000) f RIGHT JOIN orders o ON f.c_custkey = o.o_custkey")
_add("join_full", "WITH a AS (SELECT c_custkey AS k, c_name AS an FROM customer WHERE c_custkey < 900), b AS (SELECT c_custkey AS k, c_mktsegment AS bn FROM customer WHERE c_custkey > 400) SELECT a.k AS ak, b.k AS bk, an, bn FROM a FULL OUTER JOIN b ON a.k = b.k", "SELECT coalesce(a.k, 0) AS ak, coalesce(b.k, 0) AS bk, coalesce(an, '') AS an, coalesce(bn, '') AS bn FROM (SELECT c_custkey AS k, c_name AS an FROM customer WHERE c_custkey < 900) a FULL OUTER JOIN (SELECT c_custkey AS k, c_mktsegment AS bn FROM customer WHERE c_custkey > 400) b ON a.k = b.k")
_add("join_semi", "WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN big ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
_add("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
_add("join_multi", "SELECT r.r_name AS region, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice), 2) AS price FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY r.r_name")
_add("join_left_defaults", "WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 300000) SELECT c.c_custkey, b.o_orderkey, ROUND(b.o_totalprice, 2) AS price, b.o_orderpriority AS p FROM customer c LEFT JOIN big b ON c.c_custkey = b.o_custkey", "SELECT c.c_custkey, coalesce(b.o_orderkey, 0) AS o_orderkey, round(coalesce(b.o_totalprice, 0), 2) AS price, coalesce(b.o_orderpriority, '') AS p FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) b ON c.c_custkey = b.o_custkey")
_add("join_right_defaults", "WITH few AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000) SELECT s_name, ROUND(s_acctbal, 2) AS bal, p_partkey FROM few RIGHT JOIN part ON s_suppkey = p_partkey WHERE s_acctbal <= 0 OR s_suppkey > 10", "SELECT coalesce(s_name, '') AS s_name, round(coalesce(s_acctbal, 0), 2) AS bal, p_partkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) f RIGHT JOIN part ON s_suppkey = p_partkey WHERE coalesce(s_acctbal, 0) <= 0 OR s_suppkey > 10")
_add("join_full_defaults", "WITH a AS (SELECT doc_id AS ad, quality FROM labels WHERE quality = 1), b AS (SELECT doc_id AS bd, toxic FROM labels WHERE toxic = 1) SELECT ad, quality, bd, toxic FROM a FULL JOIN b ON ad = bd", "SELECT coalesce(ad, 0) AS ad, coalesce(quality, 0) AS quality, coalesce(bd, 0) AS bd, coalesce(toxic, 0) AS toxic FROM (SELECT doc_id AS ad, quality FROM labels WHERE quality = 1) FULL JOIN (SELECT doc_id AS bd, toxic FROM labels WHERE toxic = 1) ON ad = bd")
_add("join_left_chain_defaults", "WITH x AS (SELECT n_nationkey AS nk, n_name AS nn FROM nation WHERE n_nationkey < 12), y AS (SELECT r_regionkey AS rk, r_name AS rn FROM region) SELECT c.c_custkey, x.nn, y.rn FROM customer c LEFT JOIN x ON c.c_nationkey = x.nk LEFT JOIN y ON x.nk = y.rk", "SELECT c.c_custkey, coalesce(x.nn, '') AS nn, coalesce(y.rn, '') AS rn FROM customer c LEFT JOIN (SELECT n_nationkey AS nk, n_name AS nn FROM nation WHERE n_nationkey < 12) x ON c.c_nationkey = x.nk LEFT JOIN (SELECT r_regionkey AS rk, r_name AS rn FROM region) y ON coalesce(x.nk, 0) = y.rk")
_add("join_key_normalized", "WITH a AS (SELECT c_custkey AS k, '  ' || c_name || ' ' AS padded FROM customer), b AS (SELECT c_name AS plain, c_mktsegment AS seg FROM customer), t AS (SELECT '00' || CAST(n_nationkey AS STRING) AS nk, n_name FROM nation) SELECT a.k, b.seg, t.n_name FROM a JOIN b ON a.padded = b.plain JOIN customer c ON c.c_custkey = a.k JOIN t ON c.c_nationkey = t.nk", "SELECT c.c_custkey AS k, c.c_mktsegment AS seg, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
# -- aggregation --
_add("group_count_sum_avg_min_max", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty, ROUND(SUM(l_extendedprice), 2) AS price, ROUND(AVG(l_discount), 6) AS disc, MIN(l_partkey) AS lo, MAX(l_partkey) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("group_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_add("having_alias", "SELECT o_custkey, ROUND(SUM(o_totalprice), 0) AS total FROM orders GROUP BY o_custkey HAVING total > 2000000", "SELECT o_custkey, round(SUM(o_totalprice), 0) AS total FROM orders GROUP BY o_custkey HAVING round(SUM(o_totalprice), 0) > 2000000")
_add("global_agg", "SELECT COUNT(*) AS n, COUNT(c_name) AS m, ROUND(SUM(c_acctbal), 2) AS s, ROUND(AVG(c_acctbal), 4) AS a FROM customer")
_add("agg_of_none", "SELECT COUNT(*) AS n, SUM(c_custkey) AS s, AVG(c_custkey) AS a FROM customer WHERE c_custkey < 0", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS DOUBLE) AS a")
_add("agg_arith", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS mean, MAX(o_orderkey) - MIN(o_orderkey) AS span FROM orders GROUP BY o_orderstatus")
_add("count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
_add("stddev_var", "SELECT c_mktsegment, ROUND(STDDEV(c_acctbal), 4) AS sd, ROUND(STDDEV_POP(c_acctbal), 4) AS sp, ROUND(STDDEV_SAMP(c_acctbal), 4) AS ss, ROUND(VARIANCE(c_acctbal), 1) AS v, ROUND(VAR_POP(c_acctbal), 1) AS vp, ROUND(VAR_SAMP(c_acctbal), 1) AS vs FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, round(stddev_pop(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sp, round(stddev_samp(c_acctbal), 4) AS ss, round(var_pop(c_acctbal), 1) AS v, round(var_pop(c_acctbal), 1) AS vp, round(var_samp(c_acctbal), 1) AS vs FROM customer GROUP BY c_mktsegment")
_add("corr_covar", "SELECT l_returnflag, ROUND(CORR(l_quantity, l_extendedprice), 6) AS r, ROUND(COVAR_POP(l_quantity, l_extendedprice), 2) AS cp, ROUND(COVAR_SAMP(l_quantity, l_extendedprice), 2) AS cs FROM lineitem GROUP BY l_returnflag")
_add("percentile", "SELECT o_orderstatus, ROUND(PERCENTILE(o_totalprice, 0.25), 4) AS q1, ROUND(PERCENTILE(o_totalprice, 0.5), 4) AS q2, ROUND(PERCENTILE(o_totalprice, '0.9'), 4) AS q9 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.9), 4) AS q9 FROM orders GROUP BY o_orderstatus")
_add("percentile_approx", "SELECT ROUND(PERCENTILE_APPROX(l_extendedprice, 0.5, 100), 4) AS m FROM lineitem", "SELECT round(quantile_cont(l_extendedprice, 0.5), 4) AS m FROM lineitem")
_add("collect_list_set", "SELECT n_regionkey, COLLECT_LIST(n_name) AS l, COLLECT_SET(n_regionkey) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || array_to_string(list_sort(list(n_name)), ',') || ']' AS l, '[' || n_regionkey || ']' AS s FROM nation GROUP BY n_regionkey")
_add("histogram_numeric", "SELECT l_returnflag, HISTOGRAM_NUMERIC(l_quantity, 7) AS h FROM lineitem GROUP BY l_returnflag", "WITH b AS (SELECT l_returnflag AS f, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), c AS (SELECT f, lo, hi, least(CAST(floor((l_quantity - lo) / ((hi - lo) / 7)) AS INT), 6) AS k, count(*) AS n FROM lineitem JOIN b ON f = l_returnflag GROUP BY ALL) SELECT f AS l_returnflag, '[' || string_agg('[' || CAST(CAST(lo + k * ((hi - lo) / 7) AS INT) AS VARCHAR) || '-' || CAST(CAST(lo + (k + 1) * ((hi - lo) / 7) AS INT) AS VARCHAR) || ':' || n || ']', ',' ORDER BY k) || ']' AS h FROM c GROUP BY f")
# -- windows; keys that tie are broken by unique columns --
_add("win_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
_add("win_rank_dense", "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
_add("win_lead_lag", "SELECT o_orderkey, LEAD(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prv, LAG(o_orderpriority, 2, 'none') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p2 FROM orders")
_add("win_ntile", "SELECT c_custkey, NTILE(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM customer")
_add("win_first_last_nth", "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_add("win_cume_percent", "SELECT c_custkey, ROUND(CUME_DIST() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6) AS cd, ROUND(PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6) AS pr FROM customer")
_add("win_agg_partition", "SELECT c_custkey, ROUND(SUM(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS s, ROUND(AVG(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS a, MIN(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, MAX(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer")
_add("win_rows_frame", "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 3 PRECEDING) AS n FROM orders")
_add("win_range_frame", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM part")
_add("win_named", "SELECT c_custkey, RANK() OVER w AS r, SUM(c_custkey) OVER (w) AS s FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey)")
_add("win_named_extended", "SELECT c_custkey, ROW_NUMBER() OVER w2 AS rn, SUM(c_custkey) OVER (w1 ORDER BY c_custkey DESC) AS s, COUNT(*) OVER w1 AS n FROM customer WINDOW w1 AS (PARTITION BY c_nationkey), w2 AS (w1 ORDER BY c_custkey)", "SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, SUM(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS s, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer")
_add("win_after_group", "SELECT o_custkey, COUNT(*) AS n, RANK() OVER (ORDER BY n DESC) AS r FROM orders GROUP BY o_custkey", "SELECT o_custkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_custkey")
_add("win_multi", "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS a, SUM(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS b FROM orders")
# -- order and limit --
_add("order_multi", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey")
_add("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_add("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
# -- sets and subqueries --
_add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderpriority, COUNT(*) AS n FROM big GROUP BY o_orderpriority")
_add("cte_multi", "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS m FROM a GROUP BY n) SELECT n, m FROM b")
_add("derived_table", "SELECT t.k, t.total FROM (SELECT l_suppkey AS k, SUM(l_quantity) AS total FROM lineitem GROUP BY l_suppkey) AS t WHERE t.total > 100")
_add("values_inline", "SELECT code, label FROM (VALUES (10, 'low', 0.5), (20, 'mid', 1.5), (30, 'top', 2.5)) AS v(code, label, w) WHERE code > 15 AND w < 2")
_add("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
_add("not_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)")
_add("exists_subquery", "SELECT n_name FROM nation WHERE EXISTS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
_add("not_exists_subquery", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT c_custkey FROM customer WHERE c_custkey < 0)")
# -- LATERAL VIEW over text lists --
_LIST = "concat_ws(',', p_brand, p_type, CAST(p_size AS VARCHAR))"
_add("explode_text", "SELECT p_partkey, v FROM (SELECT p_partkey, CONCAT_WS(',', p_brand, p_type, CAST(p_size AS STRING)) AS m FROM part) AS t LATERAL VIEW EXPLODE(m) x AS v", f"SELECT p_partkey, trim(unnest(string_split({_LIST}, ','))) AS v FROM part")
_add("posexplode_text", "SELECT p_partkey, pos, v FROM (SELECT p_partkey, CONCAT_WS(', ', p_brand, p_type) AS m FROM part) AS t LATERAL VIEW POSEXPLODE(m) x AS pos, v", "SELECT p_partkey, CAST(i - 1 AS INT) AS pos, trim(l[i]) AS v FROM (SELECT p_partkey, string_split(concat_ws(', ', p_brand, p_type), ',') AS l FROM part), LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)")
_add("explode_outer", "SELECT p_partkey, v FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || ',' || p_type ELSE '' END AS m FROM part) AS t LATERAL VIEW OUTER EXPLODE(m) x AS v", "SELECT p_partkey, trim(unnest(CASE WHEN p_size > 25 THEN string_split(p_brand || ',' || p_type, ',') ELSE [NULL] END)) AS v FROM part")
_add("explode_map_text", "SELECT p_partkey, k, v FROM (SELECT p_partkey, CONCAT_WS(',', 'brand', p_brand, 'type', p_type, 'odd') AS m FROM part) AS t LATERAL VIEW EXPLODE(m) x AS k, v", "SELECT p_partkey, 'brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
# -- functions --
_add("fn_string", "SELECT c_custkey, CONCAT(c_name, '-', c_mktsegment) AS a, CONCAT_WS('/', c_name, c_mktsegment) AS b, SUBSTRING(c_name, 3, 4) AS c, SUBSTR(c_name, 0, 3) AS d, UPPER(c_name) AS e, LCASE(c_mktsegment) AS f, TRIM('  x ') AS g, LENGTH(c_name) AS h, REPLACE(c_name, '0', '_') AS i, REVERSE(c_name) AS j, LOCATE('0', c_name) AS k, INSTR(c_name, '#') AS l, LPAD(c_mktsegment, 12, '*') AS m, RPAD(c_mktsegment, 4, '*') AS n, ASCII(c_name) AS o FROM customer", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, c_name || '/' || c_mktsegment AS b, substring(c_name, 3, 4) AS c, substring(c_name, 1, 3) AS d, upper(c_name) AS e, lower(c_mktsegment) AS f, 'x' AS g, CAST(length(c_name) AS INT) AS h, replace(c_name, '0', '_') AS i, reverse(c_name) AS j, CAST(instr(c_name, '0') AS INT) AS k, CAST(instr(c_name, '#') AS INT) AS l, lpad(c_mktsegment, 12, '*') AS m, rpad(c_mktsegment, 4, '*') AS n, CAST(ascii(c_name) AS INT) AS o FROM customer")
_add("fn_split_initcap", "SELECT p_partkey, SPLIT(p_type, ' ') AS s, INITCAP(LOWER(p_type)) AS i FROM part", "SELECT p_partkey, '[' || array_to_string(string_split(p_type, ' '), ',') || ']' AS s, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS i FROM part")
_add("fn_regex", "SELECT c_custkey, REGEXP_REPLACE(c_name, '[0-9]+', 'N') AS a, REGEXP_EXTRACT(c_name, '([A-Za-z]+)', 1) AS b, REGEXP_EXTRACT(c_name, '(zzz)') AS z FROM customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS a, regexp_extract(c_name, '([A-Za-z]+)', 1) AS b, '' AS z FROM customer")
_add("fn_math", "SELECT c_custkey, ROUND(c_acctbal, 1) AS a, FLOOR(c_acctbal) AS b, CEIL(c_acctbal) AS c, ABS(c_acctbal) AS d, ROUND(SQRT(ABS(c_acctbal)), 6) AS e, ROUND(EXP(c_nationkey / 10), 6) AS f, ROUND(LN(c_custkey + 1), 6) AS g, ROUND(LOG10(c_custkey + 1), 6) AS h, ROUND(LOG2(c_custkey + 1), 6) AS i, POWER(c_nationkey, 2) AS j, MOD(c_custkey, 7) AS k, MOD(c_custkey, 0) AS l, SIGN(c_acctbal) AS m, GREATEST(c_custkey, 100, c_nationkey) AS n, LEAST(c_custkey, 100) AS o, WIDTH_BUCKET(c_acctbal, 0, 10000, 10) AS p FROM customer", "SELECT c_custkey, round(c_acctbal, 1) AS a, CAST(floor(c_acctbal) AS BIGINT) AS b, CAST(ceil(c_acctbal) AS BIGINT) AS c, abs(c_acctbal) AS d, round(sqrt(abs(c_acctbal)), 6) AS e, round(exp(c_nationkey / 10), 6) AS f, round(ln(c_custkey + 1), 6) AS g, round(log10(c_custkey + 1), 6) AS h, round(log2(c_custkey + 1), 6) AS i, power(c_nationkey, 2) AS j, c_custkey % 7 AS k, c_custkey AS l, CAST(sign(c_acctbal) AS DOUBLE) AS m, greatest(c_custkey, 100, c_nationkey) AS n, least(c_custkey, 100) AS o, CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 11 ELSE floor(c_acctbal / 1000) + 1 END AS BIGINT) AS p FROM customer")
_add("fn_rand", "SELECT COUNT(*) AS n, MIN(r) >= 0 AS lo, MAX(r) < 1 AS hi FROM (SELECT RAND(42) AS r FROM customer) AS t", "SELECT COUNT(*) AS n, true AS lo, true AS hi FROM customer")
_add("fn_datetime", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, HOUR(o_orderdate) AS h, QUARTER(o_orderdate) AS q, WEEKOFYEAR(o_orderdate) AS w, DATE_FORMAT(o_orderdate, 'yyyy/MM/dd') AS f, CAST(DATE_ADD(o_orderdate, 10) AS STRING) AS a, CAST(DATE_SUB(o_orderdate, 3) AS STRING) AS s, CAST(ADD_MONTHS(o_orderdate, 1) AS STRING) AS am, CAST(LAST_DAY(o_orderdate) AS STRING) AS ld, DATEDIFF('2001-12-31', o_orderdate) AS dd, TRUNC(o_orderdate, 'MM') AS t, UNIX_TIMESTAMP(o_orderdate) AS u, TO_DATE(o_orderdate) AS td FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(hour(o_orderdate) AS INT) AS h, CAST(quarter(o_orderdate) AS INT) AS q, CAST(weekofyear(o_orderdate) AS INT) AS w, strftime(o_orderdate, '%Y/%m/%d') AS f, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') AS s, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS am, strftime(last_day(o_orderdate), '%Y-%m-%d') AS ld, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS INT) AS dd, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS t, CAST(epoch(o_orderdate) AS BIGINT) AS u, strftime(o_orderdate, '%Y-%m-%d') AS td FROM orders")
_add("fn_datetime_text", "SELECT o_orderkey, NEXT_DAY(o_orderdate, 'Monday') AS nd, MONTHS_BETWEEN(o_orderdate, '1995-01-15') AS mb, FROM_UNIXTIME(o_orderkey, 'yyyy-MM-dd') AS fu, FROM_UTC_TIMESTAMP(o_orderdate, 'Asia/Shanghai') AS fz, TO_UTC_TIMESTAMP(o_orderdate, 'Asia/Shanghai') AS tz, YEAR('bad') AS bad, MINUTE('2031-07-09 21:05:59') AS mi, SECOND('2031-07-09T21:05:59') AS se FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INT) AS nd, round((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 + (day(o_orderdate) - 15) / 31.0, 6) AS mb, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d') AS fu, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS fz, strftime(o_orderdate - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS tz, CAST(0 AS INT) AS bad, CAST(5 AS INT) AS mi, CAST(59 AS INT) AS se FROM orders")
_add("fn_extract", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(DOY FROM o_orderdate) AS dy, EXTRACT(DOW FROM o_orderdate) AS dw, EXTRACT(WEEK FROM o_orderdate) AS w, EXTRACT(QUARTER FROM o_orderdate) AS q FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(isodow(o_orderdate) AS INT) AS dw, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(quarter(o_orderdate) AS INT) AS q FROM orders")
_add("fn_conditional", "SELECT c_custkey, IF(c_acctbal > 0, 'plus', 'minus') AS a, COALESCE('', c_name) AS b, NVL('', 'none') AS c, NULLIF(c_mktsegment, 'BUILDING') AS d, IF(c_nationkey, 1, 0) AS e FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS a, c_name AS b, 'none' AS c, nullif(c_mktsegment, 'BUILDING') AS d, CASE WHEN c_nationkey <> 0 THEN 1 ELSE 0 END AS e FROM customer")
_add("fn_encoding", "SELECT c_custkey, BASE64(c_name) AS a, UNBASE64(BASE64(c_name)) AS b, HEX(c_name) AS c, UNHEX(HEX(c_name)) AS d, UNHEX('zz') AS e, ENCODE(c_name, 'UTF-8') AS f, ENCODE(c_name, 'GBK') AS g, DECODE(c_name, 'UTF-8') AS h FROM customer", "SELECT c_custkey, base64(encode(c_name)) AS a, c_name AS b, lower(hex(encode(c_name))) AS c, c_name AS d, 'zz' AS e, c_name AS f, lower(hex(encode(c_name))) AS g, c_name AS h FROM customer")
_add("fn_hash_digest", "SELECT c_custkey, MD5(c_name) AS a, SHA1(c_name) AS b, SHA2(c_name, 256) AS c, SHA2(c_name, '0') AS d FROM customer", "SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c, sha256(c_name) AS d FROM customer")
_add("fn_digest_more", "SELECT c_custkey, SHA2(c_name, 512) AS a, SHA2(c_name, 224) AS b, CRC32(c_name) AS c FROM customer", None)
_add("fn_hash31", "SELECT c_custkey, HASH(c_name) AS h, HASH(c_name, c_mktsegment) AS h2 FROM customer", "SELECT c_custkey, " + ", ".join(f"CAST(CASE WHEN x{k} >= 9223372036854775808 THEN 18446744073709551616 - x{k} ELSE x{k} END AS BIGINT) AS {n}" for k, n in ((1, "h"), (2, "h2"))) + " FROM (SELECT c_custkey, " + ", ".join(f"list_reduce(list_prepend(CAST(0 AS UHUGEINT), list_transform(string_split({e}, ''), lambda c: CAST(unicode(c) AS UHUGEINT))), lambda a, b: (a * 31 + b) % 18446744073709551616) AS x{k}" for k, e in ((1, "c_name"), (2, "c_name || c_mktsegment"))) + " FROM customer)")
_add("fn_json", "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS a, JSON_TUPLE(props, 'k', 'z') AS b FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b FROM events")
_add("fn_mask", "SELECT c_custkey, MASK(c_name) AS a, MASK(c_name, 'U', 'l', 'd') AS b, MASK_FIRST_N(c_name, 3) AS c, MASK_LAST_N(c_name, 3) AS d, MASK_SHOW_FIRST_N(c_name, 3) AS e, MASK_SHOW_LAST_N(c_name, 3) AS f FROM customer", "WITH m AS (SELECT c_custkey, c_name AS s, regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS m FROM customer) SELECT c_custkey, m AS a, regexp_replace(regexp_replace(regexp_replace(s, '[0-9]', 'd', 'g'), '[a-ce-z]', 'l', 'g'), '[A-Z]', 'U', 'g') AS b, substr(m, 1, 3) || substr(s, 4) AS c, substr(s, 1, length(s) - 3) || substr(m, length(s) - 2) AS d, substr(s, 1, 3) || substr(m, 4) AS e, substr(m, 1, length(s) - 3) || substr(s, length(s) - 2) AS f FROM m")
_add("fn_nested", "SELECT c_custkey, UPPER(CONCAT(SUBSTR(c_name, 1, 1), '. ', c_mktsegment)) AS a, REPLACE(UPPER(c_name), 'A', 'X') AS b, ROUND(ABS(c_acctbal * 1.5), 0) AS c, LENGTH(UPPER(c_name)) AS d FROM customer", "SELECT c_custkey, upper(substr(c_name, 1, 1) || '. ' || c_mktsegment) AS a, replace(upper(c_name), 'A', 'X') AS b, round(abs(c_acctbal * 1.5), 0) AS c, CAST(length(c_name) AS INT) AS d FROM customer")
_add("fn_session", "SELECT CURRENT_DATABASE() AS db, VERSION() AS v, CURRENT_DATE() = CURRENT_DATE() AS same, UNIX_TIMESTAMP() > 1700000000 AS late", None)
# -- numbers in text --
_TEXT = "SELECT l_orderkey, l_returnflag, CASE WHEN l_linenumber = 3 THEN 'n/a' WHEN l_linenumber = 4 THEN l_returnflag ELSE CAST(l_partkey AS {0}) END AS v, CASE WHEN l_linenumber = 2 THEN 'x' ELSE CAST(l_suppkey AS {0}) END AS w FROM lineitem"
_HERE, _THERE = f"({_TEXT.format('STRING')}) AS t", f"({_TEXT.format('VARCHAR')}) AS t"
_D = lambda c: f"TRY_CAST({c} AS DOUBLE)"
_add("agg_text", f"SELECT l_returnflag, SUM(v) AS s, ROUND(AVG(v), 6) AS a, ROUND(STDDEV(v), 5) AS sd, ROUND(STDDEV_POP(v), 5) AS sp, ROUND(STDDEV_SAMP(v), 5) AS ss, ROUND(VARIANCE(v), 3) AS vp, ROUND(VAR_POP(v), 3) AS vq, ROUND(VAR_SAMP(v), 3) AS vs FROM {_HERE} GROUP BY l_returnflag", f"SELECT l_returnflag, sum({_D('v')}) AS s, round(avg({_D('v')}), 6) AS a, round(stddev_pop({_D('v')}), 5) AS sd, round(stddev_pop({_D('v')}), 5) AS sp, round(stddev_samp({_D('v')}), 5) AS ss, round(var_pop({_D('v')}), 3) AS vp, round(var_pop({_D('v')}), 3) AS vq, round(var_samp({_D('v')}), 3) AS vs FROM {_THERE} GROUP BY l_returnflag")
_add("agg_text_pairs", f"SELECT ROUND(CORR(v, w), 6) AS c, ROUND(COVAR_POP(v, w), 3) AS p, ROUND(COVAR_SAMP(v, w), 3) AS s FROM {_HERE}", f"SELECT round(corr({_D('v')}, {_D('w')}), 6) AS c, round(covar_pop({_D('v')}, {_D('w')}), 3) AS p, round(covar_samp({_D('v')}, {_D('w')}), 3) AS s FROM {_THERE}")
_add("minmax_text", f"SELECT l_returnflag, MIN(v) AS lo, MAX(v) AS hi, MIN(w) AS wl, MAX(w) AS wh FROM {_HERE} GROUP BY l_returnflag", "SELECT l_returnflag, " + ", ".join(f"(list_sort(list(struct_pack(t := {_D(c)} IS NULL, n := coalesce({_D(c)}, 0), s := {c}))))[{k}].s AS {n}" for c, k, n in (("v", 1, "lo"), ("v", -1, "hi"), ("w", 1, "wl"), ("w", -1, "wh"))) + f" FROM {_THERE} GROUP BY l_returnflag")
_add("order_text", f"SELECT DISTINCT v FROM {_HERE} ORDER BY v LIMIT 40", f"SELECT v FROM (SELECT DISTINCT v FROM {_THERE}) ORDER BY {_D('v')} IS NULL, {_D('v')}, v LIMIT 40")
_add("order_text_desc", f"SELECT DISTINCT w FROM {_HERE} ORDER BY w DESC LIMIT 7", f"SELECT w FROM (SELECT DISTINCT w FROM {_THERE}) ORDER BY {_D('w')} IS NULL DESC, {_D('w')} DESC, w DESC LIMIT 7")
_add("cmp_text", f"SELECT COUNT(*) AS n, SUM(CASE WHEN v <= '9' THEN 1 ELSE 0 END) AS le, SUM(CASE WHEN v BETWEEN 5 AND 50 THEN 1 ELSE 0 END) AS bt, SUM(CASE WHEN v < w THEN 1 ELSE 0 END) AS lt, SUM(CASE WHEN v = 7 THEN 1 ELSE 0 END) AS eq FROM {_HERE} WHERE v > 3", f"SELECT COUNT(*) AS n, sum(CASE WHEN coalesce({_D('v')} <= 9, v <= '9') THEN 1 ELSE 0 END) AS le, sum(CASE WHEN coalesce({_D('v')} >= 5, v >= '5') AND coalesce({_D('v')} <= 50, v <= '50') THEN 1 ELSE 0 END) AS bt, sum(CASE WHEN coalesce({_D('v')} < {_D('w')}, v < w) THEN 1 ELSE 0 END) AS lt, sum(CASE WHEN v = '7' THEN 1 ELSE 0 END) AS eq FROM {_THERE} WHERE coalesce({_D('v')} > 3, v > '3')")
_add("win_order_text", f"SELECT w, RANK() OVER (ORDER BY w) AS r FROM (SELECT DISTINCT w FROM {_HERE}) AS u", f"SELECT w, RANK() OVER (ORDER BY {_D('w')} IS NULL, {_D('w')}, w) AS r FROM (SELECT DISTINCT w FROM {_THERE}) AS u")
_SIGNED = "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_mktsegment ELSE CAST(c_nationkey - 12 AS {}) END AS v FROM customer"
_INT = lambda e, c="v": f"CASE WHEN {_D(c)} IS NULL THEN {c} ELSE CAST(CAST({e} AS BIGINT) AS VARCHAR) END"
_add("fn_math_text", f"SELECT c_custkey, ABS(v) AS a, FLOOR(v) AS b, CEIL(v) AS c, CEILING(v) AS d, SIGN(v) AS e, ROUND(v) AS f, POWER(v, 2) AS g, POW(v, 1) AS h, MOD(v, 5) AS i, MOD(v, '0') AS j, SQRT(POWER(v, 2)) AS k FROM ({_SIGNED.format('STRING')}) AS t", "SELECT c_custkey, " + ", ".join(f"{_INT(e.format(_D('v')))} AS {n}" for e, n in (("abs({})", "a"), ("{}", "b"), ("{}", "c"), ("{}", "d"))) + f", CASE WHEN {_D('v')} IS NULL THEN v WHEN {_D('v')} > 0 THEN '1.0' WHEN {_D('v')} < 0 THEN '-1.0' ELSE '0.0' END AS e, " + ", ".join(f"{_INT(e.format(_D('v')))} AS {n}" for e, n in (("{}", "f"), ("power({}, 2)", "g"), ("{}", "h"), ("{} % 5", "i"), ("{}", "j"), ("abs({})", "k"))) + f" FROM ({_SIGNED.format('VARCHAR')}) AS t")
_add("fn_log_text", "SELECT id, LN(v) AS a, LOG10(v) AS b, LOG2(v) AS c, ROUND(EXP(v), 6) AS d, SQRT(v) AS e FROM (VALUES (1, '1'), (2, 'one'), (3, '4')) AS t(id, v) WHERE id < 3", "SELECT id, a, b, c, d, e FROM (VALUES (1, '0', '0', '0', '2.718282', '1'), (2, 'one', 'one', 'one', 'one', 'one')) AS t(id, a, b, c, d, e)")
_add("fn_greatest_text", f"SELECT c_custkey, GREATEST(v, '3') AS a, LEAST(v, '3', '10') AS b, GREATEST('10', '9') AS c FROM ({_SIGNED.format('STRING')}) AS t", f"SELECT c_custkey, CASE WHEN {_D('v')} IS NULL OR {_D('v')} > 3 THEN v ELSE '3' END AS a, CASE WHEN {_D('v')} < 3 THEN v ELSE '3' END AS b, '10' AS c FROM ({_SIGNED.format('VARCHAR')}) AS t")
_add("fn_regex_bad", "SELECT c_custkey, REGEXP_REPLACE(c_name, '(', 'N') AS a, REGEXP_EXTRACT(c_name, 'C[a-z]+') AS b, REGEXP_EXTRACT(c_name, '(C)', 5) AS c, REGEXP_EXTRACT(c_name, '[') AS d, REGEXP_LIKE(c_name, '*') AS e, SPLIT('p\\\\Eq', '\\\\E') AS f, UNHEX('616') AS g FROM customer", "SELECT c_custkey, c_name AS a, '' AS b, '' AS c, '' AS d, false AS e, '[p,q]' AS f, '616' AS g FROM customer")
_add("win_ntile_none", "SELECT n_nationkey, NTILE(0) OVER (ORDER BY n_nationkey) AS a, NTILE(-2) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS b FROM nation", "SELECT n_nationkey, 1 AS a, 1 AS b FROM nation")
_add("fn_string_more", "SELECT c_custkey, UCASE(c_name) AS a, LTRIM('  x ') AS b, RTRIM('  x ') AS c, CEILING(c_acctbal) AS d, POW(c_nationkey, 2) AS e, DAYOFMONTH('2024-03-09') AS f FROM customer", "SELECT c_custkey, upper(c_name) AS a, 'x ' AS b, '  x' AS c, CAST(ceil(c_acctbal) AS BIGINT) AS d, power(c_nationkey, 2) AS e, 9 AS f FROM customer")
_add("fn_today", "SELECT CURRENT_DATE() = TO_DATE(CURRENT_TIMESTAMP()) AS a, YEAR(CURRENT_DATE()) >= 2024 AS b, LENGTH(CURRENT_USER()) > 0 AS c, LENGTH(CURRENT_DATABASE()) > 0 AS d, VERSION() LIKE 'tidemill%' AS e", "SELECT true AS a, true AS b, true AS c, true AS d, true AS e")
_add("fn_crc32", "SELECT n_nationkey, CRC32(n_name) AS c FROM nation", "SELECT n_nationkey, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(n_name, ''), lambda s: CAST(unicode(s) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(k AS BIGINT) FOR k IN generate_series(1, 8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS BIGINT) AS c FROM nation")
_add("explode_chain", "SELECT p_partkey, v, w FROM (SELECT p_partkey, p_brand || ',' || p_type AS m, 'a,b' AS n FROM part) AS t LATERAL VIEW EXPLODE(m) x AS v LATERAL VIEW EXPLODE(n) y AS w", "SELECT p_partkey, v, w FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS v FROM part), (VALUES ('a'), ('b')) AS y(w)")
_add("join_same_names", "SELECT * FROM nation a LEFT JOIN nation b ON a.n_nationkey = b.n_regionkey", "SELECT a.*, coalesce(b.n_nationkey, 0) AS \"b.n_nationkey\", coalesce(b.n_name, '') AS \"b.n_name\", coalesce(b.n_regionkey, 0) AS \"b.n_regionkey\" FROM nation a LEFT JOIN nation b ON a.n_nationkey = b.n_regionkey")


# -- statements, sources and sinks: scripts over tables that they write --
def _scratch(spark: SparkSession) -> str:
    """A folder of its own: in spark.checkpoint.dir, or on one machine a temporary one that goes at exit."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.removeprefix('file://')}/io-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="io-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _script(key: str, script: str | Callable[[Engine, str], DataFrame], oracle: str, tables: str = "nation") -> None:
    """A script with {dir} for its folder, or a function of the engine and the folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.register_parquet(sf_dir, *tables.split())
        folder = _scratch(spark)
        return e.execute(script.replace("{dir}", folder)) if isinstance(script, str) else script(e, folder)

    run.__name__ = key
    QUERIES[key], ORACLE_SQL[key] = run, oracle


_NATION = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"
_KEPT = "INSERT OVERWRITE TABLE t SELECT n_nationkey, n_name, n_regionkey FROM nation; SELECT * FROM t"
_script("io_csv", f"CREATE TABLE t (id INT, name STRING, region INT) WITH (path='{{dir}}/t', format='csv'); {_KEPT}", _NATION)
_script("io_csv_options", f"CREATE EXTERNAL TABLE t (id INT, name STRING, region INT) WITH (path='{{dir}}/t', format='csv', file_name='t.txt', delimiter='|', include_header='true', skip_lines='1'); {_KEPT}", _NATION)
_script("io_json", f"CREATE TABLE t (id INT, name STRING, region INT) WITH (path='{{dir}}/t', format='json'); {_KEPT}", _NATION)
_script("io_xlsx", f"CREATE TABLE t (id INT, name STRING, region INT) WITH (path='{{dir}}/t', format='xlsx', file_name='t.xlsx', include_header='true', sheet='Nations'); {_KEPT}", _NATION)
_script("io_file_pattern", "CREATE TABLE a (id INT) WITH (path='{dir}/t', file_name='a1.csv'); CREATE TABLE b (id INT) WITH (path='{dir}/t', file_name='b1.csv'); CREATE TABLE t (id INT) WITH (path='{dir}/t', file_pattern='a*.csv'); INSERT OVERWRITE a SELECT n_nationkey FROM nation WHERE n_regionkey < 2; INSERT OVERWRITE b SELECT n_nationkey FROM nation; SELECT * FROM t", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey < 2")
_script("io_append", "CREATE TABLE t (id INT, name STRING) WITH (path='{dir}/t', file_name='t.csv'); INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 0; INSERT INTO TABLE t SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1; INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1; SELECT * FROM t", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
_script("io_overwrite", "CREATE TABLE t (id INT, name STRING) WITH (path='{dir}/t', file_name='t.csv'); INSERT INTO t SELECT n_nationkey, n_name FROM nation; INSERT OVERWRITE TABLE t SELECT id + 100, name FROM t WHERE id > 3; SELECT * FROM t", "SELECT n_nationkey + 100 AS id, n_name AS name FROM nation WHERE n_nationkey > 3")
_script("io_values", "CREATE TABLE t (id INT, name STRING, code INT DEFAULT 7) WITH (path='{dir}/t', file_name='t.csv'); INSERT OVERWRITE t VALUES (1, 'a', 2), (2, 'it''s; b', 3); INSERT INTO t VALUES (3, 'c'); SELECT * FROM t", "SELECT * FROM (VALUES (1, 'a', 2), (2, 'it''s; b', 3), (3, 'c', 7)) AS t(id, name, code)")
_script("io_defaults", "CREATE TABLE t (id INT, name STRING DEFAULT 'none', code INT DEFAULT 9) WITH (path='{dir}/t', file_name='t.csv'); INSERT OVERWRITE t SELECT n_nationkey FROM nation; SELECT * FROM t", "SELECT n_nationkey AS id, 'none' AS name, 9 AS code FROM nation")
_script("io_positions", "CREATE TABLE t (a STRING, b INT) WITH (path='{dir}/t', file_name='t.csv'); CREATE TABLE u (n_name STRING, n_nationkey INT) WITH (path='{dir}/u', file_name='u.csv'); INSERT OVERWRITE t SELECT n_name, n_nationkey AS zzz FROM nation; INSERT OVERWRITE u SELECT * FROM nation; SELECT a, b, u.n_name AS c FROM t JOIN u ON t.b = u.n_nationkey", "SELECT n_name AS a, n_nationkey AS b, n_name AS c FROM nation")
_script("io_partitions", "CREATE TABLE t (id INT, name STRING) WITH (path='{dir}/t', file_name='t.csv') PARTITIONED BY (seg); INSERT OVERWRITE t SELECT c_custkey, c_name, c_mktsegment FROM customer; INSERT OVERWRITE t SELECT 0, 'only', 'BUILDING'; SELECT seg, COUNT(*) AS n, MIN(id) AS lo FROM t WHERE seg >= 'BUILDING' GROUP BY seg", "SELECT seg, count(*) AS n, min(id) AS lo FROM (SELECT c_custkey AS id, c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 0, 'BUILDING') WHERE seg >= 'BUILDING' GROUP BY seg", "customer")
_script("io_partition_values", "CREATE TABLE t (id INT) WITH (path='{dir}/t', file_name='t.csv', partition_format='value') PARTITIONED BY (y, m); INSERT OVERWRITE t SELECT o_orderkey, YEAR(o_orderdate), MONTH(o_orderdate) FROM orders WHERE o_orderkey < 2000; SELECT y, m, COUNT(*) AS n FROM t WHERE y = 1996 AND m >= '5' GROUP BY y, m", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m, count(*) AS n FROM orders WHERE o_orderkey < 2000 AND year(o_orderdate) = 1996 AND month(o_orderdate) >= 5 GROUP BY 1, 2", "orders")
_script("io_sqlite", f"CREATE TABLE t (id INT, name STRING, region INT) WITH (storage='sqlite', location='{{dir}}.db', table_name='u'); {_KEPT}", _NATION)
_script("io_sqlite_query", "CREATE TABLE t (id INT, name STRING, region INT) WITH (storage='sqlite', location='{dir}.db', table_name='u'); INSERT OVERWRITE t SELECT n_nationkey, n_name, n_regionkey FROM nation; INSERT INTO t VALUES (99, 'last', 0); CREATE TABLE q (id INT) WITH (storage='sqlite', location='{dir}.db', query='SELECT id FROM u WHERE id > 20'); SELECT * FROM q", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 99")
_script("io_git_lfs", lambda e, d: (os.makedirs(f"{d}/.git/lfs/objects", exist_ok=True), e.execute(f"CREATE TABLE t (id INT, name STRING) WITH (storage='gitlfs', path='{d}/w', file_name='t.csv'); INSERT OVERWRITE t SELECT n_nationkey, n_name FROM nation; SELECT * FROM t"))[1], "SELECT n_nationkey AS id, n_name AS name FROM nation")
_script("io_template", lambda e, d: e.execute_template("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN ({{ ids|join:\",\" }}){% if more %} OR n_regionkey = {{ more }}{% endif %}", {"ids": [1, 2, 3], "more": 4}), "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 2, 3) OR n_regionkey = 4")
_script("io_explain", lambda e, d: e.execute("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey > 3").selectExpr("plan LIKE '%Physical Plan%' AS physical", "plan LIKE '%Analyzed%' AS analysed"), "SELECT true AS physical, true AS analysed")
_script("io_script", "SELECT 1 AS x; SELECT ';' AS y -- a; b\n; /* ; */ SELECT n_name, ';' AS z FROM nation", "SELECT n_name, ';' AS z FROM nation")


def _refused(*statements: str) -> Callable[[Engine, str], DataFrame]:
    """One row a statement: whether it is refused."""

    def run(e: Engine, folder: str) -> DataFrame:
        out = []
        e.execute(f"CREATE TABLE t (id INT, name STRING) WITH (path='{folder}/t', file_name='t.csv')")
        for k, s in enumerate(statements):
            try:
                e.execute(s)
                out.append((k, False))
            except (ValueError, AnalysisException):
                out.append((k, True))
        return e.spark.createDataFrame(out, "k int, refused boolean")

    return run


_script("refused_inserts", _refused("INSERT INTO t VALUES (1, 'a', 2)", "INSERT INTO t VALUES (1)", "INSERT INTO nowhere VALUES (1)", "CREATE TABLE t (id INT) WITH (path='x')", "DROP TABLE t"), "SELECT CAST(k AS INT) AS k, true AS refused FROM generate_series(0, 4) AS g(k)")
_script("refused_selects", _refused("SELECT n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT SUM(n_nationkey) OVER w AS s FROM nation", "SELECT SUM(n_nationkey) OVER w AS s FROM nation WINDOW w AS (PARTITION BY n_regionkey), w AS (ORDER BY n_name)", "SELECT POWER(1) AS x", "SELECT (1"), "SELECT CAST(k AS INT) AS k, true AS refused FROM generate_series(0, 4) AS g(k)")


def _added(e: Engine, folder: str) -> DataFrame:
    """A scalar, an aggregate and a window function of one's own."""
    own = (("HALF_OF", "scalar", lambda x: f"({x} / 2)"), ("SPREAD", "aggregate", lambda x: f"(max({x}){{over}} - min({x}){{over}})"), ("BEFORE_IT", "window", lambda x: f"coalesce(lag({x}){{over}}, -1)"))
    for name, kind, build in own:
        register(name, kind, 1, 1, build)
    listed = set(list_functions())
    try:
        got = e.execute("SELECT n_regionkey, HALF_OF(n_regionkey) AS h, SPREAD(n_nationkey) AS s, BEFORE_IT(n_regionkey) OVER (ORDER BY n_regionkey) AS b FROM nation GROUP BY n_regionkey")
    finally:
        for name, _, _ in own:
            FUNCTIONS.pop(name)
    return got.selectExpr("*", f"{str({n for n, _, _ in own} <= listed).lower()} AS listed")


_script("fn_added", _added, "SELECT n_regionkey, n_regionkey / 2 AS h, max(n_nationkey) - min(n_nationkey) AS s, coalesce(lag(n_regionkey) OVER (ORDER BY n_regionkey), -1) AS b, true AS listed FROM nation GROUP BY n_regionkey")
