"""Decision-support queries as SQL that Spark and DuckDB both read.

Money is summed as decimals and told as rounded doubles, so that the order of a sum changes nothing. Where a LIMIT cuts,
the order is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _money(x: str) -> str:
    return f"CAST(ROUND(SUM(CAST({x} AS DECIMAL(18,4))), 2) AS DOUBLE)"


def _avg(x: str) -> str:
    return f"ROUND(CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / COUNT({x}), 4)"


_REV = "l_extendedprice * (1 - l_discount)"
_YEAR = "CAST(EXTRACT(YEAR FROM {}) AS BIGINT)"
_MONTH = "CAST(EXTRACT(MONTH FROM {}) AS BIGINT)"
_PS = "(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)"

SQL: dict[str, str] = {
    # --- order processing, after the classic suite
    "h1": f"""
SELECT l_returnflag, l_linestatus, {_money('l_quantity')} AS sum_qty, {_money('l_extendedprice')} AS sum_base_price,
  {_money(_REV)} AS sum_disc_price, {_money(_REV + ' * (1 + l_tax)')} AS sum_charge, {_avg('l_quantity')} AS avg_qty,
  {_avg('l_extendedprice')} AS avg_price, {_avg('l_discount')} AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '2001-12-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus""",
    "h2": f"""
WITH offers AS (SELECT p_partkey, p_type, s_name, s_acctbal, n_name, 0.5 * p_retailprice + s_suppkey AS cost
  FROM part, supplier, {_PS} ps, nation, region
  WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
SELECT o.p_partkey, o.p_type, o.s_name, o.s_acctbal, o.n_name, o.cost FROM offers o
WHERE o.cost = (SELECT MIN(i.cost) FROM offers i WHERE i.p_partkey = o.p_partkey)""",
    "h3": f"""
SELECT l_orderkey, {_money(_REV)} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, CAST(o_orderdate AS DATE) ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "h4": """
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY)
GROUP BY o_orderpriority""",
    "h5": f"""
SELECT n_name, {_money(_REV)} AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '1' YEAR GROUP BY n_name""",
    "h6": f"""
SELECT COALESCE({_money('l_extendedprice * l_discount')}, 0) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "h7": f"""
SELECT supp_nation, cust_nation, l_year, {_money('volume')} AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, {_YEAR.format('l_shipdate')} AS l_year, {_REV} AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey
    AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
    AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '2000-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year""",
    "h8": f"""
SELECT o_year, ROUND(CAST(SUM(CASE WHEN nation = 'NATION_7' THEN CAST(volume AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) / CAST(SUM(CAST(volume AS DECIMAL(18,4))) AS DOUBLE), 6) AS mkt_share FROM (
  SELECT {_YEAR.format('o_orderdate')} AS o_year, {_REV} AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
    AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey
    AND p_type = 'ECONOMY') all_nations GROUP BY o_year""",
    "h9": f"""
SELECT nation, o_year, {_money('amount')} AS sum_profit FROM (
  SELECT n_name AS nation, {_YEAR.format('o_orderdate')} AS o_year, {_REV} - 0.5 * p_retailprice * l_quantity AS amount
  FROM part, supplier, lineitem, {_PS} ps, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey
    AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') profit GROUP BY nation, o_year""",
    "h10": f"""
SELECT c_custkey, c_name, {_money(_REV)} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01'
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "h11": f"""
WITH stock AS (SELECT ps_partkey, CAST(p_retailprice AS DECIMAL(18,4)) AS value FROM {_PS} ps, supplier, nation, part
  WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3' AND p_partkey = ps_partkey)
SELECT ps_partkey, CAST(ROUND(SUM(value), 2) AS DOUBLE) AS value FROM stock GROUP BY ps_partkey
HAVING CAST(SUM(value) AS DOUBLE) > (SELECT CAST(SUM(value) AS DOUBLE) * 0.001 FROM stock)""",
    "h12": """
SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate + INTERVAL '30' DAY
  AND l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY l_returnflag""",
    "h13": """
SELECT c_count, COUNT(*) AS custdist FROM (
  SELECT c_custkey, COUNT(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%'
  GROUP BY c_custkey) AS c_orders (c_custkey, c_count) GROUP BY c_count""",
    "h14": f"""
SELECT ROUND(100.0 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN CAST({_REV} AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) / CAST(SUM(CAST({_REV} AS DECIMAL(18,4))) AS DOUBLE), 6) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "h15": f"""
WITH revenue (supplier_no, total_revenue) AS (SELECT l_suppkey, SUM(CAST({_REV} AS DECIMAL(18,4))) FROM lineitem
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, CAST(ROUND(total_revenue, 2) AS DOUBLE) AS total_revenue FROM supplier, revenue
WHERE s_suppkey = supplier_no AND total_revenue = (SELECT MAX(total_revenue) FROM revenue)""",
    "h16": f"""
SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {_PS} ps, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#9' AND p_type NOT LIKE 'MED%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "h17": f"""
SELECT COALESCE({_money('l_extendedprice / 7.0')}, 0) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * AVG(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "h18": f"""
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, {_money('l_quantity')} AS sum_qty
FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE), o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "h19": f"""
SELECT COALESCE({_money(_REV)}, 0) AS revenue FROM lineitem, part
WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
  OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
  OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))""",
    "h20": f"""
SELECT s_name, s_acctbal FROM supplier, nation WHERE s_suppkey IN (
  SELECT ps_suppkey FROM {_PS} ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
    AND 10 < (SELECT 0.5 * SUM(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
      AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1998-01-01'))
  AND s_nationkey = n_nationkey AND n_name LIKE 'NATION_1%'""",
    "h21": """
SELECT s_name, COUNT(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL '60' DAY)
  AND s_nationkey = n_nationkey GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "h22": f"""
SELECT cntrycode, COUNT(*) AS numcust, {_money('c_acctbal')} AS totacctbal FROM (
  SELECT SUBSTRING(CAST(c_nationkey + 10 AS VARCHAR(10)) FROM 1 FOR 2) AS cntrycode, c_acctbal FROM customer
  WHERE c_nationkey + 10 IN (13, 31, 23, 29, 30, 18, 17)
    AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey + 10 IN (13, 31, 23, 29, 30, 18, 17))
    AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1999-01-01')) custsale GROUP BY cntrycode""",
    # --- retail analytics, one query a feature
    "rollup_avg": f"""
SELECT r_name, n_name, c_mktsegment, {_avg('o_totalprice')} AS avg_price, {_avg('c_acctbal')} AS avg_bal, COUNT(*) AS n
FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
    "rollup_vs_union": f"""
WITH base AS (SELECT r_name, n_name, o_totalprice FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey)
SELECT r_name, n_name, {_avg('o_totalprice')} AS avg_price FROM base GROUP BY r_name, n_name
UNION ALL SELECT r_name, NULL, {_avg('o_totalprice')} FROM base GROUP BY r_name
UNION ALL SELECT NULL, NULL, {_avg('o_totalprice')} FROM base""",
    "rollup_rank_grouping": f"""
SELECT total, p_type, p_brand, lochierarchy, CAST(RANK() OVER (PARTITION BY lochierarchy, CASE WHEN g = 0 THEN p_type END ORDER BY total DESC) AS BIGINT) AS rank_within_parent FROM (
  SELECT {_money(_REV)} AS total, p_type, p_brand, CAST(GROUPING(p_type) + GROUPING(p_brand) AS BIGINT) AS lochierarchy, GROUPING(p_brand) AS g
  FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY ROLLUP (p_type, p_brand)) t""",
    "ratio_to_class": f"""
SELECT p_brand, p_type, revenue, ROUND(revenue * 100 / SUM(revenue) OVER (PARTITION BY p_type), 4) AS ratio FROM (
  SELECT p_brand, p_type, {_money('l_extendedprice')} AS revenue FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_brand, p_type) t""",
    "cume_window": """
WITH web AS (SELECT user_id, CAST(ts AS DATE) AS d, SUM(SUM(CAST(value AS DECIMAL(18,4)))) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE)),
store AS (SELECT user_id, CAST(ts AS DATE) AS d, SUM(SUM(CAST(value AS DECIMAL(18,4)))) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events WHERE event_type = 'click' GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id, d, CAST(wc AS DOUBLE) AS web_cume, CAST(sc AS DOUBLE) AS store_cume FROM (
  SELECT user_id, d, MAX(w) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wc,
    MAX(s) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sc FROM (
    SELECT COALESCE(web.user_id, store.user_id) AS user_id, COALESCE(web.d, store.d) AS d, web.c AS w, store.c AS s
    FROM web FULL OUTER JOIN store ON web.user_id = store.user_id AND web.d = store.d) x) y WHERE wc > sc""",
    "topn_per_group": f"""
SELECT p_type, p_brand, yr, sales, rk FROM (
  SELECT p_type, p_brand, yr, sales, CAST(RANK() OVER (PARTITION BY p_type ORDER BY sales DESC, p_brand, yr) AS BIGINT) AS rk FROM (
    SELECT p_type, p_brand, {_YEAR.format('l_shipdate')} AS yr, {_money(_REV)} AS sales FROM lineitem, part WHERE l_partkey = p_partkey
    GROUP BY p_type, p_brand, {_YEAR.format('l_shipdate')}) a) b WHERE rk <= 10""",
    "intersect3": f"""
SELECT COUNT(*) AS n FROM (
  SELECT DISTINCT o_custkey FROM orders WHERE {_YEAR.format('o_orderdate')} = 1996 INTERSECT
  SELECT DISTINCT o_custkey FROM orders WHERE {_YEAR.format('o_orderdate')} = 1997 INTERSECT
  SELECT DISTINCT o_custkey FROM orders WHERE {_YEAR.format('o_orderdate')} = 1998) hot""",
    "except3": f"""
SELECT COUNT(*) AS n FROM (
  SELECT DISTINCT o_custkey FROM orders WHERE {_YEAR.format('o_orderdate')} = 1996 EXCEPT
  SELECT DISTINCT o_custkey FROM orders WHERE {_YEAR.format('o_orderdate')} = 1997 EXCEPT
  SELECT DISTINCT o_custkey FROM orders WHERE {_YEAR.format('o_orderdate')} = 1998) cold""",
    "full_outer_flags": """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48)
SELECT CAST(SUM(CASE WHEN a.k IS NOT NULL AND b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(SUM(CASE WHEN a.k IS NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b,
  CAST(SUM(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_ab FROM a FULL OUTER JOIN b ON a.k = b.k""",
    "union_all_channels": f"""
SELECT channel, yr, COUNT(*) AS n, {_money('amount')} AS amount FROM (
  SELECT 'order' AS channel, {_YEAR.format('o_orderdate')} AS yr, o_totalprice AS amount FROM orders
  UNION ALL SELECT 'ship', {_YEAR.format('l_shipdate')}, l_extendedprice FROM lineitem
  UNION ALL SELECT 'event', {_YEAR.format('ts')}, value FROM events) t GROUP BY channel, yr""",
    "union_distinct": f"""
SELECT yr, COUNT(*) AS n, {_money('q')} AS q FROM (
  SELECT {_YEAR.format('l_shipdate')} AS yr, l_partkey AS k, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT {_YEAR.format('l_shipdate')}, l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'A') t GROUP BY yr""",
    "stddev_cov": f"""
SELECT p_brand, {_MONTH.format('l_shipdate')} AS moy, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(STDDEV_SAMP(l_quantity) / AVG(l_quantity), 6) AS cov
FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_brand, {_MONTH.format('l_shipdate')} HAVING STDDEV_SAMP(l_quantity) / AVG(l_quantity) > 0.5""",
    "count_distinct_buckets": f"""
SELECT * FROM (SELECT {_avg('l_extendedprice')} AS b1_avg, COUNT(l_extendedprice) AS b1_n, COUNT(DISTINCT l_extendedprice) AS b1_d FROM lineitem WHERE l_quantity BETWEEN 0 AND 5) b1
CROSS JOIN (SELECT {_avg('l_extendedprice')} AS b2_avg, COUNT(l_extendedprice) AS b2_n, COUNT(DISTINCT l_extendedprice) AS b2_d FROM lineitem WHERE l_quantity BETWEEN 6 AND 10) b2
CROSS JOIN (SELECT {_avg('l_extendedprice')} AS b3_avg, COUNT(l_extendedprice) AS b3_n, COUNT(DISTINCT l_extendedprice) AS b3_d FROM lineitem WHERE l_quantity BETWEEN 11 AND 15) b3""",
    "case_scalar_subq": f"""
SELECT CASE WHEN (SELECT COUNT(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT {_avg('l_discount')} FROM lineitem WHERE l_quantity BETWEEN 1 AND 20)
  ELSE (SELECT {_avg('l_tax')} FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS bucket1 FROM region WHERE r_regionkey = 1""",
    "month_pivot": "SELECT n_name, " + ", ".join(f"CAST(ROUND(SUM(CASE WHEN {_MONTH.format('o_orderdate')} = {m} THEN CAST(o_totalprice AS DECIMAL(18,4)) END), 2) AS DOUBLE) AS m{m}" for m in range(1, 13)) + " FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name",
    "neighbour_rank_selfjoin": f"""
WITH v AS (SELECT n_name, yr, moy, sales, RANK() OVER (PARTITION BY n_name ORDER BY yr, moy) AS rn, AVG(sales) OVER (PARTITION BY n_name, yr) AS avg_monthly FROM (
  SELECT n_name, {_YEAR.format('o_orderdate')} AS yr, {_MONTH.format('o_orderdate')} AS moy, {_money('o_totalprice')} AS sales FROM orders, customer, nation
  WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name, {_YEAR.format('o_orderdate')}, {_MONTH.format('o_orderdate')}) s)
SELECT v1.n_name, v1.yr, v1.moy, v1.sales, v0.sales AS psum, v2.sales AS nsum FROM v v1, v v0, v v2
WHERE v1.n_name = v0.n_name AND v1.n_name = v2.n_name AND v1.rn = v0.rn + 1 AND v1.rn = v2.rn - 1 AND v1.yr = 1997 AND ABS(v1.sales - v1.avg_monthly) / v1.avg_monthly > 0.1""",
    "rank_position_join": f"""
WITH s AS (SELECT l_suppkey AS k, {_money(_REV)} AS v FROM lineitem GROUP BY l_suppkey)
SELECT a.rnk, a.k AS best, d.k AS worst FROM (SELECT k, CAST(RANK() OVER (ORDER BY v DESC, k) AS BIGINT) AS rnk FROM s) a, (SELECT k, CAST(RANK() OVER (ORDER BY v, k) AS BIGINT) AS rnk FROM s) d WHERE a.rnk = d.rnk AND a.rnk <= 10""",
    "correlated_avg": """
WITH t AS (SELECT o_custkey AS ck, c_nationkey AS nk, SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS total FROM orders, customer WHERE o_custkey = c_custkey GROUP BY o_custkey, c_nationkey)
SELECT t1.ck, CAST(ROUND(t1.total, 2) AS DOUBLE) AS total FROM t t1 WHERE CAST(t1.total AS DOUBLE) > (SELECT AVG(CAST(t2.total AS DOUBLE)) * 1.5 FROM t t2 WHERE t1.nk = t2.nk)""",
    "exists_any": """
SELECT c_mktsegment, COUNT(*) AS n FROM customer c WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'F')
  AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 OR o_orderpriority = '1-URGENT') GROUP BY c_mktsegment""",
    "exists_not_exists": f"""
SELECT COUNT(DISTINCT l1.l_orderkey) AS order_count, {_money('l1.l_extendedprice')} AS total FROM lineitem l1
WHERE EXISTS (SELECT * FROM lineitem l2 WHERE l1.l_orderkey = l2.l_orderkey AND l1.l_suppkey <> l2.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l1.l_orderkey = l3.l_orderkey AND l3.l_returnflag = 'R')""",
    "left_join_coalesce": f"""
SELECT c_mktsegment, COALESCE({_money("CASE WHEN o_orderkey IS NOT NULL THEN o_totalprice ELSE 0 END")}, 0) AS act_sales, COUNT(o_orderkey) AS n
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_mktsegment""",
    "non_equi_residual": """
SELECT COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_quantity < b.l_quantity AND b.l_shipdate > a.l_shipdate + INTERVAL '5' DAY""",
    "date_string_functions": f"""
SELECT UPPER(SUBSTR(p_name, 1, 3)) || '-' || p_type AS tag, {_YEAR.format("l_shipdate + INTERVAL '30' DAY")} AS yr, COUNT(*) AS n, ABS(MIN(l_discount) - MAX(l_discount)) AS spread
FROM lineitem, part WHERE l_partkey = p_partkey AND p_name LIKE '%b%' GROUP BY UPPER(SUBSTR(p_name, 1, 3)) || '-' || p_type, {_YEAR.format("l_shipdate + INTERVAL '30' DAY")}""",
    "select_distinct": "SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 25",
    "having_scalar": f"""
SELECT l_suppkey, {_money('l_quantity')} AS q FROM lineitem GROUP BY l_suppkey
HAVING CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) > 1.05 * (SELECT CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / COUNT(DISTINCT l_suppkey) FROM lineitem)""",
    "nulls_last_rank": "SELECT c_custkey, k, CAST(RANK() OVER (ORDER BY k DESC NULLS LAST, c_custkey) AS BIGINT) AS rk FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer) t",
    "events_by_key": f"SELECT event_type, {_YEAR.format('ts')} AS yr, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, {_money('value')} AS total FROM events GROUP BY event_type, {_YEAR.format('ts')}",
}


def quoted(spark, text: str):
    """SQL text in which double quotes enclose names, as the standard has it."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")}
    try:
        for k in kept:
            spark.conf.set(k, "true")
        return spark.sql(text)  # parsed at once
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def runner(name: str):
    """The query as a function of (spark, folder)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in SQL[name]:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(SQL[name])

    run.__name__ = name
    return run
