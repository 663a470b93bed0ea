"""Messy tables derived from the clean test tables: SQL that Spark and DuckDB read alike."""

DIRTY_CUSTOMER = """
WITH b AS (
  SELECT c_custkey AS k, c_name, c_mktsegment AS seg, CAST(c_custkey AS VARCHAR(20)) AS ks,
         CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents, c_acctbal < 0 AS neg
  FROM customer),
t AS (
  SELECT *, CASE WHEN neg THEN '-' ELSE '' END || CAST(CAST(floor(cents / 100.0) AS BIGINT) AS VARCHAR(20)) AS ip,
         lpad(CAST(cents % 100 AS VARCHAR(20)), 2, '0') AS fp FROM b),
d AS (
  SELECT k * 10 AS rid,
    CASE WHEN k % 50 = 7 THEN 'CUST-' || ks ELSE ks END AS cust_id,
    CASE WHEN k % 11 = 0 THEN '  ' || c_name || ' ' WHEN k % 11 = 1 THEN upper(c_name)
         WHEN k % 11 = 2 THEN lower(c_name) WHEN k % 11 = 3 THEN NULL ELSE c_name END AS full_name,
    CASE WHEN k % 9 = 0 THEN upper('user' || ks || '@example.com') WHEN k % 13 = 0 THEN 'user' || ks || 'example.com'
         ELSE 'user' || ks || '@example.com' END AS email,
    CASE WHEN k % 10 = 0 THEN lower(seg) WHEN k % 10 = 1 THEN substr(seg, 1, 4) || '-' || substr(seg, 5)
         WHEN k % 67 = 0 THEN substr(seg, 1, length(seg) - 1) WHEN k % 23 = 0 THEN 'unknown'
         WHEN k % 29 = 0 THEN 'N/A' ELSE seg END AS segment,
    CASE WHEN k % 31 = 0 THEN 'ERROR' WHEN k % 37 = 0 THEN 'seven' WHEN k % 6 = 0 THEN '$' || ip || '.' || fp
         WHEN k % 6 = 1 THEN ip || ',' || fp WHEN k % 6 = 2 THEN ip || '.' || fp || ' USD'
         ELSE ip || '.' || fp END AS balance_text,
    CASE WHEN k % 101 = 0 THEN '-5' WHEN k % 103 = 0 THEN '130'
         ELSE CAST(k * 7 % 80 + 18 AS VARCHAR(20)) END AS customer_age,
    CASE WHEN k % 8 = 0 THEN '+212 6' || lpad(ks, 8, '0') WHEN k % 8 = 1 THEN '06-' || lpad(ks, 8, '0')
         WHEN k % 83 = 0 THEN '123' ELSE '6' || lpad(ks, 8, '0') END AS phone
  FROM t)
SELECT * FROM d
UNION ALL SELECT rid + 1, cust_id, full_name, email, segment, balance_text, customer_age, phone FROM d WHERE rid % 400 = 0
UNION ALL SELECT rid + 2, cust_id, full_name, email, 'CONFLICT', balance_text, customer_age, phone FROM d WHERE rid % 600 = 10
UNION ALL SELECT rid + 3, cust_id, full_name, upper(email), segment, balance_text, customer_age, phone FROM d WHERE rid % 900 = 20
UNION ALL SELECT rid + 4, CAST(NULL AS VARCHAR(20)), NULL, NULL, NULL, NULL, NULL, NULL FROM d WHERE rid % 1000 = 30
"""
DIRTY_ORDERS = """
WITH b AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS VARCHAR(4)) AS y,
    lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0') AS m, lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0') AS dd,
    o_totalprice FROM orders)
SELECT k AS rid, k AS order_id, o_totalprice,
  CASE WHEN k % 97 = 0 THEN y || '-02-31' WHEN k % 89 = 0 THEN 'not a date' WHEN k % 5 = 0 THEN dd || '/' || m || '/' || y
       WHEN k % 5 = 1 THEN m || '-' || dd || '-' || y WHEN k % 5 = 2 THEN y || '/' || m || '/' || dd
       ELSE y || '-' || m || '-' || dd END AS order_date
FROM b
"""
DIRTY_LINEITEM = """
WITH b AS (SELECT l_orderkey * 100 + l_linenumber AS k, l_quantity AS q, CAST(l_partkey % 97 + 1 AS DOUBLE) / 4 AS p FROM lineitem)
SELECT k AS row_key,
  CASE WHEN k % 53 = 0 THEN NULL ELSE q END AS quantity,
  CASE WHEN k % 59 = 0 THEN NULL ELSE p END AS unit_price,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 71 = 0 THEN q * p * 1.5 ELSE q * p END AS amount
FROM b
"""
WIDE_LINEITEM = """
WITH b AS (SELECT l_orderkey * 100 + l_linenumber AS k, CAST(l_quantity AS DOUBLE) AS q, CAST(l_partkey % 97 + 1 AS DOUBLE) / 4 AS p, CAST(l_suppkey % 19 + 1 AS DOUBLE) / 8 AS r,
    CAST(l_orderkey % 89 + 3 AS DOUBLE) / 2 AS w, CAST(l_extendedprice AS DOUBLE) AS e, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem)
SELECT k AS row_key, CASE WHEN k % 53 = 0 THEN NULL ELSE q END AS quantity, p AS unit_price,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 71 = 0 THEN q * p * 1.5 ELSE q * p END AS amount,
  CASE WHEN k % 3 = 0 THEN 0.0 ELSE r END AS rate, CASE WHEN k % 3 = 0 THEN 0.0 WHEN k % 47 = 0 THEN q * p * r + 9 ELSE q * p * r END AS commission,
  w AS unit_weight, CASE WHEN k % 40 = 0 THEN -q * w ELSE q * w END AS weight, CASE WHEN k % 12 = 0 THEN q * e ELSE q * w * p END AS freight,
  e AS gross, d AS discount, t AS tax, n AS position, -d * e AS rebate
FROM b
"""
DIRTY_PART = """
SELECT p_partkey AS rid, p_brand,
  CASE WHEN p_partkey % 67 = 0 THEN substr(p_type, 1, length(p_type) - 1) WHEN p_partkey % 9 = 0 THEN lower(p_type)
       WHEN p_partkey % 10 = 0 THEN substr(p_type, 1, 3) || ' ' || substr(p_type, 4) ELSE p_type END AS part_type
FROM part
"""
DIRTY_SUPPLIER = """
SELECT s_suppkey AS rid, CASE WHEN s_suppkey % 7 = 0 THEN lower(s_name) ELSE s_name END AS supplier_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'FR' WHEN 1 THEN 'France' WHEN 2 THEN 'Morocco' WHEN 3 THEN 'MA' ELSE 'Spain' END AS country,
  CASE s_suppkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'North' WHEN 2 THEN 'South' ELSE 'NORTH' END AS region_label,
  s_acctbal AS list_price, CASE WHEN s_suppkey % 9 = 0 THEN -1.5 ELSE CAST(s_nationkey AS DOUBLE) END AS score
FROM supplier
"""
_SHORT = "CASE m " + " ".join(f"WHEN {i} THEN '{n[:3]}'" for i, n in enumerate("January February March April May June July August September October November December".split(), 1)) + " END"
_LONG = "CASE m " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate("January February March April May June July August September October November December".split(), 1)) + " END"
#: Every order's date in one of nine notations; y, m, d as they are.
MIXED_DATES = f"""
WITH b AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(year(o_orderdate) AS VARCHAR(4)) AS ys,
    lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0') AS ms, lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0') AS ds FROM orders)
SELECT k, y, m, d, CASE k % 9 WHEN 0 THEN ms || '/' || ds || '/' || substr(ys, 3, 2) WHEN 1 THEN ds || '-' || ms || '-' || substr(ys, 3, 2) WHEN 2 THEN {_SHORT} || ' ' || ds || ' ' || ys
    WHEN 3 THEN ds || ' ' || lower({_LONG}) || ', ' || ys WHEN 4 THEN ds || '-' || upper({_SHORT}) || '-' || ys WHEN 5 THEN ys || '-' || ms || '-' || ds || 'T10:20:30.5Z'
    WHEN 6 THEN ys || '/' || ms || '/' || ds || ' 10:20' WHEN 7 THEN '32/13/' || ys ELSE 'maybe ' || ds END AS written
FROM b
"""
VIEWS = {"dirty_customer": ("customer", DIRTY_CUSTOMER), "dirty_orders": ("orders", DIRTY_ORDERS), "dirty_lineitem": ("lineitem", DIRTY_LINEITEM), "wide_lineitem": ("lineitem", WIDE_LINEITEM), "mixed_dates": ("orders", MIXED_DATES), "dirty_part": ("part", DIRTY_PART), "dirty_supplier": ("supplier", DIRTY_SUPPLIER)}
