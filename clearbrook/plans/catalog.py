"""Queries over the test tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates, profile, relations
from ..operators import inspect as tools
from ..operators import scan as scanning
from ..operators.cleaning import clean
from ..operators.values import value_table
from ..sources import sinks
from . import repairs, validation
from .model import Action
from .views import VIEWS

TEXT = ["cust_id", "full_name", "email", "segment", "balance_text", "customer_age", "phone"]
_NULLS = "('', 'na', 'n/a', 'null', 'none', 'nan', 'unknown', 'unk', 'error', 'err', 'tbd', '-', '--', '?', 'missing', 'not available')"
_SCAN = r"(?i)^(?:unknown|unk|error|err|n/?a|#n/?a|null|none|nan|nil|missing|undefined|-+|\?+|\.+|not[_ ]?(?:a[_ ]?)?(?:date|number|available|applicable)|[a-z]+_unknown|unknown_[a-z]+)$"
_NUM = "TRY_CAST(replace(regexp_replace({0}, '[^0-9,.\\-]', '', 'g'), ',', '.') AS DOUBLE)"
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a messy one derived from it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, sql = VIEWS[name]
    spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(sql)


def query(name: str, of: str, sql: str | None = None):
    """Register a query over one table; its SQL may name that table."""

    def add(f: Callable[[DataFrame], DataFrame]):
        _Q[name] = lambda spark, sf_dir: f(table(spark, sf_dir, of))
        if sql and of in VIEWS:
            rest = sql.lstrip()
            _SQL[name] = f"WITH {of} AS ({VIEWS[of][1]})" + (f", {rest[5:]}" if rest.startswith("WITH ") else f" {rest}")
        elif sql:
            _SQL[name] = sql
        return f

    return add


def cells(of: str, columns: list[str], rid: str = "rid") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, {rid} AS rid FROM {of}" for c in columns)


def counted(of: str, columns: list[str]) -> str:
    """v: cells; s: usable values, stripped and counted."""
    return f"""WITH v AS ({cells(of, columns)}),
s AS (SELECT name, trim(value) AS value, count(*) AS n, min(rid) AS first FROM v WHERE value IS NOT NULL AND trim(value) <> ''
  AND NOT regexp_matches(trim(value), '{_SCAN}') GROUP BY name, trim(value))"""


def _cleaned(name: str, of: str, actions: list[Action], keep: list[str], sql: str, order: str | None = "rid") -> None:
    query(name, of, sql)(lambda df: clean(df, actions, order).df.select(*keep))


_cleaned(
    "clean_strip",
    "dirty_customer",
    [Action("strip_whitespace", ("full_name", "email"))],
    ["rid", "full_name", "email"],
    "SELECT rid, trim(full_name) AS full_name, trim(email) AS email FROM dirty_customer",
)
_cleaned(
    "clean_null_like",
    "dirty_customer",
    [Action("replace_null_like", ("segment", "balance_text"))],
    ["rid", "segment", "balance_text"],
    f"""SELECT rid, CASE WHEN lower(trim(segment)) IN {_NULLS} THEN NULL ELSE segment END AS segment, CASE WHEN lower(trim(balance_text)) IN {_NULLS} THEN NULL ELSE balance_text END AS balance_text
FROM dirty_customer""",
)
for _name, _comma in (("auto", False), ("comma", True)):
    _cleaned(
        f"clean_to_numeric_{_name}",
        "dirty_customer",
        [Action("to_numeric", ("balance_text", "customer_age"), decimal_comma=_comma)],
        ["rid", "balance_text", "customer_age"],
        f"SELECT rid, {_NUM.format('balance_text')} AS balance_text, {_NUM.format('customer_age')} AS customer_age FROM dirty_customer",
    )
for _mode, _expr in (("lower", "lower(full_name)"), ("upper", "upper(full_name)"), ("title", r"CASE WHEN full_name IS NOT NULL THEN array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN regexp_extract_all(full_name, '\p{L}+|\P{L}+')], '') END")):
    _cleaned(
        f"clean_case_{_mode}",
        "dirty_customer",
        [Action("normalize_case", ("full_name",), case_mode=_mode)],
        ["rid", "full_name"],
        f"SELECT rid, {_expr} AS full_name FROM dirty_customer",
    )
_cleaned(
    "clean_replace_values",
    "dirty_customer",
    [Action("replace_values", ("segment",), replacements={"BUILDING": "HOUSEHOLD", "HOUSEHOLD": "HOME", "unknown": None})],
    ["rid", "segment"],
    """SELECT rid, CASE segment WHEN 'BUILDING' THEN 'HOUSEHOLD' WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'unknown' THEN NULL ELSE segment END AS segment
FROM dirty_customer""",
)
_cleaned(
    "clean_drop_empty_rows",
    "dirty_customer",
    [Action("drop_empty_rows")],
    ["rid", "cust_id"],
    f"SELECT rid, cust_id FROM dirty_customer WHERE coalesce({', '.join(TEXT)}) IS NOT NULL",
)
_cleaned(
    "clean_dedupe_rows",
    "dirty_customer",
    [Action("drop_duplicate_rows")],
    ["rid", "cust_id", "segment"],
    f"SELECT min(rid) AS rid, cust_id, segment FROM dirty_customer GROUP BY {', '.join(TEXT)}",
)
_cleaned(
    "clean_dedupe_late",
    "dirty_customer",
    [Action("strip_whitespace", tuple(TEXT)), Action("normalize_case", ("email",), case_mode="lower"), Action("drop_duplicate_rows_after_cleaning")],
    ["rid", "cust_id", "email"],
    """SELECT min(rid) AS rid, cust_id, lower(trim(email)) AS email
FROM dirty_customer
GROUP BY cust_id, trim(full_name), lower(trim(email)), segment, balance_text, customer_age, phone""",
)
_cleaned(
    "clean_dedupe_by_key",
    "dirty_customer",
    [Action("drop_duplicates_by_columns", ("cust_id",))],
    ["rid", "cust_id", "segment"],
    """SELECT rid, cust_id, segment
FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY rid) AS k
FROM dirty_customer)
WHERE k = 1""",
)
_cleaned(
    "clean_dedupe_documents",
    "documents",
    [Action("drop_duplicates_by_columns", ("text",))],
    ["doc_id", "source"],
    "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
    "doc_id",
)
_cleaned(
    "clean_negative_to_null",
    "customer",
    [Action("set_negative_to_null", ("c_acctbal",))],
    ["c_custkey", "c_acctbal"],
    "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer",
    "c_custkey",
)
_cleaned(
    "clean_fill_formula",
    "dirty_lineitem",
    [Action("fill_missing_from_formula", ("amount",), source_columns=("quantity", "unit_price"))],
    ["row_key", "quantity", "unit_price", "amount"],
    """
SELECT row_key,
  CASE WHEN quantity IS NULL AND unit_price <> 0 AND amount IS NOT NULL THEN CASE WHEN abs(amount / unit_price - round(amount / unit_price)) < 1e-9 THEN round(amount / unit_price) END ELSE quantity END AS quantity,
  CASE WHEN unit_price IS NULL AND quantity <> 0 AND amount IS NOT NULL THEN round_even(CAST(amount / quantity AS DOUBLE), 2) ELSE unit_price END AS unit_price,
  CASE WHEN amount IS NULL AND quantity IS NOT NULL AND unit_price IS NOT NULL THEN round_even(CAST(quantity * unit_price AS DOUBLE), 2) ELSE amount END AS amount FROM dirty_lineitem""",
    "row_key",
)
_cleaned(
    "clean_recalculate",
    "dirty_lineitem",
    [Action("recalculate_from_columns", ("amount",), source_columns=("quantity", "unit_price"))],
    ["row_key", "amount"],
    """SELECT row_key, CASE WHEN abs(quantity * unit_price - amount) > 0.02 * greatest(abs(amount), 1.0) THEN round_even(CAST(quantity * unit_price AS DOUBLE), 2) ELSE amount END AS amount
FROM dirty_lineitem""",
    "row_key",
)
_cleaned(
    "clean_customer_e2e",
    "dirty_customer",
    [Action("strip_whitespace", tuple(TEXT)), Action("replace_null_like", tuple(TEXT)), Action("to_numeric", ("balance_text", "customer_age")), Action("drop_duplicate_rows")],
    ["rid", *TEXT],
    f"""
WITH c AS (SELECT rid, {', '.join(f"CASE WHEN lower(trim({t})) IN {_NULLS} THEN NULL ELSE trim({t}) END AS {t}" for t in TEXT)} FROM dirty_customer),
n AS (SELECT rid, cust_id, full_name, email, segment, {_NUM.format('balance_text')} AS balance_text, {_NUM.format('customer_age')} AS customer_age, phone FROM c)
SELECT min(rid) AS rid, {', '.join(TEXT)} FROM n GROUP BY {', '.join(TEXT)}""",
)


@query("clean_drop_empty_columns", "dirty_customer", "SELECT rid, cust_id, segment FROM dirty_customer")
def _(df):
    return clean(df.select("rid", "cust_id", "segment", F.lit(None).cast("string").alias("nothing")), [Action("drop_empty_columns")], "rid").df


@query("clean_normalize_names", "customer", "SELECT c_custkey AS \"Customer key\", c_name AS \"Name\" FROM customer")
def _(df):
    return clean(df.select(F.col("c_custkey").alias(" Customer\n key "), F.col("c_name").alias("﻿Name")), [Action("normalize_column_names")]).df


@query("clean_to_datetime", "dirty_orders", r"""
SELECT rid, strftime(CASE WHEN regexp_matches(order_date, '^\d{4}[-/.]') THEN coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%Y/%m/%d'))
  ELSE coalesce(try_strptime(order_date, '%m/%d/%Y'), try_strptime(order_date, '%m-%d-%Y'), try_strptime(order_date, '%d/%m/%Y'), try_strptime(order_date, '%d-%m-%Y')) END, '%Y-%m-%d') AS order_date FROM dirty_orders""")
def _(df):
    return clean(df, [Action("to_datetime", ("order_date",))], "rid").df.select("rid", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))


@query("profile_columns", "dirty_customer", f"""
WITH v AS ({cells('dirty_customer', TEXT)})
SELECT name, count(*) AS rows,
    count(*) - count(value) AS missing,
    round_even(100.0 * (count(*) - count(value))::DOUBLE / count(*), 2)::DOUBLE AS missing_pct,
    count(DISTINCT value) AS unique,
  count(*) FILTER (value <> trim(value)) AS whitespace, count(*) FILTER (lower(trim(value)) IN {_NULLS} AND lower(trim(value)) NOT IN ('error', 'err')) AS null_like,
  round_even((count(*) FILTER (TRY_CAST(replace(regexp_replace(value, '[^0-9,.\\-]', '', 'g'), ',', '.') AS DOUBLE) IS NOT NULL))::DOUBLE / count(value), 4)::DOUBLE AS numeric_ratio FROM v GROUP BY name""")
def _(df):
    return profile.column_profile(df, TEXT, "rid")


@query("profile_events", "events", f"""
WITH v AS ({cells('events', ['event_id', 'user_id', 'event_type'], 'event_id')})
SELECT name, count(*) AS rows, count(*) - count(value) AS missing, count(DISTINCT value) AS unique FROM v GROUP BY name""")
def _(df):
    return profile.column_profile(df, ["event_id", "user_id", "event_type"], "event_id").select("name", "rows", "missing", "unique")


@query("profile_numeric", "lineitem", " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, count(*) FILTER ({c} < 0) AS negative FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(df):
    return profile.numeric_profile(df, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("mean", F.round("mean", 6))


_DUPES = "SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS involved, coalesce(sum(n - 1), 0)::BIGINT AS removable FROM (SELECT count(*) AS n FROM {0} GROUP BY {1})"
query("profile_duplicates", "dirty_customer", _DUPES.format("dirty_customer", ", ".join(TEXT)))(lambda df: profile.duplicate_rows(df, TEXT))
query(
    "profile_duplicates_lineitem",
    "lineitem",
    _DUPES.format("lineitem", "ALL").replace("SELECT count(*) AS n FROM lineitem GROUP BY ALL", "SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"),
)(lambda df: profile.duplicate_rows(df, df.columns))
query(
    "profile_topk",
    "dirty_customer",
    f"""WITH v AS ({cells('dirty_customer', ['segment', 'customer_age'])}), c AS (SELECT name, value, count(*) AS n, min(rid) AS first
FROM v
WHERE value IS NOT NULL
GROUP BY name, value)
SELECT name, rank, value, n
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first) AS rank
FROM c)
WHERE rank <= 12""",
)(lambda df: profile.top_values(df, ["segment", "customer_age"], "rid"))
query(
    "profile_samples",
    "dirty_customer",
    f"""WITH v AS ({cells('dirty_customer', ['segment', 'full_name'])}), c AS (SELECT name, trim(value) AS value, min(rid) AS first
FROM v
WHERE trim(value) <> ''
GROUP BY name, trim(value))
SELECT name, rank, value
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first) AS rank
FROM c)
WHERE rank <= 8""",
)(lambda df: profile.samples(df, ["segment", "full_name"], "rid"))
query("profile_date_ratio", "dirty_orders", r"""
WITH f AS (SELECT order_date AS x FROM dirty_orders ORDER BY rid LIMIT 500),
d AS (SELECT CASE WHEN regexp_matches(x, '^\d{4}[-/.]') THEN coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%Y/%m/%d'))
  ELSE coalesce(try_strptime(x, '%m/%d/%Y'), try_strptime(x, '%m-%d-%Y'), try_strptime(x, '%d/%m/%Y'), try_strptime(x, '%d-%m-%Y')) END AS day FROM f)
SELECT round(count(day)::DOUBLE / count(*), 4) AS date_ratio FROM d""")(lambda df: profile.date_ratio(df, "order_date", "rid"))


def _facts(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return scanning.column_facts(df, columns, "rid").select("name", *keep)


query(
    "scan_whitespace",
    "dirty_customer",
    f"""WITH v AS ({cells('dirty_customer', TEXT)})
SELECT name, count(*) - count(value) AS missing,
    count(*) FILTER (value <> trim(value)) AS whitespace,
    count(*) FILTER (trim(value) = '' OR regexp_matches(trim(value), '{_SCAN}')) AS null_like,
    count(DISTINCT value) AS \"unique\"
FROM v
GROUP BY name""",
)(lambda df: _facts(df, TEXT, "missing", "whitespace", "null_like", "unique"))
query(
    "scan_numeric_flags",
    "dirty_customer",
    counted("dirty_customer", ["balance_text", "customer_age"]) + r""",
p AS (SELECT *, replace(regexp_replace(value, '(?i)[$€£¥]|\b(?:USD|EUR|GBP|MAD|DHS?)\b', '', 'g'), ' ', '') AS t FROM s),
x AS (SELECT *, CASE WHEN regexp_matches(t, '^[-+]?(?:\d[\d.,]*|[.,]\d+)$') THEN TRY_CAST(replace(t, ',', '.') AS DOUBLE) END AS x FROM p)
SELECT name, sum(n) FILTER (x IS NOT NULL)::BIGINT AS numbers,
    coalesce(sum(n) FILTER (x IS NOT NULL AND t <> value), 0)::BIGINT AS currency,
    coalesce(sum(n) FILTER (x IS NOT NULL AND contains(t, ',')), 0)::BIGINT AS decimal_comma,
  min(x) AS min, max(x) AS max, coalesce(sum(n) FILTER (x < 0), 0)::BIGINT AS negative FROM x GROUP BY name""",
)(lambda df: _facts(df, ["balance_text", "customer_age"], "numbers", "currency", "decimal_comma", "min", "max", "negative"))
query(
    "scan_emails",
    "dirty_customer",
    counted("dirty_customer", ["email"]) + r"""
SELECT name, sum(n) FILTER (value <> lower(value))::BIGINT AS uppercase, sum(n) FILTER (NOT regexp_matches(value, '^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$'))::BIGINT AS bad_mails
FROM s
GROUP BY name""",
)(lambda df: _facts(df, ["email"], "uppercase", "bad_mails"))
query(
    "scan_dates",
    "dirty_orders",
    counted("dirty_orders", ["order_date"]) + r""",
d AS (SELECT *, string_split_regex(value, '[-/.]') AS p FROM s WHERE regexp_matches(value, '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$')),
e AS (SELECT *, TRY_CAST(p[1] AS INTEGER) AS a, TRY_CAST(p[2] AS INTEGER) AS b FROM d)
SELECT name, sum(n)::BIGINT AS dates,
    coalesce(sum(n) FILTER (length(p[1]) <> 4 AND a > 12), 0)::BIGINT AS day_first,
    coalesce(sum(n) FILTER (length(p[1]) <> 4 AND a <= 12 AND b > 12), 0)::BIGINT AS month_first,
    coalesce(sum(n) FILTER (length(p[1]) <> 4 AND a <= 12 AND b <= 12), 0)::BIGINT AS ambiguous FROM e GROUP BY name""",
)(lambda df: _facts(df, ["order_date"], "dates", "day_first", "month_first", "ambiguous"))
query(
    "scan_kinds",
    "dirty_customer",
    counted("dirty_customer", TEXT) + r""",
h AS (SELECT *, regexp_matches(lower(name), 'mail') AS mail, regexp_matches(name, '(^|_)(id|uuid|ref|sku|key)(_|$)|phone') AS ident FROM s),
k AS (SELECT name, bool_or(mail) AS mail, bool_or(ident) AS ident, count(*) AS forms, sum(n) AS total, coalesce(sum(n) FILTER (contains(value, '@')), 0) AS mails,
  coalesce(sum(n) FILTER (regexp_matches(value, '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$')), 0) AS dates,
  coalesce(sum(n) FILTER (regexp_matches(replace(regexp_replace(value, '(?i)[$€£¥]|\b(?:USD|EUR|GBP|MAD|DHS?)\b', '', 'g'), ' ', ''), '^[-+]?(?:\d[\d.,]*|[.,]\d+)$')), 0) AS numbers FROM h GROUP BY name)
SELECT name, CASE WHEN mail OR mails >= 0.5 * total THEN 'email' WHEN dates >= 0.5 * total THEN 'date' WHEN numbers >= 0.5 * total THEN 'numeric'
  WHEN forms <= 80 AND NOT ident THEN 'categorical' WHEN ident THEN 'identifier' ELSE 'text' END AS kind FROM k""",
)(lambda df: _facts(df, TEXT, "kind"))
query(
    "scan_names",
    "dirty_customer",
    counted("dirty_customer", ["full_name"]) + r"""
SELECT name, coalesce(sum(n) FILTER (regexp_matches(value, '[A-Za-z]') AND (value = lower(value) OR value = upper(value))), 0)::BIGINT AS odd_case
FROM s
GROUP BY name""",
)(lambda df: _facts(df, ["full_name"], "odd_case"))
_RANKED = "SELECT name, rank, {0}, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= {1}"
query(
    "scan_null_tokens",
    "dirty_customer",
    f"""WITH v AS ({cells('dirty_customer', TEXT)}), c AS (SELECT name, trim(value) AS value, count(*) AS n, min(rid) AS first
FROM v
WHERE trim(value) = '' OR regexp_matches(trim(value), '{_SCAN}')
GROUP BY name, trim(value)) """ + _RANKED.format("value", 10),
)(lambda df: scanning.null_tokens(value_table(df, TEXT, "rid")))
query(
    "scan_masks",
    "dirty_customer",
    counted("dirty_customer", ["cust_id", "phone", "balance_text"]) + r""", c AS (SELECT name, regexp_replace(regexp_replace(value, '\d', '9', 'g'), '[A-Za-zÀ-ÿ]+', 'A', 'g') AS mask,
    sum(n)::BIGINT AS n,
    min(first) AS first,
    arg_min(value, first) AS example
FROM s
GROUP BY 1, 2) """ + _RANKED.format("mask, example", 8),
)(lambda df: scanning.masks(value_table(df, ["cust_id", "phone", "balance_text"], "rid")))
query(
    "scan_date_masks",
    "dirty_orders",
    counted("dirty_orders", ["order_date"]) + r""", c AS (SELECT name, regexp_replace(value, '\d', '9', 'g') AS mask, sum(n)::BIGINT AS n, min(first) AS first
FROM s
WHERE regexp_matches(value, '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$')
GROUP BY 1, 2) """ + _RANKED.format("mask", 8),
)(lambda df: scanning.date_masks(value_table(df, ["order_date"], "rid")))
query(
    "scan_unparseable",
    "dirty_customer",
    counted("dirty_customer", ["balance_text", "customer_age"]) + r""", c AS (SELECT *
FROM s
WHERE NOT regexp_matches(replace(regexp_replace(value, '(?i)[$€£¥]|\b(?:USD|EUR|GBP|MAD|DHS?)\b', '', 'g'), ' ', ''), '^[-+]?(?:\d[\d.,]*|[.,]\d+)$')) """ + _RANKED.format("value", 12),
)(lambda df: scanning.unparseable(value_table(df, ["balance_text", "customer_age"], "rid")))
query(
    "scan_ages",
    "dirty_customer",
    counted("dirty_customer", ["customer_age"]) + " SELECT name, value, n FROM s WHERE TRY_CAST(value AS DOUBLE) < 0 OR TRY_CAST(value AS DOUBLE) > 120",
)(
    lambda df: scanning.implausible_ages(value_table(df, ["customer_age"], "rid"), {"customer_age": scanning.age_policy("customer_age")}).drop("first")
)
_VARIANTS = """, k AS (SELECT *, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS key FROM s),
g AS (SELECT name, key, count(DISTINCT lower(value)) AS lowered, arg_max(value, n * 10000000 - first) AS dominant FROM k GROUP BY name, key HAVING count(*) > 1)
SELECT k.name, k.key, k.value AS form, k.n, g.lowered, g.dominant FROM k JOIN g ON k.name = g.name AND k.key = g.key"""
query("scan_variants", "dirty_customer", counted("dirty_customer", ["segment"]) + _VARIANTS)(lambda df: scanning.variants(value_table(df, ["segment"], "rid")))
query("scan_variants_part", "dirty_part", counted("dirty_part", ["part_type"]) + _VARIANTS)(lambda df: scanning.variants(value_table(df, ["part_type"], "rid")))


query(
    "dup_key_groups",
    "lineitem",
    """SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS payloads, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) > 1 AS conflict
FROM lineitem
GROUP BY l_orderkey
HAVING count(*) > 1""",
)(
    lambda df: duplicates.key_groups(df, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_quantity"]).select("l_orderkey", "n", "payloads", "conflict")
)
query(
    "dup_key_conflicts",
    "dirty_customer",
    """WITH g AS (SELECT cust_id, count(*) AS n, count(DISTINCT (full_name, email, segment, balance_text, customer_age, phone)) AS p
FROM dirty_customer
WHERE trim(cust_id) <> ''
GROUP BY cust_id
HAVING count(*) > 1)
SELECT count(*) AS groups,
    count(*) FILTER (p = 1) AS exact_groups,
    count(*) FILTER (p > 1) AS conflict_groups,
    sum(n)::BIGINT AS involved,
    sum(n - 1)::BIGINT AS removable,
    count(*) > 0 AND count(*) FILTER (p > 1) = 0 AS safe_to_drop_by_key
FROM g""",
)(lambda df: duplicates.key_summary(df, ["cust_id"], [c for c in TEXT if c != "cust_id"]))
query(
    "dup_by_key",
    "dirty_customer",
    """SELECT count(*) AS groups, sum(n)::BIGINT AS involved, sum(n - 1)::BIGINT AS removable
FROM (SELECT count(*) AS n
FROM dirty_customer
WHERE cust_id IS NOT NULL
GROUP BY cust_id
HAVING count(*) > 1)""",
)(lambda df: duplicates.by_key(df, ["cust_id"], blanks=True))
query(
    "plan_hidden_duplicates",
    "dirty_customer",
    _DUPES.format("dirty_customer", ", ".join(f"lower(trim({c}))" for c in TEXT)),
)(lambda df: duplicates.hidden(df, TEXT))
query(
    "rel_counts",
    "dirty_lineitem",
    """
SELECT count(*) FILTER (quantity IS NOT NULL AND unit_price IS NOT NULL AND amount IS NOT NULL) AS complete,
    count(*) FILTER (abs(quantity * unit_price - amount) > 0.02 * greatest(abs(amount), 1.0)) AS mismatches,
  count(*) FILTER (quantity IS NULL AND unit_price <> 0 AND amount IS NOT NULL) AS fillable_left,
    count(*) FILTER (unit_price IS NULL AND quantity <> 0 AND amount IS NOT NULL) AS fillable_right,
  count(*) FILTER (amount IS NULL AND quantity IS NOT NULL AND unit_price IS NOT NULL) AS fillable_target FROM dirty_lineitem""",
)(lambda df: relations.relation_counts(df, "quantity", "unit_price", "amount"))


@query("rel_discover", "dirty_lineitem", """
WITH m AS (SELECT quantity * unit_price AS p, amount AS c FROM dirty_lineitem WHERE quantity IS NOT NULL AND unit_price IS NOT NULL AND amount IS NOT NULL),
t AS (SELECT *, abs(p) > 1e-9 OR abs(c) > 1e-9 AS telling, abs(p - c) <= 0.02 * greatest(abs(c), 1.0) AS fits FROM m)
SELECT 'quantity' AS "left",
    'unit_price' AS "right",
    'amount' AS target,
    round_even(((count(*) FILTER (telling AND fits))::DOUBLE / count(*) FILTER (telling)), 4)::DOUBLE AS rate,
    count(*) AS rows,
    count(*) FILTER (telling AND NOT fits) AS mismatch_rows FROM t""")
def _(df):
    return _relations(df, ["quantity", "unit_price", "amount"])


def _relations(df: DataFrame, columns: list[str]) -> DataFrame:
    found = relations.discover(df, columns)
    return df.sparkSession.createDataFrame([(r["left"], r["right"], r["target"], r["rate"], r["rows"], r["mismatch_rows"]) for r in found], "left string, right string, target string, rate double, rows long, mismatch_rows long")


_WIDE = ["quantity", "unit_price", "amount", "rate", "commission", "unit_weight", "weight", "freight", "gross", "discount", "tax", "position", "rebate"]
#: Every pair times every target, over all rows.
query("rel_discover_wide", "wide_lineitem", f"""
WITH x AS (SELECT [{', '.join(_WIDE)}] AS v FROM wide_lineitem),
k AS (SELECT unnest({_WIDE}) AS name, unnest(range(1, {len(_WIDE) + 1})) AS i),
c AS (SELECT a.name AS "left", b.name AS "right", t.name AS target, a.i AS ai, b.i AS bi, t.i AS ti FROM k a JOIN k b ON a.name < b.name JOIN k t ON t.i NOT IN (a.i, b.i)),
m AS (SELECT "left", "right", target, ai, bi, ti, v[ai] AS a, v[bi] AS b, v[ti] AS t FROM x, c WHERE v[ai] IS NOT NULL AND v[bi] IS NOT NULL AND v[ti] IS NOT NULL),
f AS (SELECT *, abs(a * b) > 1e-9 OR abs(t) > 1e-9 AS telling, abs(a * b - t) <= 0.02 * greatest(abs(t), 1.0) AS fits FROM m),
g AS (SELECT "left", "right", target, ai, bi, ti, count(*) AS rows, count(*) FILTER (telling) AS telling, count(*) FILTER (telling AND fits) AS hit,
    min(a) FILTER (telling) < max(a) FILTER (telling) AND min(b) FILTER (telling) < max(b) FILTER (telling) AND min(t) FILTER (telling) < max(t) FILTER (telling) AS varies FROM f GROUP BY ALL),
r AS (SELECT *, round_even(hit::DOUBLE / telling, 4) AS rate, telling - hit AS mismatch_rows FROM g WHERE rows >= 100 AND telling >= greatest(50, ceil(rows * 0.15)) AND varies AND hit >= 0.95 * telling)
SELECT "left", "right", target, rate::DOUBLE AS rate, rows, mismatch_rows
FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY target ORDER BY rate DESC, mismatch_rows, ai, bi, ti) = 1) ORDER BY rate DESC, mismatch_rows, ai, bi, ti LIMIT 3""")(lambda df: _relations(df, _WIDE))


query(
    "plan_email_repair",
    "dirty_customer",
    counted("dirty_customer", ["email"]) + r""",
d AS (SELECT lower(split_part(value, '@', 2)) AS domain FROM s WHERE regexp_matches(value, '^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$') GROUP BY 1 HAVING sum(n) >= 5),
b AS (SELECT s.name, s.value, s.n, d.domain, substr(s.value, 1, length(s.value) - length(d.domain)) AS local,
    row_number() OVER (PARTITION BY s.value ORDER BY length(d.domain) DESC) AS k FROM s JOIN d ON NOT contains(s.value, '@') AND ends_with(lower(s.value), d.domain) AND length(s.value) > length(d.domain))
SELECT name, value, local || '@' || domain AS repaired, n FROM b WHERE k = 1""",
)(lambda df: repairs.email_repairs(value_table(df, ["email"], "rid")))
query(
    "plan_id_prefix",
    "dirty_customer",
    counted("dirty_customer", ["cust_id"]) + r"""
SELECT name, value, regexp_extract(value, '^[A-Za-z]+[-_ #:]*(\d+)$', 1) AS repaired, n
FROM s
WHERE regexp_matches(value, '^[A-Za-z]+[-_ #:]*\d+$')""",
)(lambda df: repairs.id_prefixes(value_table(df, ["cust_id"], "rid")))
query(
    "plan_phone",
    "dirty_customer",
    counted("dirty_customer", ["phone"]) + r""",
d AS (SELECT *, regexp_replace(value, '\D', '', 'g') AS d FROM s),
u AS (SELECT arg_max(size, k) AS size FROM (SELECT length(d) AS size, sum(n) AS k FROM d GROUP BY 1)),
r AS (SELECT name, value, n, CASE WHEN length(d) < 6 THEN NULL WHEN length(d) = size THEN d WHEN d[1] = '0' AND length(d) - 1 = size THEN d[2:] WHEN length(d) - 1 = size THEN d[2:] WHEN length(d) - 2 = size THEN d[3:] WHEN length(d) - 3 = size THEN d[4:] WHEN value[1] = '+' THEN '+' || d ELSE d END AS repaired FROM d, u)
SELECT name, value, repaired, n FROM r WHERE repaired IS DISTINCT FROM value""",
)(lambda df: repairs.phone_repairs(value_table(df, ["phone"], "rid")))
query(
    "plan_decimal_marks",
    "dirty_customer",
    counted("dirty_customer", ["balance_text", "customer_age"]) + r"""
SELECT name, coalesce(sum(n) FILTER (regexp_matches(value, '\d,\d{1,2}(\D|$)')), 0)::BIGINT AS commas,
    coalesce(sum(n) FILTER (regexp_matches(value, '\d\.\d{1,2}(\D|$)')), 0)::BIGINT AS points,
    coalesce(sum(n) FILTER (regexp_matches(value, '\d,\d{1,2}(\D|$)')), 0) > coalesce(sum(n) FILTER (regexp_matches(value, '\d\.\d{1,2}(\D|$)')), 0) AS decimal_comma
FROM s
GROUP BY name""",
)(lambda df: repairs.decimal_marks(value_table(df, ["balance_text", "customer_age"], "rid")))
query(
    "plan_date_masks",
    "dirty_orders",
    counted("dirty_orders", ["order_date"]) + r""",
d AS (SELECT *, string_split_regex(value, '[-/.]') AS p,
    regexp_replace(value, '\d', '9', 'g') AS mask FROM s WHERE regexp_matches(value, '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$'))
SELECT name, mask, coalesce(sum(n) FILTER (length(p[1]) <> 4 AND p[1]::INTEGER > 12), 0)::BIGINT AS day_first,
    coalesce(sum(n) FILTER (length(p[1]) <> 4 AND p[1]::INTEGER <= 12 AND p[2]::INTEGER > 12), 0)::BIGINT AS month_first,
    sum(n)::BIGINT AS n FROM d GROUP BY name, mask""",
)(lambda df: repairs.date_masks(value_table(df, ["order_date"], "rid")))
query(
    "plan_iso_dates",
    "dirty_orders",
    counted("dirty_orders", ["order_date"]) + r""",
d AS (SELECT *, CASE WHEN regexp_matches(value, '^\d{4}[-/]') THEN coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%Y/%m/%d')) WHEN contains(value, '/') THEN try_strptime(value, '%d/%m/%Y') ELSE try_strptime(value, '%m-%d-%Y') END AS day FROM s WHERE regexp_matches(value, '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$'))
SELECT name, value, strftime(day, '%Y-%m-%d') AS iso, n FROM d""",
)(lambda df: repairs.iso_dates(value_table(df, ["order_date"], "rid")).select("name", "value", "iso", "n"))
query(
    "inspect_numeric_issues",
    "dirty_customer",
    f"WITH v AS ({cells('dirty_customer', ['balance_text', 'customer_age'])}), " + r"""
p AS (SELECT name, trim(value) AS value,
    replace(regexp_replace(trim(value), '(?i)[$€£¥]|\b(?:USD|EUR|GBP|MAD|DHS?)\b', '', 'g'), ' ', '') AS t FROM v WHERE value IS NOT NULL),
x AS (SELECT *, CASE WHEN regexp_matches(t, '^[-+]?(?:\d[\d.,]*|[.,]\d+)$') THEN TRY_CAST(replace(t, ',', '.') AS DOUBLE) END AS x FROM p)
SELECT name, count(*) AS non_null,
    count(x) AS parseable,
    count(*) - count(x) AS invalid,
    count(*) FILTER (x < 0) AS negative,
    min(x) AS min,
    max(x) AS max,
    count(*) FILTER (regexp_matches(value, '^[-+]?\d+,\d+$')) AS decimal_comma,
  count(*) FILTER (regexp_matches(value, '^[-+]?\d+\.\d+$')) AS decimal_point,
    count(*) FILTER (regexp_matches(value, '[^0-9,.+\-\s]')) AS affix,
    count(*) FILTER (regexp_matches(value, '^[-+]?\d+,\d+$')) > count(*) FILTER (regexp_matches(value, '^[-+]?\d+\.\d+$')) AS suggest_decimal_comma FROM x GROUP BY name""",
)(lambda df: tools.numeric_issues(df, ["balance_text", "customer_age"], "rid"))


def _before_after(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df, clean(df, [Action("replace_null_like", ("segment",)), Action("to_numeric", ("balance_text",)), Action("set_negative_to_null", ("customer_age",))], "rid").df


query(
    "validate_new_missing",
    "dirty_customer",
    f"""
WITH c AS (SELECT *, CASE WHEN lower(trim(segment)) IN {_NULLS} THEN NULL ELSE segment END AS s,
    {_NUM.format('balance_text')} AS b,
    CASE WHEN customer_age <> '-5' THEN customer_age END AS a FROM dirty_customer)
SELECT 'segment' AS name,
    count(*) FILTER (segment IS NOT NULL AND s IS NULL) AS new_missing FROM c UNION ALL SELECT 'balance_text', count(*) FILTER (balance_text IS NOT NULL AND b IS NULL) FROM c
UNION ALL SELECT 'customer_age', count(*) FILTER (customer_age IS NOT NULL AND a IS NULL) FROM c UNION ALL SELECT x, 0 FROM (VALUES ('cust_id'), ('full_name'), ('email'), ('phone')) v(x)""",
)(lambda df: validation.new_missing(*_before_after(df), "rid"))
query(
    "validate_negatives",
    "dirty_customer",
    r"""
WITH c AS (SELECT regexp_matches(balance_text, '^\s*-\s*[\d.,]') AS b, regexp_matches(customer_age, '^\s*-\s*[\d.,]') AS a FROM dirty_customer)
SELECT 'balance_text' AS name,
    count(*) FILTER (b) AS negative,
    count(*) FILTER (b) AS kept,
    0 AS lost FROM c UNION ALL SELECT 'customer_age', count(*) FILTER (a), 0, count(*) FILTER (a) FROM c""",
)(lambda df: validation.negatives(*_before_after(df), "rid"))
query(
    "quality_format_rows",
    "dirty_customer",
    counted("dirty_customer", ["cust_id"]) + r""",
m AS (SELECT *, regexp_replace(regexp_replace(value, '\d+', '9', 'g'), '[A-Za-z]+', 'A', 'g') AS mask FROM s), u AS (SELECT arg_max(mask, k) AS mask FROM (SELECT mask, sum(n) AS k FROM m GROUP BY mask))
SELECT m.name, coalesce(sum(n) FILTER (m.mask <> u.mask), 0)::BIGINT AS n FROM m, u GROUP BY m.name""",
)(lambda df: validation.format_rows(value_table(df, ["cust_id"], "rid"), ["cust_id"]))
query(
    "export_display",
    "customer",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, replace(regexp_replace(printf('%.10f', c_acctbal), '\\.?0+$', ''), '.', ',') AS c_acctbal
FROM customer""",
)(lambda df: sinks.display(df.select("c_custkey", "c_name", "c_acctbal")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import flow_catalog  # noqa: F401  registers its queries

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from . import flow_catalog  # noqa: F401

    return dict(_SQL)
