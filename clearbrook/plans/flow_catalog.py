"""Queries over the main flow: requirements, plan, rewrites, validation and quality, with SQL that derives the same from the tables.

``facts`` is one chain of common table expressions over any messy table: v are its cells, s its
usable values, kinds its columns' kinds. The rules are then stated one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.shared import shared_path, stored
from ..functions.text import number_text
from ..operators import inspect as tools
from ..operators import profile
from ..operators import scan as scanning
from ..operators.cleaning import clean
from ..operators.values import value_table
from ..sources import sinks, tabular
from . import planner, validation
from .catalog import _SCAN, TEXT, _NULLS, cells, query
from .model import OPERATIONS, Action, PlanError, Requirement, default_selection, finalise, merge_replacements, ordered, resolve_chains, reviewed, uncovered, without_repeats
from .requirements import requirements
from .views import VIEWS

#: Tables of the flow: columns, and the column that orders rows.
TABLES = {
    "dirty_customer": (TEXT, "rid"),
    "dirty_orders": (["order_id", "o_totalprice", "order_date"], "rid"),
    "dirty_lineitem": (["quantity", "unit_price", "amount"], "row_key"),
    "dirty_supplier": (["supplier_name", "country", "region_label", "list_price", "score"], "rid"),
    "dirty_part": (["p_brand", "part_type"], "rid"),
}
_SHAPE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"
_NUMBER = r"^[-+]?(?:\d[\d.,]*|[.,]\d+)$"
_MAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
_KEY = r"(^|_)(id|uuid|ref|sku|key)(_|$)"


def facts(of: str) -> str:
    columns, rid = TABLES[of]
    place = "CASE name " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(columns)) + " END"
    return f"""v AS ({cells(of, columns, rid)}),
s AS (SELECT name, trim(value) AS value, count(*) AS n, min(rid) AS first, regexp_replace(lower(trim(value)), '[^a-z0-9]', '', 'g') AS key FROM v
  WHERE value IS NOT NULL AND trim(value) <> '' AND NOT regexp_matches(trim(value), '{_SCAN}') GROUP BY name, trim(value)),
x AS (SELECT *, CASE WHEN regexp_matches(t, '{_NUMBER}') THEN TRY_CAST(replace(t, ',', '.') AS DOUBLE) END AS x FROM
  (SELECT *, replace(regexp_replace(value, '(?i)[$€£¥]|\\b(?:USD|EUR|GBP|MAD|DHS?)\\b', '', 'g'), ' ', '') AS t FROM s)),
real AS (SELECT *, coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%Y/%m/%d'), try_strptime(value, '%m/%d/%Y'), try_strptime(value, '%m-%d-%Y'), try_strptime(value, '%d/%m/%Y'), try_strptime(value, '%d-%m-%Y')) IS NOT NULL AND regexp_matches(value, '{_SHAPE}') AS real FROM s),
kinds AS (SELECT name, {place} AS place, ident, CASE WHEN mail OR mails >= 0.5 * total THEN 'email' WHEN dates >= 0.5 * total THEN 'date' WHEN numbers >= 0.5 * total THEN 'numeric'
    WHEN forms <= 80 AND NOT ident THEN 'categorical' WHEN ident THEN 'identifier' ELSE 'text' END AS kind FROM
  (SELECT name, regexp_matches(lower(name), 'mail') AS mail, regexp_matches(name, '{_KEY}|phone') AS ident, count(*) AS forms, sum(n) AS total,
    sum(CASE WHEN contains(value, '@') THEN n ELSE 0 END) AS mails, sum(CASE WHEN regexp_matches(value, '{_SHAPE}') THEN n ELSE 0 END) AS dates, sum(CASE WHEN x IS NOT NULL THEN n ELSE 0 END) AS numbers FROM x GROUP BY name)),
nulls AS (SELECT name, trim(value) AS value, count(*) AS n FROM v WHERE trim(value) = '' OR regexp_matches(trim(value), '{_SCAN}') GROUP BY name, trim(value)),
nums AS (SELECT x.*, regexp_matches(name, '(^|_)ages?(_|$)') AS age, regexp_matches(name, 'price|cost|stock') AS positive, t <> value OR contains(t, ',') AS marked FROM x JOIN kinds USING (name) WHERE kind = 'numeric' AND NOT ident),
masks AS (SELECT name, regexp_replace(regexp_replace(value, '\\d', '9', 'g'), '[A-Za-zÀ-ÿ]+', 'A', 'g') AS mask, sum(n) AS n FROM s GROUP BY 1, 2),
formats AS (SELECT name FROM masks JOIN kinds USING (name) WHERE ident GROUP BY name HAVING count(*) > 1 AND sum(n) - max(n) >= 0.02 * sum(n)),
cats AS (SELECT s.* FROM s JOIN kinds USING (name) WHERE kind = 'categorical'),
groups AS (SELECT name, key, sum(n) AS n, count(*) AS forms, count(DISTINCT lower(value)) AS lowered, arg_max(value, n * 10000000 - first) AS dominant, max(n) AS most FROM cats GROUP BY name, key),
wrong AS (SELECT name, key, arg_max(right_, n * 1000 + length(right_key)) AS target, dominant, max(n) AS times, any_value(most) AS most, arg_max(right_most, n) AS right_most FROM
  (SELECT a.name, a.key, a.dominant, a.most, b.dominant AS right_, b.key AS right_key, b.n, b.most AS right_most FROM groups a JOIN groups b ON a.name = b.name AND a.key <> b.key AND b.n >= greatest(3, 3 * a.n)
    AND levenshtein(a.key, b.key) = 1 AND length(a.key) >= 4 AND regexp_replace(a.key, '\\D', '', 'g') = regexp_replace(b.key, '\\D', '', 'g')) GROUP BY name, key, dominant),
keyed AS (SELECT name FROM v WHERE regexp_matches(name, '{_KEY}') GROUP BY name HAVING count(DISTINCT value) >= 0.7 * count(value) AND count(DISTINCT value) < count(value)),
rows AS (SELECT {', '.join(columns)}, count(*) AS n FROM {of} GROUP BY ALL)"""


def _relation(of: str, what: str) -> str:
    """Rows of dirty_lineitem that break the relation, or cells that it can fill; nothing in other tables."""
    if of != "dirty_lineitem":
        return "FALSE"
    return {"broken": "EXISTS (SELECT 1 FROM dirty_lineitem WHERE abs(quantity * unit_price - amount) > 0.02 * greatest(abs(amount), 1.0))", "open": "EXISTS (SELECT 1 FROM dirty_lineitem WHERE (quantity IS NULL)::INT + (unit_price IS NULL)::INT + (amount IS NULL)::INT = 1)"}[what]


def requirements_sql(of: str) -> str:
    rule = lambda name, issue, ops, rest, review="FALSE", tokens="''": f"SELECT {name} AS \"column\", '{issue}' AS issue, '{ops}' AS use_one_of, {review} AS review_required, {tokens} AS tokens {rest}"  # noqa: E731
    listed = "string_agg(DISTINCT value, '|' ORDER BY value)"
    return f"WITH {facts(of)} " + " UNION ALL ".join([
        rule("NULL", "full_duplicates", "drop_duplicate_rows", "WHERE EXISTS (SELECT 1 FROM rows WHERE n > 1)"),
        rule("name", "whitespace", "strip_whitespace", "FROM v WHERE value <> trim(value) GROUP BY name"),
        rule("name", "null_like", "replace_null_like, replace_values", "FROM nulls GROUP BY name", tokens=listed),
        rule("name", "number_format", "to_numeric", "FROM nums WHERE x IS NOT NULL AND marked GROUP BY name"),
        rule("name", "unparseable", "replace_values, replace_null_like", "FROM nums WHERE x IS NULL GROUP BY name", tokens=listed),
        rule("name", "text_numbers", "to_numeric", "FROM nums WHERE x IS NULL OR marked GROUP BY name"),
        rule("name", "implausible_age", "replace_null_like", "FROM nums WHERE age AND (x < 0 OR x > 120) GROUP BY name", "TRUE", listed),
        rule("name", "negative", "set_negative_to_null", "FROM nums WHERE NOT age AND x < 0 GROUP BY name", "NOT bool_or(positive)"),
        rule(
            "name", "dates", "to_datetime",
            """FROM real JOIN kinds USING (name) WHERE kind = 'date' GROUP BY name
          HAVING NOT bool_and(real) OR count(DISTINCT regexp_replace(value, '\\d', '9', 'g')) > 1""",
            "NOT bool_and(real)",
        ),
        rule("name", "email_case", "normalize_case", "FROM s JOIN kinds USING (name) WHERE kind = 'email' AND value <> lower(value) GROUP BY name"),
        rule(
            "name", "email_format", "replace_values",
            f"FROM s JOIN kinds USING (name) WHERE kind = 'email' AND NOT regexp_matches(value, '{_MAIL}') GROUP BY name",
            "TRUE",
        ),
        rule("name", "case_variants", "normalize_case, replace_values", "FROM groups WHERE forms > 1 AND lowered = 1 GROUP BY name"),
        rule("name", "punctuation_variants", "replace_values", "FROM groups WHERE lowered > 1 GROUP BY name"),
        rule("name", "typos", "replace_values", "FROM wrong GROUP BY name"),
        rule(
            "name", "country_mix", "replace_values",
            """FROM cats WHERE regexp_matches(name, 'country|nation') GROUP BY name
          HAVING bool_or(regexp_matches(value, '^[A-Za-z]{2,3}$')) AND bool_or(regexp_matches(value, '[A-Za-z]{4,}'))""",
        ),
        rule(
            "name", "name_case", "normalize_case",
            """FROM s JOIN kinds USING (name) WHERE kind = 'text' AND regexp_matches(name, '(^|_)name(_|$)')
          AND regexp_matches(value, '[A-Za-z]') AND (value = lower(value) OR value = upper(value)) GROUP BY name""",
            "TRUE",
        ),
        rule("name", "identifier_formats", "replace_values", "FROM formats", "TRUE"),
        rule("'amount'", "relationship", "recalculate_from_columns", f"WHERE {_relation(of, 'broken')}", "TRUE"),
        rule("name", "repeated_key", "drop_duplicates_by_columns", "FROM keyed", "TRUE"),
    ])  # fmt: skip


def actions_sql(of: str) -> str:
    """The plan's actions but for their replacement pairs."""
    text = [c for c in TABLES[of][0] if of == "dirty_customer" or c in ("supplier_name", "country", "region_label", "order_date", "p_brand", "part_type")]
    rule = lambda op, cols, rest, confidence="'high'", review="FALSE", tokens="''", case="''", comma="FALSE": f"SELECT '{op}' AS operation, {cols} AS columns, {confidence} AS confidence, {review} AS requires_review, {tokens} AS null_tokens, {case} AS case_mode, {comma} AS decimal_comma {rest}"  # noqa: E731
    listed = "string_agg(DISTINCT value, '|' ORDER BY value)"
    plain = ", ".join(f"lower(trim(CAST({c} AS VARCHAR)))" for c in TABLES[of][0])
    person = "FROM s JOIN kinds USING (name) WHERE kind = 'text' AND regexp_matches(name, '(^|_)name(_|$)') AND regexp_matches(value, '[A-Za-z]') AND (value = lower(value) OR value = upper(value)) GROUP BY name"
    return f"WITH {facts(of)} " + " UNION ALL ".join([
        rule("strip_whitespace", "string_agg(DISTINCT name, ', ' ORDER BY name)", "FROM v WHERE value <> trim(value) HAVING count(*) > 0"),
        rule(
            "replace_null_like", "string_agg(name, ', ' ORDER BY name)",
            f"FROM (SELECT name, {listed} AS tokens FROM nulls GROUP BY name) GROUP BY tokens",
            tokens="tokens",
        ),
        rule(
            "replace_values", "name",
            """FROM (SELECT name, bool_and(most >= 0.6 * n) AS sure FROM groups WHERE forms > 1 AND (name, key) NOT IN (SELECT name, key
          FROM wrong) OR (name, key) IN (SELECT name, key FROM wrong) GROUP BY name) WHERE name IN (SELECT name FROM groups
          WHERE forms > 1 UNION SELECT name FROM wrong)""",
            "CASE WHEN sure THEN 'high' ELSE 'medium' END", "NOT sure",
        ),
        rule("normalize_case", "name", "FROM s JOIN kinds USING (name) WHERE kind = 'email' AND value <> lower(value) GROUP BY name", case="'lower'"),
        rule(
            "replace_values", "name",
            f"FROM s JOIN kinds USING (name) WHERE kind = 'email' AND NOT regexp_matches(value, '{_MAIL}') GROUP BY name",
            "'medium'", "TRUE",
        ),
        rule("replace_values", "name", "FROM nums WHERE x IS NULL AND lower(value) = 'seven' GROUP BY name"),
        rule("replace_null_like", "name", "FROM nums WHERE x IS NULL AND lower(value) <> 'seven' GROUP BY name", tokens=listed),
        rule("replace_null_like", "name", "FROM nums WHERE age AND (x < 0 OR x > 120) GROUP BY name", "'medium'", "TRUE", listed),
        rule(
            "set_negative_to_null", "name", "FROM nums WHERE NOT age AND x < 0 GROUP BY name",
            "CASE WHEN bool_or(positive) THEN 'medium' ELSE 'low' END", "TRUE",
        ),
        rule(
            "replace_values", "name",
            """FROM real JOIN kinds USING (name) WHERE kind = 'date' AND real AND NOT regexp_matches(value, '^\\d{4}-\\d\\d-\\d\\d$')
          GROUP BY name""",
        ),
        rule("to_datetime", "name", "FROM real JOIN kinds USING (name) WHERE kind = 'date' GROUP BY name", review="NOT bool_and(real)"),
        rule("normalize_case", "name", person, "'medium'", "TRUE", case="'title'"),
        rule(
            "replace_values", "name",
            f"""FROM formats WHERE regexp_matches(name, 'phone') OR name IN (SELECT name FROM keyed) AND name IN (SELECT name FROM s
          GROUP BY name HAVING sum(CASE WHEN regexp_matches(value, '^\\d+$') THEN n ELSE 0 END) BETWEEN 0.8 * sum(n)
          AND sum(n) - 1)""",
            "'medium'", "TRUE",
        ),
        rule("no_change", "name", "FROM formats WHERE NOT regexp_matches(name, 'phone') AND name NOT IN (SELECT name FROM keyed)", "'low'", "TRUE"),
        rule(
            "no_change", "name",
            """FROM cats WHERE regexp_matches(name, 'country|nation') AND name NOT IN (SELECT name FROM groups WHERE forms > 1 UNION
          SELECT name FROM wrong) GROUP BY name HAVING bool_or(regexp_matches(value, '^[A-Za-z]{2,3}$'))
          AND bool_or(regexp_matches(value, '[A-Za-z]{4,}'))""",
            "'low'", "TRUE",
        ),
        rule(
            "to_numeric", "string_agg(name, ', ' ORDER BY name)",
            f"""FROM (SELECT name, sum(CASE WHEN regexp_matches(value, '\\d,\\d{{1,2}}(\\D|$)') THEN n ELSE 0 END) > sum(CASE WHEN regexp_matches(value, '\\d\\.\\d{{1,2}}(\\D|$)') THEN n ELSE 0 END) AS comma
          FROM nums WHERE name IN ({', '.join(map(repr, text)) or 'NULL'}) AND NOT regexp_matches(name, '{_KEY}|phone')
          GROUP BY name) GROUP BY comma""",
            comma="comma",
        ),
        rule("drop_duplicates_by_columns", "name", "FROM keyed", "'low'", "TRUE"),
        rule("drop_duplicate_rows", "''", "WHERE EXISTS (SELECT 1 FROM rows WHERE n > 1)"),
        rule(
            "drop_duplicate_rows_after_cleaning", "''",
            f"WHERE (SELECT count(DISTINCT ({plain})) FROM {of}) < (SELECT count(*) FROM rows)",
            "'medium'", "TRUE",
        ),
        rule("fill_missing_from_formula", "'amount'", f"WHERE {_relation(of, 'open')}", "'medium'", "TRUE"),
        rule("recalculate_from_columns", "'amount'", f"WHERE {_relation(of, 'broken')}", "'medium'", "TRUE"),
    ])  # fmt: skip


def issues_sql(of: str) -> str:
    total = lambda key, rest, what="n": f"SELECT '{key}' AS key, CAST(coalesce((SELECT sum({what}) {rest}), 0) AS BIGINT) AS n"  # noqa: E731
    plain = ", ".join(TABLES[of][0])
    return f"WITH {facts(of)} " + " UNION ALL ".join([
        total("whitespace", "FROM v WHERE value <> trim(value)", "1"),
        total("null_like", "FROM nulls"),
        total("number_format", "FROM nums WHERE x IS NOT NULL", "n * ((t <> value)::INT + contains(t, ',')::INT)"),
        total("unparseable", "FROM nums WHERE x IS NULL"),
        total(
            "date_formats",
            f"""FROM (SELECT sum(n) - max(n) AS n FROM (SELECT name, regexp_replace(value, '\\d', '9', 'g') AS mask, sum(n) AS n
          FROM real JOIN kinds USING (name) WHERE kind = 'date' AND regexp_matches(value, '{_SHAPE}') GROUP BY 1, 2)
          GROUP BY name)""",
        ),
        total("invalid_dates", "FROM real JOIN kinds USING (name) WHERE kind = 'date' AND NOT real"),
        total(
            "variants",
            """FROM (SELECT c.n FROM cats c JOIN groups g USING (name, key) WHERE g.forms > 1 AND c.value <> g.dominant UNION ALL
          SELECT c.n FROM cats c JOIN wrong w ON c.name = w.name AND c.value = w.dominant)""",
        ),
        total(
            "emails", f"FROM s JOIN kinds USING (name) WHERE kind = 'email'",
            f"n * ((value <> lower(value))::INT + (NOT regexp_matches(value, '{_MAIL}'))::INT)",
        ),
        total(
            "names",
            """FROM s JOIN kinds USING (name) WHERE kind = 'text' AND contains(name, 'name') AND regexp_matches(value, '[A-Za-z]')
          AND (value = lower(value) OR value = upper(value))""",
        ),
        total("negatives", "FROM nums WHERE NOT age AND x < 0"),
        total("ages", "FROM nums WHERE age AND (x < 0 OR x > 120)"),
        total("id_formats", """FROM (SELECT s.n FROM s JOIN kinds USING (name) JOIN (SELECT name, arg_max(mask, n) AS mask FROM (SELECT name, regexp_replace(regexp_replace(value, '\\d+', '9', 'g'), '[A-Za-z]+', 'A', 'g') AS mask, sum(n) AS n FROM s GROUP BY 1, 2) GROUP BY name) u USING (name)
          JOIN (SELECT name, arg_max(size, n) AS size FROM (SELECT name, length(regexp_replace(value, '\\D', '', 'g')) AS size, sum(n) AS n FROM s GROUP BY 1, 2) GROUP BY name) w USING (name)
          WHERE ident AND (regexp_replace(regexp_replace(value, '\\d+', '9', 'g'), '[A-Za-z]+', 'A', 'g') <> u.mask OR regexp_matches(name, 'phone') AND length(regexp_replace(value, '\\D', '', 'g')) <> w.size))"""),
        total("duplicates", "FROM rows", "n - 1"),
        total(
            "key_conflicts",
            """FROM (SELECT name, value, count(*) AS n FROM v JOIN keyed USING (name) WHERE value IS NOT NULL GROUP BY 1, 2
          HAVING count(*) > 1)""",
        ),
        total(
            "relations",
            f"FROM (SELECT 1 AS n FROM {of} WHERE abs(quantity * unit_price - amount) > 0.02 * greatest(abs(amount), 1.0))"
            if of == "dirty_lineitem"
            else "FROM (SELECT 0 AS n)",
        ),
    ])  # fmt: skip


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _scanned(of: str):
    return lambda df: scanning.scan(df, TABLES[of][1], TABLES[of][0])


for _of in TABLES:
    _short = _of.removeprefix("dirty_")

    @query(f"requirements_{_short}", _of, requirements_sql(_of))
    def _(df, of=_of):
        found = requirements(_scanned(of)(df))
        return _rows(df, [(r.column, r.issue, ", ".join(r.use_one_of), r.review_required, "|".join(sorted(r.required_tokens))) for r in found], "`column` string, issue string, use_one_of string, review_required boolean, tokens string")

    @query(f"plan_actions_{_short}", _of, actions_sql(_of))
    def _(df, of=_of):
        actions = planner.plan(df.select(TABLES[of][1], *TABLES[of][0]), TABLES[of][1]).actions
        return _rows(df, [(a.operation, ", ".join(sorted(a.columns)), a.confidence, a.requires_review, "|".join(sorted(a.null_tokens or ())), a.case_mode or "", a.decimal_comma) for a in actions], "operation string, columns string, confidence string, requires_review boolean, null_tokens string, case_mode string, decimal_comma boolean")

    @query(f"quality_counts_{_short}", _of, issues_sql(_of))
    def _(df, of=_of):
        columns, order = TABLES[of]
        values = stored(value_table(df, columns, order), "values")
        counts = validation.issue_counts(df, scanning.scan(df, order, columns, values=values), order, values)
        return _rows(df, sorted(counts.items()), "key string, n long")


@query("plan_pairs_customer", "dirty_customer", f"WITH {facts('dirty_customer')}" + r"""
SELECT 'segment' AS "column", c.value AS old, coalesce(w.target, g.dominant) AS new FROM cats c JOIN groups g USING (name, key) LEFT JOIN wrong w USING (name, key) WHERE w.target IS NOT NULL OR (g.forms > 1 AND c.value <> g.dominant)
UNION ALL SELECT name, value, '7' FROM nums WHERE x IS NULL AND lower(value) = 'seven'
UNION ALL SELECT name, value, regexp_extract(value, '^[A-Za-z]+[-_ #:]*(\d+)$', 1) FROM s WHERE name = 'cust_id' AND regexp_matches(value, '^[A-Za-z]+[-_ #:]*\d+$')""")
def _(df):
    """The replacements of categories, number words and identifiers, listed or stored."""
    actions = planner.plan(df, "rid").actions
    own = [a for a in actions if a.operation == "replace_values" and a.columns[0] in ("segment", "balance_text", "cust_id")]
    out = _rows(df, [(a.columns[0], k, v) for a in own for k, v in (a.replacements or {}).items()], "`column` string, old string, new string")
    for a in (a for a in own if a.replacements_path):  # beyond MOST_PAIRS
        out = out.union(df.sparkSession.read.parquet(a.replacements_path).select(F.lit(a.columns[0]), "_old", "_new"))
    return out


@query("plan_open_decisions", "dirty_customer", f"WITH {facts('dirty_customer')} SELECT name AS \"column\", value AS form FROM cats JOIN groups g USING (name, key) WHERE value = g.dominant AND (name, key) NOT IN (SELECT name, key FROM wrong)")
def _(df):
    opened = planner.plan(df, "rid").open_decisions
    return _rows(df, [(c, f) for c, forms in opened.items() for f in forms], "`column` string, form string")


@query("plan_forecast", "dirty_customer", f"SELECT count(*) AS rows, count(*) - count(DISTINCT ({', '.join(TEXT)})) AS exact_duplicates, count(DISTINCT ({', '.join(TEXT)})) AS expected_rows FROM dirty_customer")
def _(df):
    f = planner.forecast(df, "rid")
    return _rows(df, [(f["rows"], f["exact_duplicates"], f["expected_rows"])], "rows long, exact_duplicates long, expected_rows long")


@query("plan_rewrites", "region", """SELECT * FROM (VALUES
  ('chains', 'a>c, b>c, x>c'), ('cycle', 'a>b, b>a'), ('merged', 'low a>b, b>c, x>a'), ('merged review', 'medium q>r'),
  ('order', 'strip_whitespace, replace_null_like, to_numeric, fill_missing_from_formula, drop_duplicate_rows_after_cleaning'),
  ('once', '1'), ('uncovered', 'R2'), ('note', 'no_change c True low'), ('reviewer', 'medium True a>b'), ('default', 'strip_whitespace'),
  ('summary', 'strip_whitespace c: outer space')) v("case", result)""")
def _(df):
    """The rewrites of a plan on fixed actions, one case a row."""
    pairs = lambda a: ", ".join(f"{k}>{v}" for k, v in sorted(a.replacements.items()))  # noqa: E731
    replace = lambda r, **k: Action("replace_values", ("c",), replacements=r, **k)  # noqa: E731
    some = [replace({"a": "b", "x": "a"}), replace({"b": "c"}, confidence="low"), replace({"q": "r"}, confidence="medium", requires_review=True)]
    merged = merge_replacements(some)
    strip, null = Action("strip_whitespace", ("c",), "outer space"), Action("replace_null_like", ("c",), null_tokens=("n/a",))
    needs = [Requirement("R1", "c", "null_like", ("replace_null_like",), False, ("N/A",)), Requirement("R2", "c", "null_like", ("replace_null_like",), False, ("n/a", "unk"))]
    note = finalise([null], [], needs)[-1]
    mixed = [Action("drop_duplicate_rows_after_cleaning"), Action("fill_missing_from_formula", ("c",), source_columns=("a", "b")), Action("to_numeric", ("c",)), null, strip]
    kept = reviewed([{"operation": "drop_duplicate_rows"}, {"operation": "replace_values", "column": "c", "replacements": {"a": "b", "x": " ", "y": "unk"}, "confidence": "sure", "requires_review": 1}], lambda v: v.lower() in ("unk",))[0]
    cases = [
        ("chains", pairs(resolve_chains(merged)[0])), ("cycle", pairs(resolve_chains([replace({"a": "b", "b": "a"})])[0])),
        ("merged", f"{merged[0].confidence} {pairs(merged[0])}"), ("merged review", f"{merged[1].confidence} {pairs(merged[1])}"),
        ("order", ", ".join(a.operation for a in ordered(mixed))), ("once", str(len(without_repeats([strip, strip])))),
        ("uncovered", ", ".join(n.id for n in uncovered([null], needs))), ("note", f"{note.operation} {note.columns[0]} {note.requires_review} {note.confidence}"),
        ("reviewer", f"{kept.confidence} {kept.requires_review} {pairs(kept)}"), ("default", ", ".join(a.operation for a in default_selection([strip, note, some[2]]))),
        ("summary", planner.summary([strip])[0]),
    ]  # fmt: skip
    return _rows(df, cases, "`case` string, result string")


@query("plan_rewrites_nation", "nation", """
WITH n AS (SELECT n_nationkey AS k, n_name AS old, lead(n_name) OVER (ORDER BY n_nationkey) AS next, last_value(n_name) OVER (PARTITION BY n_nationkey // 5 ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM nation),
p AS (SELECT 1 AS step, 'strip_whitespace' AS operation, '' AS old, '' AS new, 'high' AS confidence, false AS review
UNION ALL SELECT 2, 'replace_null_like', upper(old), '', 'high', false FROM n WHERE k % 2 = 0
UNION ALL SELECT 3, 'replace_values', old, last, 'low', false FROM n WHERE k % 5 < 4
UNION ALL SELECT 4, 'replace_values', old, coalesce(next, old), 'medium', true FROM n WHERE k % 5 = 4
UNION ALL SELECT 5, 'no_change', 'R' || k, '', 'low', true FROM n WHERE k % 2 = 1)
SELECT * FROM p""")
def _(df):
    """A plan whose replacements, markers and requirements come from a table: merged, chains followed to their ends, without repeats, in order, what isn't covered noted."""
    rows = [(r["n_nationkey"], r["n_name"]) for r in df.orderBy("n_nationkey").collect()]  # 25 nations at every scale
    to = {k: rows[min(i + 1, len(rows) - 1)][1] for i, (k, _) in enumerate(rows)}
    replace = lambda test, **how: Action("replace_values", ("n_name",), replacements={n: to[k] for k, n in rows if test(k % 5)}, **how)  # noqa: E731
    strip = Action("strip_whitespace", ("n_name",))
    marks = Action("replace_null_like", ("n_name",), null_tokens=tuple(n.upper() for k, n in rows if k % 2 == 0))
    needs = [Requirement(f"R{k}", "n_name", f"R{k}", ("replace_null_like",), False, (n,)) for k, n in rows]
    final = finalise([replace(lambda k: k < 3), marks, strip, replace(lambda k: k == 4, confidence="medium", requires_review=True), strip], [replace(lambda k: k == 3, confidence="low")], needs)
    out = []
    for a in final:
        step = {"strip_whitespace": 1, "replace_null_like": 2, "no_change": 5}.get(a.operation) or (4 if a.requires_review else 3)
        pairs = [(t, "") for t in a.null_tokens or ()] or list((a.replacements or {}).items()) or [(a.reason.removeprefix("not covered: ") if a.operation == "no_change" else "", "")]
        out += [(step, a.operation, old, new, a.confidence, a.requires_review) for old, new in pairs]
    assert [r[0] for r in out] == sorted(r[0] for r in out)
    return _rows(df, out, "step int, operation string, old string, new string, confidence string, review boolean")


@query("validate_report", "dirty_customer", f"""
WITH c AS (SELECT *, CASE WHEN lower(trim(segment)) IN {_NULLS} THEN NULL ELSE segment END AS s, TRY_CAST(replace(regexp_replace(balance_text, '[^0-9,.\\-]', '', 'g'), ',', '.') AS DOUBLE) AS b FROM dirty_customer),
k AS (SELECT min(rid) AS rid FROM c GROUP BY cust_id, full_name, email, s, b, customer_age, phone), j AS (SELECT c.* FROM c JOIN k USING (rid)),
n AS (SELECT (SELECT count(*) FROM c) AS rows_before, (SELECT count(*) FROM j) AS rows_after)
SELECT 'rows' AS name, 'ok' AS status, '' AS "column", rows_before AS a, rows_after AS b FROM n UNION ALL SELECT 'removed_rows_logged', 'ok', '', rows_before - rows_after, rows_before - rows_after FROM n
UNION ALL SELECT 'columns', 'ok', '', 8, 8 UNION ALL SELECT 'duplicates', 'ok', '', 0, 0 UNION ALL SELECT 'types', 'ok', 'balance_text', 1, 1
UNION ALL SELECT 'new_missing', 'warning', 'segment', count(*), 0 FROM j WHERE segment IS NOT NULL AND s IS NULL UNION ALL SELECT 'new_missing', 'warning', 'balance_text', count(*), 0 FROM j WHERE balance_text IS NOT NULL AND b IS NULL
UNION ALL SELECT 'negatives', 'ok', 'balance_text', count(*), 0 FROM j WHERE regexp_matches(balance_text, '^\\s*-\\s*[\\d.,]') UNION ALL SELECT 'negative_ages', 'ok', 'customer_age', count(*), 0 FROM j WHERE regexp_matches(customer_age, '^\\s*-\\s*[\\d.,]')
UNION ALL SELECT 'overall', 'warning', '', 0, 0""")
def _(df):
    report, _ = validation.validate_cleaning(df, [Action("replace_null_like", ("segment",)), Action("to_numeric", ("balance_text",)), Action("drop_duplicate_rows_after_cleaning")], "rid")
    pick = {"rows": ("before", "after"), "removed_rows_logged": ("logged", "removed"), "columns": ("before", "after"), "duplicates": ("left", "left"), "new_missing": ("cells", None), "negatives": ("kept", "lost"), "negative_ages": ("kept", "lost")}
    rows = []
    for c in report.checks:
        a, b = pick.get(c["name"], (None, None))
        changed = c.get("changed")
        rows.append((c["name"], c["status"], changed[0][0] if changed else c.get("column", ""), len(changed) if changed else c.get(a) or 0, len(changed) if changed else c.get(b) or 0))
    return _rows(df, [*rows, ("overall", report.status, "", 0, 0)], "name string, status string, `column` string, a long, b long")


@query("validate_failures", "nation", """SELECT * FROM (VALUES ('rows', 'error'), ('removed_rows_logged', 'warning'), ('columns', 'error'), ('duplicates', 'warning'), ('new_missing', 'error'), ('negatives', 'warning'), ('types', 'ok'), ('overall', 'error')) v(name, status)""")
def _(df):
    """A result with more rows and columns than the table, repeats, cells emptied without an action, and a lost sign."""
    before = df.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") == 3, "-7").otherwise("5").alias("amount"))
    after = before.union(before.where("n_nationkey < 2").withColumn("n_nationkey", F.col("n_nationkey") + 100)).withColumns({"n_name": F.when(F.col("n_nationkey") != 4, F.col("n_name")), "amount": F.translate("amount", "-", ""), "more": F.lit(1)})
    report = validation.validate(before, after, [], "n_nationkey")
    return _rows(df, [*((c["name"], c["status"]) for c in report.checks), ("overall", report.status)], "name string, status string")


@query("tool_overview", "dirty_customer", f"SELECT 'find_duplicates' AS tool, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS a, coalesce(sum(n - 1), 0)::BIGINT AS b FROM (SELECT count(*) AS n FROM dirty_customer GROUP BY {', '.join(TEXT)}) UNION ALL SELECT 'inspect_column', count(*) - count(segment), count(DISTINCT segment) FROM dirty_customer UNION ALL SELECT 'detect_text_anomalies', count(*) FILTER (full_name <> trim(full_name)), 0 FROM dirty_customer UNION ALL SELECT 'verify_external_reference', 2, 0")
def _(df):
    """One figure or two of each inspection, called by name."""
    run = lambda name, **k: tools.run_tool(name, df, "rid", **k)  # noqa: E731
    twice, column, text = run("find_duplicates"), run("inspect_column", column="segment"), run("detect_text_anomalies", columns=["full_name"])
    present = run("verify_external_reference", column="segment", values=["BUILDING", "MACHINERY", "NO SUCH"])["present"]
    return _rows(df, [("find_duplicates", twice["involved"], twice["removable"]), ("inspect_column", column["missing"], column["unique"]), ("detect_text_anomalies", text["full_name"]["whitespace"], 0), ("verify_external_reference", len(present), 0)], "tool string, a long, b long")


@query("scan_examples", "dirty_customer", f"""WITH {facts('dirty_customer')},
e AS (SELECT name, 'whitespace' AS what, value, count(*) AS n, min(rid) AS first FROM v WHERE value <> trim(value) GROUP BY name, value
  UNION ALL SELECT name, 'bad_mails', value, n, first FROM s WHERE NOT regexp_matches(value, '{_MAIL}') AND name = 'email'
  UNION ALL SELECT name, 'odd_case', value, n, first FROM s WHERE regexp_matches(value, '[A-Za-z]') AND (value = lower(value) OR value = upper(value)) AND name = 'full_name')
SELECT * FROM (SELECT name, what, row_number() OVER (PARTITION BY name, what ORDER BY first, value) AS rank, value, n FROM e) WHERE rank <= CASE what WHEN 'whitespace' THEN 5 ELSE 8 END""")
def _(df):
    found = scanning.examples(value_table(df, TEXT, "rid"))
    return found.where("what = 'whitespace' or (what = 'bad_mails' and name = 'email') or (what = 'odd_case' and name = 'full_name')")


@query("scan_invalid_dates", "dirty_orders", f"WITH {facts('dirty_orders')} SELECT name, rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first) AS rank FROM real WHERE NOT real AND name = 'order_date') WHERE rank <= 10")
def _(df):
    return scanning.examples(value_table(df, ["order_date"], "rid")).where("what = 'bad_dates'").select("name", "rank", "value", "n")


_DAY = "lpad(CAST({} AS VARCHAR), 4, '0') || '-' || lpad(CAST({} AS VARCHAR), 2, '0') || '-' || lpad(CAST({} AS VARCHAR), 2, '0')"


@query("clean_mixed_dates", "mixed_dates", f"""
SELECT k, written, CASE WHEN k % 9 >= 7 THEN NULL WHEN k % 9 = 0 THEN {_DAY.format('y % 100 + 2000', 'm', 'd')} WHEN k % 9 = 1 AND d <= 12 THEN {_DAY.format('y % 100 + 2000', 'd', 'm')} WHEN k % 9 = 1 THEN {_DAY.format('y % 100 + 2000', 'm', 'd')} ELSE {_DAY.format('y', 'm', 'd')} END AS month_first,
  CASE WHEN k % 9 >= 7 THEN NULL WHEN k % 9 = 0 AND d <= 12 THEN {_DAY.format('y % 100 + 2000', 'd', 'm')} WHEN k % 9 <= 1 THEN {_DAY.format('y % 100 + 2000', 'm', 'd')} ELSE {_DAY.format('y', 'm', 'd')} END AS day_first
FROM mixed_dates""")
def _(df):
    """All orders' dates in nine notations, read month first and day first."""
    read = lambda first: F.date_format(dates.mixed(F.col("written"), first), "yyyy-MM-dd")  # noqa: E731
    return df.select("k", "written", read(False).alias("month_first"), read(True).alias("day_first"))


_POWERS = (-28, -12, -6, -1, 0, 3, 9, 14, 40)


@query("text_of_numbers", "lineitem", f"""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 10 = 9 THEN CAST('-0.0' AS DOUBLE) ELSE CAST(CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END || CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR) || 'e' || [{', '.join(f"'{p}'" for p in _POWERS)}][CAST(l_orderkey % 9 + 1 AS INTEGER)] AS DOUBLE) END AS VARCHAR) AS printed FROM lineitem""")
def _(df):
    """Numbers of all sizes as text, with exponents and signed zeros."""
    power = F.element_at(F.array(*(F.lit(f"e{p}") for p in _POWERS)), (F.col("l_orderkey") % 9 + 1).cast("int"))
    x = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(""), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), power).cast("double")
    return df.select("l_orderkey", "l_linenumber", number_text(F.when(F.col("l_orderkey") % 10 == 9, F.lit(-0.0)).otherwise(x)).alias("printed"))


@query("clean_log", "dirty_customer", f"""
WITH n AS (SELECT *, CASE WHEN lower(trim(segment)) IN {_NULLS} THEN NULL ELSE segment END AS seg FROM dirty_customer),
e AS (SELECT count(DISTINCT (cust_id, trim(full_name), email, seg, balance_text, customer_age, phone)) AS left_, count(*) AS all_ FROM n)
SELECT * FROM (SELECT 1 AS number, 'strip_whitespace' AS operation, count(*) FILTER (full_name <> trim(full_name)) AS affected, count(*) AS rows_before, count(*) AS rows_after FROM n
UNION ALL SELECT 2, 'replace_null_like', count(*) FILTER (segment IS NOT NULL AND seg IS NULL), count(*), count(*) FROM n
UNION ALL SELECT 3, 'no_change', 0, count(*), count(*) FROM n UNION ALL SELECT 4, 'drop_duplicate_rows_after_cleaning', all_ - left_, all_, left_ FROM e)""")
def _(df):
    """What a plan did, as its log says."""
    done = clean(df, [Action("strip_whitespace", ("full_name",)), Action("replace_null_like", ("segment",)), Action("no_change", ("phone",)), Action("drop_duplicate_rows_after_cleaning")], "rid")
    return _rows(df, [(e.number, e.operation, e.affected, e.rows_before, e.rows_after) for e in done.log()], "number int, operation string, affected long, rows_before long, rows_after long")


@query("source_csv", "customer", "SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'say \"' || c_mktsegment || '; \"' ELSE '' END AS c_name, c_mktsegment, c_acctbal FROM customer")
def _(df):
    """A table written as one CSV file with semicolons, decimal commas, quotes and line breaks in fields, found out, read in ranges, numbers cleaned."""
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('\nsay "'), "c_mktsegment", F.lit('; "'))).otherwise(""))
    path = shared_path(df.sparkSession, "csv")
    sinks.write_csv(df.select("c_custkey", name.alias("c_name"), "c_mktsegment", "c_acctbal").coalesce(1), path, "c_custkey", french=True, keep_order=True)
    got = tabular.read_csv(df.sparkSession, _part(df.sparkSession, path)).df
    got = clean(got, [Action("to_numeric", ("c_acctbal",), decimal_comma=True)], "_rid").df
    return got.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment", "c_acctbal")


def _part(spark, path: str) -> str:
    """The one file of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").first()["path"]


_ACCENTS = " é" + chr(0xFC)


@query("source_encodings", "nation", f"SELECT 'cp1252' AS encoding, n_nationkey, n_name || '{_ACCENTS} €' AS label FROM nation UNION ALL SELECT 'latin1', n_nationkey, n_name || '{_ACCENTS}' || chr(129) FROM nation")
def _(df):
    """Files in cp1252 and in Latin-1, told apart by bytes that only one of them has."""
    out = None
    for tail in ("\x80", "\x81"):  # as bytes: a euro sign in cp1252; nothing in cp1252
        path = shared_path(df.sparkSession, "csv")
        label = F.concat("n_name", F.lit(_ACCENTS + (" " if tail == "\x80" else "") + tail))
        df.select("n_nationkey", label.alias("label")).coalesce(1).write.option("encoding", "ISO-8859-1").csv(path, header=True)
        got = tabular.read_csv(df.sparkSession, _part(df.sparkSession, path))
        got = got.df.select(F.lit(got.meta["encoding"]).alias("encoding"), "n_nationkey", "label")
        out = got if out is None else out.union(got)
    return out


@query("source_raw", "supplier", """
WITH x AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS r, s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS s_name, s_nationkey FROM supplier)
SELECT 'raw' AS what, r AS _rid, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_suppkey AS VARCHAR) END AS a, CASE WHEN s_name IS NULL THEN '' ELSE s_name || ' ↵ ' || 'x' END AS b, '' AS c FROM x
UNION ALL SELECT 'raw', 0, 'id', 'name', 'nothing' UNION ALL SELECT 'kept', r, CAST(s_suppkey AS VARCHAR), s_name || chr(10) || 'x', NULL FROM x WHERE s_suppkey % 5 <> 0""")
def _(df):
    """A file as it is, line breaks shown, and as a table: without its empty rows and its empty column."""
    held = F.col("s_suppkey") % 5 != 0
    path = shared_path(df.sparkSession, "csv")
    rows = df.select(F.when(held, F.col("s_suppkey")).alias("id"), F.when(held, F.concat("s_name", F.lit("\nx"))).alias("name"), F.lit(None).cast("string").alias("nothing"), "s_suppkey")
    sinks.write_csv(rows.coalesce(1), path, "s_suppkey")
    got = tabular.read_csv(df.sparkSession, _part(df.sparkSession, path))
    raw = got.raw.select(F.lit("raw").alias("what"), "_rid", F.regexp_replace("column_1", "\ufeff", "").alias("a"), F.col("column_2").alias("b"), F.col("column_3").alias("c"))
    return raw.union(got.df.select(F.lit("kept"), "_rid", F.col("id").cast("string"), "name", F.lit(None).cast("string") if "nothing" not in got.df.columns else F.col("nothing")))


@query("source_parquet", "supplier", "SELECT s_suppkey AS _rid, s_suppkey, s_name FROM supplier")
def _(df):
    path = shared_path(df.sparkSession, "table") + ".parquet"
    df.write.parquet(path)
    return tabular.read_table(df.sparkSession, path, "s_suppkey").df.select("_rid", "s_suppkey", "s_name")


@query("source_xlsx", "supplier", "SELECT row_number() OVER (ORDER BY s_suppkey) AS _rid, s_suppkey, s_name, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def _(df):
    """A workbook written by tasks and read again through the loader."""
    path = shared_path(df.sparkSession, "book") + ".xlsx"
    sinks.write_xlsx(df.select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")).orderBy("s_suppkey"), path)
    return tabular.read_table(df.sparkSession, path).df.select("_rid", "s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("inspect_examples", "dirty_customer", r"""
WITH v AS (SELECT rid, 'full_name' AS name, full_name AS value FROM dirty_customer UNION ALL SELECT rid, 'segment', segment FROM dirty_customer),
e AS (SELECT name, 'whitespace' AS what, value, min(rid) AS first FROM v WHERE value <> trim(value) GROUP BY name, value
  UNION ALL SELECT name, 'null_like', value, min(rid) FROM v WHERE lower(trim(value)) IN ('', 'na', 'n/a', 'null', 'none', 'nan', 'unknown', 'unk', 'tbd', '-', '--', '?', 'missing', 'not available') GROUP BY name, value)
SELECT name, what, row_number() OVER (PARTITION BY name, what ORDER BY first, value) AS rank, value FROM e QUALIFY rank <= 8""")
def _(df):
    """The texts that the text inspection shows."""
    found = tools.text_anomalies(df, "rid", ["full_name", "segment"])
    rows = [(c, what, i, v) for c, f in found.items() for what in ("whitespace", "null_like") for i, v in enumerate(f[f"{what}_examples"], 1)]
    return _rows(df, rows, "name string, what string, rank long, value string")


@query("inspect_dates", "dirty_orders", r"""
WITH v AS (SELECT order_date AS value, min(rid) AS first, CASE WHEN regexp_matches(order_date, '^\d{4}') THEN coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%Y/%m/%d'))
  ELSE coalesce(try_strptime(order_date, '%d/%m/%Y'), try_strptime(order_date, '%m/%d/%Y'), try_strptime(order_date, '%m-%d-%Y')) END AS day FROM dirty_orders WHERE order_date IS NOT NULL GROUP BY 1)
SELECT 'invalid' AS what, row_number() OVER (ORDER BY first, value) AS rank, value FROM v WHERE day IS NULL QUALIFY rank <= 15
UNION ALL SELECT 'all', row_number() OVER (ORDER BY first, value) AS rank, value FROM v QUALIFY rank <= 12""")
def _(df):
    """The texts that the date inspection shows."""
    found = tools.date_report(df, "rid", "order_date")
    return _rows(df, [(what, i, v) for what, key in (("invalid", "invalid_examples"), ("all", "examples")) for i, v in enumerate(found[key], 1)], "what string, rank long, value string")


@query("source_detection", "region", """SELECT * FROM (VALUES ('encoding utf-8', 'utf-8-sig'), ('encoding cp1252', 'cp1252'), ('encoding latin1', 'latin1'), ('separator ;', ';'), ('separator tab', chr(9)), ('separator none', ','),
  ('header below a title', '1'), ('header first', '0'), ('names', 'a, a.1, Unnamed: 2')) v("case", result)""")
def _(df):
    """How a file is taken, on fixed heads."""
    cases = [
        ("encoding utf-8", tabular.detect_encoding("é".encode())), ("encoding cp1252", tabular.detect_encoding("é".encode("cp1252"))), ("encoding latin1", tabular.detect_encoding(b"\x81\xff")),
        ("separator ;", tabular.detect_separator("a;b;c\n1;2,5;3\n")), ("separator tab", tabular.detect_separator("a\tb\n1\t2\n")), ("separator none", tabular.detect_separator("abc")),
        ("header below a title", str(tabular.detect_header_row([["Report", None, None], ["id", "name", "price"], ["1", "x", "2"]]))), ("header first", str(tabular.detect_header_row([["id", "name"], ["1", "x"]]))),
        ("names", ", ".join(tabular.column_names(["a", "a", None]))),
    ]  # fmt: skip
    return _rows(df, cases, "`case` string, result string")


@query("plan_errors", "region", """SELECT * FROM (VALUES ('unknown operation', 'PlanError'), ('unknown column', 'PlanError'), ('no replacements', 'PlanError'), ('odd case', 'PlanError'), ('no list', 'PlanError'), ('alias', 'r_regionkey, Region name'), ('loose name', 'ok')) v("case", result)""")
def _(df):
    """What a plan that can't be run says, and how columns are found."""

    def tried(plan, of=df) -> str:
        try:
            return ", ".join(clean(of, plan).df.columns)
        except PlanError:
            return "PlanError"

    named = df.select("r_regionkey", F.col("r_name").alias("Region\n name"))
    cases = [
        ("unknown operation", tried([{"operation": "explode"}])), ("unknown column", tried([{"operation": "strip_whitespace", "column": "y"}])), ("no replacements", tried([{"operation": "replace_values", "column": "r_name"}])),
        ("odd case", tried([{"operation": "normalize_case", "column": "r_name", "case_mode": "odd"}])), ("no list", tried("plan")),
        ("alias", tried([{"operation": "normalize_column_names"}, {"operation": "strip_whitespace", "column": "Region\n name"}], named)),
        ("loose name", "ok" if tried([{"operation": "strip_whitespace", "column": "region name"}], named) != "PlanError" else "PlanError"),
    ]  # fmt: skip
    return _rows(df, cases, "`case` string, result string")


@query("profile_header", "nation", r"""
WITH x AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN n_name || chr(10) || ' x' WHEN 1 THEN ' ' || n_name WHEN 2 THEN n_name ELSE 'same' || repeat(' ', CAST(n_nationkey AS INTEGER)) END AS name FROM nation),
c AS (SELECT name, trim(regexp_replace(name, '\s+', ' ', 'g')) AS suggested FROM x)
SELECT name, suggested, (SELECT count(*) FROM c o WHERE o.suggested = c.suggested) > 1 AS clashes FROM c WHERE name <> suggested""")
def _(df):
    """Names that need cleaning, made of a table's values."""
    made = lambda k, n: (n + "\n x", " " + n, n, "same" + " " * k)[k % 4]  # noqa: E731
    names = [made(r["n_nationkey"], r["n_name"]) for r in df.orderBy("n_nationkey").collect()]  # 25 nations at every scale
    return _rows(df, [(h["name"], h["suggested"], h["clashes"]) for h in profile.header_issues(names)], "name string, suggested string, clashes boolean")


@query("profile_long_texts", "documents", """
SELECT name, count(*) AS rows, count(*) - count(value) AS missing, round_even(100.0 * (count(*) - count(value)) / count(*), 2)::DOUBLE AS missing_pct, count(DISTINCT value) AS unique, count(*) FILTER (value <> trim(value, ' 	

')) AS whitespace
FROM (SELECT 'text' AS name, text AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'lang', lang FROM documents) GROUP BY name""")
def _(df):
    """Columns with long texts, which the grouping sees as digests."""
    return profile.column_profile(df.withColumn("rid", F.monotonically_increasing_id()), ["text", "source", "lang"], "rid").select("name", "rows", "missing", "missing_pct", "unique", "whitespace")


_RANKED = " ".join(f"WHEN '{o}' THEN {i}" for i, o in enumerate(OPERATIONS))
_PLACE = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(TEXT))


@query("plan_customer", "dirty_customer", f"""SELECT row_number() OVER (ORDER BY CASE operation {_RANKED} END, CASE WHEN operation = 'replace_null_like' THEN requires_review END, CASE split_part(columns, ', ', 1) {_PLACE} END) - 1 AS step,
  operation, columns, confidence, requires_review FROM ({actions_sql('dirty_customer')})""")
def _(df):
    """The plan in its order of execution."""
    actions = planner.plan(df, "rid").actions
    return _rows(df, [(i, a.operation, ", ".join(a.columns), a.confidence, a.requires_review) for i, a in enumerate(actions)], "step long, operation string, columns string, confidence string, requires_review boolean")


TABLES["cleaned_customer"] = (TEXT, "rid")
_MANUAL = ", ".join(f"'{k}'" for k, manual in validation.CATEGORIES.items() if manual)
_CLEANED = ", ".join(f"CASE WHEN lower(trim({c})) IN {_NULLS} THEN NULL ELSE trim({c}) END AS {c}" for c in TEXT)


@query("quality_report", "dirty_customer", f"""
WITH cleaned_customer AS (SELECT min(rid) AS rid, {', '.join(TEXT)} FROM (SELECT rid, {_CLEANED} FROM dirty_customer) GROUP BY {', '.join(TEXT)})
SELECT b.key, b.n AS before, a.n AS after, b.key IN ({_MANUAL}) AS manual FROM ({issues_sql('dirty_customer')}) b JOIN ({issues_sql('cleaned_customer')}) a USING (key) WHERE b.n > 0 OR a.n > 0""")
def _(df):
    """Quality before and after a short cleaning."""
    report = validation.quality_of(df, [Action("strip_whitespace", tuple(TEXT)), Action("replace_null_like", tuple(TEXT)), Action("drop_duplicate_rows")], "rid")
    return _rows(df, [(r["key"], r["before"], r["after"], r["manual"]) for r in report["rows"]], "key string, before long, after long, manual boolean")


@query("scan_typos", "dirty_part", f"WITH {facts('dirty_part')} SELECT dominant AS form, target AS stands_for FROM wrong WHERE name = 'part_type'")
def _(df):
    found = scanning.scan(df, "rid").columns["part_type"]["typos"]
    return _rows(df, sorted(found.items()), "form string, stands_for string")


__all__ = ["TABLES", "VIEWS", "facts"]
