"""Inspections on demand, by name. Results are plain objects with capped lists."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.text import PROFILE_NULLS, as_text, is_null_marker, strip
from ..plans.model import PlanError
from . import duplicates, profile
from .scan import CATEGORIES, typos
from .values import top, usable, value_table


def _known(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise PlanError(f"unknown column: {column}")


def inspect_column(df: DataFrame, order: str, column: str) -> dict:
    _known(df, column)
    facts = profile.column_profile(df, [column], order).first().asDict()
    out = facts | {"type": df.schema[column].dataType.simpleString(), "top_values": [(r["value"], r["n"]) for r in profile.top_values(df, [column], order).orderBy("rank").collect()], "samples": [r["value"] for r in profile.samples(df, [column], order, 12).orderBy("rank").collect()]}
    if facts["numeric_ratio"] == 1.0 and df.schema[column].dataType.typeName() not in ("string",):
        out |= profile.numeric_profile(df, [column]).first().asDict()
    return out


def numeric_issues(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A row per column: non_null, parseable, invalid, negative, min, max, decimal_comma, decimal_point, affix, suggest_decimal_comma."""
    v = value_table(df, columns, order).where("value is not null").withColumn("value", strip(F.col("value")))
    x = numbers.inspected(F.col("value"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    out = v.groupBy("name").agg(
        n(F.lit(True)).alias("non_null"), n(x.isNotNull()).alias("parseable"), n(x.isNull()).alias("invalid"), n(x < 0).alias("negative"), F.min(x).alias("min"), F.max(x).alias("max"),
        n(F.col("value").rlike(r"\A[-+]?\d+,\d+\z")).alias("decimal_comma"), n(F.col("value").rlike(r"\A[-+]?\d+\.\d+\z")).alias("decimal_point"), n(F.col("value").rlike(r"[^0-9,.+\-\s]")).alias("affix"),
    )
    return out.withColumn("suggest_decimal_comma", F.col("decimal_comma") > F.col("decimal_point"))


def date_issues(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A row per column: values, month_first, day_first, and recommend_dayfirst if that parses strictly more."""
    v = value_table(df, columns, order).where("value is not null").withColumn("value", strip(F.col("value")))
    a, b, _ = dates.parts(F.col("value"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    strict = F.col("value").rlike(r"\A\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\z")
    real = dates.mixed(F.col("value")).isNotNull()
    out = v.groupBy("name").agg(n(F.lit(True)).alias("values"), n(real & (~strict | (a <= 12))).alias("month_first"), n(real & (~strict | (b <= 12))).alias("day_first"))
    return out.withColumn("recommend_dayfirst", F.col("day_first") > F.col("month_first"))


def _first(values: DataFrame, text: Column, when: Column, k: int) -> DataFrame:
    """name, text: the first k distinct texts of each column among the values that fit."""
    seen = values.where(when).groupBy("name", text.alias("text")).agg(F.min("first").alias("first"))
    order = Window.partitionBy("name").orderBy("first", "text")
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).orderBy("name", "rank").select("name", "text")


def date_report(df: DataFrame, order: str, column: str) -> dict:
    """date_issues of a column with examples: the first 15 texts that are no date and the first 12 of all."""
    _known(df, column)
    held = value_table(df, [column], order).where("value is not null")
    bare = strip(F.col("value"))
    out = (date_issues(df, [column], order).first() or {"name": column, "values": 0, "month_first": 0, "day_first": 0, "recommend_dayfirst": False})
    out = out if isinstance(out, dict) else out.asDict()
    texts = lambda when, k: [r["text"] for r in _first(held, bare, when, k).collect()]
    return out | {"invalid_examples": texts(dates.mixed(bare).isNull(), 15), "examples": texts(F.lit(True), 12)}


def invalid_numbers(df: DataFrame, column: str, order: str, k: int = 15) -> list[str]:
    """The first k distinct texts of a column that aren't numbers."""
    v = value_table(df, [column], order).where("value is not null").withColumn("value", strip(F.col("value")))
    v = v.where(numbers.inspected(F.col("value")).isNull()).groupBy("value").agg(F.min("first").alias("first"))
    return [r["value"] for r in v.orderBy("first", "value").limit(k).collect()]


def text_anomalies(df: DataFrame, order: str, columns: list[str]) -> dict:
    for c in columns:
        _known(df, c)
    out = {c: {"name": c, "whitespace": 0, "null_like": 0, "forms": 0, "case_variants": [], "typos": {}} for c in columns}
    v = value_table(df, columns, order).persist()
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    held = v.where("value is not null")
    for r in held.groupBy("name").agg(n(F.col("value") != strip(F.col("value"))).alias("whitespace"), n(is_null_marker(F.col("value"), PROFILE_NULLS)).alias("null_like"), F.count("*").alias("forms")).collect():
        out[r["name"]] = r.asDict() | {"case_variants": [], "typos": {}}
    padded, marker = F.col("value") != strip(F.col("value")), is_null_marker(F.col("value"), PROFILE_NULLS)
    for c in out.values():
        c |= {"whitespace_examples": [], "null_like_examples": []}
    for what, when in (("whitespace_examples", padded), ("null_like_examples", marker)):
        for r in _first(held, F.col("value"), when, 8).collect():
            out[r["name"]][what].append(r["text"])
    u = usable(v)
    cases = u.groupBy("name", F.lower("value").alias("low")).agg(F.min("first").alias("first"), F.count("*").alias("k")).where("k > 1")
    shown = top(cases.withColumn("value", F.col("low")).withColumn("n", F.lit(0)), 12).select("name", "low", F.col("rank").alias("place"))
    spelt = u.join(F.broadcast(shown), (u["name"] == shown["name"]) & (F.lower(u["value"]) == shown["low"]))  # 12 groups a column
    by = Window.partitionBy(shown["name"], "place").orderBy(F.desc("n"), "first")
    groups: dict[tuple[str, int], list[str]] = {}
    for r in spelt.select(shown["name"], "place", "value", F.row_number().over(by).alias("rank")).where(F.col("rank") <= CATEGORIES).orderBy("place").collect():
        groups.setdefault((r["name"], r["place"]), []).append(r["value"])
    for (name, _), own in groups.items():
        out[name]["case_variants"].append(sorted(own))
    few = [c for c in out if out[c]["forms"] <= CATEGORIES]
    forms: dict[str, list[tuple[str, int]]] = {}
    for r in u.where(F.col("name").isin(*few) & (F.length("value") >= 3)).orderBy("name", F.desc("n"), "first").collect() if few else []:
        forms.setdefault(r["name"], []).append((r["value"], r["n"]))
    for name, own in forms.items():
        out[name]["typos"] = typos(own, 0.84, digits=False)
    v.unpersist()
    return out


def find_duplicates(df: DataFrame, order: str, columns: list[str] | None = None) -> dict:
    data = [c for c in df.columns if c != order]
    if not columns:
        return duplicates.full(df, data).first().asDict()
    for c in columns:
        _known(df, c)
    payload = [c for c in data if c not in columns]
    groups = duplicates.key_groups(df, columns, payload).where("conflict").orderBy(F.desc("n"), *(F.col(f"`{c}`") for c in columns)).limit(10).collect()
    conflicts = [{"key": [r[c] for c in columns], "rows": r["n"], "differing_columns": r["differing_columns"]} for r in groups]
    return duplicates.key_summary(df, columns, payload).first().asDict() | {"conflicts": conflicts}


def verify_external_reference(df: DataFrame, order: str, column: str, values: list[str], verifier=None) -> dict:
    """Which of at most 30 values the column has, and what a verifier says of them; without one, nothing."""
    _known(df, column)
    wanted = [str(v) for v in values][:30]
    c = as_text(F.col(f"`{column}`"), df.schema[column].dataType)
    present = sorted(r[0] for r in df.where(c.isin(*wanted)).select(c).distinct().collect())
    return {"present": present, "corrections": verifier(column, present) if verifier else []}


TOOLS = {
    "profile_dataset": lambda df, order: {r["name"]: r.asDict() for r in profile.column_profile(df, [c for c in df.columns if c != order], order).collect()},
    "inspect_column": inspect_column,
    "detect_numeric_issues": lambda df, order, column: (_known(df, column), numeric_issues(df, [column], order).first().asDict() | {"invalid_examples": invalid_numbers(df, column, order)})[1],
    "detect_date_issues": date_report,
    "detect_text_anomalies": text_anomalies,
    "find_duplicates": find_duplicates,
    "verify_external_reference": verify_external_reference,
    "submit_cleaning_plan": lambda df, order, actions: {"actions": actions},
}


def plain(value):
    """A result as JSON can hold it: dates as ISO text, numbers that aren't finite as nothing."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        value = float(value)
    return None if isinstance(value, float) and not isfinite(value) else value


def run_tool(name: str, df: DataFrame, order: str, **arguments) -> dict:
    """An inspection by name; its result as plain objects."""
    if name not in TOOLS:
        raise PlanError(f"unknown tool: {name}")
    return plain(TOOLS[name](df, order, **arguments))
