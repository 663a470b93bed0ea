"""Dataset profile: a row per column, and the table's counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numbers
from ..functions.shared import let
from ..functions.text import PROFILE_NULLS, as_text, strip
from ..plans.model import header
from .values import LONG, melt, short_key, spread, top, value_table

DATE_SAMPLE = 500


def column_profile(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """name, rows, missing, missing_pct, unique, whitespace, null_like, numeric_ratio of each column."""
    kinds = {c: df.schema[c].dataType for c in columns}
    text = [c for c in columns if isinstance(kinds[c], T.StringType)]
    numeric = [c for c in columns if isinstance(kinds[c], T.NumericType | T.BooleanType)]
    is_text = F.col("name").isin(*text) if text else F.lit(False)
    signs = lambda v, bare: (v != bare).cast("int") + F.when(F.lower(bare).isin(*PROFILE_NULLS), 2).otherwise(0) + F.when(numbers.profiled(v).isNotNull(), 4).otherwise(0)
    marks = lambda v: let(strip(v), lambda bare: signs(v, bare))
    # what is asked of a long value is settled where it is read and it goes on as its digest, so its length doesn't matter; of other values once they are counted
    cell = lambda v: F.struct(short_key(v).alias("key"), F.when(F.length(v) > LONG, marks(v)).alias("marks"))
    cells = F.transform(F.array(*(as_text(F.col(f"`{c}`"), kinds[c]) for c in columns)), cell)
    rows = spread(df.select(F.col(f"`{order}`").alias("rid"), cells.alias("cells")), "rid", df.count() * len(columns))
    v = rows.select(F.posexplode("cells").alias("at", "cell")).select("at", "cell.key", "cell.marks").groupBy("at", "key", "marks").agg(F.count("*").alias("n"))
    v = v.select(F.get(F.array(*map(F.lit, columns)), F.col("at")).alias("name"), "key", "n", F.coalesce("marks", marks(F.col("key"))).alias("marks"))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    marked = lambda bit: F.col("marks").bitwiseAND(bit) > 0
    out = v.groupBy("name").agg(
        F.sum("n").cast("long").alias("rows"),
        n(F.col("key").isNull()).alias("missing"),
        F.count("key").alias("unique"),
        n(is_text & marked(1)).alias("whitespace"),
        n(is_text & marked(2)).alias("null_like"),
        n(marked(4)).alias("_numbers"),
        n(F.col("key").isNotNull()).alias("_held"),
    )
    ratio = F.when(F.col("_held") == 0, 0.0).when(F.col("name").isin(*numeric) if numeric else F.lit(False), 1.0).otherwise(numbers.round_even(F.col("_numbers") / F.col("_held"), 4))
    return out.select("name", "rows", "missing", numbers.round_even(100.0 * F.col("missing") / F.col("rows")).alias("missing_pct"), "unique", "whitespace", "null_like", ratio.alias("numeric_ratio"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, min, max, mean, negative of numeric columns, in one aggregation."""
    aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("negative", lambda x: F.count_if(x < 0)))]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("name"), *(F.col(f"{k}_{i}").alias(k) for k in ("min", "max", "mean", "negative"))) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows)))


def samples(df: DataFrame, columns: list[str], order: str, k: int = 8) -> DataFrame:
    """name, rank, value: the first k distinct non-blank values, stripped."""
    from pyspark.sql import Window

    s = melt(df, columns, order).select("name", strip(F.col("value")).alias("value"), "rid").where("value <> ''").groupBy("name", "value").agg(F.min("rid").alias("first"))
    by = Window.partitionBy("name").orderBy("first", "value")
    return s.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("name", "rank", "value")


def top_values(df: DataFrame, columns: list[str], order: str, k: int = 12) -> DataFrame:
    return top(value_table(df, columns, order).where("value is not null"), k).select("name", "rank", "value", "n")


def date_ratio(df: DataFrame, column: str, order: str, n: int = DATE_SAMPLE) -> DataFrame:
    """date_ratio over the first n present values: part of the definition, not a shortcut."""
    c = as_text(F.col(f"`{column}`"), df.schema[column].dataType)
    first = df.select(c.alias("value"), F.col(order)).where("value is not null").orderBy(order).limit(n)
    return first.agg(F.coalesce(numbers.round_even(F.avg(dates.mixed(strip(F.col("value"))).isNotNull().cast("double")), 4), F.lit(0.0)).alias("date_ratio"))


def duplicate_rows(df: DataFrame, columns: list[str], rows: bool = False) -> DataFrame:
    """involved: rows that have an equal; removable: rows beyond the first of their kind; rows, if asked for: all."""
    groups = df.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("involved"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("removable"), *([F.coalesce(F.sum("n"), F.lit(0)).alias("rows")] if rows else []))


def audit_key(name: str) -> str:
    """A column name with single spaces, its byte order mark kept: two names that only the mark tells apart are two columns to the audit."""
    return re.sub(r"\s+", " ", str(name)).strip()


def header_issues(columns: list[str]) -> list[dict]:
    """Columns whose name has line breaks, marks or doubled spaces, or clashes with another once cleaned."""
    clean = [header(c) for c in columns]
    return [{"name": c, "suggested": h, "clashes": clean.count(h) > 1} for c, h in zip(columns, clean, strict=True) if c != h or clean.count(h) > 1]
