"""Duplicates: whole rows, keys, and whether rows of a key agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, strip
from .profile import duplicate_rows as full


def _keyed(df: DataFrame, keys: list[str], blanks: bool) -> DataFrame:
    """Rows whose keys are all present; blank keys too if asked for."""
    for k in keys:
        c = F.col(f"`{k}`")
        df = df.where(c.isNotNull() if blanks else c.isNotNull() & (strip(as_text(c, df.schema[k].dataType)) != ""))
    return df


def by_key(df: DataFrame, keys: list[str], blanks: bool = False) -> DataFrame:
    """involved and removable rows of repeated keys; null keys aren't equal to each other."""
    groups = _keyed(df, keys, blanks).groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("involved"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("removable"))


def repeated_values(values: DataFrame, columns: list[str]) -> DataFrame:
    """name and, as by_key with blanks, groups, involved and removable of each of the columns that has a value twice: from the value table, without the rows."""
    twice = values.where(F.col("name").isin(*columns) & F.col("value").isNotNull() & (F.col("n") > 1))
    return twice.groupBy("name").agg(F.count("*").alias("groups"), F.sum("n").cast("long").alias("involved"), F.sum(F.col("n") - 1).cast("long").alias("removable"))


def key_groups(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """A row per repeated key: n, payloads (distinct), conflict, and which columns differ.

    Distinct payloads are counted by grouping twice, so that a key that holds a large share of
    the rows is combined before it meets.
    """
    rows = _keyed(df, keys, False)
    own = [F.col(f"`{k}`") for k in keys]
    kinds = rows.groupBy(*own, *(F.col(f"`{c}`") for c in payload)).agg(F.count("*").alias("_n"))
    low_high = lambda c: F.struct(F.col(f"`{c}`").isNull().alias("none"), as_text(F.col(f"`{c}`"), df.schema[c].dataType).alias("v"))
    differing = [F.when(F.min(low_high(c)) != F.max(low_high(c)), F.lit(c)) for c in payload]
    groups = kinds.groupBy(*own).agg(F.sum("_n").cast("long").alias("n"), F.count("*").alias("payloads"), F.array_compact(F.array(*differing)).alias("differing_columns"))
    return groups.where("n > 1").withColumn("conflict", F.col("payloads") > 1)


def key_summary(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """groups, exact_groups, conflict_groups, involved, removable, safe_to_drop_by_key."""
    g = key_groups(df, keys, payload)
    out = g.agg(F.count("*").alias("groups"), F.count_if(~F.col("conflict")).alias("exact_groups"), F.count_if("conflict").alias("conflict_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("involved"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("removable"))
    return out.withColumn("safe_to_drop_by_key", (F.col("groups") > 0) & (F.col("conflict_groups") == 0) & (F.col("removable") > 0))


def hidden(df: DataFrame, columns: list[str]) -> DataFrame:
    """removable: rows that repeat another but for case and outer white space."""
    plain = [F.lower(strip(as_text(F.col(f"`{c}`"), df.schema[c].dataType))).alias(f"c{i}") for i, c in enumerate(columns)]
    return full(df.select(*plain), [f"c{i}" for i in range(len(columns))])


__all__ = ["full", "by_key", "repeated_values", "key_groups", "key_summary", "hidden"]
