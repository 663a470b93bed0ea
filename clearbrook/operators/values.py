"""The value table: every column's distinct values, counted. Most detectors only need this.

One shuffle with map-side combining serves all columns and all detectors, and rules run
once per distinct value instead of once per row. Rows of a large table are spread over
tasks first, so that what a task combines doesn't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_text, is_scan_null, strip


#: Characters of a value from which on it is grouped by its digest.
LONG = 64
#: Cells that a task counts, roughly.
CELLS = 1_000_000


def spread(rows: DataFrame, order: str, cells: int) -> DataFrame:
    """Rows of so many cells in tasks of CELLS each. A task holds all distinct cells that it reads until it has counted them, and a large file may come in one piece."""
    tasks = -(-cells // CELLS)
    return rows.repartition(tasks, F.col(f"`{order}`")) if tasks > 1 else rows


def melt(df: DataFrame, columns: list[str], order: str, rows: int | None = None) -> DataFrame:
    """(name, value, rid): a row per cell, values as text. ``rows``, if known, is about how many the table has; else they are counted."""
    df = spread(df.select(*(F.col(f"`{c}`") for c in dict.fromkeys((order, *columns)))), order, (df.count() if rows is None else rows) * len(columns))
    cells = [F.struct(F.lit(c).alias("name"), as_text(F.col(f"`{c}`"), df.schema[c].dataType).alias("value")) for c in columns]
    return df.select(F.col(f"`{order}`").alias("rid"), F.explode(F.array(*cells)).alias("cell")).select("rid", "cell.name", "cell.value")


def short_key(value: Column) -> Column:
    """A value to group by: itself, or beyond LONG characters its length and 128 bits of digest."""
    return F.when(F.length(value) > LONG, F.concat(F.lit("\0"), F.length(value).cast("string"), F.lit(":"), F.md5(value))).otherwise(value)


def value_table(df: DataFrame, columns: list[str], order: str, rows: int | None = None) -> DataFrame:
    """(name, value, n, first): value null counts missing cells. ``rows`` as in melt."""
    return melt(df, columns, order, rows).groupBy("name", "value").agg(F.count("*").alias("n"), F.min("rid").alias("first"))


def forms(values: DataFrame) -> DataFrame:
    """(name, value, n, first, spellings, padded): values stripped and counted again; spellings they had, and cells with outer white space. Null counts missing cells."""
    value = strip(F.col("value"))
    return values.groupBy("name", value.alias("value")).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.count("value").alias("spellings"), F.coalesce(F.sum(F.when(F.col("value") != value, F.col("n"))), F.lit(0)).alias("padded")
    )


def usable(values: DataFrame) -> DataFrame:
    """Stripped values that are neither blank nor a null marker, counted again: the scan's input."""
    s = values.where("value is not null").withColumn("value", strip(F.col("value"))).where(~is_scan_null(F.col("value")))
    return s.groupBy("name", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def top(counted: DataFrame, k: int, by: Column | None = None) -> DataFrame:
    """The k most frequent values of each name, ties by first appearance; adds rank."""
    order = Window.partitionBy("name").orderBy(F.desc("n"), F.asc("first"), F.asc("value"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
