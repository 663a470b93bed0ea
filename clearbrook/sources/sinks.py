"""Exports: CSV for machines and for French spreadsheets, XLSX, display text, previews."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_text
from .xlsx import assemble, row_pieces

#: A sheet holds no more rows.
MOST_SHEET_ROWS = 1_048_575


def _data(df: DataFrame, order: str | None) -> DataFrame:
    return df.drop(order) if order else df


def write_csv(df: DataFrame, path: str, order: str | None = None, french: bool = False, keep_order: bool = False) -> None:
    """A folder of CSV parts with header and byte order mark, written in parallel.

    french: semicolons between fields and commas for decimals. With ``order`` rows are sorted by that
    column, within partitions where there is one partition; ``keep_order`` also writes the column.
    """
    one = order and df._jdf.queryExecution().executedPlan().outputPartitioning().numPartitions() == 1
    rows = df.sortWithinPartitions(order) if one else df.orderBy(order) if order else df
    rows = rows if keep_order else _data(rows, order)
    out = []
    for f in rows.schema:
        c = as_text(F.col(f"`{f.name}`"), f.dataType)
        out.append((F.translate(c, ".", ",") if french and isinstance(f.dataType, T.FractionalType) else c).alias(f.name))
    first = rows.columns[0]
    rows.select(*out).withColumnRenamed(first, "﻿" + first).write.mode("overwrite").csv(path, header=True, sep=";" if french else ",", encoding="UTF-8", quote='"', escape='"')


def _sheet(df: DataFrame, order: str | None) -> tuple[list[str], Iterator[tuple[bytes, int, int]]]:
    """Names and deflated rows of one sheet, made by tasks and fetched one piece at a time; raises where the rows don't fit a sheet."""
    if df.limit(MOST_SHEET_ROWS + 1).count() > MOST_SHEET_ROWS:
        raise ValueError(f"a sheet holds at most {MOST_SHEET_ROWS} rows; export as CSV")
    rows = _data(df.orderBy(order) if order else df, order)
    plain = (T.StringType, T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType)
    rows = rows.select(*(F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema))
    return rows.columns, ((bytes(r["piece"]), r["crc"], r["size"]) for r in row_pieces(rows).toLocalIterator())


def xlsx_bytes(df: DataFrame, order: str | None = None) -> bytes:
    """A workbook with one sheet named Cleaned Data, to hand over as it is."""
    out = io.BytesIO()
    assemble(*_sheet(df, order), out.write)
    return out.getvalue()


def write_xlsx(df: DataFrame, path: str, order: str | None = None) -> None:
    """The same as a file, anywhere Spark can write: what passes through the driver is one deflated piece at a time."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    try:
        assemble(*_sheet(df, order), lambda data: stream.write(bytearray(data)))
    finally:
        stream.close()


def display(df: DataFrame) -> DataFrame:
    """Text for people: decimals with a comma, dates without time, nothing for missing."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FractionalType):
            text = F.translate(F.regexp_replace(F.format_string("%.10f", c.cast("double")), r"\.?0+\z", ""), ".", ",")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
            text = F.date_format(c, "yyyy-MM-dd")
        else:
            text = as_text(c, f.dataType)
        out.append(F.coalesce(F.when(c.isNotNull(), text), F.lit("")).alias(f.name))
    return df.select(*out)


def preview(df: DataFrame, order: str, n: int = 12) -> DataFrame:
    return df.orderBy(order).limit(n)
