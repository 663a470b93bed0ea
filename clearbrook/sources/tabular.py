"""Tables from CSV, XLSX and Parquet, with encoding, separator, header row and types found out.

The driver looks at the head of a file only; tasks check the encoding and the number of
columns over the whole file. Rows are numbered in ``_rid`` in file order;
cells that are missing by convention become null; rows and columns without any value go.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import header
from . import ranges, xlsx

HEAD = 1 << 20
# Cell texts that mean missing, and words that hint at a header.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
HINTS = ("id", "date", "name", "country", "pays", "nation", "city", "population", "sales", "price", "amount", "quantity", "category", "product", "customer", "client", "email", "phone", "currency", "rate", "salary", "department", "status", "observation")
_NUMERIC = re.compile(r"-?\d+(?:[.,]\d+)?")


@dataclass
class Loaded:
    df: DataFrame
    raw: DataFrame
    meta: dict = field(default_factory=dict)


def detect_encoding(data: bytes) -> str:
    for name in ("utf-8-sig", "utf-8", "cp1252"):
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError as e:
            if e.end >= len(data) - 3 and name.startswith("utf") and len(data) == HEAD:
                return name  # a character cut at the end of the head
    return "latin1"


def detect_separator(text: str) -> str:
    """Of comma, semicolon, tab and bar, that which splits most of the first 30 lines into equally many fields."""
    lines = [x for x in text.splitlines() if x.strip()][:30]
    best, most = ",", 0.0
    for sep in ",;\t|":
        widths = [len(r) for r in csv.reader(lines, delimiter=sep) if len(r) > 1]
        if widths:
            width, times = Counter(widths).most_common(1)[0]
            if times * 10 + width > most:
                best, most = sep, times * 10 + width
    return best


def detect_header_row(rows: list[list]) -> int:
    """Index of the row that most looks like column names: full, textual, with familiar words, early."""
    width = max(map(len, rows), default=0)
    held = [[str(c).strip() for c in r if _held(c)] for r in rows]
    if len(rows) > 1 and width > 1 and len(held[0]) < 0.5 * width and len(held[1]) >= 0.65 * width:
        return 1  # a title above the names

    def score(cells: list[str], at: int) -> float:
        if not cells:
            return -100.0
        words = [w for c in cells for w in re.findall("[A-Za-zÀ-ÿ]+", c.casefold())]
        share = lambda test: sum(map(bool, map(test, cells))) / len(cells)
        likely = 2.5 * share(lambda c: re.search(r"[^\W\d_]", c)) - 2 * share(lambda c: _NUMERIC.fullmatch(c.replace(" ", "")))
        return 5 * len(cells) / width + likely + 0.9 * sum(w in HINTS for w in words) - 0.05 * at

    scores = [score(cells, at) for at, cells in enumerate(held[:10])]
    return max(range(len(scores)), key=scores.__getitem__, default=0)


def _held(cell) -> bool:
    return cell is not None and str(cell).strip() != ""


def column_names(cells: list) -> list[str]:
    """Names as given; repeats get .1, .2 and so on, blanks a number."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name = base = str(c) if _held(c) else f"Unnamed: {i}"
        k = 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns whose every value is a whole number, a number or a boolean, cast so; decided in one pass."""
    tests = {"bigint": r"\A\s*[-+]?\d{1,18}\s*\z", "double": r"\A\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*\z", "boolean": r"\A(?:True|False|TRUE|FALSE|true|false)\z"}
    col = lambda c: F.col(f"`{c}`")
    row = df.agg(*(F.bool_and(col(c).rlike(r)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, r in tests.items()), *(F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns))).first()
    out = []
    for i, c in enumerate(columns):
        if row[f"n{i}"]:
            kind = next((k for k in tests if row[f"{k}{i}"]), None)
            out.append((F.trim(col(c)).try_cast(kind) if kind else col(c)).alias(c))
    return df.select("_rid", *out)


def _finish(spark: SparkSession, rows: DataFrame, width: int, head: list[list], meta: dict) -> Loaded:
    """rows: _rid and c0 to c(width - 1) as text."""
    cells = [f"c{i}" for i in range(width)]
    at = detect_header_row(head)
    names = column_names([*(head[at] if head else []), *[None] * width][:width])
    raw = rows.select("_rid", *(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|[\r\n]", " ↵ ").alias(f"column_{i + 1}") for i, c in enumerate(cells)))
    data = rows.where(F.col("_rid") > at).select("_rid", *(F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(n) for c, n in zip(cells, names, strict=True)))
    data = data.na.drop("all", subset=[f"`{n}`" for n in names])
    issues = [n for n in names if n != header(n)]
    return Loaded(typed(data, names), raw, meta | {"header_row": at, "header_issues": issues})


def read_csv(spark: SparkSession, path: str) -> Loaded:
    """A CSV file of any size, quoted fields with line breaks included, read by as many tasks as it has splits.

    Records are numbered in file order without the blank ones. Shorter records are filled up with nulls.
    """
    top = ranges.head(spark, path, HEAD)
    sep = detect_separator(top.decode(detect_encoding(top), errors="ignore"))
    rows, encoding = ranges.records(spark, path, sep)
    row = rows.agg(F.max(F.size("cells")).alias("width"), F.sort_array(F.collect_list(F.when(F.col("_rid") < 12, F.struct("_rid", "cells")))).alias("head")).first()
    width, first = max(row["width"] or 1, 1), [[c if c != "" else None for c in r["cells"]] for r in row["head"]]
    cells = rows.select("_rid", *(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)))
    return _finish(spark, cells, width, first, {"file_type": "csv", "encoding": encoding, "separator": sep})


def read_xlsx(spark: SparkSession, path: str) -> Loaded:
    """The first sheet of a workbook; its rows are parsed by many tasks."""
    rows, names = xlsx.workbook(spark, path)
    row = rows.agg(F.max(F.size("cells")).alias("width"), F.sort_array(F.collect_list(F.when(F.col("_rid") < 12, F.struct("_rid", "cells")))).alias("head")).first()
    width = max(row["width"] or 1, 1)
    cells = rows.select("_rid", *(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)))
    return _finish(spark, cells, width, [list(r["cells"]) for r in row["head"]], {"file_type": "xlsx", "sheet_name": names[0] if names else None, "sheet_names": names})


def read_table(spark: SparkSession, path: str, order: str | None = None) -> Loaded:
    """A CSV, XLSX or Parquet table by suffix. Parquet needs a column that orders its rows, if order matters."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith(".xlsx"):
        return read_xlsx(spark, path)
    if low.endswith(".parquet"):
        df = spark.read.parquet(path)
        df = df.withColumn("_rid", F.col(order) if order else F.monotonically_increasing_id())
        return Loaded(df, df, {"file_type": "parquet"})
    raise ValueError(f"unsupported file: {path}" + (" (save it as .xlsx)" if low.endswith(".xls") else ""))
