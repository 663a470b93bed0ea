"""Checks of a cleaned table against the table before, and the quality report of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.shared import stored
from ..functions.text import as_text, run_mask
from ..operators import duplicates
from ..operators.cleaning import Cleaned, clean
from ..operators.maintained import value_table_after
from ..operators.scan import AGE, PHONE, Findings, scan
from ..operators.values import usable, value_table
from .model import LogEntry, header

_EXPECTED = frozenset(("to_numeric", "to_datetime", "replace_null_like", "set_negative_to_null", "replace_values"))
_WORST = {"ok": 0, "warning": 1, "error": 2}
# Category of the report: key, and whether it is left to people.
CATEGORIES = {k: k in ("negatives", "ages", "key_conflicts", "relations") for k in ("whitespace", "null_like", "number_format", "unparseable", "date_formats", "invalid_dates", "variants", "emails", "names", "negatives", "ages", "id_formats", "duplicates", "key_conflicts", "relations")}


def paired(before: DataFrame, after: DataFrame) -> list[tuple[str, str]]:
    """Columns of both tables with the same normalised name."""
    names = {header(c).lower(): c for c in after.columns}
    return [(c, names[header(c).lower()]) for c in before.columns if header(c).lower() in names]


def _texts(df: DataFrame, names: list[str], prefix: str) -> list[Column]:
    return [as_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"{prefix}{i}") for i, c in enumerate(names)]


def surviving(before: DataFrame, after: DataFrame, order: str) -> DataFrame:
    """Rows in both tables, by the order column: columns b_i and a_i. For tables of any origin; a cleaning of ours needs no join, see ``cleaned_pairs``."""
    pairs = [p for p in paired(before, after) if p[0] != order]
    b = before.select(F.col(order).alias("_o"), *_texts(before, [x for x, _ in pairs], "b"))
    a = after.select(F.col(order).alias("_o"), *_texts(after, [y for _, y in pairs], "a"))
    return b.join(a, "_o")


def cleaned_pairs(before: DataFrame, plan, order: str, count: bool = True) -> tuple[Cleaned, DataFrame]:
    """The cleaning of a plan, and its rows with columns b_i and a_i: the cells before are carried along with the rows that stay."""
    names = [c for c in before.columns if c != order]
    carried = before.withColumn("_before", F.struct(*_texts(before, names, "b")) if names else F.lit(None))
    done = clean(carried, plan, order, count, carry=("_before",))
    after = done.df.drop("_before")
    pairs = [p for p in paired(before, after) if p[0] != order]
    b = [F.col(f"_before.b{names.index(x)}").alias(f"b{i}") for i, (x, _) in enumerate(pairs)]
    return done, done.df.select(*b, *_texts(done.df, [y for _, y in pairs], "a"))


def _minus(c: Column) -> Column:
    """A text with a leading minus."""
    return c.rlike(r"\A\s*-\s*[\d.,]")


def _wide_counts(rows: DataFrame, n: int) -> DataFrame:
    """One row: rows, and of each column pair new_missing (m), negative (n) and kept (k)."""
    counts = [F.count("*").alias("rows")]
    for i in range(n):
        b, a = F.col(f"b{i}"), F.col(f"a{i}")
        counts += [F.count_if(b.isNotNull() & a.isNull()).alias(f"m{i}"), F.count_if(_minus(b)).alias(f"n{i}"), F.count_if(_minus(b) & _minus(a)).alias(f"k{i}")]
    return rows.agg(*counts)


def _cell_counts(before: DataFrame, after: DataFrame, order: str) -> DataFrame:
    """A row per column of both tables, from one join and one aggregation: name, new_missing, negative, kept."""
    pairs = [p for p in paired(before, after) if p[0] != order]
    wide = _wide_counts(surviving(before, after, order), len(pairs))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(y).alias("name"), F.col(f"m{i}").alias("new_missing"), F.col(f"n{i}").alias("negative"), F.col(f"k{i}").alias("kept")) for i, (_, y) in enumerate(pairs)))))


def new_missing(before: DataFrame, after: DataFrame, order: str) -> DataFrame:
    """name, new_missing: cells of surviving rows that had a value and have none now."""
    return _cell_counts(before, after, order).select("name", "new_missing")


def negatives(before: DataFrame, after: DataFrame, order: str) -> DataFrame:
    """name, negative, kept, lost: texts with a leading minus, and whether the sign survived."""
    return _cell_counts(before, after, order).where("negative > 0").select("name", "negative", "kept", (F.col("negative") - F.col("kept")).alias("lost"))


@dataclass
class Report:
    status: str
    checks: list[dict]


def validate(before: DataFrame, after: DataFrame, log: list[LogEntry], order: str) -> Report:
    """The checks of two tables, whatever made one of the other: rows are paired by the order column."""
    twice = duplicates.full(after, [c for c in after.columns if c != order], rows=True).first()
    return _report(before, after, log, order, before.count(), twice["rows"], twice["removable"], [r.asDict() for r in _cell_counts(before, after, order).collect()])


def validate_cleaning(before: DataFrame, plan, order: str) -> tuple[Report, list[LogEntry]]:
    """The same checks of a plan's result, with its log: cells before and after, rows and log come from one pass without a join."""
    done, rows = cleaned_pairs(before, plan, order)
    after = done.df.drop("_before")
    pairs = [p for p in paired(before, after) if p[0] != order]
    wide = _wide_counts(rows, len(pairs)).first()
    log = done.log(run=False)
    cells = [{"name": y, "new_missing": wide[f"m{i}"], "negative": wide[f"n{i}"], "kept": wide[f"k{i}"]} for i, (_, y) in enumerate(pairs)]
    plain = clean(before, plan, order, count=False).df
    left = duplicates.full(plain, [c for c in plain.columns if c != order]).first()["removable"]
    return _report(before, after, log, order, log[0].rows_before if log else before.count(), wide["rows"], left, cells), log


def _report(before: DataFrame, after: DataFrame, log: list[LogEntry], order: str, n: int, m: int, left: int, cells: list[dict]) -> Report:
    checks: list[dict] = []

    def check(name: str, status: str, **facts) -> None:
        checks.append({"name": name, "status": status} | facts)

    check("rows", "error" if m > n else "ok", before=n, after=m)
    logged = sum(e.rows_before - e.rows_after for e in log)
    check("removed_rows_logged", "ok" if logged == n - m else "warning", logged=logged, removed=n - m)
    check("columns", "error" if len(after.columns) > len(before.columns) else "ok", before=len(before.columns), after=len(after.columns))
    deduped = any(e.operation.startswith("drop_duplicate") for e in log)
    check("duplicates", "ok" if not left else "warning", left=left, flavour=None if not left else "revealed" if deduped else "not_run")
    expected = {c for e in log if e.operation in _EXPECTED for c in e.columns}
    for r in (r for r in cells if r["new_missing"]):
        check("new_missing", "warning" if r["name"] in expected else "error", column=r["name"], cells=r["new_missing"])
    for r in (r for r in cells if r["negative"]):
        lost = r["negative"] - r["kept"]
        check("negative_ages" if AGE.search(r["name"]) else "negatives", "warning" if lost else "ok", column=r["name"], kept=r["kept"], lost=lost)
    kinds = {y: (before.schema[x].dataType.simpleString(), after.schema[y].dataType.simpleString()) for x, y in paired(before, after)}
    check("types", "ok", changed=[(c, *k) for c, k in kinds.items() if k[0] != k[1]][:10])
    return Report(max((c["status"] for c in checks), key=_WORST.get), checks)


def format_rows(values: DataFrame, columns: list[str]) -> DataFrame:
    """name, n: identifiers whose format, or for phones whose number of digits, isn't the usual one."""
    u = usable(values.where(F.col("name").isin(*columns))).withColumn("mask", run_mask(F.col("value"))).withColumn("digits", F.length(F.regexp_replace("value", r"\D", "")))
    usual = {}
    for c in ("mask", "digits"):
        g = u.groupBy("name", c).agg(F.sum("n").alias("k"), F.min("first").alias("first"))
        usual[c] = g.groupBy("name").agg(F.max_by(c, F.struct("k", -F.col("first"))).alias(f"usual_{c}"))
    phones = [c for c in columns if PHONE.search(c)]
    odd = (F.col("mask") != F.col("usual_mask")) | ((F.col("name").isin(*phones) if phones else F.lit(False)) & (F.col("digits") != F.col("usual_digits")))
    # what is broadcast has a row per column
    return u.join(F.broadcast(usual["mask"]), "name").join(F.broadcast(usual["digits"]), "name").groupBy("name").agg(F.coalesce(F.sum(F.when(odd, F.col("n"))), F.lit(0)).cast("long").alias("n"))


def issue_counts(df: DataFrame, f: Findings, order: str, values: DataFrame | None = None) -> dict[str, int]:
    """Rows or cells per category. Counters cut by a cap (null markers, texts) are those of the findings. ``values``: a value table to use."""
    out = dict.fromkeys(CATEGORIES, 0)
    for c in f.columns.values():
        kind, ident = c["kind"], c["identifier_like"]
        out["whitespace"] += c["whitespace"]
        out["null_like"] += sum(t["n"] for t in c.get("null_tokens") or [])
        if kind == "numeric":
            out["number_format"] += c["currency"] + c["thousands_sep"] + c["decimal_comma"]
            out["unparseable"] += 0 if ident else sum(t["n"] for t in c.get("unparseable") or [])
            if not ident:
                out["negatives"] += 0 if c.get("age_policy") else c["negative"]
                out["ages"] += c.get("implausible", 0)
        if kind == "date":
            shapes = [d["n"] for d in c.get("date_formats") or []]
            out["date_formats"] += sum(shapes) - max(shapes) if len(shapes) > 1 else 0
            out["invalid_dates"] += c["bad_dates"]
        if kind == "email":
            out["emails"] += c["uppercase"] + c["bad_mails"]
        if kind == "categorical":
            out["variants"] += sum(v["n"] for v in c.get("variants") or [] if v["form"] != v["dominant"]) + sum(c["values"].get(t, 0) for t in c.get("typos") or {})
        if kind == "text":
            out["names"] += c["odd_case"] if "name" in c["name"].lower() else 0
    if ids := [n for n, c in f.columns.items() if c["identifier_like"]]:
        out["id_formats"] = sum(r["n"] for r in format_rows(value_table(df, ids, order) if values is None else values, ids).collect())
    out["duplicates"] = f.full_duplicates.get("removable", 0)
    out["key_conflicts"] = sum(d["involved"] for d in f.key_duplicates.values())
    out["relations"] = sum(r["mismatch_rows"] for r in f.relationships)
    return out


def quality_report(before: dict[str, int], after: dict[str, int]) -> dict:
    """Rows per category with something to say, totals, and the share resolved of what isn't left to people."""
    rows = [{"key": k, "before": before[k], "after": after[k], "manual": manual} for k, manual in CATEGORIES.items() if before[k] or after[k]]
    b, a = (sum(r[k] for r in rows if not r["manual"]) for k in ("before", "after"))
    return {"rows": rows, "before": b, "after": a, "resolved_pct": round(100 * max(b - a, 0) / b, 1) if b else 100.0}


def quality_of(before: DataFrame, plan, order: str) -> dict:
    """The quality report of a plan: the table is read and scanned; its values after the plan are kept up, not read again."""
    columns = [c for c in before.columns if c != order]
    values = stored(value_table(before, columns, order), "values")
    first = scan(before, order, columns, values=values)
    after = clean(before, plan, order, count=False).df
    later = stored(value_table_after(values, before, plan, order), "values")
    second = scan(after, order, values=later)
    return quality_report(issue_counts(before, first, order, values), issue_counts(after, second, order, later))


__all__ = ["validate", "validate_cleaning", "quality_report", "quality_of", "issue_counts", "new_missing", "negatives", "numbers"]
