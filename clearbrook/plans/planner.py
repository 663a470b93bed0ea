"""From findings to a plan: every rule proposes actions, certain ones to run, others for review."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..functions.text import CLEAN_NULLS
from ..operators import duplicates, relations
from ..operators.scan import MOST_AGES, NON_NEGATIVE, PERSON, PHONE, Findings, implausible_ages, scan
from ..operators.values import value_table
from . import repairs
from .model import Action, Requirement, finalise, reviewed
from .requirements import requirements

# Number words, English and French.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
    "zéro": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11,
    "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16, "vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50,
    "soixante": 60, "cent": 100,
}
DOMINANT, SURE_RATIO, SURE_TIMES, OPEN_COLUMNS, OPEN_FORMS = 0.6, 0.85, 10, 6, 40
#: Repairs of one column that a plan may list; beyond, they are stored and the action names the path.
MOST_PAIRS = 10_000


@dataclass
class Planned:
    actions: list[Action]
    findings: Findings
    requirements: list[Requirement]
    open_decisions: dict[str, list[str]] = field(default_factory=dict)


def key_of(form: str) -> str:
    return re.sub(r"[^a-z0-9]", "", form.lower())


def _category_actions(name: str, c: dict) -> tuple[list[Action], list[str]]:
    """Forms of one key become the commonest of them, those of a mistyped key the commonest of the key meant.

    Each of the two is one action, certain only if all its keys are: a form that makes up DOMINANT of
    its key, a key meant that is SURE_TIMES as frequent, all forms counted, and SURE_RATIO similar.
    """
    forms = dict(c.get("values") or {})
    table = pd.DataFrame({"form": list(forms), "n": list(forms.values())})
    table["key"] = [key_of(f) for f in forms]
    keys = table.sort_values("n", ascending=False, kind="stable").groupby("key", sort=False).agg(dominant=("form", "first"), most=("n", "first"), total=("n", "sum"), forms=("form", "size"))
    typos = pd.DataFrame(list((c.get("typos") or {}).items()), columns=["source", "meant"], dtype=object)
    typos["key"], typos["meant"] = [key_of(f) for f in typos["source"]], [key_of(f) for f in typos["meant"]]
    typos = typos[(typos["key"] != typos["meant"]) & typos["key"].isin(keys.index) & typos["meant"].isin(keys.index)].drop_duplicates("key", keep="last")
    typos = typos.join(keys, on="key").join(keys, on="meant", rsuffix="_of")
    wrong = table.merge(typos[["key", "dominant_of"]], on="key")
    own = table[~table["key"].isin(typos["key"])].join(keys[["dominant", "forms"]], on="key")
    own = own[(own["forms"] > 1) & (own["form"] != own["dominant"])]
    split = keys[(keys["forms"] > 1) & ~keys.index.isin(typos["key"])]
    out = []
    if len(own):
        sure = bool((split["most"] >= DOMINANT * split["total"]).all())
        out.append(Action("replace_values", (name,), "variants of one category", "high" if sure else "medium", not sure, replacements=dict(zip(own["form"], own["dominant"]))))
    if len(wrong):
        alike = [SequenceMatcher(None, a, b).ratio() >= SURE_RATIO for a, b in zip(typos["key"], typos["meant"])]
        sure = all(alike) and bool((typos["total_of"] >= SURE_TIMES * typos["total"]).all())
        out.append(Action("replace_values", (name,), "probable typo", "high" if sure else "medium", not sure, replacements=dict(zip(wrong["form"], wrong["dominant_of"]))))
    done = {*own["form"], *wrong["form"]}
    left = [f for f in forms if f not in done]
    return out, left if 2 <= len(left) <= OPEN_FORMS else []


#: What makes the repairs of a column, as (name, value, repaired).
_MAKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "email": repairs.email_repairs,
    "phone": repairs.phone_repairs,
    "prefix": repairs.id_prefixes,
    "date": lambda values: repairs.iso_dates(values).where("iso is not null and iso <> value").withColumnRenamed("iso", "repaired"),
}


def _wanted(name: str, c: dict) -> str | None:
    """Which repairs a column's findings ask for."""
    if c["kind"] == "date":
        return "date"
    if c["kind"] == "email" and c["bad_mails"]:
        return "email"
    if c["identifier_like"] and len(c.get("format_patterns") or []) > 1:
        return "phone" if PHONE.search(name) else "prefix" if c.get("key_candidate") else None
    return None


def _repairs(values: DataFrame, columns: dict[str, dict]) -> dict[str, dict]:
    """What actions need to apply all repairs of each column: the pairs, or where they are stored; nothing for a column without any. One query for all columns."""
    asked: dict[str, list[str]] = {}
    for name, c in columns.items():
        if what := _wanted(name, c):
            asked.setdefault(what, []).append(name)
    found = None
    for what, names in asked.items():
        own = _MAKERS[what](values.where(F.col("name").isin(*names))).select("name", "value", "repaired")
        found = own if found is None else found.union(own)
    if found is None:
        return {}
    found = stored(found, "repairs")
    by = Window.partitionBy("name").orderBy("value")
    pairs: dict[str, dict] = {}
    for r in found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= MOST_PAIRS + 1).collect():
        pairs.setdefault(r["name"], {})[r["value"]] = r["repaired"]
    path = lambda name: repairs.written(found.where(F.col("name") == name).select(F.col("value").alias("_old"), F.col("repaired").alias("_new")))
    return {name: {"replacements": own} if len(own) <= MOST_PAIRS else {"replacements_path": path(name)} for name, own in pairs.items()}


def plan(df: DataFrame, order: str, findings: Findings | None = None, reviewer: Callable | None = None) -> Planned:
    """Scan (unless findings are given), propose, let a reviewer add replacements, finalise."""
    names = list(findings.columns) if findings else [c for c in df.columns if c != order]
    values = stored(value_table(df, names, order), "values")
    f = findings or scan(df, order, names, values=values)
    acts: list[Action] = []
    opened: dict[str, list[str]] = {}
    if blanks := tuple(n for n in names if f.columns[n]["whitespace"]):
        acts.append(Action("strip_whitespace", blanks, "outer white space"))
    by_tokens: dict[tuple, list[str]] = {}
    for n in names:
        if tokens := tuple(sorted(t["value"] for t in f.columns[n].get("null_tokens") or [])):
            by_tokens.setdefault(tokens, []).append(n)
    acts += [Action("replace_null_like", tuple(c), "null markers", null_tokens=t) for t, c in by_tokens.items()]
    repaired = _repairs(values, f.columns)
    asked = [n for n in names if f.columns[n]["kind"] == "numeric"]
    marks = {r["name"]: r for r in repairs.decimal_marks(values.where(F.col("name").isin(*asked))).collect()} if asked else {}
    numeric: dict[bool, list[str]] = {}
    for n in names:
        c = f.columns[n]
        kind, ident, text = c["kind"], c["identifier_like"], dict(df.dtypes)[n] == "string"
        if kind == "categorical":
            more, left = _category_actions(n, c)
            acts += more
            if left and len(opened) < OPEN_COLUMNS:
                opened[n] = left
        elif kind == "email":
            if c["uppercase"]:
                acts.append(Action("normalize_case", (n,), "e-mails in lower case", case_mode="lower"))
            if c["bad_mails"]:
                pairs = repaired.get(n)
                acts.append(Action("replace_values", (n,), "missing @", "medium", True, **pairs) if pairs else Action("no_change", (n,), "malformed e-mails", "low", True))
        elif kind == "numeric" and not ident:
            odd = [t["value"] for t in c.get("unparseable") or []]
            if words := {t: str(NUMBER_WORDS[t.lower()]) for t in odd if t.lower() in NUMBER_WORDS}:
                acts.append(Action("replace_values", (n,), "number words", replacements=words))
            if rest := tuple(t for t in odd if t not in words):
                acts.append(Action("replace_null_like", (n,), "not a number", null_tokens=rest))
            if text:
                numeric.setdefault(bool(marks[n]["decimal_comma"]) if n in marks else False, []).append(n)
            ages = tuple(t["value"] for t in c.get("implausible_ages") or [])
            if len(ages) >= MOST_AGES:  # too many to list
                rest = implausible_ages(values, {n: c["age_policy"]}).select(F.col("value").alias("_old"), F.lit(None).cast("string").alias("_new"))
                acts.append(Action("replace_values", (n,), "implausible ages", "medium", True, replacements_path=repairs.written(rest)))
            elif ages:
                acts.append(Action("replace_null_like", (n,), "implausible ages", "medium", True, null_tokens=ages))
            elif c["negative"] and not c.get("age_policy"):
                acts.append(Action("set_negative_to_null", (n,), "negative values", "medium" if NON_NEGATIVE.search(n) else "low", True))
        elif kind == "date":
            if pairs := repaired.get(n):
                acts.append(Action("replace_values", (n,), "dates as year-month-day", **pairs))
            acts.append(Action("to_datetime", (n,), "dates", requires_review=bool(c["bad_dates"])))
        elif kind == "text" and PERSON.search(n) and c["odd_case"]:
            acts.append(Action("normalize_case", (n,), "names in title case", "medium", True, case_mode="title"))
        if ident and len(c.get("format_patterns") or []) > 1:
            pairs = repaired.get(n)
            acts.append(Action("replace_values", (n,), "identifier formats", "medium", True, **pairs) if pairs else Action("no_change", (n,), "several identifier formats", "low", True))
    acts += [Action("to_numeric", tuple(c), "numbers as text", decimal_comma=comma) for comma, c in numeric.items()]
    for key in f.key_duplicates:
        safe = duplicates.key_summary(df, [key], [c for c in names if c != key]).first()["safe_to_drop_by_key"]
        acts.append(Action("drop_duplicates_by_columns", (key,), "repeated key", "medium" if safe else "low", True))
    if f.full_duplicates.get("removable"):
        acts.append(Action("drop_duplicate_rows", reason="equal rows"))
    if duplicates.hidden(df, names).first()["removable"] > f.full_duplicates.get("removable", 0):
        acts.append(Action("drop_duplicate_rows_after_cleaning", reason="rows equal but for case and space", confidence="medium", requires_review=True))
    for r in f.relationships:
        counts = relations.relation_counts(df, r["left"], r["right"], r["target"]).first()
        if any(counts[k] for k in ("fillable_left", "fillable_right", "fillable_target")):
            acts.append(Action("fill_missing_from_formula", (r["target"],), "product of two columns", "medium", True, source_columns=(r["left"], r["right"])))
        if r["mismatch_rows"]:
            acts.append(Action("recalculate_from_columns", (r["target"],), "product of two columns", "medium", True, source_columns=(r["left"], r["right"])))
    needs = requirements(f)
    extra = reviewed(reviewer(opened) if reviewer else [], lambda v: v.strip().lower() in CLEAN_NULLS)
    return Planned(finalise(acts, extra, needs), f, needs, opened)


def forecast(df: DataFrame, order: str) -> dict:
    """Rows now, rows that equal an earlier one, and rows expected without them."""
    rows, removable = df.count(), duplicates.full(df, [c for c in df.columns if c != order]).first()["removable"]
    return {"rows": rows, "exact_duplicates": removable, "expected_rows": rows - removable}


def summary(actions: list[Action], most: int = 30) -> list[str]:
    return [f"{a.operation} {', '.join(a.columns)}: {a.reason}".strip() for a in actions[:most]]
