"""What a scan's findings oblige a plan to deal with."""

from __future__ import annotations

from ..operators.scan import MOST_AGES, NON_NEGATIVE, PERSON, Findings
from .model import Requirement


def requirements(f: Findings) -> list[Requirement]:
    out: list[Requirement] = []

    def need(column, issue, *ops, review=False, tokens=()):
        out.append(Requirement(f"R{len(out) + 1:03d}", column, issue, tuple(ops), bool(review), tuple(tokens)))

    if f.full_duplicates.get("removable"):
        need(None, "full_duplicates", "drop_duplicate_rows")
    for name, c in f.columns.items():
        kind, ident = c["kind"], c["identifier_like"]
        if c["whitespace"]:
            need(name, "whitespace", "strip_whitespace")
        if c.get("null_tokens"):
            need(name, "null_like", "replace_null_like", "replace_values", tokens=[t["value"] for t in c["null_tokens"]])
        if kind == "numeric":
            if not ident and (c["currency"] or c["thousands_sep"] or c["decimal_comma"]):
                need(name, "number_format", "to_numeric")
            if not ident and c.get("unparseable"):
                need(name, "unparseable", "replace_values", "replace_null_like", tokens=[t["value"] for t in c["unparseable"]])
            if not ident and (c.get("unparseable") or c["currency"] or c["thousands_sep"] or c["decimal_comma"]):
                need(name, "text_numbers", "to_numeric")
            if c.get("implausible_ages"):
                ages = [t["value"] for t in c["implausible_ages"]]
                need(name, "implausible_age", *(("replace_null_like",) if len(ages) < MOST_AGES else ("replace_null_like", "replace_values")), review=True, tokens=ages if len(ages) < MOST_AGES else ())
            elif c["negative"] and not ident and not c.get("age_policy"):
                need(name, "negative", "set_negative_to_null", review=not NON_NEGATIVE.search(name))
        elif kind == "date" and (len(c.get("date_formats") or []) > 1 or c["bad_dates"]):
            need(name, "dates", "to_datetime", review=c["bad_dates"])
        elif kind == "email":
            if c["uppercase"]:
                need(name, "email_case", "normalize_case")
            if c["bad_mails"]:
                need(name, "email_format", "replace_values", review=True)
        elif kind == "categorical":
            kinds = {v["lowered"] > 1 for v in c.get("variants") or []}
            if False in kinds:
                need(name, "case_variants", "normalize_case", "replace_values")
            if True in kinds:
                need(name, "punctuation_variants", "replace_values")
            if c.get("typos"):
                need(name, "typos", "replace_values")
            if c.get("country_codes"):
                need(name, "country_mix", "replace_values")
        elif kind == "text" and PERSON.search(name) and c["odd_case"]:
            need(name, "name_case", "normalize_case", review=True)
        if ident and len(c.get("format_patterns") or []) > 1:
            need(name, "identifier_formats", "replace_values", review=True)
    for r in f.relationships:
        if r["mismatch_rows"]:
            need(r["target"], "relationship", "recalculate_from_columns", review=True)
    for name in f.key_duplicates:
        need(name, "repeated_key", "drop_duplicates_by_columns", review=True)
    return out
