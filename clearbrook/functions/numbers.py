"""Number parsers as Column expressions. They differ on purpose: each belongs to one operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import let

# Currency marks that parsers ignore.
CURRENCY = r"(?i)[$€£¥]|\b(?:USD|EUR|GBP|MAD|DHS?)\b"
_NUMBER = r"\A[-+]?(?:\d[\d.,]*|[.,]\d+)\z"
_COMMA_GROUPS, _DOT_GROUPS = r"\A[-+]?\d{1,3}(?:,\d{3})+\z", r"\A[-+]?\d{1,3}(?:\.\d{3})+\z"
_PLAIN = r"\A\s*[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|(?i:inf|infinity|nan))\s*\z"


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.translate(c, what, ""))


def _without(c: Column, what: str) -> Column:
    return F.translate(c, what, "")


def _comma_last(c: Column) -> Column:
    return F.instr(F.reverse(c), ",") < F.instr(F.reverse(c), ".")


def _last_as_point(c: Column, sep: str) -> Column:
    """All separators dropped but the last, which becomes the point."""
    tail = F.substring_index(c, sep, -1)
    return F.concat(_without(F.substring(c, F.lit(1), F.length(c) - F.length(tail)), sep), F.lit("."), tail)


def lenient(c: Column, decimal_comma: bool = False) -> Column:
    """The cleaning operator's parser: keeps digits, separators and minus signs, then decides which separator is the decimal one."""
    t = F.regexp_replace(c, r"[^0-9,.\-]", "")
    commas, dots = _count(t, ","), _count(t, ".")
    both = F.when(_comma_last(t), F.translate(_without(t, "."), ",", ".")).otherwise(_without(t, ","))
    if decimal_comma:
        only_comma = F.when(commas == 1, F.translate(t, ",", ".")).otherwise(F.when(t.rlike(r"\A[^,]*(?:,[^,]{3})+\z"), _without(t, ",")).otherwise(_last_as_point(t, ",")))
        one_dot = F.when(t.rlike(r"\A[^.]*\.[^.]{3}\z") & (F.length(_without(F.substring_index(t, ".", 1), "-")) <= 3), _without(t, ".")).otherwise(t)
    else:
        only_comma = F.when((commas == 1) & t.rlike(r",[^,]{1,3}\z"), F.translate(t, ",", ".")).otherwise(_without(t, ","))
        one_dot = t
    only_dot = F.when(dots > 1, F.when(t.rlike(r"\A[^.]*(?:\.[^.]{3})+\z"), _without(t, ".")).otherwise(_last_as_point(t, "."))).otherwise(one_dot)
    text = F.when((commas > 0) & (dots > 0), both).when(commas > 0, only_comma).when(dots > 0, only_dot).otherwise(t)
    return F.when(text.rlike(r"\A-?(?:\d+\.?\d*|\.\d+)\z"), text).try_cast("double")


def strict(c: Column) -> Column:
    """The scan's parser: struct of value, currency, thousands_sep, decimal_comma; value is null for text that isn't wholly a number."""
    return let(F.trim(F.regexp_replace(c, CURRENCY, "")), lambda bare: let(F.translate(bare, "  ", ""), lambda t: _read(t, bare != F.trim(c))))


def _read(t: Column, currency: Column) -> Column:
    """The struct of ``strict`` for a text without currency and spaces."""
    ok = t.rlike(_NUMBER)
    commas, dots = _count(t, ","), _count(t, ".")
    both = (commas > 0) & (dots > 0)
    grouped = t.rlike(_COMMA_GROUPS)
    dotted = t.rlike(_DOT_GROUPS)
    text = (
        F.when(both, F.when(_comma_last(t), F.translate(_without(t, "."), ",", ".")).otherwise(_without(t, ",")))
        .when(commas > 0, F.when(grouped, _without(t, ",")).otherwise(F.translate(t, ",", ".")))
        .when(dots > 1, F.when(dotted, _without(t, ".")))
        .otherwise(t)
    )
    thousands = (both & ~_comma_last(t)) | ((dots == 0) & grouped) | ((commas == 0) & (dots > 1) & dotted)
    comma = (both & _comma_last(t)) | ((commas > 0) & (dots == 0) & ~grouped)
    return F.struct(F.when(ok, text).try_cast("double").alias("value"), currency.alias("currency"), (ok & thousands).alias("thousands_sep"), (ok & comma).alias("decimal_comma"))


def inspected(c: Column) -> Column:
    """The inspection tool's parser: as strict, but several points are never thousands."""
    t = F.translate(F.regexp_replace(c, CURRENCY, ""), "  ", "")
    commas, dots = _count(t, ","), _count(t, ".")
    text = F.when((commas > 0) & (dots > 0), F.when(_comma_last(t), F.translate(_without(t, "."), ",", ".")).otherwise(_without(t, ","))).when(commas > 0, F.when(t.rlike(_COMMA_GROUPS), _without(t, ",")).otherwise(F.translate(t, ",", "."))).otherwise(t)
    return F.when(t.rlike(_NUMBER), text).try_cast("double")


def profiled(c: Column) -> Column:
    """The profile's parser: digits, separators and signs, comma as point."""
    t = F.translate(F.regexp_replace(c, r"[^0-9,.\-]", ""), ",", ".")
    return F.when(t.rlike(_PLAIN), t).try_cast("double")


def plain(c: Column) -> Column:
    """A number as Python's float would read it, else null."""
    return F.when(c.rlike(_PLAIN), F.trim(c)).try_cast("double")


def round_even(c: Column, places: int = 2) -> Column:
    return F.rint(c * float(10**places)) / float(10**places)


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))
