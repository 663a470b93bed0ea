"""Date parsing as Column expressions: a notation is told by its shape, rewritten as year-month-day, and read by a cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import let
from .text import digit_mask

_YEAR_FIRST = r"\A(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[ T](\d{1,2}:\d{1,2}(?::\d{1,2})?)(?:\.\d+)?\s*(?:Z|UTC|[+-]\d\d:?\d\d)?)?\z"
_YEAR_LAST = r"\A(\d{1,2})([-/.])(\d{1,2})\2(\d{2}|\d{4})\z"
# English months.
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAME = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in _MONTHS)
#: Month, day, year; day, month, year; year, month, day: what stands where.
_NAMED = ((rf"\A({_NAME}) (\d{{1,2}}) (\d{{4}})\z", 3, 1, 2), (rf"\A(\d{{1,2}}) ({_NAME}) (\d{{4}})\z", 3, 2, 1), (rf"\A(\d{{4}}) ({_NAME}) (\d{{1,2}})\z", 1, 2, 3))


def _read(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def mixed(c: Column, dayfirst: bool = False) -> Column:
    """Timestamp without zone of a date in mixed notation; impossible readings in one order fall back to the other.

    Years of two digits are of this century; months may be English names, with or without points
    and commas; a time's fraction and zone are dropped.
    """
    return let(c, lambda value: _mixed(value, dayfirst))


def _mixed(c: Column, dayfirst: bool) -> Column:
    century = F.when(c.rlike(r"[-/.]\d{2}\z"), "20").otherwise("")
    first, second = ("$3-$1", "$1-$3") if dayfirst else ("$1-$3", "$3-$1")
    year_last = F.coalesce(*(_read(F.concat(century, F.regexp_replace(c, _YEAR_LAST, f"$4-{order}"))) for order in (first, second)))
    month = lambda word: F.array_position(F.array(*(F.lit(m[:3]) for m in _MONTHS)), F.left(word, F.lit(3))).cast("string")
    part = F.regexp_extract
    of_plain = lambda plain: F.coalesce(*(F.when(plain.rlike(of), _read(F.concat_ws("-", part(plain, of, y), month(part(plain, of, m)), part(plain, of, d)))) for of, y, m, d in _NAMED))
    named = let(F.trim(F.regexp_replace(F.lower(c), r"[\s,./-]+", " ")), of_plain)
    return F.when(c.rlike(_YEAR_FIRST), _read(F.regexp_replace(c, _YEAR_FIRST, "$1-$3-$4 $5"))).when(c.rlike(_YEAR_LAST), year_last).when(c.rlike(r"[A-Za-z]{3}"), named)


def iso(c: Column) -> Column:
    return F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


def parts(c: Column) -> tuple[Column, Column, Column]:
    """First, second and third number of a date-shaped text."""
    p = F.split(c, "[-/.]")
    return tuple(F.get(p, F.lit(i)).try_cast("int") for i in range(3))


def mask_evidence(c: Column) -> tuple[Column, Column, Column]:
    """Mask, and whether the text can only be day-first, or only month-first."""
    a, b, _ = parts(c)
    year_first = F.length(F.get(F.split(c, "[-/.]"), F.lit(0))) == 4
    return digit_mask(c), ~year_first & (a > 12), ~year_first & (a <= 12) & (b > 12)
