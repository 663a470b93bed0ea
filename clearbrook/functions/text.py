"""Text rules as Column expressions: strip, case, masks, null markers, stringification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"
# Null markers of the cleaning operator and of the profile, the scan's pattern, and the shapes of e-mails and dates.
CLEAN_NULLS = ("", "na", "n/a", "null", "none", "nan", "unknown", "unk", "error", "err", "tbd", "-", "--", "?", "missing", "not available")
PROFILE_NULLS = tuple(t for t in CLEAN_NULLS if t not in ("error", "err"))
SCAN_NULLS = r"(?i)\A(?:unknown|unk|error|err|n/?a|#n/?a|null|none|nan|nil|missing|undefined|-+|\?+|\.+|not[_ ]?(?:a[_ ]?)?(?:date|number|available|applicable)|[a-z]+_unknown|unknown_[a-z]+)\z"
EMAIL = r"\A[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\z"
DATE_SHAPE = r"\A\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\z"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(c, rf"\A{_BLANK}|{_BLANK}\z", "")


def title(c: Column) -> Column:
    """Every run of letters capitalised."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def cased(c: Column, mode: str) -> Column:
    return {"lower": F.lower, "upper": F.upper, "title": title}[mode](c)


def mask(c: Column) -> Column:
    """Each digit as 9, each run of letters as A."""
    return F.regexp_replace(F.regexp_replace(c, r"\d", "9"), "[A-Za-zÀ-ÿ]+", "A")


def run_mask(c: Column) -> Column:
    """Each run of digits as 9, each run of ASCII letters as A."""
    return F.regexp_replace(F.regexp_replace(c, r"\d+", "9"), "[A-Za-z]+", "A")


def digit_mask(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "9")


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_null_marker(c: Column, tokens: tuple[str, ...] = CLEAN_NULLS) -> Column:
    return F.lower(strip(c)).isin(*tokens)


def is_scan_null(c: Column) -> Column:
    """On a stripped value: a null marker of the scan, or blank."""
    return (c == "") | c.rlike(SCAN_NULLS)


def one_case(c: Column) -> Column:
    """All lower or all upper, with a letter, and not in title case."""
    lower, upper = F.lower(c), F.upper(c)
    return (((c == lower) | (c == upper)) & (lower != upper)) & (c != title(c))


def number_text(c: Column) -> Column:
    """A binary fraction as Python prints it: the fewest digits that give it back, plain from 1e-04 on and below 1e+16, else with an exponent of two digits or more.

    The JVM may print a digit or two too many; where it prints 16 or more, fewer are tried, rounded and cut off.
    Where 17 are needed the last is the JVM's, and so are all below 2.3e-308.
    """
    size, given = F.abs(c), c.cast("string")
    power10 = F.coalesce(F.nullif(F.regexp_extract(given, r"(E.*)\z", 1), F.lit("")), F.lit(""))
    tries = [F.upper(F.format_string(f"%.{k}e", c)) for k in (14, 15)]
    tries.append(F.concat(F.regexp_extract(given, r"\A(-?\d\.\d{15})", 1), power10))
    tries.append(F.upper(F.format_string("%.16e", c)))
    fewer = F.coalesce(*(F.when(t.try_cast("double") == c, t) for t in tries), given)
    many = F.length(F.regexp_replace(given, r"[-.]|E.*", "")) >= 16
    digits = F.when(many & (size >= 2.3e-308), F.regexp_replace(F.regexp_replace(fewer, r"E\+?(-?)0?(\d)", "E$1$2"), r"\.?0*E", "E")).otherwise(given)
    plain = F.regexp_replace(F.regexp_replace(digits.try_cast("decimal(38,22)").cast("string"), r"0+\z", ""), r"\.\z", ".0")
    power = F.regexp_extract(digits, r"E-?(\d+)\z", 1)
    scientific = F.concat(F.regexp_extract(digits, r"\A(-?\d+(?:\.\d*[1-9])?)", 1), F.when(F.contains(digits, F.lit("E-")), "e-").otherwise("e+"), F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    named = F.when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
    zero = F.when(F.startswith(digits, F.lit("-")), "-0.0").otherwise("0.0")
    return F.when(F.isnan(c) | (size == float("inf")), named).when(c == 0, zero).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as Python would print it."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return number_text(c)
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), r" 00:00:00\z", "")
    if isinstance(kind, T.AtomicType):
        return c.cast("string")
    return F.to_json(c) if isinstance(kind, T.StructType | T.MapType | T.ArrayType) else c.cast("string")
