"""Repairs that need a look at the data: e-mails, identifiers, phones, dates, decimal commas.

Each is a frame of (value, repaired, n) over distinct values, to be turned into
replacements for review, or joined back where there are too many for a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.shared import shared_path
from ..functions.text import DATE_SHAPE, EMAIL, digit_mask, strip
from ..operators.values import usable

DOMAIN_LEAST = 5


def email_repairs(values: DataFrame) -> DataFrame:
    """Values without @ that end in a domain seen DOMAIN_LEAST times: the longest such domain is split off."""
    u = usable(values)
    valid = u.where(F.col("value").rlike(EMAIL))
    domains = valid.groupBy("name", F.lower(F.substring_index("value", "@", -1)).alias("domain")).agg(F.sum("n").alias("seen")).where(F.col("seen") >= DOMAIN_LEAST)
    # a text can only end in a domain of one of the lengths that domains of its column have, so it is joined on its ends of
    # those lengths: what a text costs follows the domains, not the text
    lengths = domains.groupBy("name").agg(F.collect_set(F.length("domain")).alias("lengths"))
    broken = u.where(~F.contains(F.col("value"), F.lit("@"))).join(F.broadcast(lengths), "name")  # a row per column
    fitting = F.filter("lengths", lambda k: k < F.length("value"))
    ends = broken.select("name", "value", "n", F.explode(fitting).alias("size")).withColumn("domain", F.lower(F.expr("right(value, size)")))
    hit = ends.join(domains, ["name", "domain"]).withColumn("local", F.expr("left(value, length(value) - size)")).where(F.col("local").rlike(r"\A[A-Za-z0-9][A-Za-z0-9._%+\-]*\z"))
    best = hit.groupBy("name", "value", "n").agg(F.max_by(F.struct("local", "domain"), F.length("domain")).alias("b"))
    return best.select("name", "value", F.concat("b.local", F.lit("@"), "b.domain").alias("repaired"), "n")


def id_prefixes(values: DataFrame) -> DataFrame:
    """Identifiers with a prefix before digits, in columns where at least 80 % are digits alone."""
    u = usable(values)
    share = u.groupBy("name").agg((F.sum(F.when(F.col("value").rlike(r"\A\d+\z"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).where("share >= 0.8")
    odd = u.join(share, "name").withColumn("repaired", F.regexp_extract("value", r"\A[A-Za-z]+[-_ #:]*(\d+)\z", 1)).where("repaired <> ''")
    return odd.select("name", "value", "repaired", "n")


def phone_repairs(values: DataFrame) -> DataFrame:
    """Phones as digits: under 6 digits null; a leading 00, 0 or country code goes if that gives the usual length, which at least half must have."""
    u = usable(values).withColumn("digits", F.regexp_replace("value", r"\D", ""))
    by = Window.partitionBy("name")
    length = u.groupBy("name", F.length("digits").alias("size")).agg(F.sum("n").alias("k"))
    length = length.withColumn("all", F.sum("k").over(by)).groupBy("name").agg(F.max_by("size", F.struct("k", -F.col("size"))).alias("usual"), F.max("k").alias("k"), F.max("all").alias("all"))
    length = length.select("name", F.when(F.col("k") >= 0.5 * F.col("all"), F.col("usual")).alias("usual"))
    d, size = F.col("digits"), F.col("usual")
    bare = F.regexp_replace(d, r"\A00", "")
    tries: list[Column] = [F.when(F.length(x) == size, x) for x in (d, F.regexp_replace(d, r"\A0", ""), *(F.substring(bare, F.lit(k + 1), F.length(bare)) for k in (0, 1, 2, 3)))]
    kept = F.when(F.startswith(F.col("value"), F.lit("+")), F.concat(F.lit("+"), d)).otherwise(d)
    out = u.join(F.broadcast(length), "name").withColumn("repaired", F.when(F.length(d) < 6, None).otherwise(F.coalesce(*tries, kept)))
    return out.where(~F.col("repaired").eqNullSafe(F.col("value"))).select("name", "value", "repaired", "n")


def date_masks(values: DataFrame) -> DataFrame:
    """name, mask, day_first, month_first, n: what the dates of each notation prove."""
    u = usable(values).where(F.col("value").rlike(DATE_SHAPE))
    mask, day, month = dates.mask_evidence(F.col("value"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return u.groupBy("name", mask.alias("mask")).agg(n(day).alias("day_first"), n(month).alias("month_first"), F.sum("n").cast("long").alias("n"))


def iso_dates(values: DataFrame) -> DataFrame:
    """name, value, iso, certainty: certain, inferred from the notation's other dates, or unresolved (iso null).

    Two-digit years and impossible dates are left alone (certainty left).
    """
    u = usable(values).where(F.col("value").rlike(DATE_SHAPE)).withColumn("mask", digit_mask(F.col("value")))
    u = u.join(F.broadcast(date_masks(values).drop("n")), ["name", "mask"])  # a date's shape allows 288 masks a column
    a, b, c = dates.parts(F.col("value"))
    year_first = F.length(F.get(F.split("value", "[-/.]"), F.lit(0))) == 4
    four = F.length(F.get(F.split("value", "[-/.]"), F.lit(2))) == 4
    day = (a > 12) | ((a <= 12) & (b <= 12) & (F.col("day_first") > 0) & (F.col("month_first") == 0))
    month = (b > 12) | ((a <= 12) & (b <= 12) & (F.col("month_first") > 0) & (F.col("day_first") == 0))
    text = F.when(year_first, F.format_string("%04d-%02d-%02d", a, b, c)).when(~four | ((a > 12) & (b > 12)), None).when(day, F.format_string("%04d-%02d-%02d", c, b, a)).when(month, F.format_string("%04d-%02d-%02d", c, a, b))
    real = F.when(dates.iso(text).isNotNull(), text)
    kind = F.when(year_first & real.isNotNull(), "certain").when(year_first | ~four | ((a > 12) & (b > 12)), "left").when(real.isNotNull() & ((a > 12) | (b > 12)), "certain").when(real.isNotNull(), "inferred").when((a <= 12) & (b <= 12) & ~day & ~month, "unresolved").otherwise("left")
    return u.select("name", "value", real.alias("iso"), kind.alias("certainty"), "n")


def written(pairs: DataFrame) -> str:
    """The pairs as Parquet in the shared folder; their path."""
    path = shared_path(pairs.sparkSession, "repairs")
    pairs.write.parquet(path)
    return path


def decimal_marks(values: DataFrame) -> DataFrame:
    """name, commas, points, decimal_comma: which mark one or two decimals follow more often."""
    u = usable(values)
    n = lambda r: F.coalesce(F.sum(F.when(F.col("value").rlike(r), F.col("n"))), F.lit(0)).cast("long")
    return u.groupBy("name").agg(n(r"\d,\d{1,2}(?!\d)").alias("commas"), n(r"\d\.\d{1,2}(?!\d)").alias("points")).withColumn("decimal_comma", F.col("commas") > F.col("points"))


__all__ = ["email_repairs", "id_prefixes", "phone_repairs", "date_masks", "iso_dates", "written", "decimal_marks", "strip"]
