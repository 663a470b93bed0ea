import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearbrook.functions import dates, numbers, text


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_lenient_numbers(spark):
    cases = {"1.234,56": 1234.56, "1,234.56": 1234.56, "1,234": 1.234, "1,2345": 12345.0, "1,234,567": 1234567.0, "1.234.567": 1234567.0, "1.234": 1.234, "12abc": 12.0, "-": None, "abc": None, "$389.54": 389.54, "(5)": 5.0, "1.2.34": 12.34, None: None, "": None}
    assert values(spark, cases, numbers.lenient) == list(cases.values())


def test_lenient_numbers_with_decimal_comma(spark):
    cases = {"1.234": 1234.0, "389.54": 389.54, "8,4": 8.4, "112,05": 112.05, "1,234,567": 1234567.0, "793 USD": 793.0}
    assert values(spark, cases, lambda c: numbers.lenient(c, True)) == list(cases.values())


def test_strict_numbers(spark):
    cases = {"$1,234": (1234.0, True, True, False), "8,4": (8.4, False, False, True), "1.234.567": (1234567.0, False, True, False), "1.2.3": (None, False, False, False), "12abc": (None, False, False, False), "+5": (5.0, False, False, False), ".5": (0.5, False, False, False), "1.234,5": (1234.5, False, False, True)}
    assert [tuple(v) for v in values(spark, cases, numbers.strict)] == list(cases.values())


def test_inspected_numbers(spark):
    cases = {"1.234.567": None, "1,234": 1234.0, "12 EUR": 12.0, "1.5": 1.5}
    assert values(spark, cases, numbers.inspected) == list(cases.values())


def test_plain_numbers_refuse_java_suffixes(spark):
    assert values(spark, ["5d", "5f", " 1e3 ", "-2", "x"], numbers.plain) == [None, None, 1000.0, -2.0, None]


def test_null_markers(spark):
    assert values(spark, [" N/A ", "ERR", "tbd", " ", "nil", "undefined"], text.is_null_marker) == [True, True, True, True, False, False]
    assert values(spark, ["nil", "undefined", "---", "???", "...", "city_unknown", "not available", "tbd", "word"], text.is_scan_null) == [True] * 7 + [False] * 2


def test_case_and_strip(spark):
    assert values(spark, ["o'neil mc-donald 3rd"], text.title) == ["O'Neil Mc-Donald 3Rd"]
    assert values(spark, [" \ta b "], text.strip) == ["a b"]
    assert values(spark, ["abc", "ABC", "Abc", "12"], text.one_case) == [True, True, False, False]


def test_masks(spark):
    assert values(spark, ["AB-12c"], text.mask) == ["A-99A"]
    assert values(spark, ["AB-12c"], text.run_mask) == ["A-9A"]
    assert values(spark, ["Ab C.1"], text.norm_key) == ["abc1"]


def test_as_text_prints_like_python(spark):
    df = spark.createDataFrame([(1e7, 0.1, True)], "a double, b double, c boolean")
    got = df.select(*(text.as_text(F.col(f.name), f.dataType) for f in df.schema)).first()
    assert tuple(got) == ("10000000.0", "0.1", "True")
    assert text.as_text(F.lit("x"), T.StringType()) is not None


@pytest.mark.parametrize(("value", "month_first", "day_first"), [("05/06/2024", "2024-05-06", "2024-06-05"), ("31/01/2024", "2024-01-31", "2024-01-31"), ("2024-02-30", None, None), ("2024/2/3", "2024-02-03", "2024-02-03"), ("x", None, None)])
def test_mixed_dates(spark, value, month_first, day_first):
    got = [v and str(v)[:10] for d in (False, True) for v in values(spark, [value], lambda c, d=d: dates.mixed(c, d))]
    assert got == [month_first, day_first]


def test_numbers_as_text(spark):
    from clearbrook.functions.text import number_text

    rng = random.Random(1)
    values = [1e20, 1e-5, -0.0, 0.0, 1e16, 1e15, 9.99e-5, 1e-4, 0.1, 1e22, 1e23, 1.5e300, 1e7, 12345678.9, -1.25e-7, 9007199254740993.0, float("nan"), float("inf"), -float("inf")]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(1500)] + [round(rng.uniform(0, 1e5), 2) * 10.0 ** rng.randint(-8, 14) for _ in range(1500)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(number_text(F.col("x"))).collect()]
    wrong = [(v, g) for v, g in zip(values, got) if repr(v) != g]
    assert all(float(g) == v and len(g) == len(repr(v)) and g[:-6] == repr(v)[:-6] for v, g in wrong) and len(wrong) < 20
    assert [r[0] for r in spark.createDataFrame([(0.1,), (1e10,)], "x float").select(number_text(F.col("x"))).collect()] == ["0.1", "10000000000.0"]


def test_email_repair_takes_the_longest_domain_and_linear_time(spark):
    from clearbrook.operators.values import value_table
    from clearbrook.plans.repairs import email_repairs

    rows = [(i, f"u{i}@mail.example.org") for i in range(5)] + [(10 + i, f"v{i}@example.org") for i in range(5)] + [(20 + i, f"w{i}@rare.net") for i in range(4)]
    rows += [(30, "annMAIL.example.org"), (31, "bobexample.org"), (32, "carrare.net"), (33, "example.org"), (34, "x" * 20_000 + "example.org"), (35, "?dexample.org")]
    df = spark.createDataFrame(rows, "rid long, email string")
    began = time.time()
    got = {r["value"]: r["repaired"] for r in email_repairs(value_table(df, ["email"], "rid")).collect()}
    assert got == {"annMAIL.example.org": "ann@mail.example.org", "bobexample.org": "bob@example.org", "x" * 20_000 + "example.org": "x" * 20_000 + "@example.org"}
    assert time.time() - began < 15


def test_dates_by_shape(spark):
    from clearbrook.functions import dates

    cases = {"05/03/24": ("2024-05-03", "2024-03-05"), "31.12.2020": ("2020-12-31",) * 2, "2024/2/9": ("2024-02-09",) * 2, "2024-01-05 10:20": ("2024-01-05",) * 2, "5 january, 2024": ("2024-01-05",) * 2, "2024 Mar 3": ("2024-03-03",) * 2}
    cases |= dict.fromkeys(("2023-02-29", "13-13-2020", "2024-01-05 25:00", "5-6.2024", "", "maybe 3", "2024-1-5x"), (None, None))
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    got = {r["v"]: tuple(str(x)[:10] if x else None for x in (r["m"], r["d"])) for r in df.select("v", dates.mixed(F.col("v")).alias("m"), dates.mixed(F.col("v"), True).alias("d")).collect()}
    assert got == cases


def test_categories_are_certain_as_a_whole():
    from clearbrook.operators.scan import typos
    from clearbrook.plans import planner

    # the first key in the order of values counts, not the most frequent in total
    assert typos([("Marseilles", 30), ("Marseille", 25), ("marseille", 20), ("Marseile", 1)])["Marseile"] == "Marseilles"
    values = {"Paris": 40, "Lyon": 39, "paris": 3, "Pariss": 2, "Lyonn": 10}
    actions, left = planner._category_actions("city", {"values": values, "typos": {"Pariss": "Paris", "Lyonn": "Lyon"}})
    assert [(a.reason, a.requires_review, a.replacements) for a in actions] == [("variants of one category", False, {"paris": "Paris"}), ("probable typo", True, {"Pariss": "Paris", "Lyonn": "Lyon"})]
    assert left == ["Paris", "Lyon"]
    # all forms of the key meant count: 10 and 10 against 2
    actions, _ = planner._category_actions("city", {"values": {"Marseille": 10, "MARSEILLE": 10, "Marseile": 2}, "typos": {"Marseile": "Marseille"}})
    assert [a.requires_review for a in actions] == [True, False]


def test_audit_keys_keep_the_mark():
    from clearbrook.operators.profile import audit_key
    from clearbrook.plans.model import header

    assert audit_key("﻿id\n x ") == "﻿id x" and header("﻿id\n x ") == "id x"


def test_a_text_loses_its_currency_once(spark):
    """The parser's steps name what they need of a text; it's worked out once, not at each of them."""
    plan = spark.range(3).select(numbers.strict(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("USD") == 1
