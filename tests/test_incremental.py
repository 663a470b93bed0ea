"""Relation search against all triples, kept-up value tables against a full rescan, paired validation against a join."""

import itertools

import numpy as np
import pytest

from clearbrook.operators import relations
from clearbrook.operators.cleaning import clean
from clearbrook.operators.maintained import value_table_after
from clearbrook.operators.values import value_table
from clearbrook.plans import validation
from clearbrook.plans.model import Action


def all_triples(x):
    """Candidates whose rate reaches the limit, by comparing every product with every target."""
    out = set()
    for a, b in itertools.combinations(range(x.shape[1]), 2):
        for c in set(range(x.shape[1])) - {a, b}:
            full = ~np.isnan(x[:, [a, b, c]]).any(1)
            p, z = x[full, a] * x[full, b], x[full, c]
            telling = (abs(p) > 1e-9) | (abs(z) > 1e-9)
            if telling.sum() >= 50 and (abs(p - z) <= 0.02 * np.maximum(abs(z), 1))[telling].mean() >= 0.95:
                out.add((a, b, c))
    return out


def tables(n):
    rng = np.random.default_rng(4)
    for k in range(n):
        rows, m = int(rng.integers(200, 900)), int(rng.integers(4, 12))
        x = np.exp(rng.normal(0, rng.uniform(0.05, 3), (rows, m))) * rng.choice([-1, 1], (rows, m))
        x[rng.random((rows, m)) < 0.05 * (k % 2)] = 0
        for _ in range(3):
            a, b, c = rng.choice(m, 3, replace=False)
            x[:, c] = x[:, a] * x[:, b] * rng.uniform(0.99, 1.01, rows)
            x[rng.random(rows) < 0.02, c] *= 3
        x[rng.random((rows, m)) < 0.03] = np.nan
        yield x


def test_no_relation_is_lost_by_the_sketch():
    found = 0
    for x in tables(25):
        want = all_triples(x)
        found += len(want)
        assert want == set(relations.surviving(x, True))
        assert want <= set(relations.surviving(x, False))
        assert want <= set(relations.surviving(x[:150], False))  # a smaller sketch rules out less
    assert found > 20
    # and it does rule out
    x = np.exp(np.random.default_rng(1).normal(0, 2, (2000, 20)))
    assert len(relations.surviving(x, False)) < 20


def test_discover_equals_full_search(spark, monkeypatch):
    monkeypatch.setattr(relations, "SKETCH", 120)
    for x in itertools.islice(tables(6), 6):
        names = [f"c{i:02}" for i in range(x.shape[1])]
        df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names))
        got = relations.discover(df, names)
        want = all_triples(x)
        assert {r["target"] for r in got} <= {names[c] for _, _, c in want} and len(got) == min(3, len({c for _, _, c in want}))
        assert all((names.index(r["left"]), names.index(r["right"]), names.index(r["target"])) in want for r in got)
    assert relations.discover(df.limit(0), names) == []


PLANS = [
    [],
    [Action("strip_whitespace", ("a", "b")), Action("replace_null_like", ("a", "b")), Action("drop_duplicate_rows")],
    [Action("drop_duplicate_rows"), Action("normalize_case", ("a",), case_mode="upper"), Action("drop_empty_rows"), Action("drop_duplicate_rows_after_cleaning")],
    [Action("normalize_column_names"), Action("to_numeric", ("b", "x")), Action("set_negative_to_null", ("b",)), Action("drop_empty_columns"), Action("drop_duplicate_rows_after_cleaning")],
    [Action("replace_values", ("a",), replacements={"u": "v", " u ": None}), Action("to_datetime", ("d",)), Action("replace_null_like", ("x",), null_tokens=("1.5",)), Action("drop_duplicate_rows")],
    [Action("fill_missing_from_formula", ("z",), source_columns=("x", "y")), Action("drop_duplicate_rows"), Action("strip_whitespace", ("a",))],
    [Action("recalculate_from_columns", ("z",), source_columns=("x", "y")), Action("strip_whitespace", ("a",)), Action("drop_duplicates_by_columns", ("a",))],
]


@pytest.fixture(scope="module")
def messy(spark):
    rng = np.random.default_rng(2)
    pick = lambda *v: v[int(rng.integers(len(v)))]
    rows = []
    for i in range(220):
        cells = (pick("u", " u ", "V", "v", "N/A", None), pick("1", "-2", "$3", "x", None), pick("2024-01-05", "05/03/2024", "?", None), pick(1.5, 2.0, None), pick(2.0, 4.0, None), pick(3.0, 9.0, None), None)
        rows.append((i, *(cells if rng.random() > 0.1 else (None,) * 7)))
    return spark.createDataFrame(rows, "rid long, a string, b string, d string, x double, y double, z double, `e\n e` string").cache()


@pytest.mark.parametrize("plan", PLANS, ids=range(len(PLANS)))
def test_kept_up_values_equal_a_rescan(messy, plan):
    before = value_table(messy, [c for c in messy.columns if c != "rid"], "rid")
    after = clean(messy, plan, "rid", count=False).df
    want = value_table(after, [c for c in after.columns if c != "rid"], "rid").collect()
    got = value_table_after(before, messy, plan, "rid").collect()
    figures = lambda rows: sorted((r["name"], r["value"] or "", r["value"] is None, r["n"], r["first"] if r["value"] is not None else 0) for r in rows)
    assert figures(got) == figures(want)


@pytest.mark.parametrize("plan", PLANS, ids=range(len(PLANS)))
def test_paired_checks_equal_joined_ones(messy, plan):
    done = clean(messy, plan, "rid")
    want = validation.validate(messy, done.df, done.log(), "rid")
    got, log = validation.validate_cleaning(messy, plan, "rid")
    assert got == want and [(e.operation, e.affected, e.rows_before, e.rows_after) for e in log] == [(e.operation, e.affected, e.rows_before, e.rows_after) for e in done.log()]


def test_row_local_plans_move_no_rows(messy):
    _, pairs = validation.cleaned_pairs(messy, PLANS[1][:2], "rid", count=False)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
