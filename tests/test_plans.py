import pytest

from clearbrook.operators.cleaning import clean
from clearbrook.operators.scan import age_policy, scan, typos
from clearbrook.plans import planner, validation
from clearbrook.plans.model import Action, PlanError, Requirement, finalise, merge_replacements, ordered, resolve_chains, reviewed, uncovered
from clearbrook.plans.requirements import requirements


def test_ages():
    assert age_policy("customer_age")[::2] == ("human", 120)
    assert age_policy("companyAge") == ("company", 0, None)
    assert age_policy("age")[0] == "unknown"
    assert age_policy("page_id") is None
    assert age_policy("ages")[0] == "unknown" and age_policy("child_age")[0] == "human" and age_policy("customer_company_age")[0] == "unknown"
    assert age_policy("years", "company") == ("company", 0, None) and age_policy("âgeClient")[0] == "human"
    with pytest.raises(ValueError):
        age_policy("age", "robot")


def test_rewrites():
    a = Action("replace_values", ("c",), replacements={"a": "b"}, confidence="high")
    b = Action("replace_values", ("c",), replacements={"b": "c", "x": "x"}, confidence="low")
    merged = merge_replacements([a, b])
    assert len(merged) == 1 and merged[0].confidence == "low"
    assert resolve_chains(merged)[0].replacements["a"] == "c"
    loop = resolve_chains([Action("replace_values", ("c",), replacements={"a": "b", "b": "a"})])[0]
    assert loop.replacements == {"a": "b", "b": "a"}
    assert resolve_chains([Action("replace_values", ("c",), replacements={"a": "a"})]) == []
    assert [x.operation for x in ordered([Action("to_numeric", ("c",)), Action("strip_whitespace", ("c",))])] == ["strip_whitespace", "to_numeric"]


def test_coverage():
    need = Requirement("R001", "c", "null_like", ("replace_null_like",), False, ("N/A", "unk"))
    assert uncovered([Action("replace_null_like", ("c",), null_tokens=("n/a",))], [need])
    assert not uncovered([Action("replace_null_like", ("c",), null_tokens=("n/a", "UNK"))], [need])
    assert finalise([], [], [need])[0].operation == "no_change"


def test_reviewer_is_held_to_replacements():
    got = reviewed([{"operation": "drop_duplicate_rows"}, {"operation": "replace_values", "column": "c", "replacements": {"a": "b", "x": " ", "y": "n/a"}, "confidence": "sure"}], lambda v: v.lower() == "n/a")
    assert len(got) == 1 and got[0].replacements == {"a": "b"} and got[0].confidence == "medium" and got[0].requires_review


def test_errors(spark):
    df = spark.createDataFrame([("a",)], "x string")
    for plan in ([{"operation": "explode"}], [{"operation": "strip_whitespace", "column": "y"}], [{"operation": "replace_values", "column": "x"}], [{"operation": "normalize_case", "column": "x", "case_mode": "odd"}], "plan"):
        with pytest.raises(PlanError):
            clean(df, plan)


def test_typos_need_frequency_and_equal_digits():
    assert typos([("MEDIUM", 30), ("MEDIU", 2)]) == {"MEDIU": "MEDIUM"}
    assert typos([("SIZE 10", 30), ("SIZE 11", 2)]) == {}
    assert typos([("a-b", 9), ("?", 3)]) == {} and typos([]) == {}
    # the commonest of several that are close; forms of one key count together
    assert typos([("Marseille", 40), ("Marseilles", 30), ("marseille", 5), ("Marseile", 1), ("marseile", 1)]) == {"Marseile": "Marseille"}


def test_a_typo_is_repaired_in_all_its_forms():
    values = {"Marseille": 40, "Marseile": 2, "MARSEILE": 1}
    c = {"values": values, "typos": {"Marseile": "Marseille"}, "variants": [{"key": "marseile", "form": f, "n": values[f], "dominant": "Marseile"} for f in ("Marseile", "MARSEILE")]}
    actions, left = planner._category_actions("city", c)
    assert actions[-1].replacements == {"Marseile": "Marseille", "MARSEILE": "Marseille"} and left == []


def test_alias_and_log(spark):
    df = spark.createDataFrame([(0, " A ", "8,4"), (1, "B", None), (1, "B", None)], "rid long, `Na\nme` string, `Population\n(M)` string")
    done = clean(df, {"actions": [{"operation": "normalize_column_names"}, {"operation": "to_numeric", "column": "Population\n(M)", "decimal_comma": True}, {"operation": "strip_whitespace", "columns": ["Na\nme"]}, {"operation": "drop_duplicate_rows"}]}, "rid")
    rows = {tuple(r) for r in done.df.collect()}
    assert rows == {(0, "A", 8.4), (1, "B", None)}
    log = done.log()
    assert [(e.operation, e.affected) for e in log] == [("normalize_column_names", 2), ("to_numeric", 1), ("strip_whitespace", 1), ("drop_duplicate_rows", 1)]
    assert (log[-1].rows_before, log[-1].rows_after) == (3, 2)


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(i, f" v{i % 3} ", "x" if i % 2 else None) for i in range(12)], "rid long, a string, b string")
    plan = [Action("strip_whitespace", ("a", "b")), Action("normalize_case", ("a",), case_mode="title"), Action("drop_duplicate_rows"), Action("drop_empty_rows")]
    once = clean(df, plan, "rid").df
    assert sorted(map(tuple, clean(once, plan, "rid").df.collect())) == sorted(map(tuple, once.collect()))
    assert once.count() == 6


def test_empty_table(spark):
    df = spark.createDataFrame([], "rid long, a string, b double")
    assert clean(df, [Action("drop_duplicate_rows"), Action("drop_empty_rows"), Action("to_numeric", ("a",))], "rid").df.count() == 0
    assert scan(df, "rid").rows == 0


def test_rare_formats_and_text_numbers(spark):
    rows = [(i, f"AB{i:03d}" if i else "7-x", f"AB{i:03d}" if i > 3 else f"{i}-x", "n.d.y" if i == 5 else str(i)) for i in range(100)]
    found = scan(spark.createDataFrame(rows, "rid long, a_id string, b_id string, amount string"), "rid")
    assert "format_patterns" not in found.columns["a_id"]  # 1 of 100
    assert [(p["mask"], p["n"]) for p in found.columns["b_id"]["format_patterns"]] == [("A999", 96), ("9-A", 4)]
    needs = {(n.column, n.issue) for n in requirements(found)}
    assert ("b_id", "identifier_formats") in needs and ("a_id", "identifier_formats") not in needs
    assert {("amount", "unparseable"), ("amount", "text_numbers")} <= needs


def test_scan_plan_validate(spark):
    rows = [(i, f"user{i}@mail.org" if i % 10 else f"USER{i}mail.org", ["Red", "red", "Blue", "Blu-e", "N/A"][i % 5], f"{i},5" if i % 2 else f"${i}.25") for i in range(200)]
    df = spark.createDataFrame([*rows, (200, *rows[3][1:])], "rid long, email string, colour string, price string")
    found = planner.plan(df, "rid")
    assert {f: found.findings.columns[f]["kind"] for f in ("email", "colour", "price")} == {"email": "email", "colour": "categorical", "price": "numeric"}
    assert found.findings.full_duplicates == {"involved": 2, "removable": 1}
    operations = {a.operation for a in found.actions}
    assert {"drop_duplicate_rows", "replace_null_like", "replace_values", "to_numeric", "normalize_case"} <= operations
    done = clean(df, [a for a in found.actions if not a.requires_review and a.operation != "no_change"], "rid")
    report = validation.validate(df, done.df, done.log(), "rid")
    assert report.status in ("ok", "warning")
    assert dict(done.df.dtypes)["price"] == "double"


def test_ages_beyond_the_limit_of_a_plan(spark, monkeypatch):
    from clearbrook.operators import scan as scanning
    from clearbrook.plans import requirements as needs

    df = spark.createDataFrame([(i, str(200 + i) if i < 20 else str(i)) for i in range(60)], "rid long, customer_age string")
    for module in (scanning, planner, needs):
        monkeypatch.setattr(module, "MOST_AGES", 5)
    found = planner.plan(df, "rid")
    assert found.findings.columns["customer_age"]["implausible"] == 20 and len(found.findings.columns["customer_age"]["implausible_ages"]) == 5
    assert not [a for a in found.actions if a.operation == "no_change"]
    done = clean(df, [a for a in found.actions if a.replacements_path], "rid").df
    assert done.where("customer_age is null").count() == 20 and done.count() == 60


def test_repairs_beyond_the_limit_of_a_plan(spark, monkeypatch):
    """Dates of a day-first notation and e-mails are all repaired, however many a plan may list."""
    days = [(d, m, y) for y in (2021, 2022) for m in range(1, 13) for d in (3, 5, 25)]
    rows = [(i, f"{d:02}/{m:02}/{y}", f"user{i}mail.org" if i % 7 == 0 else f"user{i}@mail.org") for i, (d, m, y) in enumerate(days)]
    df = spark.createDataFrame([*rows, (900, None, None)], "rid long, start_date string, email string")
    for most in (10_000, 4):
        monkeypatch.setattr(planner, "MOST_PAIRS", most)
        found = planner.plan(df, "rid")
        repair = [a for a in found.actions if a.operation == "replace_values"]
        assert {a.columns: bool(a.replacements_path) for a in repair} == {("start_date",): most == 4, ("email",): most == 4}
        done = clean(df, [a for a in found.actions if a.operation in ("replace_values", "to_datetime")], "rid")
        got = {r["rid"]: (r["start_date"], r["email"]) for r in done.df.collect()}
        assert {i: (t.day, t.month, t.year) for i, (t, _) in got.items() if t} == dict(enumerate(days)) and got[900] == (None, None)
        assert all(e == f"user{i}@mail.org" for i, (_, e) in got.items() if e)
        assert [e.affected for e in done.log() if e.operation == "replace_values"] == [sum(i % 7 == 0 for i in range(len(days))), len(days)][:: 1 if repair[0].columns == ("email",) else -1]


def test_the_pairs_query_gives_stored_repairs_too(spark, monkeypatch):
    """What a plan stores because it is too long to list is part of the query's result."""
    from __spark_entry__ import queries

    run = lambda: sorted(map(tuple, queries()["plan_pairs_customer"](spark, "/root/testdata/sf0.001").collect()))
    want = run()
    monkeypatch.setattr(planner, "MOST_PAIRS", 1)
    assert run() == want and sum(r[0] == "cust_id" for r in want) > 1


def test_a_scan_works_out_its_values_once(spark, monkeypatch):
    """The lists come from stored tables of values, not from the rows again."""
    from clearbrook.operators import scan as scanning

    seen, own = [], scanning.listed
    monkeypatch.setattr(scanning, "listed", lambda values, stripped, *rest: seen.extend((values, stripped)) or own(values, stripped, *rest))
    scan(spark.createDataFrame([(i, f" {i % 9} ") for i in range(40)], "rid long, a string"), "rid")
    assert len(seen) == 2 and all(frame.inputFiles() for frame in seen)
