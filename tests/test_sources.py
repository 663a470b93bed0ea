import pytest

from clearbrook.operators.inspect import run_tool
from clearbrook.operators.cleaning import clean
from clearbrook.plans.model import Action, PlanError
from clearbrook.sources import sinks, tabular, xlsx
from clearbrook.sources.tabular import detect_encoding, detect_header_row, detect_separator, read_table
from clearbrook.streaming.cleaning import clean_stream


def test_csv_with_title_row(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text('Report,,,,\nObservation,Country,"Population\n(M)",Price,Name\n1,France,"8,4",$389.54, A \n2,Spain,"9,1",793 USD,B\n')
    got = read_table(spark, f"file://{path}")
    assert got.meta["header_row"] == 1 and got.meta["header_issues"] == ["Population\n(M)"] and got.raw.count() > 0
    plan = [{"operation": "normalize_column_names"}, {"operation": "to_numeric", "columns": ["Price", "Population\n(M)"], "decimal_comma": True}, {"operation": "strip_whitespace", "column": "Name"}]
    rows = clean(got.df, plan, "_rid").df.orderBy("_rid").collect()
    assert [r["Price"] for r in rows] == [389.54, 793.0] and rows[0]["Population (M)"] == 8.4 and rows[0]["Name"] == "A"
    assert dict(got.df.dtypes)["Observation"] == "bigint"


def test_xlsx_round_trip(spark, tmp_path):
    path = tmp_path / "sample.xlsx"
    path.write_bytes(xlsx.write_sheet(["Title"], [("ID", "Country", "Value"), (1, "France", 2.5), (2, "Spain", 3.5)]))
    got = read_table(spark, f"file://{path}")
    assert got.meta["header_row"] == 1 and got.df.columns == ["_rid", "ID", "Country", "Value"]
    assert [tuple(r)[1:] for r in got.df.orderBy("_rid").collect()] == [(1, "France", 2.5), (2, "Spain", 3.5)]
    names, rows = xlsx.sheet_rows(sinks.xlsx_bytes(got.df, "_rid"))
    assert names == ["Cleaned Data"] and rows[0] == ["ID", "Country", "Value"] and rows[2][1] == "Spain"
    with pytest.raises(ValueError):
        read_table(spark, "file:///x.xls")


def test_detection():
    assert detect_encoding("é".encode()) == "utf-8-sig" and detect_encoding("é".encode("cp1252")) == "cp1252" and detect_encoding(b"\x81\xff") == "latin1"
    assert detect_separator("a;b;c\n1;2;3\n") == ";" and detect_separator("a\tb\n1\t2\n") == "\t" and detect_separator("abc") == ","
    assert detect_header_row([["Report", None, None], ["id", "name", "price"], ["1", "x", "2"]]) == 1
    # hints are words, each counts; amounts with a currency aren't numbers, spaced ones are
    assert detect_header_row([["paid amid", "renamed"], ["customer name", "sales date"]]) == 1
    assert detect_header_row([["1 200", "3,5"], ["$5", "a1"]]) == 1 and detect_header_row([]) == 0


def test_excel_dates(spark, tmp_path):
    import io
    import zipfile

    plain = xlsx.write_sheet(["id", "date", "amount"], [(1, 45296.0, 45296.0), (2, 45296.5, 1.5), (3, 59.0, 2.5)])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            data = a.read(name).decode()
            if name.endswith("sheet1.xml"):
                for v in ("45296.0", "45296.5", "59.0"):
                    data = data.replace(f"<c><v>{v}</v></c>", f'<c s="1"><v>{v}</v></c>', 1)
            b.writestr(name, data)
        b.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
    path = tmp_path / "dates.xlsx"
    path.write_bytes(out.getvalue())
    got = read_table(spark, f"file://{path}").df.orderBy("_rid").collect()
    assert [(r["date"], r["amount"]) for r in got] == [("2024-01-05", 45296.0), ("2024-01-05 12:00:00", 1.5), ("1900-02-28", 2.5)]


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1.5), (1, None, None)], "rid long, x string, y double")
    sinks.write_csv(df, f"file://{tmp_path}/out", "rid", french=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert "﻿x;y" in text and "a;1,5" in text
    assert [tuple(r) for r in sinks.display(df.drop("rid")).collect()] == [("a", "1,5"), ("", "")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(" a ", "$5"), ("b", "n/a")], "x string, y string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x string, y string").parquet(f"{tmp_path}/in")
    out = clean_stream(stream, [Action("strip_whitespace", ("x",)), Action("to_numeric", ("y",))])
    run = out.writeStream.format("memory").queryName("cleaned").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("cleaned").collect())) == [("a", 5.0), ("b", None)]
    with pytest.raises(PlanError):
        clean_stream(stream, [Action("drop_empty_columns")])


def test_tools(spark):
    df = spark.createDataFrame([(i, ["yes", "Yes", "no"][i % 3], f"{i},5", "05/06/2024") for i in range(30)], "rid long, a string, n string, d string")
    assert run_tool("detect_numeric_issues", df, "rid", column="n")["suggest_decimal_comma"]
    assert run_tool("detect_text_anomalies", df, "rid", columns=["a"])["a"]["case_variants"] == [["Yes", "yes"]]
    assert run_tool("inspect_column", df, "rid", column="a")["unique"] == 3
    twice = run_tool("find_duplicates", df, "rid", columns=["a"])
    assert twice["conflict_groups"] == 3 and twice["conflicts"][0] == {"key": ["Yes"], "rows": 10, "differing_columns": ["n"]}
    assert run_tool("detect_numeric_issues", df, "rid", column="a")["invalid_examples"] == ["yes", "Yes", "no"]
    with pytest.raises(PlanError):
        run_tool("detect_text_anomalies", df, "rid", columns=["nowhere"])
    assert not run_tool("detect_date_issues", df, "rid", column="d")["recommend_dayfirst"]
    assert run_tool("verify_external_reference", df, "rid", column="a", values=["yes", "x"])["present"] == ["yes"]
    with pytest.raises(PlanError):
        run_tool("nothing", df, "rid")


def test_csv_is_judged_beyond_its_head(spark, tmp_path):
    """The first accent, and the widest row with a quoted line break, come after the first megabyte."""
    rows = "".join(f"{i},plain text without any accent at all\n" for i in range(30_000))
    path = tmp_path / "late.csv"
    path.write_bytes(("id,name\n" + rows + 'x,café,"more\nlines",é\ny\n').encode("cp1252"))
    assert path.stat().st_size > tabular.HEAD + 100_000
    loaded = tabular.read_csv(spark, f"file://{path}")
    assert loaded.meta["encoding"] == "cp1252" and loaded.raw.columns == ["_rid", *(f"column_{i}" for i in range(1, 5))]
    last = loaded.df.where("id in ('x', 'y')").orderBy("_rid").collect()
    assert [tuple(r)[1:] for r in last] == [("x", "café", "more\nlines", "é"), ("y", None, None, None)] and loaded.df.count() == 30_002
