"""Cells are counted by tasks whose share doesn't grow with the table, also if the rows come in one piece."""

from pyspark.sql import functions as F

from clearbrook.operators import profile, values

COLUMNS = ["own", "few", "text", "x", "yes"]


def one_piece(spark):
    texts = [" " * 80 + "n/a", "word " * 20, "1" * 80, "long" * 20, None]
    rows = [(i, f"user {i}", ["a", " a", "7,5", "N/A", None][i % 5], texts[i // 5 % 5], float("nan") if i % 4 == 0 else i / 4, i % 2 == 0) for i in range(200)]
    return spark.createDataFrame(rows, "rid long, own string, few string, text string, x double, yes boolean").coalesce(1)


def test_a_task_takes_a_share_of_the_cells(spark, monkeypatch):
    df = one_piece(spark)
    most = lambda: values.melt(df, COLUMNS, "rid").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    table = lambda: sorted(map(str, values.value_table(df, COLUMNS, "rid").collect()))
    want = table()
    assert most() == 1000
    monkeypatch.setattr(values, "CELLS", 100, raising=False)
    assert most() <= 200 and table() == want


def test_a_profile_is_counted_in_shares(spark, monkeypatch):
    df = one_piece(spark)
    run = lambda: {r["name"]: tuple(r)[1:] for r in profile.column_profile(df, COLUMNS, "rid").collect()}
    want = {
        "own": (200, 0, 0.0, 200, 0, 0, 1.0),
        "few": (200, 40, 20.0, 4, 40, 40, 0.25),
        "text": (200, 40, 20.0, 4, 80, 40, 0.25),
        "x": (200, 0, 0.0, 151, 0, 0, 1.0),
        "yes": (200, 0, 0.0, 2, 0, 0, 1.0),
    }
    assert run() == want
    monkeypatch.setattr(values, "CELLS", 100, raising=False)
    assert run() == want
    plan = profile.column_profile(df, COLUMNS, "rid")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_a_column_may_be_the_row_id(spark, monkeypatch):
    monkeypatch.setattr(values, "CELLS", 50, raising=False)
    df = one_piece(spark)
    assert [tuple(r)[:5] for r in profile.column_profile(df, ["rid"], "rid").collect()] == [("rid", 200, 0, 0.0, 200)]
    assert values.value_table(df, ["rid"], "rid").count() == 200
