"""A stream in batches gives the state of one scan; what is delivered again changes nothing."""

from clearbrook.operators.scan import column_facts, listed
from clearbrook.operators.values import forms, value_table
from clearbrook.streaming.profile import StreamValues

COLUMNS = ["a", "b"]


def rows(lo, hi):
    return [(i, [" x", "X", "n/a", None][i % 4], f"{i % 7},5" if i % 5 else "$3") for i in range(lo, hi)]


def table(df):
    return sorted((r["name"], r["value"] or "", r["n"], r["first"]) for r in df.collect())


def test_three_batches_equal_one_scan(spark, tmp_path):
    schema = "rid long, a string, b string"
    for k, (lo, hi) in enumerate(((0, 40), (40, 41), (41, 130))):
        spark.createDataFrame(rows(lo, hi), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    state = StreamValues(spark, f"file://{tmp_path}/state", COLUMNS, "rid")
    assert state.values().count() == 0
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = state.start(stream, f"file://{tmp_path}/checkpoint")
    run.processAllAvailable()
    run.stop()
    whole = spark.createDataFrame(rows(0, 130), schema)
    want = table(value_table(whole, COLUMNS, "rid"))
    assert table(state.values()) == want and state.versions() == [1, 2]  # older ones are gone
    facts = lambda df: sorted(map(tuple, df.collect()))
    assert facts(state.facts()) == facts(column_facts(whole, COLUMNS, "rid"))
    values = value_table(whole, COLUMNS, "rid")
    assert facts(state.lists("null_tokens", "format_patterns")) == facts(listed(values, forms(values), ("null_tokens", "format_patterns")))


def test_replays_and_torn_versions(spark, tmp_path):
    schema = "rid long, a string, b string"
    batches = [spark.createDataFrame(rows(lo, lo + 20), schema) for lo in (0, 20, 40)]
    state = StreamValues(spark, f"file://{tmp_path}/state", COLUMNS, "rid")
    for k, b in enumerate(batches):
        state.update(b, k)
    want = table(state.values())
    state.update(batches[2], 2)  # delivered again
    assert table(state.values()) == want
    (tmp_path / "state" / f"batch={2:019d}" / "_SUCCESS").unlink()  # the write broke off
    assert state.versions() == [1]
    state.update(batches[2], 2)
    assert table(state.values()) == want == table(value_table(batches[0].union(batches[1]).union(batches[2]), COLUMNS, "rid"))
