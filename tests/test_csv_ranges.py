"""CSV files cut into many ranges against one reader of the whole text."""

import csv
import io
import random

import pytest

from clearbrook.sources import ranges, sinks
from clearbrook.sources.tabular import read_csv


def whole(data: bytes, sep: str, encoding: str) -> list[list[str]]:
    rows = csv.reader(io.StringIO(data.decode(encoding), newline="\n"), delimiter=sep)
    return [r for r in rows if r and not (len(r) == 1 and not r[0].strip())]


def random_csv(rng: random.Random, rows: int) -> bytes:
    """Fields with breaks, separators and quotes, stray quotes, blank lines, both kinds of line ends."""

    def field():
        text = "".join(rng.choices(["a", "bc", " ", ",", "\n", '"', "é", "\n\n", "x\r\n"], k=rng.randint(0, 9)))
        if rng.random() < 0.6:
            text += "" if text.strip() else "q"
            return '"' + text.replace('"', '""') + '"' + ("" if rng.random() < 0.9 else "tail")
        bare = text.replace(",", "").replace("\n", "").replace("\r", "").replace('"', "")
        return bare + ('"' if bare.strip() and rng.random() < 0.1 else "")

    end = rng.choice(["\n", "\r\n"])
    lines = [",".join(field() for _ in range(rng.randint(1, 4))) if rng.random() < 0.95 else "" for _ in range(rows)]
    return (end.join(lines) + (end if rng.random() < 0.5 else "")).encode()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_states_follow_the_csv_module():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(['"', ",", "a", " "], k=rng.randint(0, 12)))
        row = next(csv.reader(io.StringIO(text + "\nzz", newline="\n")), [])
        assert ranges.ends_inside(text.encode(), False, b",") == any("\nzz" in c for c in row), text
        row = next(csv.reader(io.StringIO('"' + text + "\nzz", newline="\n")))
        assert ranges.ends_inside(text.encode(), True, b",") == any("\nzz" in c for c in row), text


def test_many_ranges_equal_one_reader(spark, tmp_path, small_splits, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(ranges, "CHUNK", 3)
    inside = 0
    for k in range(8):
        data = random_csv(rng, 30) + (b'last,"open\nfield' if k % 4 == 0 else b"")
        path = tmp_path / f"{k}.csv"
        path.write_bytes(data)
        rows, encoding = ranges.records(spark, f"file://{path}", ",")
        found = ranges.entries(ranges.states(spark, f"file://{path}", ","))
        assert len(found) > 3
        inside += sum(i for i, _ in found.values())
        got = sorted((r["_rid"], r["cells"]) for r in rows.collect())
        assert got == list(enumerate(whole(data, ",", encoding))), k
    assert inside > 10  # ranges that begin inside of quotes


def test_a_field_longer_than_ranges(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, é" for i in range(300))
    path = tmp_path / "long.csv"
    path.write_bytes(f'id,text,n\n1,"{long}",2\n2,short,3\n'.encode("cp1252"))
    got = read_csv(spark, f"file://{path}")
    assert got.meta["encoding"] == "cp1252" and got.df.columns == ["_rid", "id", "text", "n"]
    assert [tuple(r) for r in got.df.orderBy("_rid").collect()] == [(1, 1, long, 2), (2, 2, "short", 3)]


def test_marks_alone_and_empty_files(spark, tmp_path):
    for name, data, want in (("mark", "﻿id;x\n1;a\n".encode(), [("1", "a")]), ("cr", b"id,x\n1,a\rb\n", [("1", "a\rb")])):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(data)
        got = read_csv(spark, f"file://{path}")
        assert got.df.columns == ["_rid", "id", "x"] and [(str(r["id"]), r["x"]) for r in got.df.collect()] == want
    (tmp_path / "none.csv").write_bytes(b"")
    assert read_csv(spark, f"file://{tmp_path}/none.csv").df.count() == 0


def test_written_and_read(spark, tmp_path, small_splits):
    rows = [(i, f'say "hi"\n{i};{i}' if i % 3 else None, i / 4) for i in range(120)]
    sinks.write_csv(spark.createDataFrame(rows, "k long, t string, x double").coalesce(1), f"file://{tmp_path}/out", french=True)
    part = next((tmp_path / "out").glob("part-*"))
    got = read_csv(spark, f"file://{part}").df.orderBy("_rid").collect()
    assert [(r["k"], r["t"], r["x"]) for r in got] == [(i, t, f"{x}".replace(".", ",")) for i, t, x in rows]
