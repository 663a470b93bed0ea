"""One CSV file read by many tasks, quoted line breaks included.

A byte range can't tell whether it begins inside a quoted field. So each range is read twice.
First it is gone through for both possible entries, outside and inside of quotes: either way it
says how it ends and how many records begin in it. A range's true entry follows from those before
it, so composing these answers in file order, a row a range, gives every range its entry and the
number of its first record. Then the ranges are parsed independently. A record that runs over the
end of its range is cut there; its pieces, known by the record's number, are put together by a
grouping, which only sees such records.

Spark's text reader gives lines whole, so states are kept line by line, by the rules of Python's
csv module: a quote opens a field only at its begin, two quotes in it are one, and what follows
the closing quote is taken as it is. Blank lines outside of quotes are no records.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path

#: Lines that are parsed at once.
CHUNK = 5000
_LONE = re.compile("\r(?!\n|\\Z)")


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a line that begins inside (or outside) of quotes ends inside."""
    if b'"' not in line:
        return inside
    i = 0
    while True:
        if not inside:
            if line[i : i + 1] != b'"':  # an unquoted field: to its end
                i = line.find(sep, i) + 1
                if not i or line.find(b'"', i) < 0:
                    return False
                continue
            i += 1
        i = line.find(b'"', i)
        while i >= 0 and line[i + 1 : i + 2] == b'"':
            i = line.find(b'"', i + 2)
        if i < 0:
            return True
        i = line.find(sep, i + 1) + 1  # after the closing quote all is literal up to the next separator
        inside = False
        if not i:
            return False


def parse(text: str, sep: str) -> list[list[str]]:
    """The records of a text without blank lines between them; a carriage return alone is part of its field."""
    csv.field_size_limit(sys.maxsize)
    try:
        return list(csv.reader(io.StringIO(text, newline="\n"), delimiter=sep))
    except csv.Error:
        rows = csv.reader(io.StringIO(_LONE.sub("\ue00d", text), newline="\n"), delimiter=sep)
        return [[c.replace("\ue00d", "\r") for c in r] for r in rows]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(start, value): each line as bytes, with the begin of the range that it was read from."""
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(start, lines) of successive batches; a range's batches follow each other."""
    for batch in batches:
        starts = batch.column(0).to_pylist()
        lines = batch.column(1).to_pylist()
        i = 0
        while i < len(lines):
            j = i
            while j < len(lines) and starts[j] == starts[i]:
                j += 1
            yield starts[i], lines[i:j]
            i = j


def head(spark: SparkSession, path: str, most: int, rows: int = 2000) -> bytes:
    """The first lines of a file, ``most`` bytes at the most."""
    found = spark.read.text(path, lineSep="\n").select(F.substring(F.col("value").cast("binary"), 1, most).alias("value")).take(rows)
    return b"\n".join(bytes(r["value"]) for r in found)[:most]


def states(spark: SparkSession, path: str, sep: str) -> list[dict]:
    """A row per range, in file order: for either entry its exit and the records that begin, and which encodings fit its bytes."""
    delimiter = sep.encode()

    def scan(batches):
        now: dict | None = None
        for start, lines in _by_range(batches):
            if now is None or now["start"] != start:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now], schema=schema)
                now = {"start": start, "out_end": False, "out_n": 0, "in_end": True, "in_n": 0, "utf8": True, "cp1252": True}
            for line in lines:
                full = bool(line.strip())
                now["out_n"] += full and not now["out_end"]
                now["in_n"] += full and not now["in_end"]
                if b'"' in line:
                    now["out_end"], now["in_end"] = ends_inside(line, now["out_end"], delimiter), ends_inside(line, now["in_end"], delimiter)
                if not line.isascii():
                    for key, name in (("utf8", "utf-8"), ("cp1252", "cp1252")):
                        if now[key]:
                            try:
                                line.decode(name)
                            except UnicodeDecodeError:
                                now[key] = False
        if now is not None:
            yield pa.RecordBatch.from_pylist([now], schema=schema)

    schema = pa.schema([("start", pa.int64()), ("out_end", pa.bool_()), ("out_n", pa.int64()), ("in_end", pa.bool_()), ("in_n", pa.int64()), ("utf8", pa.bool_()), ("cp1252", pa.bool_())])
    rows = _lines(spark, path).mapInArrow(scan, "start long, out_end boolean, out_n long, in_end boolean, in_n long, utf8 boolean, cp1252 boolean")
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["start"])  # a row a range


def entries(found: list[dict]) -> dict[int, tuple[bool, int]]:
    """Of each range, by its begin: whether it begins inside of quotes, and the number of the first record that begins in it."""
    inside, n, out = False, 0, {}
    for r in found:
        out[r["start"]] = (inside, n)
        n += r["in_n"] if inside else r["out_n"]
        inside = r["in_end"] if inside else r["out_end"]
    return out


class Range:
    """One range's lines, dealt out as whole records and as pieces of records that other ranges have a part of."""

    def __init__(self, start: int, inside: bool, rid: int, sep: bytes):
        self.start, self.inside, self.rid, self.sep = start, inside, rid, sep  # rid: the next record's number
        self.before = inside  # the first record began in another range
        self.open: list[bytes] = []
        self.done: list[list[bytes]] = []
        self.pieces: list[tuple[int, int, bytes]] = []

    def add(self, line: bytes) -> None:
        if not self.inside:
            if not line.strip():
                return
            self.rid += 1
            if b'"' not in line:
                self.done.append([line])
                return
        self.open.append(line)
        self.inside = ends_inside(line, self.inside, self.sep)
        if not self.inside:
            if self.before:
                self.cut()
            else:
                self.done.append(self.open)
            self.open, self.before = [], False

    def cut(self) -> None:
        if self.open:
            self.pieces.append((self.rid - 1, self.start, b"\n".join(self.open)))

    def taken(self) -> tuple[int, bytes]:
        """The number of the first whole record not taken yet, and the text of all of them."""
        first = self.rid - len(self.done) - bool(self.open and not self.before)
        text = b"\n".join(line for record in self.done for line in record)
        self.done = []
        return first, text


class RangesChanged(RuntimeError):
    """Spark split the file otherwise than when its ranges were gone through."""


def records(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, str]:
    """(_rid, cells), the file's records numbered from 0 in file order, and the file's encoding.

    The records are stored once in the shared folder: Spark may split a file otherwise as executors
    come and go, so they aren't parsed again later. The file is gone through anew if that happens in between.
    """
    for attempt in range(3):
        found = states(spark, path, sep)
        first = bytes((spark.read.text(path, lineSep="\n").select(F.substring(F.col("value").cast("binary"), 1, 3).alias("value")).first() or [b""])[0])
        encoding = "utf-8-sig" if all(r["utf8"] for r in found) else "cp1252" if all(r["cp1252"] for r in found) else "latin1"
        try:
            return _stored(spark, path, sep, encoding, entries(found), first == b"\xef\xbb\xbf"), encoding
        except Exception as e:
            if "RangesChanged" not in str(e) or attempt == 2:
                raise
    raise AssertionError


def _stored(spark: SparkSession, path: str, sep: str, encoding: str, entry: dict[int, tuple[bool, int]], mark: bool) -> DataFrame:
    delimiter, known = sep.encode(), spark.sparkContext.broadcast(entry)  # a few bytes a range
    name = "utf-8" if encoding == "utf-8-sig" else encoding
    kinds = pa.schema([("_rid", pa.int64()), ("cells", pa.list_(pa.string())), ("start", pa.int64()), ("piece", pa.binary())])

    def text_of(data: bytes, rid: int) -> str:
        return data.removeprefix(b"\xef\xbb\xbf" if mark and not rid else b"").decode(name)

    def rows(at: Range):
        first, data = at.taken()
        cells = parse(text_of(data, first), sep)
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(cells)), pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.nulls(len(cells), pa.int64()), pa.nulls(len(cells), pa.binary())], schema=kinds)

    def ended(at: Range):
        if at.done:
            yield rows(at)
        at.cut()
        if at.pieces:
            yield pa.RecordBatch.from_pylist([{"_rid": rid, "cells": None, "start": start, "piece": piece} for rid, start, piece in at.pieces], schema=kinds)

    def split(batches):
        now: Range | None = None
        for start, lines in _by_range(batches):
            if now is None or now.start != start:
                if now is not None:
                    yield from ended(now)
                if start not in known.value:
                    raise RangesChanged(f"no range begins at {start}")
                now = Range(start, *known.value[start], delimiter)
            for line in lines:
                now.add(line)
                if len(now.done) >= CHUNK:
                    yield rows(now)
        if now is not None:
            yield from ended(now)

    folder = shared_path(spark, "csv-records")
    schema = "_rid long, cells array<string>, start long, piece binary"
    _lines(spark, path).mapInArrow(split, schema).write.parquet(folder)
    stored = spark.read.schema(schema).parquet(folder)
    pieces = stored.where("piece is not null").groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("p")).select("_rid", F.col("p.piece").alias("pieces"))

    def joined(batches):
        for batch in batches:
            cells = [parse(text_of(b"\n".join(p), r), sep) for r, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] if c else [] for c in cells], pa.list_(pa.string()))], names=["_rid", "cells"])

    return stored.where("piece is null").select("_rid", "cells").union(pieces.mapInArrow(joined, "_rid long, cells array<string>"))
