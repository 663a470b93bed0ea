"""The little of the XLSX format that tables need: the first sheet in, one sheet out.

Rows are parsed, and made into XML and deflated, by many tasks; only the archive as such is read
and put together in one place, piece by piece.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path

#: Bytes of XML that a task parses at once, characters of shared texts that are sent to all tasks, rows of a deflated piece.
CHUNK, MOST_SHARED, ROWS = 1 << 20, 16 << 20, 10_000
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


# Number formats of the file format that show dates or times.
_DATES = frozenset((*range(14, 23), *range(45, 48)))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search("[dmyhs]", plain(f.get("formatCode") or ""), re.I)}
    used = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(used if used is not None else ()) if int(x.get("numFmtId") or 0) in _DATES | own}


def _date(serial: str, early: bool) -> str:
    """A day number of a workbook as text; ``early``: days count from 1904."""
    days = float(serial)
    if days < 0 or days > 2_958_465:
        return serial
    start = datetime(1904, 1, 1) if early else datetime(1899, 12, 30 if days >= 61 else 31)
    moment = start + timedelta(seconds=round(days * 86400))
    return moment.strftime("%Y-%m-%d" if moment.time() == time() else "%Y-%m-%d %H:%M:%S")


def _open(z: zipfile.ZipFile) -> tuple[list[str], str, bool, set[int]]:
    """Sheet names, the first sheet's part, whether days count from 1904, and the cell styles that show dates."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    sheets = book.findall(f"{_NS}sheets/{_NS}sheet")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    settings = book.find(f"{_NS}workbookPr")
    early = settings is not None and settings.get("date1904") in ("1", "true")
    return [s.get("name") for s in sheets], "xl/" + targets[sheets[0].get(_REL)].lstrip("/").removeprefix("xl/"), early, _date_styles(z)


def _strings(z: zipfile.ZipFile) -> Iterator[str]:
    """The workbook's shared texts, one after the other."""
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, si in ElementTree.iterparse(f):
                if si.tag == f"{_NS}si":
                    yield "".join(t.text or "" for t in si.iter(f"{_NS}t"))
                    si.clear()


def _row_chunks(z: zipfile.ZipFile, part: str, size: int) -> Iterator[bytes]:
    """The sheet's row elements as XML in chunks of about ``size`` bytes, each cut at a row's end and with the sheet's own root around it."""
    root, rest = b"", b""
    with z.open(part) as f:
        while data := f.read(size):
            rest += data
            if not root:
                at = re.search(rb"<(?:\w+:)?sheetData\s*/?>", rest)
                if not at:
                    continue
                root, rest = re.search(rb"<(?:\w+:)?worksheet\b[^>]*>", rest)[0], rest[at.end() :]
            end = max((m.end() for m in re.finditer(rb"</(?:\w+:)?row>|<(?:\w+:)?row\b[^>]*/>", rest)), default=0)
            if end:
                yield root + rest[:end] + _closing(root)
                rest = rest[end:]


def _closing(root: bytes) -> bytes:
    return b"</" + re.match(rb"<([\w:]+)", root)[1] + b">"


def _cells(row: ElementTree.Element, dated: set[int], early: bool) -> list[tuple[str | None, int | None]]:
    """Text of each cell, or the number of its shared text."""
    cells: list[tuple[str | None, int | None]] = []
    for c in row.findall(f"{_NS}c"):
        at = _column(c.get("r")) if c.get("r") else len(cells)
        cells += [(None, None)] * (at + 1 - len(cells))
        v, kind = c.findtext(f"{_NS}v"), c.get("t")
        if kind == "s" and v is not None:
            cells[at] = (None, int(v))
            continue
        if kind == "inlineStr":
            v = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
        elif kind == "b":
            v = {"1": "True", "0": "False"}.get(v, v)
        elif kind in (None, "n") and v and int(c.get("s") or 0) in dated:
            v = _date(v, early)
        cells[at] = (v, None)
    return cells


def sheet_rows(data: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Sheet names, and the rows of the first sheet as text: for workbooks that are known to be small."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, part, early, dated = _open(z)
        shared = list(_strings(z))
        rows = [_cells(row, dated, early) for chunk in _row_chunks(z, part, CHUNK) for row in ElementTree.fromstring(chunk)]
        return names, [[shared[i] if i is not None else v for v, i in r] for r in rows]


def workbook(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(_rid, cells) of the first sheet, and the sheets' names.

    One task unpacks the archive, a stream that can't be split, and stores its rows as chunks of XML
    and its shared texts as blocks; neither is held whole. The chunks are parsed by many tasks.
    Shared texts are sent to all tasks up to MOST_SHARED characters and joined beyond.
    """
    content = spark.read.format("binaryFile").load(path).select("content")
    chunk = CHUNK

    def unpack(batches):
        for batch in batches:
            for blob in batch.column(0):
                with zipfile.ZipFile(pa.BufferReader(blob.as_buffer())) as z:
                    names, part, early, dated = _open(z)
                    meta = json.dumps({"names": names, "early": early, "dated": sorted(dated)})
                    yield pa.RecordBatch.from_pylist([{"kind": "meta", "at": 0, "n": 0, "data": meta.encode()}], schema=unpacked)
                    first = 0
                    for data in _row_chunks(z, part, chunk):
                        n = len(re.findall(rb"<(?:\w+:)?row\b", data))
                        yield pa.RecordBatch.from_pylist([{"kind": "rows", "at": first, "n": n, "data": data}], schema=unpacked)
                        first += n
                    block: list[dict] = []
                    for i, text in enumerate(_strings(z)):
                        block.append({"kind": "text", "at": i, "n": len(text), "data": text.encode()})
                        if len(block) == 4096:
                            yield pa.RecordBatch.from_pylist(block, schema=unpacked)
                            block = []
                    if block:
                        yield pa.RecordBatch.from_pylist(block, schema=unpacked)

    unpacked = pa.schema([("kind", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    schema = "kind string, at long, n long, data binary"
    folder = shared_path(spark, "workbook")
    content.mapInArrow(unpack, schema).write.partitionBy("kind").parquet(folder)
    parts = spark.read.schema(schema).parquet(folder)
    meta = json.loads(bytes(parts.where("kind = 'meta'").first()["data"]))
    size = parts.where("kind = 'text'").agg(F.sum("n").alias("n")).first()["n"]
    texts = parts.where("kind = 'text'").select(F.col("at").alias("_text"), F.col("data").cast("string").alias("_shared"))
    few = size is not None and size <= MOST_SHARED
    shared = spark.sparkContext.broadcast([r["_shared"] for r in texts.orderBy("_text").collect()] if few else None)
    dated, early = set(meta["dated"]), meta["early"]
    kind = pa.list_(pa.struct([("v", pa.string()), ("i", pa.int64())]))

    def parse(batches):
        known = shared.value
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [_cells(row, dated, early) for row in ElementTree.fromstring(data)]
                if known is not None:
                    rows = [[(v if i is None else known[i], None) for v, i in r] for r in rows]
                cells = pa.array([[{"v": v, "i": i} for v, i in r] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(rows)), pa.int64()), cells], names=["_rid", "cells"])

    chunks = parts.where("kind = 'rows'").select("at", "data").repartition(max(1, spark.sparkContext.defaultParallelism), "at")
    rows = chunks.mapInArrow(parse, "_rid long, cells array<struct<v:string,i:long>>")
    if few or size is None:
        return rows.select("_rid", F.col("cells.v").alias("cells")), meta["names"]
    each = rows.select("_rid", F.posexplode_outer("cells").alias("p", "c")).join(texts, F.col("c.i") == F.col("_text"), "left")
    back = each.groupBy("_rid").agg(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", F.coalesce("_shared", "c.v").alias("v"))))).alias("c"))
    return back.select("_rid", F.col("c.v").alias("cells")), meta["names"]


def _cell(v) -> str:
    """Numbers stay numbers, all else is text."""
    if v is None:
        return "<c/>"
    if isinstance(v, int | float) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'


def deflated(xml: bytes) -> tuple[bytes, int, int]:
    """A piece of a deflate stream that others can follow, the CRC-32 and the size of what it holds."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(xml) + c.flush(zlib.Z_FULL_FLUSH), zlib.crc32(xml), len(xml)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two texts in a row, from theirs and the second's size: the first is shifted by so many bytes."""
    power, step, n = 0x80000000, 0x00800000, size  # x^0 and x^8
    while n:
        if n & 1:
            power = _times(power, step)
        step, n = _times(step, step), n >> 1
    return _times(power, first) ^ second


def row_pieces(df: DataFrame) -> DataFrame:
    """(piece, crc, size): df's rows, in its order, as deflated XML."""
    rows_at_once = ROWS

    def render(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i in range(0, batch.num_rows, rows_at_once):
                xml = "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in zip(*(c[i : i + rows_at_once] for c in columns)))
                piece, crc, size = deflated(xml.encode())
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary()), pa.array([crc], pa.int64()), pa.array([size], pa.int64())], names=["piece", "crc", "size"])

    return df.mapInArrow(render, "piece binary, crc long, size long")


def assemble(names: list[str], pieces: Iterator[tuple[bytes, int, int]], write: Callable[[bytes], object], sheet: str = "Cleaned Data") -> None:
    """A workbook with one sheet, written front to back; one piece is held at a time."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    small = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{doc}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{doc}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    at, directory = 0, b""

    def entry(name: str, parts: Iterator[tuple[bytes, int, int]]) -> None:
        nonlocal at, directory
        fixed = struct.pack("<HHHHH", 20, 8, 8, 0, 33)  # sizes follow the data; deflate; 1980-01-01
        begin, crc, packed, size = at, 0, 0, 0
        head = b"PK\3\4" + fixed + struct.pack("<IIIHH", 0, 0, 0, len(name), 0) + name.encode()
        write(head)
        for piece, own, n in parts:
            write(piece)
            crc, packed, size = joined_crc(crc, own, n), packed + len(piece), size + n
        write(b"\x03\x00" + b"PK\7\x08" + struct.pack("<III", crc, packed + 2, size))  # an empty last block
        at += len(head) + packed + 2 + 16
        directory += b"PK\1\2" + struct.pack("<H", 20) + fixed + struct.pack("<IIIHHHHHII", crc, packed + 2, size, len(name), 0, 0, 0, 0, 0, begin) + name.encode()

    def sheet_parts():
        yield deflated(f'<worksheet xmlns="{main}"><sheetData><row>{"".join(map(_cell, names))}</row>'.encode())
        yield from pieces
        yield deflated(b"</sheetData></worksheet>")

    for name, xml in small.items():
        entry(name, iter([deflated(xml.encode())]))
    entry("xl/worksheets/sheet1.xml", sheet_parts())
    write(directory + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(small) + 1, len(small) + 1, len(directory), at, 0))


def write_sheet(names: list[str], rows, sheet: str = "Cleaned Data") -> bytes:
    """A workbook of a few rows, in memory."""
    out = io.BytesIO()
    assemble(names, iter([deflated("".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in rows).encode())]), out.write, sheet)
    return out.getvalue()
