"""Workbooks: pieces made by tasks, chunks parsed by tasks."""

import io
import random
import zipfile
import zlib

import pytest

from clearbrook.sources import sinks, tabular, xlsx


def test_crc_of_pieces():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.randbytes(rng.randint(0, 300)) for _ in range(2))
        assert xlsx.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_workbook_of_many_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx, "ROWS", 300)
    monkeypatch.setattr(xlsx, "CHUNK", 5000)
    rows = [(i, f"näme <{i}> & co" if i % 7 else None, i / 3, i % 2 == 0) for i in range(2500)]
    df = spark.createDataFrame(rows, "k long, t string, x double, b boolean").repartition(5)
    assert xlsx.row_pieces(df).count() > 5
    sinks.write_xlsx(df.withColumn("rid", df.k), f"file://{tmp_path}/out.xlsx", "rid")
    data = (tmp_path / "out.xlsx").read_bytes()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and len(z.namelist()) == 5
    names, got = xlsx.sheet_rows(data)
    assert names == ["Cleaned Data"] and got[0] == ["k", "t", "x", "b"]
    assert [r[:3] for r in got[1:]] == [[str(i), t, repr(x)] for i, t, x, _ in rows] and got[1][3] == "True"
    loaded = tabular.read_xlsx(spark, f"file://{tmp_path}/out.xlsx")
    assert [tuple(r)[1:] for r in loaded.df.orderBy("_rid").collect()] == rows
    assert sinks.xlsx_bytes(df.limit(0))[:2] == b"PK"


def shared(rows, prefix=""):
    """A workbook with shared texts, rich runs, gaps, references and, if asked for, a prefix on every element."""
    texts = sorted({c for r in rows for c in r if isinstance(c, str)})
    p = prefix + ":" if prefix else ""
    letter = "ABCDEFGH"
    cell = lambda c, i, k: "" if c is None else f'<{p}c r="{letter[k]}{i + 1}" t="s"><{p}v>{texts.index(c)}</{p}v></{p}c>' if isinstance(c, str) else f'<{p}c r="{letter[k]}{i + 1}"><{p}v>{c}</{p}v></{p}c>'
    body = "".join(f'<{p}row r="{i + 1}">' + "".join(cell(c, i, k) for k, c in enumerate(r)) + f"</{p}row>" if any(c is not None for c in r) else f'<{p}row r="{i + 1}"/>' for i, r in enumerate(rows))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx.write_sheet([], []))) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as b:
        for name in a.namelist():
            if not name.endswith("sheet1.xml"):
                b.writestr(name, a.read(name))
        b.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><{p}worksheet xmlns{":" + prefix if prefix else ""}="{main}"><{p}dimension ref="A1"/><{p}sheetData>{body}</{p}sheetData></{p}worksheet>')
        b.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in texts) + "</sst>")
    return out.getvalue()


@pytest.mark.parametrize("most", [0, 1 << 20])
@pytest.mark.parametrize("prefix", ["", "x"])
def test_shared_texts(spark, tmp_path, monkeypatch, most, prefix):
    monkeypatch.setattr(xlsx, "CHUNK", 400)
    monkeypatch.setattr(xlsx, "MOST_SHARED", most)  # 0: they are joined
    rows = [["id", "name", None, "city"], *([i, f"name{i % 5}", None, "Paris" if i % 3 else None] for i in range(60)), [None] * 4, [61, "last", None, "Rome"]]
    (tmp_path / "s.xlsx").write_bytes(shared(rows, prefix))
    got = tabular.read_xlsx(spark, f"file://{tmp_path}/s.xlsx")
    assert got.df.columns == ["_rid", "id", "name", "city"]
    assert [tuple(r) for r in got.df.orderBy("_rid").collect()] == [(i, r[0], r[1], r[3]) for i, r in enumerate(rows) if i and r[0] is not None]
