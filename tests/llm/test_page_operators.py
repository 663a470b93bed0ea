"""Operators over pages: archives, URL filters, HTML extraction; and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from clearbrook.llm import htmltext, urlfilter, warc
from clearbrook.llm.shared import shared_folder

PAGES = "page_id long, url string, html string, sha1 string, bundle string, frame int, text string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", "b", 1, "t", "h") for i, u, h in rows], PAGES)


def test_archives_give_back_every_payload(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 5)} {i % 4}</p>") for i in range(40)] + [(50, None, None), (51, "http://x\r\nY: z", ""), (52, "u", "long " * 200_000), (None, "u", "<p> 0</p>"), (3, "again", "<p>ééé 3</p>")]
    df = pages(spark, rows)
    folder = shared_folder(spark, "warc")
    index = warc.write_archives(df, folder)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got:
        texts = [h or "" for i, _, h in rows if i == r["page_id"]]
        h = next(t for t in texts if r["payload_digest"] == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode())
        again = r["page_id"] is not None and first[h] != r["page_id"]
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len(h.encode()), "revisit" if again else "response", first[h] if again else None)
        assert bytes(r["block"]) == (b"" if again else h.encode())
    named = {r["record_id"]: r["page_id"] for r in got if r["record_type"] == "response"}
    where, path = warc.fs.FileSystem.from_uri(folder)
    heads = [warc.parse_record(zstandard.ZstdDecompressor().stream_reader(where.open_input_file(f"{path}/{r['bundle']}").read(), read_across_frames=True).read()) for r in index.select("bundle").distinct().collect()]
    assert all(h[0]["WARC-Record-ID"][1:-1] in {r["record_id"] for r in got} for h in heads)
    assert {r["record_id"] for r in index.collect()} == {r["record_id"] for r in warc.write_archives(df, shared_folder(spark, "warc")).collect()}
    for r in got:
        if r["record_type"] == "revisit":
            digest = r["payload_digest"]
            assert named[warc.record_name(r["refers_to"], None, digest)] == r["refers_to"]
    one = warc.read_records(index.where("page_id = 52"), folder).collect()
    assert len(one) == 1 and len(one[0]["block"]) == 1_000_000
    assert warc.archived(spark, df.limit(0)).count() == 0


def test_a_task_fills_one_bundle_over_its_batches_and_damage_is_found(spark):
    df = pages(spark, [(i, "u", f"<p>{i}</p>") for i in range(60)] + [(100 + i, "u", "") for i in range(60)]).coalesce(1)
    folder = shared_folder(spark, "warc")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = warc.write_archives(df, folder)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert index.count() == 120 and index.select("bundle").distinct().count() <= spark.sparkContext.defaultParallelism
    assert {r["refers_to"] for r in warc.read_records(index.where("page_id > 100"), folder).collect()} == {100}
    data = warc.record("response", "urn:1", "u", b"abc", warc.base32_sha1(b"abd"), None, 3)
    where, path = warc.fs.FileSystem.from_uri(folder)
    bundle = warc.Bundle()
    frame, offset, length = bundle.add(data)
    with where.open_output_stream(f"{path}/bad") as out:
        out.write(bundle.bytes())
    wrong = spark.createDataFrame([("urn:1", 1, "bad", frame, offset, length)], warc._INDEX)
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(wrong, folder).collect()


def test_bundle_is_seekable_and_plain_zstandard():
    b = warc.Bundle()
    data = [warc.record("response", f"urn:{i}", "u", bytes([65 + i]) * 100_000, "D", None, 100_000) for i in range(8)]
    at = [b.add(d) for d in data]
    packed = b.bytes()
    table = warc.seek_table(packed)
    assert len(table) > 1
    for (frame, offset, length), d in zip(at, data, strict=True):
        start, size = table[frame]
        assert zstandard.ZstdDecompressor().decompress(packed[start : start + size])[offset : offset + length] == d
    whole = zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True).read()
    assert whole == b"".join(data)
    with pytest.raises(ValueError):
        warc.seek_table(b"x" * 20)


def test_url_filter_matches_every_rule_on_every_url(spark):
    rules = (*urlfilter.RULES, urlfilter.Rule("b.example.net", "/en/x", "block"), urlfilter.Rule("ample.net", "/", "allow"))
    hosts = ["example.net", "a.example.net", "b.example.net", "x.b.example.net", "net", "ample.net", "nets", "org", "a.org", "example.com", "EXAMPLE.com", "de.example.com", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/xy?q#f", "/de/", "/fr/a#/b", "?x=/en/", "/en")] + [None, "", "no scheme/", "://net/", "a://b://c/"]
    df = pages(spark, [(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], None)])
    for r in urlfilter.filter_urls(df, rules).collect():
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else None
        host = path = ""
        if rest is not None:
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.name, best.verdict if best else "allow")
    assert urlfilter.filter_urls(df, ()).where("verdict <> 'allow'").count() == 0
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


@pytest.mark.parametrize("block", [1, 3, 200_000])
def test_url_verdicts_do_not_depend_on_blocks_or_batches(spark, monkeypatch, block):
    monkeypatch.setattr(urlfilter, "BLOCK", block)
    rules = (urlfilter.Rule("a.net", "/x", "block"), urlfilter.Rule("net", "/xyz", "allow"), urlfilter.Rule("net", "/xyz", "block"), urlfilter.Rule("c.net", "/é", "allow"), urlfilter.Rule("net", "/", "allow"), urlfilter.Rule("a.net", "/xy", "allow"), urlfilter.Rule("b.a.net", "", "block"))
    urls = [f"http://{h}{p}" for h in ("a.net", "b.a.net", "net", "c.net", "x.c.net", "nett") for p in ("/xyz", "/xy", "/x", "/", "", "/éa")] * 3
    df = pages(spark, [(i, u, None) for i, u in enumerate(urls)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = urlfilter.filter_urls(df, rules).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(urls)
    for r in got:
        best = max((x for x in rules if fits(x, r["host"], r["path"])), key=lambda x: x.rank, default=None)
        assert (r["rule"], r["verdict"]) == (best and best.name, best.verdict if best else "allow")


def test_many_paths_of_one_host_and_sweeps_that_start_midway():
    rules = [urlfilter.Rule("h.net", f"/{i}/{'x' * (i % 4)}", "block" if i % 2 else "allow") for i in range(5000)] + [urlfilter.Rule("net", "/", "allow"), urlfilter.Rule("b.h.net", "/1", "allow")]
    known = urlfilter.hosts(rules)
    urls = sorted((f"net.h.{s}", f"/{i}/xx/y") for s in ("", "a.", "b.", "b.c.") for i in range(0, 5000, 7))
    want = []
    for key, path in urls:
        host = ".".join(reversed(key[:-1].split(".")))
        want.append(max((r for r in rules if fits(r, host, path)), key=lambda r: r.rank, default=None) if path < "/14" else None)
    for first in (0, 900, 2000):
        step = urlfilter.sweep(known)
        got = [step(*u) for u in urls[first:]]
        assert all(g == w for g, w, u in zip(got, want[first:], urls[first:], strict=True) if u[1] < "/14")


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>menu {i}</a></li></ul></nav><div class=\"ad\">buy {i} now</div>{body}<footer>&copy; site</footer></body></html>"


def test_blocks():
    got = htmltext.blocks("<p>one &amp;\n two<p>three <b>bold</b><br>line<div>x</div><!-- <p>no --><script>'<p>'</script><ul><li>a<li>b</ul>tail")
    assert [b.text for b in got] == ["one & two", "three bold line", "x", "a", "b", "tail"]
    assert htmltext.blocks("") == [] and htmltext.blocks("<p>a < b</p>")[0].text == "a < b"


def test_extraction(spark):
    bodies = [f"<article><h1>Head {i}</h1><p>Text number {i} goes here, with words.</p><p>Second <b>part</b> {i}.</p></article><section id='comments'><p>first! {i}</p></section>" for i in range(80)]
    rows = [(i, f"u{i}", PAGE.replace("{i}", str(i)).replace("{body}", b)) for i, b in enumerate(bodies)] + [(100, None, None), (101, "u", ""), (102, "u", "plain"), (3, "u3", PAGE.replace("{i}", "3").replace("{body}", bodies[3]))]
    got = {r["page_id"]: r for r in htmltext.extract(pages(spark, rows)).collect()}
    for i in range(80):
        assert got[i]["text"] == f"Head {i}\nText number {i} goes here, with words.\nSecond part {i}." and got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == got[101]["text"] == ""
    assert htmltext.extract(pages(spark, []).limit(0)).count() == 0


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    model = htmltext.Labeller()
    x, mask, y = rng.normal(size=(3, 4, htmltext.WIDTH)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], float), rng.integers(0, 2, (3, 4)).astype(float)

    def loss():
        p = model.forward(x, mask)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for k, v in model.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_pipeline(spark, tmp_path):
    import random

    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    item = text(30)
    texts = [text(80) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*texts, texts[0], texts[1] + " more", f"{text(40)} {item} {text(40)}", "too short", None])]
    spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
    assert set(kept["quality_rules"]) == set(range(33))
    assert kept["near_duplicates"] == [*range(30), 32]
    assert kept["decontamination"] == list(range(30))
    assert set(kept["mixing"]) <= set(range(30)) and len(kept["mixing"]) > 15
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == kept["mixing"]


def test_dropped_tags_take_no_other_text():
    page = """<article><p>one</p><svg class="i"/><p>two</p><svg-icon name='a>b'></svg-icon><p>three</p><title-bar>four</title-bar><svg viewBox="0"><text>gone</text></svg >
    <p>five <math><mi>x</mi><mo>=</mo><mn>2</mn></math> six</p><svg/><figure><img src=a><figcaption>seven</figcaption></figure><object data=a>eight</object></article><p>nine"""
    got = htmltext.blocks(page)
    assert [b.text for b in got] == ["one", "two", "three", "four", "five x=2 six", "seven", "eight", "nine"]
    assert htmltext.teacher(got) == [True] * 7 + [False]


@pytest.mark.parametrize(("page", "texts"), [
    ('<p><a href="foo>bar</a></p><p>next</p>', ["bar", "next"]),
    ('<p><a href="foo>bar</a> <a href="x">y</a></p><p title="a > b">z</p>', ["bar y", "z"]),
    ("<p><img alt='it>is'>a<p>b<span class=c\nd", ["a", "b<span class=c d"]),
    ("<div>one<p>two<b><i>three</div>four<!-- open", ["one", "twothree", "four"]),
    ("<p>x<p y <p>z</p><title>gone", ["x", "z"]),
    ("a<!DOCTYPE b>c<?php d ?>e<", ["ace<"]),
])
def test_malformed_markup(page, texts):
    assert [b.text for b in htmltext.blocks(page)] == texts


@pytest.mark.parametrize("piece", ['<a href="x ', "<div>a", "<b>", "<p>a<b>", '<a "x>" ', "<!-- ", "</div>", "<svg ", '<i class="', "<li>x<li", "<b><div></div>", "<script>"])
def test_odd_pages_are_read_in_linear_time(piece):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        htmltext.blocks(piece * n + ">")
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_long_pages_are_labelled_by_windows(monkeypatch):
    rng, model = np.random.default_rng(1), htmltext.Labeller()
    page = [htmltext.Block(bytes(rng.integers(0, 2, htmltext.PATH).astype(np.uint8)), None, False, f"block {i} " * (i % 5 + 1), i % 7) for i in range(90)]
    whole = htmltext.label_pages(model, [page[:20], [], page])
    monkeypatch.setattr(htmltext, "WINDOW", 25)
    parts = htmltext.label_pages(model, [page[:20], [], page])
    assert len(whole[1]) == 0 and all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))


def test_labeller_is_right_on_pages_without_semantic_tags(spark):
    """Learned from tagged pages; read on others of the same make whose tags, classes and ids are plain."""
    import re

    body = lambda i: f"<article><h1>Head {i} of it</h1><p>Text number {i} goes on here, with many words in it, and so on.</p><p>Second part {i} is no less long than the first one was.</p></article>"
    rows = [(i, "u", PAGE.replace("{i}", str(i)).replace("{body}", body(i))) for i in range(160)]
    model = htmltext.train(pages(spark, rows[:120]))
    plain = [(i, u, re.sub(r"<(/?)(?:article|nav|footer|ul|li|section)\b", r"<\1div", h).replace('class="ad"', "")) for i, u, h in rows[120:]]
    texts = {r["page_id"]: r["text"] for r in htmltext.extract(pages(spark, plain), model).collect()}
    want = {i: "\n".join(b.text for b, y in zip(f, htmltext.teacher(f), strict=True) if y) for i, _, h in rows[120:] if (f := htmltext.blocks(h))}
    assert sum(texts[i] == want[i] for i in want) >= 0.9 * len(want)


def test_labeller_without_any_semantic_tag_and_its_bounds(spark):
    rows = [(i, "u", f"<div class='menu'><a href=x>home {i}</a></div><div><p>Words of text {i}, a sentence.</p><p>And another {i}.</p></div>") for i in range(60)]
    df = pages(spark, rows + [rows[0]] * 50)
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert all(got[i] == f"Words of text {i}, a sentence.\nAnd another {i}." for i in range(60))
    assert htmltext.train(pages(spark, [(1, "u", ""), (2, "u", None)])) is None
    assert htmltext.train(df, most_pages=5, most_bytes=200) is not None
