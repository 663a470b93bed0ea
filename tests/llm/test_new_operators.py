"""Packing, hard negatives and periodic runs against brute force, exact round trips and odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from clearbrook.llm import negatives, packing, periodic, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SOURCE = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
TEXTS = [None, "", " ", "one", "ärger über Öl\n\n und  mehr ", "<|endoftext|> kept", "日本語 text 😀", "it's 12's\t x", " ".join(f"word{i}" for i in range(3000)), *(" ".join(["the quick brown fox"] * k) for k in range(1, 60))]


def pieces_of(rows, window):
    """Checks what holds for every packing; the ids of each document, joined."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["length"] > 0 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)  # no padding
    out = {}
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and {r["doc_tokens"] for r in own} == {sum(r["length"] for r in own)}
        out[doc] = [i for r in own for i in r["ids"]]
    return out


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_round_trip(spark, window):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = pieces_of(packing.pack(docs, SOURCE, window=window, unit=window // 64 or 1, with_ids=True).collect(), window)
    plain = tokens.Encoder(SOURCE).plainly([t or "" for t in TEXTS])
    assert got == {i: [*x.tolist(), 1] for i, x in enumerate(plain)}


def test_packing_odd_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (7, "x"), (7, "y z"), (8, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, sequence_id string")
    found = packing.pack(docs, SOURCE).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in found if not r["start"]) == sorted((i or 0, len(tokens.Encoder(SOURCE).plainly([t or ""])[0]) + 1) for i, t in rows)
    assert packing.pack(docs.limit(0), SOURCE).count() == 0


def test_cells_keep_every_id(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.integers(1, int(rng.integers(2, 90)), int(rng.integers(1, 200)))
        histogram = {}
        for n in lengths.tolist():
            if n % 16:
                histogram[n % 16] = histogram.get(n % 16, 0) + 1
        packer, got, filled, waiting = packing.Packer(packing.rates(histogram, 16, 2), 16, 2), {}, {}, 0
        monkeypatch.setattr(packing, "CELL", int(rng.integers(10, 2000)))
        for i, n in enumerate([*lengths.tolist(), None]):
            if n is not None:
                packer.add(i, np.arange(n))
                waiting += n
            if n is None or waiting >= 50:
                for d, start, size, sequence, place in packer.cell(n is None).tolist():
                    got.setdefault(packer.rows[d], []).append((start, size))
                    filled.setdefault(sequence, []).append((place, size))
                packer.forget()
                waiting = 0
        assert {i: sorted(x)[0][0] == 0 and sum(s for _, s in x) for i, x in got.items()} == dict(enumerate(lengths.tolist()))
        assert sorted(filled) == list(range(len(filled)))
        assert all(sum(s for _, s in x) in (1, 2, 4, 8, 16) for x in filled.values())


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = rng.integers(0, 4, (int(rng.integers(2, 12)), int(rng.integers(2, 30)))).astype(float), rng.random(12)
        b = b[: len(a)]
        x = packing.nnls(a, b)
        pull = a.T @ (b - a @ x)
        assert (x >= 0).all() and (pull <= 1e-7).all() and np.abs(pull[x > 0]).max(initial=0) <= 1e-7
    assert {tuple(c) for c in packing.combinations(3).T.astype(int)} == {(3, 0, 0), (1, 1, 0), (0, 0, 1)}


def test_common_characters_are_cut_alike():
    encoder, rng = tokens.Encoder(SOURCE), random.Random(1)
    assert encoder.fast is not None
    some = ["a", "Bc", " ", "  ", "\n", "12", "'s", "'", "<|endoftext|>", "’", "—", *map(chr, range(tokens.COMMON))]
    texts = [f"{lead}{chr(c)}{tail}" for c in range(tokens.COMMON) for lead in ("", "a", " ", "1") for tail in ("", "b", " b", "'s")]
    texts += ["".join(rng.choices(some, k=rng.randint(0, 15))) for _ in range(4000)] + ["x 日本", "a　b", "ǆ ᠎"]
    assert all(np.array_equal(x, y) for x, y in zip(encoder.encode(texts), encoder.plainly(texts)))


def hard_negatives(rows):
    """The contract, row by row: (anchor, positive, rank, negative, scores)."""
    known = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, l in rows if i is not None and v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, q) in enumerate(known):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for k, (i, l, v) in enumerate(known) if k != a)
        for s, positive in [(-s, i) for s, i, l in scored if l == label][:5]:
            fit = [(-n, i) for n, i, l in scored if l != label and 80 * s <= 100 * -n <= 100 * s][:5]
            out += [(anchor, positive, r, i, s, n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["clusters", "copies", "random"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(0, 1, (6, 8))
    rows = []
    for i in range(700):
        v = centres[i % 6] + rng.normal(0, 0.2, 8) if kind == "clusters" else np.round(rng.normal(0, 1, 8)) if kind == "copies" else rng.normal(0, 1, 8)
        rows.append((i, [float(x) for x in (centres[0] if kind == "copies" and i % 3 == 0 else v)], int(rng.integers(0, 10))))
    rows += [(700, None, 1), (701, [1.0, None], 2), (702, [float("nan")] * 8, 3), (None, [1.0] * 8, 1), (800, [0.5] * 8, None), (900, [], 4), (901, [2.0, 1.0], 4), (300, [0.3] * 8, 2), (300, [0.3] * 8, 2)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", score string").repartition(5)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = hard_negatives(rows)
    assert want and sorted(map(tuple, negatives.mine(table).select(columns).collect())) == want
    if kind == "clusters":  # groups of few anchors
        assert sorted(map(tuple, negatives.mine(table, group_bytes=300).select(columns).collect())) == want


def test_hard_negatives_of_nothing_and_of_large_numbers(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 2)], SCHEMA)).count() == 0
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 4e5, 6)], i % 3) for i in range(100, 260)] + [(50, [1e30] * 6, 1)]
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == hard_negatives(rows[:-1])  # scores beyond 2^53 are exact; a length that no long holds takes no part


def test_brackets_hold_every_score():
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (400, 12))
    top = float((v * v).sum(1).max())
    full = negatives.augmented(v, top)
    pivots = negatives.choose_pivots(full)
    d, bounds, exact = negatives.distances(full, pivots), negatives.Bounds(v[:50], top, pivots), v[:50] @ v.T
    at = np.arange(50)
    assert (bounds.highest(at, d, d) >= exact).all() and (bounds.lowest(at, d) <= exact).all()
    assert (bounds.highest(at, d.min(0)[None], d.max(0)[None])[:, 0] >= exact.max(1)).all()
    assert len(negatives.choose_pivots(np.ones((9, 3)))) == 1


def runs_of(w, least=12):
    """(start, length, period) of all runs, period by period."""
    found = {}
    for p in range(len(w) // 2, 0, -1):
        t = 0
        while t < len(w) - p:
            e = t
            while e < len(w) - p and w[e] == w[e + p]:
                e += 1
            if e - t + p >= max(least, 2 * p) and e > t:
                found[t, e - t + p] = p
            t = max(e, t) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def with_run(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_texts():
    rng = random.Random(2)
    out = [None, "", " \n\t", "a", "a a a a a a a a a a a a", "é ß " * 9]
    for _ in range(250):
        w = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 70))]
        if w and rng.random() < 0.5:
            q = rng.randint(1, len(w))
            w = (w[:q] * 9)[: rng.randint(1, 120)]
        out.append("  ".join(w))
    morse = ["a"]
    for _ in range(11):
        morse += ["b" if x == "a" else "a" for x in morse]  # its prefix hashes collide
    return [*out, " ".join(morse)]


def test_runs_equal_brute_force(spark, monkeypatch):
    texts = periodic_texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, runs int").repartition(3)
    got = sorted(((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.runs(docs).collect()), key=repr)
    want = []
    for t in texts:
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        found = runs_of(w)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        want.append((len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=repr)
    assert sum(map(len, (x[1] for x in want))) > 100 and periodic.runs(docs.limit(0)).count() == 0


def test_runs_in_small_slabs(monkeypatch):
    import pyarrow as pa

    from clearbrook.llm.words import words

    texts = periodic_texts()[:150]
    monkeypatch.setattr(periodic, "PAIRS", 40)
    for w in words(pa.array(texts)):
        row, start, length, period = periodic.find(w)
        for i in range(w.rows):
            own = row == i
            assert list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist())) == runs_of([x for x in (texts[w.first + i] or "").replace("\n", " ").replace("\t", " ").split(" ") if x])


def test_planted_documents_and_digests(spark, tmp_path):
    texts = [t for t in periodic_texts() if t and len(t) < 300] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic.query(spark, f"file://{tmp_path}").collect()}
    for i, t in enumerate(texts):
        w = with_run(i, [x for x in t.replace("\n", " ").replace("\t", " ").split(" ") if x])
        found = runs_of(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        milli = 1000 * best[1] // best[2] if found else None
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[i]) == (i, len(found), *best, milli, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_margin_of_the_factorization_machine_by_pairs():
    """Bias, weights and every pair of terms, added up one by one."""
    from clearbrook.llm import toxicity

    rng = np.random.default_rng(6)
    n = 30
    machine = toxicity.Machine(np.sort(rng.choice(1000, n, False)).astype(np.int32), rng.random(n), -0.3, rng.normal(0, 1, n), rng.normal(0, 0.5, (n, toxicity.FACTORS)), rng.random(n) < 0.4)
    rows = [np.sort(rng.choice(machine.codes, k, False)) for k in (0, 1, 2, 7, 25)] + [np.array([1001, 1002], np.int32)]
    code, bounds = np.concatenate(rows).astype(np.int32), np.cumsum([0, *map(len, rows)])
    got = machine.score(code, bounds)
    for row, score in zip(rows, got):
        at = [list(machine.codes).index(c) for c in row.tolist() if c in machine.codes]
        weak = [machine.value[i] for i in at if not machine.strong[i]]
        norm = max(np.sqrt(sum(v * v for v in weak)), toxicity.NORM)
        x = {i: machine.value[i] if machine.strong[i] else machine.value[i] * toxicity.NORM / norm for i in at}
        margin = machine.bias + sum(machine.linear[i] * x[i] for i in at)
        for k, i in enumerate(at):
            for j in at[k + 1 :]:
                margin += sum(a * b for a, b in zip(machine.factors[i], machine.factors[j])) * x[i] * x[j]
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_fitting_toxicity_holds_few_bytes_a_term():
    """What a fit holds beside the rows' own terms is 4 bytes a term and temporary arrays of bounded size."""
    import tracemalloc

    from clearbrook.llm import toxicity

    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(2000, 400, replace=False)).astype(np.int32) for _ in range(5000)]
    labels = rng.integers(0, 2, len(rows)).astype(float)
    tracemalloc.start()
    fitted = toxicity.fit(rows, labels, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(fitted.codes) == 2000 and peak < 14 * 400 * len(rows)
