"""Operators over documents against brute force, with odd rows: nulls, blanks, repeats, clashing columns, empty tables."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clearbrook.llm import decontaminate, jaccard, mixing, quality, sharding, substrings, toxicity
from clearbrook.llm.shared import components
from clearbrook.llm.words import windows, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string, digest string, label int, _n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)] + ["De", "LA"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = make(120)
    texts = [" ".join(make(rng.randrange(1, 150))) for _ in range(25)]
    for _ in range(25):  # near copies with a few words changed
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = "x" + str(rng.randrange(1000))
        texts.append(" ".join(copy))
    passage = " ".join(make(40))
    texts += [f"{' '.join(make(60))}\n{passage}\n{' '.join(make(50))}" for _ in range(6)]
    texts += [None, "", " \n\t ", "one", "one", "One", "a b c", "tab\tand\x0bvt  two", " ".join(["rep"] * 90), "long " * 3000, texts[3], texts[3]]
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", ["a", "b", None][i % 3] if i is not None else None, 0, 7, 3, "k", "d", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("frequent", "short"), [(4, 32), (2, 3), (10_000, 32)])
def test_jaccard_matches_all_pairs(spark, rows, frequent, short):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows), frequent=frequent, short=short).collect()}
    assert got == brute_components(rows)


def test_sets_that_share_a_name_are_told_apart(spark, rows, monkeypatch):
    own = jaccard.set_key
    weak = lambda s: (len(s) % 5, own(s)[1])

    def sets(batch, size, renamed):
        for w in words(batch.column(1)):
            for i, s in enumerate(jaccard.shingle_sets(w, size)):
                yield w.first + i, s, renamed.get(weak(s), weak(s)[0])

    # both, since tasks look functions of the module up by name, but get those of a test by value
    monkeypatch.setattr(jaccard, "set_key", weak)
    monkeypatch.setattr(jaccard, "_sets", sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_signatures_meet_at_the_threshold():
    """Two sets with the least allowed overlap share a signature, whatever tokens are frequent."""
    rng = np.random.default_rng(0)
    for n in (2, 3, 4, 5, 7, 12, 31, 64, 150):
        for _ in range(60):
            m = int(rng.integers(n, 100 * n // 75 + 1))
            shared = next((k for k in range(n + 1) if 100 * k >= 75 * (n + m - k)), None)
            if shared is None:
                continue
            tokens = rng.integers(0, 2**63, n + m - shared, dtype=np.uint64)
            x, y = np.sort(tokens[:n]), np.sort(tokens[n - shared :])
            level = dict(zip(tokens.tolist(), rng.choice([0, 2, 3], len(tokens), p=rng.dirichlet([1, 1, 1])).tolist(), strict=True))
            a, b = (set(jaccard.signatures(s, np.array([level[t] for t in s.tolist()]), 75).tolist()) for s in (x, y))
            assert a & b, (n, m, shared)


def test_keep_first_keeps_all_columns(spark, rows):
    docs = frame(spark, [*rows, rows[0], rows[0]])
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute_components(rows).values()})


def test_keep_first_decides_by_text_where_doc_ids_are_missing_or_shared(spark):
    make = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, make("a")), (5, make("a")), (None, make("a") + " more"), (None, make("n")), (None, make("n")), (None, make("n") + " more"), (None, make("alone")), (None, None), (None, "")]
    rows += [(9, make("x")), (9, make("y")), (9, make("y")), (9, None), (9, ""), (12, make("x") + " more"), (8, make("z")), (9, make("z"))]
    got = [(r["doc_id"], r["text"]) for r in jaccard.keep_first(frame(spark, rows)).collect()]
    known = [r for r in got if (r[1] or "").split(" ")[0] not in ("n0", "")]
    assert sorted(known, key=str) == sorted([(5, make("a")), (None, make("alone")), (9, make("x")), (9, make("y")), (8, make("z"))], key=str)
    assert len([r for r in got if (r[1] or "").startswith("n0")]) == 1
    assert sorted(r[0] is None for r in got if not r[1]) == [False, True, True]


def test_substrings_match_brute_force(spark, rows):
    seen, want = {}, {}
    for i, t in sorted(rows):
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if tuple(w[p : p + 20]) in seen:
                gone[p : p + 20] = [True] * 20
            seen.setdefault(tuple(w[p : p + 20]), (i, p))
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    found = substrings.dedup_substrings(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in found} == want
    texts = dict(rows)
    for r in found:
        for f in r["factors"]:
            here, there = split(texts[r["doc_id"]]), split(texts[f["ref_doc_id"]])
            assert f["length"] >= 20 and here[f["start"] : f["start"] + f["length"]] == there[f["ref_start"] : f["ref_start"] + f["length"]]


def test_substrings_of_texts_that_share_a_doc_id(spark):
    make = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    first, passage = make("a", 90), make("p", 30)
    rows = [(1, first), (2, passage), (7, first), (7, make("b", 40)), (7, f"{make('c', 50)} {passage} {make('d', 9)}"), (7, make("e", 25)), (7, make("b", 40))]
    found = substrings.dedup_substrings(frame(spark, rows)).collect()
    want = [(1, first, 0), (2, passage, 0), (7, "", 90), (7, make("b", 40), 0), (7, f"{make('c', 50)} {make('d', 9)}", 30), (7, make("e", 25), 0), (7, make("b", 40), 0)]
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in found) == sorted(want)


def test_substrings_compare_words_whatever_the_hashes_say(spark, monkeypatch):
    """All windows have one hash: the only place that is known is the first, and only true repeats of it go."""
    make = lambda c, n: [f"{c}{i}" for i in range(n)]
    passage = make("p", 30)
    rows = [(1, passage + make("a", 40)), (2, make("b", 30) + passage), (3, make("c", 60)), (4, passage[:25] + make("d", 60))]
    monkeypatch.setattr(substrings, "PIECE", 7)
    want = {1: 0, 2: 30, 3: 0, 4: 25}
    docs = frame(spark, [(i, " ".join(w)) for i, w in rows])
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(docs).collect()} == want
    pieces = [(0, 1, 0, 0, " ".join(passage).encode()), (30, 1, 0, 30, b"q " * 9 + b"q")]
    assert substrings.factor([x.encode() for x in passage + make("b", 10)], pieces, 20).tolist() == [[0, 30, 1, 0]]
    assert substrings.factor([x.encode() for x in make("b", 30)], pieces[:1], 20).tolist() == []
    # two halves of one block, the second with a word that differs in its middle
    halves = [(0, 1, 0, 5, " ".join(passage[:15]).encode()), (15, 1, 0, 20, " ".join([*passage[15:22], "other", *passage[23:]]).encode())]
    assert substrings.factor([x.encode() for x in passage], halves, 20).tolist() == [[0, 22, 1, 5]]
    def weak(h, at, window):
        return np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint32)

    # every indexed window is taken for the one at the start of document 1; what isn't equal to it stays
    monkeypatch.setattr(substrings, "window_hashes", weak)
    got = {r["doc_id"]: (r["n_removed"], r["text"].split()) for r in substrings.dedup_substrings(docs).collect()}
    assert {i: n for i, (n, _) in got.items()} == {1: 0, 2: 20, 3: 0, 4: 20}
    assert got[2][1] == rows[1][1][:30] + passage[20:] and got[4][1] == rows[3][1][20:]


def test_hot_groups_and_repeats_within_a_document(spark):
    make = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    passage = make("p", 24)
    rows = [(i, f"{make(f'u{i}x', 12)}  {passage}\n{make(f'v{i}x', 9)}") for i in range(60)] + [(100 + i, make("copy", 50)) for i in range(40)] + [(200, f"{make('r', 21)} {make('r', 21)}")]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {**{i: 24 * (i > 0) for i in range(60)}, **{100 + i: 50 * (i > 0) for i in range(40)}, 200: 21}


def test_quality_matches_brute_force(spark, rows):
    docs = [(i, t, ["a", "b", None][i % 3]) for i, t in rows]
    normal = lambda line: " ".join(split(line)).lower()
    hosts, used = {}, {}
    for _, t, s in docs:
        hosts.setdefault(s, set()).add(t or "")
        for line in {normal(x) for x in (t or "").split("\n")} - {""}:
            used.setdefault((s, line), set()).add(t or "")
    want = {}
    for i, t, s in docs:
        w, t = split(t), t or ""
        lines = [x for x in t.split("\n") if split(x)]
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(three) if three.count(x) > 1 for j in range(3)}
        lost = sum(len(split(x)) for x in lines if len(used[s, normal(x)]) > max(1, 0.05 * len(hosts[s])))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and len(w) - lost >= 0.3 * len(w))
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.judge(frame(spark, rows), least=1).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    assert got == want
    docs = frame(spark, rows)
    kept = quality.keep_good(docs, least=1)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in want.items() if v[-1])


def test_boilerplate_depletes_but_copies_do_not(spark):
    line = " ".join(f"menu{i}" for i in range(60))
    rows = [(i, line + "\n" + f"own{i} words", "h", ) for i in range(40)] + [(100 + i, " ".join(f"copy{j}" for j in range(60)), "h") for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(40)) and all(got[100 + i] for i in range(40))


def test_boilerplate_lines_leave_the_kept_texts(spark):
    own = lambda i: f"own{i} " + " ".join(f"w{i}_{j}é" for j in range(60))
    rows = [(i, f"Menu  Home\n\n{own(i)}\nmenu home\nlast{i}\nLicence é", "h", 7) for i in range(30)] + [(100 + i, f"menu home\n{own(i)}", None, 7) for i in range(3)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in quality.keep_good(docs).collect())
    left = [(i, f"\n{own(i)}\nlast{i}") for i in [0, *range(30)]]
    assert got == [(i, t, len(t)) for i, t in left] + [(i, t, 7) for i, t, _, _ in rows[30:]]
    judged = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in quality.judge(docs).collect()}
    assert all(len(split(t)) == judged[i] for i, t, _ in got)


def test_masks_find_every_two_substitutions():
    for wrong in itertools.combinations(range(13), 2):
        assert any(all(at + p not in wrong for p in decontaminate.places(m)) for m in decontaminate.MASKS for at in range(13 - len(m) + 1)), wrong


def test_seeds_find_all_allowed_substitutions_in_short_items():
    for n in range(8, 14):
        seeds = decontaminate.build_index([1], [" ".join(f"t{i}" for i in range(n))])["seeds"]
        for wrong in itertools.combinations(range(n), n // decontaminate.PER):
            assert any(all(a + p not in wrong for p in where) for _, where, *_, at in seeds for a in at.tolist()), (n, wrong)


def brute_overlap(doc, item, span=13, per=5):
    """Most aligned words of a clean enough run over all alignments, 0 without any."""
    size, best = min(span, len(item)), 0
    for shift in range(size - len(item), len(doc) - size + 1):
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        wrong = [item[j] != doc[j + shift] for j in range(a, b)]
        ok = [k for k in range(len(wrong) - size + 1) if sum(wrong[k : k + size]) <= (size // per if size >= 8 else 0)]
        while ok:
            run = [ok.pop(0)]
            while ok and ok[0] - run[-1] <= size:
                run.append(ok.pop(0))
            best = max(best, run[-1] - run[0] + size)
    return best


def test_decontamination_finds_every_allowed_substitution_in_items_of_any_length(spark):
    items, docs = {}, []
    for n in range(1, 41):
        items[n] = [f"i{n}x{k}" for k in range(n)]
        size = min(13, n)
        for at in range(n - size + 1):
            for wrong in itertools.combinations(range(at, at + size), size // 5 if size >= 8 else 0):
                docs.append((n, " ".join(["lead"] + [w if at <= k < at + size and k not in wrong else f"o{k}" for k, w in enumerate(items[n])] + ["tail"])))
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in decontaminate.contaminated(table, benchmark).collect()}
    assert len(docs) > 30_000 and all(got[i]["contaminated"] and n in got[i]["items"] for i, (n, _) in enumerate(docs))


def test_decontamination_matches_brute_force_and_sql(spark, monkeypatch):
    import duckdb

    rng = random.Random(8)
    word = lambda: f"t{rng.randrange(6)}"
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate((1, 2, 5, 7, 8, 9, 10, 12, 13, 14, 20, 30, 10, 11))] + [(20, ["same"] * 15), (21, ["a", "b"] * 9)]
    docs = [(i, [word() for _ in range(rng.randrange(0, 60))]) for i in range(60)] + [(70, ["same"] * 400), (71, ["same"] * 12), (72, ["a", "b"] * 100), (73, ["b", "a", "c"] * 30)]
    for i, item in items:
        copy = list(item)
        for k in range(2, len(copy), 6):
            copy[k] = "other"
        docs.append((100 + i, [word() for _ in range(7)] + copy + [word() for _ in range(7)]))
    text = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    monkeypatch.setattr(decontaminate, "MOST_PAIRS", 50)
    got = {r["doc_id"]: (r["items"], r["matched_words"]) for r in decontaminate.contaminated(text(docs, "doc_id"), text(items, "item_id")).collect()}
    for i, d in docs:
        found = {k: n for k, item in items if (n := brute_overlap(d, item))}
        assert got[i] == (sorted(found), max(found.values(), default=0)), i
    db = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        db.execute(f"create table {name} ({key} bigint, text varchar)")
        db.executemany(f"insert into {name} values (?, ?)", [(i, " ".join(w)) for i, w in rows])
    said = {i: (x, m) for i, _, _, x, m in db.execute(decontaminate.SQL).fetchall()}
    assert said == {i: (",".join(map(str, x)), m) for i, (x, m) in got.items()}


def test_repeated_words_do_not_multiply():
    index = decontaminate.build_index([1], [" ".join(["w"] * 2000)])
    h = next(words(pa.array([" ".join(["w"] * 200_000)]))).hashes()
    assert decontaminate.probe(h, np.array([0, len(h)]), index, 13, 5) == {(0, 0): 2000}


def test_decontamination_finds_leaks_and_spares_the_rest(spark):
    rng = random.Random(4)
    word = lambda: f"t{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (40, 15, 6, 3)]
    clean = [[word() for _ in range(100)] for _ in range(20)]
    leaks = []
    for item in items:
        for changed in (0, 1):
            copy = list(item)
            if changed and len(copy) >= 8:
                for k in range(4, len(copy), 9):
                    copy[k] = "OTHER"
            leaks.append(clean[0][:30] + [w.upper() for w in copy] + clean[1][:30])
    rows = [(i, " ".join(w)) for i, w in enumerate(clean + leaks)] + [(None, " ".join(leaks[0])), (90, None), (91, ""), (92, "t1")]
    docs = frame(spark, rows)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(8, None), (9, " ")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {None, *range(20, 28)}
    assert got[20]["items"] == [0] and got[20]["matched_words"] == 40
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {*range(20), 90, 91, 92}
    assert not any(r["contaminated"] for r in decontaminate.contaminated(docs, benchmark.limit(0)).collect())


def test_mixing(spark, rows):
    docs = frame(spark, [*rows, (None, "no id at all")])
    got = mixing.plan_mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len(split(r["text"])) and r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    weight, left, fixed = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}, dict(sizes), {}
    while True:  # share, stop those above their limit, share again
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in left)
        above = [s for s in left if weight[s] * level > 3 * sizes[s]]
        if not above:
            break
        for s in above:
            fixed[s] = 3 * left.pop(s)
    want = fixed | {s: weight[s] * level for s in left}
    assert target == pytest.approx(want) and not taken
    copies = mixing.emit(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in got)
    assert sorted(map(str, copies.collect())) == sorted(map(str, mixing.emit(docs).collect()))


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    for r in mixing.plan_mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.1)


def test_sharding(spark, rows):
    import zlib

    got = sharding.assign(frame(spark, [*rows, (None, "x"), (None, None), rows[0], rows[0]])).collect()
    slots = {}
    for r in got:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1


def test_sharding_of_a_frequent_doc_id(spark):
    got = sharding.assign(frame(spark, [(i, f"text {n}") for n in range(150) for i in (None, 9)])).collect()
    by = {i: {r["shard"] for r in got if r["doc_id"] == i} for i in (None, 9)}
    assert all(len(s) == 1 for s in by.values())
    for shard in set.union(*by.values()):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def brute_shard(key, shards):
    """The descent as the module's docstring tells it."""
    at = 0
    for level, size, inside in (("region", 20, 0), ("rack", 5, 20), ("shard", 1, 5)):
        base = at - at % inside if inside else 0
        name = level + (str(base) if inside else "")
        high = min(base + inside, shards) if inside else shards
        for i, before in enumerate(range(base + size, high, size)):
            digest = hashlib.md5(f"{name}.{i // 4}:{key}".encode()).hexdigest()
            u = (int(digest[i % 4 * 8 :][:8], 16) + 1) / 2**32
            need = max(1, math.ceil(before / u - before))
            if before > at and need <= min(size, high - before):
                at = before + need - 1
    return at


def test_hash_tree_matches_brute_force_and_a_further_shard_takes_rows_only_into_itself(spark):
    keys = [str(k) for k in range(300)]
    now = {k: 0 for k in keys}
    for n in range(1, 102):
        then = {k: brute_shard(k, n) for k in keys}
        assert all(then[k] in (now[k], n - 1) for k in keys)
        now = then
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    sizes = (1, 2, 5, 6, 20, 21, 39, 40, 41, 61, 100)
    for n in sizes:
        rows = sharding.descend(rows, n, "k", f"s{n}")
    for r in rows.collect():
        assert [r[f"s{n}"] for n in sizes] == [brute_shard(r["k"], n) for n in sizes]


@pytest.mark.parametrize("shards", [1, 4, 5, 20, 40, 60])
def test_grown_shard_is_what_one_more_shard_gives(spark, shards):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    now, then = ({r["doc_id"]: r for r in sharding.assign(docs, n).collect()} for n in (shards, shards + 1))
    assert all(now[i]["grown_shard"] == then[i]["shard"] and then[i]["shard"] in (now[i]["shard"], shards) for i in now)


def test_hash_tree_is_even(spark):
    n = {r["s"]: r["count"] for r in sharding.descend(spark.range(40_000).select(F.col("id").cast("string").alias("k")), 44, "k", "s").groupBy("s").count().collect()}
    assert len(n) == 44 and all(abs(v - 40_000 / 44) < 160 for v in n.values())


def test_clashing_names_of_the_input_are_set_apart(spark, tmp_path):
    names = ("Size", "SHARD", "slot", "Copies", "Taken", "Target", "key", "Row", "source_Size")
    docs = frame(spark, [(1, "a b"), (2, "c")]).select("doc_id", "text", "source", *(F.lit(7).alias(n) for n in names))
    for f, new in ((sharding.assign, ("Size", "SHARD", "slot")), (mixing.plan_mix, ("Size", "Copies", "Taken", "Target", "source_Size"))):
        got = f(docs)
        got.write.parquet(f"{tmp_path}/{f.__name__}")
        assert len({c.lower() for c in got.columns}) == len(got.columns)
        assert all(r[f"input_{n}" if n in new else n] == 7 for r in got.collect() for n in names)
    assert mixing.emit(docs).columns == docs.columns


def test_toxicity_learns_terms_and_pairs(spark):
    rng = random.Random(2)
    word = lambda: f"t{rng.randrange(200)}"
    rows, labels = [], []
    for i in range(900):
        toxic, w = i % 6 == 0, [word() for _ in range(30)]
        if toxic:
            w[5] = rng.choice(["idiotic", "scummy"])
        rows.append((i, " ".join(w) + ("," if i % 2 else "")))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "t1 idiotic"), (3, rows[3][1])]
    docs = frame(spark, rows)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, labelled)
    got = toxicity.score(docs, machine).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1
    again = toxicity.train(frame(spark, [*rows, (7, "another text of the same doc_id"), (7, rows[7][1])]).repartition(3), labelled.union(labelled))
    assert toxicity.train(frame(spark, [(7, rows[7][1]), (7, "another text of the same doc_id"), *rows]), labelled).bias == again.bias
    assert len(toxicity.train(docs, labelled, most_bytes=1000).codes) < len(machine.codes)
    # a pair that is toxic while its terms alone aren't
    data = [np.unique([1 if i % 4 in (1, 3) else 9, 2 if i % 4 in (2, 3) else 8, 20 + i % 7]).astype(np.int32) for i in range(800)]
    y = np.array([float(i % 4 == 3) for i in range(800)])
    m = toxicity.fit(data, y, sure=0.0)
    flat, bounds = np.concatenate(data), np.cumsum([0, *map(len, data)])
    assert ((m.score(flat, bounds) >= 0.5) == y).all() and np.abs(m.factors).max() > 0.1
    assert toxicity.score(docs, toxicity.train(docs, labelled.limit(0))).count() == len(rows)


def test_toxicity_learns_pairs_whose_terms_tell_nothing():
    """As fitted in production: terms 1 and 2 are toxic together only, and alone as often toxic as the average row."""

    def make(n, seed):
        rng, rows, y = np.random.default_rng(seed), [], []
        for _ in range(n):
            u = rng.random()
            a, b = u < 0.08, 0.05 < u < 0.13
            toxic = rng.random() < (0.95 if a and b else 0 if a or b else 0.35625)
            rows.append(np.unique([1] * int(a) + [2] * int(b) + [3] * int(toxic and not (a or b)) + (10 + rng.integers(0, 500, 25)).tolist()).astype(np.int32))
            y.append(float(toxic))
        return rows, np.array(y)

    rows, y = make(16_000, 1)
    for term in (1, 2):  # too little to be known by a test of one term
        own = np.array([term in r for r in rows])
        assert abs(y[own].sum() - own.sum() * y.mean()) < 4 * np.sqrt(own.sum() * y.mean() * (1 - y.mean()))
    machine = toxicity.fit(rows, y)
    rows, y = make(3000, 2)
    right = (machine.score(np.concatenate(rows), np.cumsum([0, *map(len, rows)])) >= 0.5) == y
    both = np.array([1 in r and 2 in r for r in rows])
    one = np.array([(1 in r) != (2 in r) for r in rows])
    assert both.sum() > 50 and right[both].mean() > 0.8 and right[one].mean() > 0.9


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for df in (jaccard.jaccard_components(none), jaccard.keep_first(none), substrings.dedup_substrings(none), quality.judge(none), quality.keep_good(none), mixing.plan_mix(none), mixing.emit(none), sharding.assign(none), decontaminate.contaminated(none, benchmark), decontaminate.drop_contaminated(none, benchmark), toxicity.score(none, toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int")))):
        assert df.count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_words_and_windows_are_those_of_the_pattern():
    texts = [None, "", " a\x0bb\u00a0c  d\n", "é " * 5, "x"]
    for w in words(pa.array(texts)):
        got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.bounds, w.bounds[1:], strict=False)]
        assert got == [split(t) for t in texts]
        h, bounds = windows(w.hashes(), w.bounds, 2)
        assert np.diff(bounds).tolist() == [max(0, len(split(t)) - 1) for t in texts] and len(set(h[bounds[3] : bounds[4]].tolist())) == 1
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_rows_without_an_id(spark):
    text = " ".join(f"u{i}" for i in range(60))
    rows = [(None, text), (5, text), (None, None), (None, text + " more"), (7, None), (None, "alone " + " ".join(f"z{i}" for i in range(70)))]
    docs = frame(spark, rows)
    linked = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(linked, key=str) == sorted([(None, 56, 5), (5, 56, 5), (None, 0, None), (None, 57, 5), (7, 0, 7), (None, 67, None)], key=str)
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.keep_first(docs).collect() if r["doc_id"] is not None) == [(5, text), (7, None)]
    cut = substrings.dedup_substrings(docs).collect()
    assert len(cut) == len(rows) and all(r["n_removed"] == 0 for r in cut)
    judged = quality.judge(docs).collect()
    assert len(judged) == len(rows) and sum(r["kept"] for r in judged) == 4
    assert mixing.plan_mix(docs).count() == len(rows)
