"""The pipeline's stages, each on what the one before kept, against brute force in plain Python."""

import hashlib
import math
import random
import zlib

import corpus_pipeline
from tests.llm.test_text_operators import brute_components, brute_overlap, brute_shard, split


def good(text):
    """The base rules; no line of so few texts is above its host's limit."""
    w = split(text)
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    repeated = {k + j for k, x in enumerate(three) if three.count(x) > 1 for j in range(3)}
    return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)


def copies(rows):
    """How often each document is taken: shares by weight, no source more than three times."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, rate = dict(sizes), {}
    while left:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in rate)) / sum(weight[s] for s in left)
        above = [s for s in left if weight[s] * level > 3 * sizes[s]]
        rate |= {s: 3.0 for s in above} if above else {s: weight[s] * level / sizes[s] for s in left}
        left = {s: n for s, n in left.items() if s not in rate}
    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
    return {i: math.floor(rate[s]) + (draw(i) < rate[s] - math.floor(rate[s])) for i, _, s in rows}


def test_every_stage_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n, kinds=3000: [f"v{rng.randrange(kinds)}é" for _ in range(n)]
    items = [text(30), text(9)]
    texts = [text(rng.randrange(40, 120)) for _ in range(40)] + [text(60, 4) for _ in range(4)]
    for k in range(12):  # copies with a few words changed, some of them too far off
        copy = list(texts[k])
        for _ in range(k):
            copy[rng.randrange(len(copy))] = "other"
        texts.append(copy)
    for k in range(6):  # items, whole and with a word changed, in long texts
        item = list(items[k % 2])
        if k > 1:
            item[k] = "changed"
        texts.append(text(40) + item + text(30))
    rows = [(i, " ".join(w), [None, "a", "b", "c"][i % 4 if i % 7 else 1]) for i, w in enumerate(texts)] + [(200, None, "a"), (201, "", "b")]
    spark.createDataFrame([(i, t, "en", s, 0, 5) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, `Shard` int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def stage(name):
        got = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        got.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    ids = lambda: sorted(r["doc_id"] for r in docs.collect())
    rows = [r for r in rows if good(r[1])]
    docs = stage("quality_rules")
    assert ids() == [r[0] for r in rows] and 20 < len(rows) < len(texts)
    component = brute_components([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    docs = stage("near_duplicates")
    assert ids() == [r[0] for r in rows]
    clean = [r for r in rows if not any(brute_overlap(split(r[1]), item) for item in items)]
    assert 0 < len(rows) - len(clean) <= 6
    rows, docs = clean, stage("decontamination")
    assert ids() == [r[0] for r in rows]
    times = copies(rows)
    docs = stage("mixing")
    assert ids() == sorted(i for i, n in times.items() for _ in range(n))
    texts, slots = {i: t for i, t, _ in rows}, {}
    for r in stage("sharding").collect():
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data)) and r["input_Shard"] == 5
        assert (r["shard"], r["grown_shard"]) == (brute_shard(str(r["doc_id"]), 40), brute_shard(str(r["doc_id"]), 41))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, slots.values())) == sum(times.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
