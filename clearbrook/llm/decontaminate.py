"""Benchmark decontamination with spaced-seed hashing.

A seed is a fixed mask over successive words; words at its 0 positions are ignored, so a
replaced word there doesn't spoil the hash. The seeds of the benchmark's items are joined
with those of the documents; a hit puts an item on a diagonal of the document, and on that
diagonal the words are compared one by one. A document is contaminated where ``span``
aligned words (or the whole item, if shorter) have at most one substitution in ``per``.
Words are compared in lower case.

The masks find every run of 13 words with 2 substitutions, and every item of 8 to 12 words with
as many as are allowed (tests try all lengths and places). Items shorter than the longest mask
are looked up whole. Items are taken in blocks of a bounded number of words, which are
broadcast as hash indexes; further blocks mean further passes, whatever the size. Hits of words
that repeat are expanded part by part, and not at all for items that are found as a whole, so
memory doesn't grow with the product of their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, stored
from .words import combined, words

MASKS = ("11111", "110111", "1011011", "11001101")
#: With MASKS they find any two substitutions in items of 10 and 11 words; longer and shorter items don't need them.
SHORT_MASKS, SHORT_WORDS = ("101111", "111101"), 11
SPAN, PER = 13, 5
BLOCK_WORDS = 200_000
#: Pairs of a document's and an item's place that are expanded at a time.
MOST_PAIRS = 1 << 18


def places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _at(bounds: np.ndarray, size: int) -> np.ndarray:
    """Words at which ``size`` words of one row begin."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    return np.arange(n.sum()) + np.repeat(bounds[:-1] - np.cumsum(n) + n, n)


def build_index(ids: list, texts: list[str]) -> dict:
    """Seed hashes of a block of items: for each mask the values in ascending order, each item's places of a value together."""
    hashes, bounds = [], [0]
    for w in words(pc.utf8_lower(pa.array(texts, pa.string()))):
        hashes.append(w.hashes())
        bounds += (w.bounds[1:] + bounds[-1] - w.bounds[0]).tolist()
    h, bounds = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(bounds)
    n = np.diff(bounds)
    wide = max(map(len, MASKS))
    seeds = []
    for mask in (*MASKS, *SHORT_MASKS, *sorted({int(k) for k in n if 0 < k < wide})):
        size = mask if isinstance(mask, int) else len(mask)
        where = list(range(size)) if isinstance(mask, int) else places(mask)
        at = _at(bounds, size)
        item = np.searchsorted(bounds, at, "right") - 1
        short = n[item] < wide
        at = at[(n[item] == size) & short] if isinstance(mask, int) else at[~short & ((n[item] <= SHORT_WORDS) | (mask not in SHORT_MASKS))]
        if not len(at):
            continue
        value, item = combined(h, at, where), np.searchsorted(bounds, at, "right") - 1
        order = np.lexsort((at, item, value))
        value, item, at = value[order], item[order], at[order]
        first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (item[1:] != item[:-1])))
        seeds.append((size, where, value[first], item[first], first, np.diff(np.append(first, len(at))), at))
    return {"ids": ids, "h": h, "bounds": bounds, "seeds": seeds}


def longest(same: np.ndarray, span: int, per: int) -> int:
    """Most aligned words in a run that is clean enough; 0 if none is ``span`` long.

    Windows of ``span`` words are clean enough if at most span // per words differ; the run is
    the union of overlapping clean windows.
    """
    span = min(span, len(same))
    wrong = np.cumsum(np.append(0, ~same))
    ok = np.flatnonzero(wrong[span:] - wrong[:-span] <= (span // per if span >= max(map(len, MASKS)) else 0))
    if not len(ok):
        return 0
    cuts = np.flatnonzero(np.diff(ok) > span)
    starts, ends = ok[np.append(0, cuts + 1)], ok[np.append(cuts, len(ok) - 1)]
    return int((ends - starts).max()) + span


def _parts(n: np.ndarray) -> Iterator[slice]:
    """Runs of entries that make MOST_PAIRS pairs at most, or one entry."""
    total, i = np.append(0, np.cumsum(n)), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, total[i] + MOST_PAIRS, "right")) - 1)
        yield slice(i, j)
        i = j


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, n of them, for each entry."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def probe(h: np.ndarray, bounds: np.ndarray, index: dict, span: int, per: int) -> dict[tuple[int, int], int]:
    """(row, item) of the verified overlaps of some rows, and the most aligned words of each."""
    best: dict[tuple[int, int], int] = {}
    seen: set[tuple[int, int, int]] = set()
    whole: set[int] = set()  # row and item of what is found as a whole: nothing longer can be found
    ih, ib = index["h"], index["bounds"]

    def left(row: np.ndarray, item: np.ndarray) -> np.ndarray:
        return ~np.isin(row * len(ib) + item, np.fromiter(whole, np.int64, len(whole))) if whole else np.ones(len(row), bool)

    for size, where, value, items, first, count, at in index["seeds"]:
        here = _at(bounds, size)
        mine = combined(h, here, where)
        low = np.searchsorted(value, mine)
        hit = np.flatnonzero(value[np.minimum(low, len(value) - 1)] == mine)
        low, here = low[hit], here[hit]
        k = np.searchsorted(value, mine[hit], "right") - low
        for part in _parts(k):
            group, place = _each(low[part], k[part]), np.repeat(here[part], k[part])
            row = np.searchsorted(bounds, place, "right") - 1
            for some in _parts(count[group]):
                g, r = group[some], row[some]
                keep = left(r, items[g])
                g, r, p = g[keep], r[keep], place[some][keep]
                n = count[g]
                found = np.column_stack([np.repeat(r, n), np.repeat(items[g], n), np.repeat(p, n) - at[_each(first[g], n)]])
                for r, i, shift in map(tuple, (np.unique(found, axis=0) if len(found) > 1 else found).tolist()):
                    if (r, i, shift) in seen or r * len(ib) + i in whole:
                        continue
                    seen.add((r, i, shift))
                    a, b = max(ib[i], bounds[r] - shift), min(ib[i + 1], bounds[r + 1] - shift)
                    if b - a >= min(span, ib[i + 1] - ib[i]) and (words_ := longest(ih[a:b] == h[a + shift : b + shift], span, per)):
                        best[r, i] = max(best.get((r, i), 0), words_)
                        if words_ == ib[i + 1] - ib[i]:
                            whole.add(int(r * len(ib) + i))
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, per: int = PER) -> DataFrame:
    """(doc_id, digest, item_id, words) of every verified overlap between a document and an item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("trim(text) <> ''")
    total = items.agg(F.sum(F.length("text") / 2 + 1).alias("n")).first()["n"] or 0
    blocks = int(total // BLOCK_WORDS) + 1
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = docs.sparkSession.sparkContext.broadcast(build_index([r["item_id"] for r in own], [r["text"] for r in own]))

        def look(batch, index=index):
            doc, item, n = [], [], []
            for w in words(pc.utf8_lower(batch.column(1))):
                for (r, i), k in probe(w.hashes(), w.bounds, index.value, span, per).items():
                    doc.append(int(w.first + r))
                    item.append(index.value["ids"][i])
                    n.append(k)
            if doc:
                yield {"doc_id": batch.column(0).take(pa.array(doc)), "digest": batch.column(2).take(pa.array(doc)), "item_id": pa.array(item, pa.int64()), "words": pa.array(n, pa.int64())}

        hits = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest")), "doc_id long, digest long, item_id long, words long", look)
        out = hits if out is None else out.union(hits)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, per: int = PER) -> DataFrame:
    """A row per distinct (doc_id, text): doc_id, digest, contaminated, n_items, items, matched_words.

    Texts are compared whole, however long. Null, empty and blank texts are clean; such items of the benchmark are ignored, and an empty
    benchmark leaves every document clean. Rows without doc_id are judged by their text like all
    others. Repeated rows are judged once; digest is the xxhash64 of the text. Other columns are ignored.
    """
    found = overlaps(docs, benchmark, span, per).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("words").alias("matched_words"))
    all_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest")).distinct()
    found = found.toDF("_id", "_digest", "items", "matched_words")
    joined = all_.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("doc_id", "digest", F.col("matched_words").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("matched_words", F.lit(0)).alias("matched_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, per: int = PER) -> DataFrame:
    """The rows of docs, all columns, whose text has no verified overlap with the benchmark."""
    bad = stored(overlaps(docs, benchmark, span, per).select("digest").distinct(), "contaminated")
    return docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("digest")).join(bad, "digest", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """items: the ids, joined by commas."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).select("doc_id", "contaminated", "n_items", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"), "matched_words")


#: Without seeds: at most 2 substitutions leave three words in a row, so aligned places are found by those and compared word by word.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS dw FROM (SELECT DISTINCT doc_id, text FROM documents)),
i AS (SELECT item_id, iw, len(iw) AS n, least(13, len(iw)) AS span FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS iw FROM benchmark WHERE trim(text) <> '') WHERE len(iw) > 0),
ig AS (SELECT item_id, p, least(3, n) AS size, array_to_string(iw[p:p + least(3, n) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - least(3, n) + 2)) AS p FROM i)),
dg AS (SELECT id, p, size, array_to_string(dw[p:p + size - 1], ' ') AS g FROM (SELECT id, dw, size, unnest(range(1, len(dw) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM ig))),
c AS (SELECT DISTINCT id, item_id, dg.p - ig.p AS shift FROM dg JOIN ig USING (size, g)),
o AS (SELECT c.*, dw, iw, n, span, CASE WHEN span >= 8 THEN span // 5 ELSE 0 END AS most, greatest(1, 1 - shift) AS a, least(n, len(dw) - shift) AS b FROM c JOIN d USING (id) JOIN i USING (item_id)),
x AS (SELECT id, item_id, shift, span, most, [CASE WHEN iw[j] = dw[j + shift] THEN 0 ELSE 1 END FOR j IN range(a, b + 1)] AS wrong FROM o WHERE b - a + 1 >= span),
k AS (SELECT id, item_id, shift, span, s FROM (SELECT *, unnest(range(1, len(wrong) - span + 2)) AS s FROM x) WHERE list_sum(wrong[s:s + span - 1]) <= most),
r AS (SELECT *, sum(new) OVER (PARTITION BY id, item_id, shift ORDER BY s) AS run FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY id, item_id, shift ORDER BY s) <= span THEN 0 ELSE 1 END AS new FROM k)),
m AS (SELECT id, item_id, max(words) AS words FROM (SELECT id, item_id, max(s) - min(s) + any_value(span) AS words FROM r GROUP BY id, item_id, shift, run) GROUP BY id, item_id),
t AS (SELECT id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(words) AS matched_words FROM m GROUP BY id)
SELECT doc_id, t.id IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, CAST(coalesce(matched_words, 0) AS BIGINT) AS matched_words
FROM d LEFT JOIN t ON d.id = t.id
"""
