"""Periodic runs of words, found on a harmonic grid.

A run of period q is a longest stretch in which words q apart are equal, of 2 q words at least.
So the places t with word t equal to word t + q are q or more in a row, and one of them is a
multiple of q. For each period q the grid has the multiples of q: n (1 + 1/2 + 1/3 ...) pairs of
(period, grid point) in a text of n words. A pair whose word differs from the word q later is
none; for all others at once, over all texts of a batch, binary search on prefix hashes says how
far the equality goes on to both sides. Stretches that are long enough are compared word by word,
by their bytes; a text whose hashes turn out to collide is gone through without them. A stretch
that several grid points or multiples of its period give is one run, of the smallest period.

Every row is worked on by itself, in slabs of ``PAIRS`` pairs, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, words_column
from .sharding import let
from .words import _STEP, U64, Words, _power, words

#: Fewest words of a run, and pairs of (period, grid point) that are looked at together.
LEAST, PAIRS = 12, 1 << 19


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a[i] and b[i] have the same bytes."""
    size = end[a] - start[a]
    same = size == end[b] - start[b]
    at = np.flatnonzero(same)
    for i in range(0, len(at), PAIRS):
        part = at[i : i + PAIRS]
        n = size[part]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(start[a[part]], n) + step] == data[np.repeat(start[b[part]], n) + step]
        same[part] = np.add.reduceat(equal, first) == n if len(n) else True
    return same


def _reach(sums: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i and j on (back: before them) are equal in a row, ``most`` at the most; all pairs at once."""
    up = _power(1)[0]
    shift = up[j - i]
    low, high = np.zeros(len(i), np.int64), most.copy()
    while True:
        at = np.flatnonzero(low < high)
        if not len(at):
            return low
        mid = (low[at] + high[at] + 1) >> 1
        a, b = (i[at] - mid, j[at] - mid) if back else (i[at], j[at])
        equal = (sums[a + mid] - sums[a]) * shift[at] == sums[b + mid] - sums[b]
        low[at[equal]] = mid[equal]
        high[at[~equal]] = mid[~equal] - 1


def _plainly(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs of one text by comparing each word with that each period later."""
    n, found = len(ids), {}
    for p in range(n // 2, 0, -1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids[p:] == ids[:-p]).astype(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= max(p, least - p):
                found[s, e + p - s] = p
    return sorted((s, size, p) for (s, size), p in found.items())


def find(w: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all rows: row, first word in it, length, period, in this order."""
    counts = w.counts()
    hashes = w.hashes()
    up, _ = _power(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    rows = np.flatnonzero(counts >= least)
    periods = counts[rows] // 2
    row = np.repeat(rows, periods)
    period = np.arange(len(row)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = np.append(0, np.cumsum((counts[row] - 1) // period))
    out = [np.zeros((4, 0), np.int64)]
    k = 0
    while k < len(row):
        e = max(k + 1, int(np.searchsorted(points, points[k] + PAIRS, "right")) - 1)
        n = np.diff(points[k : e + 1])
        r, p = np.repeat(row[k:e], n), np.repeat(period[k:e], n)
        i = w.bounds[r] + (np.arange(len(r)) - np.repeat(points[k:e] - points[k], n)) * p
        k = e
        keep = np.flatnonzero(hashes[i] == hashes[i + p])
        r, p, i = r[keep], p[keep], i[keep]
        # a stretch that goes back a whole period has its grid point there
        before = _reach(sums, i, i + p, np.minimum(i - w.bounds[r], p), True)
        keep = np.flatnonzero(before < p)
        r, p, i, before = r[keep], p[keep], i[keep], before[keep]
        ahead = _reach(sums, i, i + p, w.bounds[r + 1] - i - p, False)
        keep = np.flatnonzero(ahead + before >= np.maximum(p, least - p))
        r, p, i, ahead, before = (x[keep] for x in (r, p, i, ahead, before))
        out.append(np.stack([r, i - before - w.bounds[r], ahead + before + p, p]))
    r, start, length, p = np.concatenate(out, axis=1)
    order = np.lexsort((p, length, start, r))
    r, start, length, p = (x[order] for x in (r, start, length, p))
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    r, start, length, p = (x[new] for x in (r, start, length, p))
    wrong = _unlike(w, r, start, length, p)
    if len(wrong):
        keep = ~np.isin(r, wrong)
        plain = [(q, *run) for q in wrong.tolist() for run in _plainly(np.unique([w.data[s:e].tobytes() for s, e in zip(w.start[w.bounds[q] : w.bounds[q + 1]], w.end[w.bounds[q] : w.bounds[q + 1]])], return_inverse=True)[1], least)]
        r, start, length, p = np.concatenate([np.stack([r, start, length, p])[:, keep], np.array(plain, np.int64).reshape(-1, 4).T], axis=1)
        order = np.lexsort((p, start, r))
        r, start, length, p = (x[order] for x in (r, start, length, p))
    return r, start, length, p


def _unlike(w: Words, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows with a run whose words a period apart aren't equal, though their hashes are."""
    wrong, size = [], np.append(0, np.cumsum(length - period))
    k = 0
    while k < len(row):
        e = max(k + 1, int(np.searchsorted(size, size[k] + PAIRS, "right")) - 1)
        n = np.diff(size[k : e + 1])
        a = np.repeat(w.bounds[row[k:e]] + start[k:e], n) + np.arange(int(n.sum())) - np.repeat(size[k:e] - size[k], n)
        same = same_words(w.data, w.start, w.end, a, a + np.repeat(period[k:e], n))
        wrong.append(np.repeat(row[k:e], n)[~same])
        k = e
    return np.unique(np.concatenate(wrong)) if wrong else np.zeros(0, np.int64)


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row doc_id, n_words, runs (array of start, length, period, in this order) and collapsed, the text without repeats.

    Takes doc_id and text. collapsed has the words that no run holds after its first period, joined
    by one space. A null, empty or blank text has no word and no run, and collapsed is empty. Rows
    are judged alone, so null or repeated ids and repeated rows change nothing. Very long texts are
    worked on whole, in slabs. Other columns aren't read. An empty table gives an empty result.
    """

    def make(batch: pa.RecordBatch):
        for w in words(batch.column(1)):
            row, start, length, period = find(w, least)
            gone = np.zeros(w.bounds[-1] + 1, np.int64)
            np.add.at(gone, w.bounds[row] + start + period, 1)
            np.add.at(gone, w.bounds[row] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            bounds = np.searchsorted(row, np.arange(w.rows + 1))
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            yield {
                "doc_id": batch.column(0).slice(w.first, w.rows),
                "n_words": pa.array(w.counts(), pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each),
                "collapsed": _joined(w, kept),
            }

    return map_arrow(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", make)


def _joined(w: Words, kept: np.ndarray) -> pa.Array:
    """Per row the words ``kept`` (ascending), joined by one space."""
    size = w.end[kept] - w.start[kept]
    bounds = np.searchsorted(kept, w.bounds)
    gap = np.ones(len(kept), np.int64)  # a space after each word but a row's last
    gap[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = 0
    at = np.append(0, np.cumsum(size + gap))
    data = np.full(at[-1], 0x20, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(at[:-1], size) + step] = w.data[np.repeat(w.start[kept], size) + step]
    return pa.Array.from_buffers(pa.large_string(), w.rows, [None, pa.py_buffer(at[bounds].astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document by the CRC-32 of its doc_id repeats a stretch of its words to its end; see the query's contract."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(all_words: Column) -> Column:
        n = F.size(all_words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, all_words[i]).otherwise(all_words[a + (i - a) % p])), " ")

    text = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), let(words_column(F.col("text")), repeated)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: Equal words of a text, the places between them in a row for each distance (islands), and the rows of the contract; CRC-32 as in sharding.
SQL = r"""
WITH t AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS n))),
b AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
  xor(list_reduce(list_prepend(4294967295, [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..')]), lambda c, v: xor(c // 256, crc[xor(c % 256, v) + 1])), 4294967295) AS h FROM documents, t),
g AS (SELECT id, doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM b),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS q FROM g),
d AS (SELECT id, doc_id, CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % q END + 1] FOR i IN range(n)] END AS w FROM p),
x AS (SELECT id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
e AS (SELECT x.id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.id, y.i - x.i ORDER BY x.i) AS island
  FROM x JOIN x y ON x.id = y.id AND x.word = y.word AND x.i < y.i),
s AS (SELECT id, q, min(i) AS start, count(*) AS n FROM e GROUP BY id, q, island HAVING count(*) >= greatest(q, 12 - q)),
r AS (SELECT id, start, n + q AS length, min(q) AS period FROM s GROUP BY id, start, n + q),
l AS (SELECT id, count(*) AS n_runs, arg_max(start, (length, -start, -period)) AS start, arg_max(length, (length, -start, -period)) AS length, arg_max(period, (length, -start, -period)) AS period,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY id),
k AS (SELECT id, i FROM (SELECT id, unnest(range(start + period, start + length)) AS i FROM r) GROUP BY id, i),
c AS (SELECT x.id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN k ON x.id = k.id AND x.i = k.i GROUP BY x.id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l USING (id) LEFT JOIN c USING (id)
"""
