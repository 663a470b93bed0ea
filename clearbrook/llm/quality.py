"""Quality rules with cross-document line frequency.

Base rules look at one document. The line rule looks across a host's documents (here the
column ``source``): the distinct normalised lines of each distinct text are hashed, and a
line that stands in more than max(``least``, ``share`` of the host's texts) of them is
boilerplate; ``least`` only says that a line in three texts or fewer is none. ``judge`` counts the words in such lines; a document that keeps less than
``keep`` of its words is depleted and rejected. ``keep_good`` also takes such lines out of
the documents that stay. Copies of one text count once, so a text isn't rejected for having
been copied.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, stored
from .words import U64, Words, mix, span_hashes, windows, words

LEAST, SHARE, KEEP = 3, 0.05, 0.3
FEWEST_WORDS, MOST_REPEATED = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ROW = "doc_id long, source string, digest binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"


def _per_row(values: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values (which stand at ascending places ``at``) within each row's offsets."""
    total = np.append(0, np.cumsum(values))
    return np.diff(total[np.searchsorted(at, offsets)])


def repeated_words(w: Words, size: int = 3) -> np.ndarray:
    """Per row, words that lie in a run of ``size`` words found twice or more in the text."""
    h, bounds = windows(w.hashes(), w.bounds, size)
    row = np.repeat(np.arange(w.rows), np.diff(bounds))
    order = np.lexsort((h, row))
    h, owner = h[order], row[order]
    same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    twice = np.append(same, False) | np.append(False, same) if len(h) else np.zeros(0, bool)
    window = order[twice]
    word = window - bounds[row[window]] + w.bounds[row[window]]
    mark = np.zeros(w.bounds[-1] + size, bool)
    for k in range(size):
        mark[word + k] = True
    total = np.append(0, np.cumsum(mark))
    return total[w.bounds[1:]] - total[w.bounds[:-1]]


def _lines(w: Words) -> tuple[np.ndarray, ...]:
    """Of each line with words: its first byte, its end, its first word, its last and its row."""
    cut = np.flatnonzero(w.data == 10)
    begin = np.unique(np.concatenate([w.offsets[:-1], cut + 1]))
    begin = begin[begin < len(w.data)]
    end = np.append(begin[1:], len(w.data))
    end = end - (w.data[end - 1] == 10) if len(begin) else end
    low, high = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    full = high > low
    begin, end, low, high = begin[full], end[full], low[full], high[full]
    return begin, end, low, high, np.searchsorted(w.offsets, begin, "right") - 1


def without_lines(text: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines whose hashes are listed; the others, blank ones too, stay as they are. Null where no list is."""
    out = []
    for w in words(text):
        begin, _, low, high, row = _lines(w)
        normal = mix(_sequence(w.hashes(lower=True), low, high)).view(np.int64)
        cut = np.flatnonzero(w.data == 10)
        number = np.searchsorted(cut, begin) - np.searchsorted(cut, w.offsets[row])
        own = np.searchsorted(row, np.arange(w.rows + 1))
        for i in range(w.rows):
            lines = gone[w.first + i].as_py()
            if lines is None:
                out.append(None)
                continue
            here = slice(own[i], own[i + 1])
            dropped = set(number[here][np.isin(normal[here], np.array(lines, np.int64))].tolist())
            parts = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split(b"\n")
            out.append(b"\n".join(p for k, p in enumerate(parts) if k not in dropped))
    return pa.array(out, pa.binary()).cast(pa.string())


def measure(docs: DataFrame) -> DataFrame:
    """Per row the base figures, a digest of the text and its distinct non-blank lines with their words."""

    def make(batch):
        out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        digests, line, count, first = [], [], [], [0]
        for w in words(batch.column(2)):
            out["n_words"].append(w.counts())
            lead = (w.data & 0xC0) != 0x80  # one byte of each code point
            chars = np.append(0, np.cumsum(lead))
            out["word_chars"].append(_per_row(chars[w.end] - chars[w.start], w.start, w.offsets))
            symbols = np.append(0, np.cumsum(_SYMBOL[w.data]))
            out["n_symbols"].append(np.diff(symbols[w.offsets]))
            out["n_repeat_words"].append(repeated_words(w))
            begin, end, low, high, row = _lines(w)
            exact = span_hashes(w.data, begin, end)
            order = np.lexsort((exact, row))
            again = (exact[order][1:] == exact[order][:-1]) & (row[order][1:] == row[order][:-1])
            out["n_dup_lines"].append(np.bincount(row[order][1:][again], minlength=w.rows))
            normal = mix(_sequence(w.hashes(lower=True), low, high))
            for i in range(w.rows):
                digests.append(hashlib.md5(w.data[w.offsets[i] : w.offsets[i + 1]]).digest())
            order = np.lexsort((normal, row))
            r, v, k = row[order], normal[order], (high - low)[order]
            new = np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])) if len(v) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            line.append(v[at].view(np.int64))
            count.append(np.add.reduceat(k, at) if len(at) else k[:0])
            first += (first[-1] + np.cumsum(np.bincount(r[at], minlength=w.rows))).tolist()
        lines = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (line, count)], ["line", "words"])
        yield {"doc_id": batch.column(0), "source": batch.column(1), "digest": pa.array(digests, pa.binary()), "lines": pa.ListArray.from_arrays(pa.array(first, pa.int32()), lines)} | {k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in out.items()}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), _ROW, make)


def _sequence(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of each run of words [low, high): lines that differ only in case or spacing are equal."""
    step, back = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
    n = len(h)
    up = np.multiply.accumulate(np.append(U64(1), np.full(n, step, U64)))
    down = np.multiply.accumulate(np.append(U64(1), np.full(n, back, U64)))
    sums = np.append(U64(0), np.cumsum(h * up[:n], dtype=U64))
    return (sums[high] - sums[low]) * down[low] + (high - low).astype(U64)


def line_limits(texts: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(source, line) of the lines above their host's limit; texts has source, digest, lines."""
    host = texts.groupBy("source").agg(F.count("*").alias("texts")).select(F.col("source").alias("_host"), F.greatest(F.lit(float(least)), F.col("texts") * share).alias("most"))
    used = texts.select("source", F.explode("lines.line").alias("line")).groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return used.join(host, F.col("source").eqNullSafe(F.col("_host"))).where("n > most").select("source", "line")


def _judged(docs: DataFrame, least: int, share: float, keep: float) -> DataFrame:
    """What judge returns, and gone, the hashes of the text's lines above the limit (null: none)."""
    rows = stored(measure(docs), "measured")
    texts = rows.groupBy("source", "digest").agg(F.first("lines").alias("lines"))
    common = line_limits(texts, least, share).toDF("_source", "_line")
    lines = texts.select("source", "digest", F.inline("lines"))
    lost = lines.join(common, F.col("source").eqNullSafe(F.col("_source")) & (F.col("line") == F.col("_line"))).groupBy("source", "digest").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("gone"))
    lost = lost.toDF("_source", "_digest", "lost", "gone")
    full = rows.join(lost, F.col("source").eqNullSafe(F.col("_source")) & (F.col("digest") == F.col("_digest")), "left")
    full = full.withColumn("n_removed", F.coalesce("lost", F.lit(0)).cast("long"))
    full = full.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return full.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= keep * F.col("n_words")))


def judge(docs: DataFrame, least: int = LEAST, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """A row per input row: doc_id, the base figures, base_failed, n_removed, kept, and source and digest.

    Takes doc_id, text and source; other columns are ignored. Null, empty and blank texts have no
    words and fail the base rule. Rows without source form one host. Rows without doc_id and
    repeated rows are judged by their text like all others. An empty table gives an empty result.
    """
    return _judged(docs, least, share, keep).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept", "source", "digest")


def keep_good(docs: DataFrame, least: int = LEAST, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """The rows of docs, all columns, that the rules keep, their texts without the lines above the limit.

    Where lines go, a column n_chars becomes the length of what is left.
    """
    good = _judged(docs, least, share, keep).where("kept").groupBy(F.col("source").alias("_source"), F.lower(F.hex("digest")).alias("_digest")).agg(F.first("gone").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("host"), F.md5("text").alias("digest"))
    rows = rows.join(good, F.col("host").eqNullSafe(F.col("_source")) & (F.col("digest") == F.col("_digest"))).select("row", "gone")
    # null unless lines go, so that other texts aren't sent to Python
    cut = F.arrow_udf(without_lines, "string")(F.when(F.col("gone").isNotNull(), F.col("row.text")), F.col("gone"))
    rows = rows.select("row", cut.alias("cut"))
    new = {"text": F.coalesce("cut", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut").isNotNull(), F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


#: The line rule with the parameters above; lines are compared in lower case with single spaces.
SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT doc_id, source, digest, text, ws, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
tri AS (SELECT doc_id, i, ws[i:i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM b)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, digest, unnest(string_split(text, chr(10))) AS line FROM b),
f AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM f WHERE len(lw) > 0 GROUP BY doc_id, line) GROUP BY doc_id),
norm AS (SELECT doc_id, source, digest, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, len(lw) AS k FROM f WHERE len(lw) > 0),
host AS (SELECT source, count(DISTINCT digest) AS texts FROM b GROUP BY source),
used AS (SELECT source, line, count(DISTINCT digest) AS n FROM norm GROUP BY source, line),
common AS (SELECT u.source, u.line FROM used u JOIN host h ON u.source IS NOT DISTINCT FROM h.source WHERE u.n > greatest(3, 0.05 * h.texts)),
lost AS (SELECT n.doc_id, sum(n.k) AS k FROM norm n JOIN common c ON n.line = c.line AND n.source IS NOT DISTINCT FROM c.source GROUP BY n.doc_id),
j AS (SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.k, 0) AS lost
  FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - lost >= 0.3 * n_words AS kept, CAST(lost AS BIGINT) AS n_removed FROM j
"""
