"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is factored against text that stands earlier in the corpus (a smaller doc_id, or
an earlier place in the same document). The reference is the corpus itself: each document is a
reference block for all that come after it, and an index says where to factor.

1. Anchors. Of each window of ``window`` words the smallest hash among its ``gram``-word
   runs is its anchor, so equal windows have equal anchors at equal places. About one word
   in seven begins an anchor; anchors found once can't lead to a factor.
2. Index. Windows whose anchor is found again are looked up by 96 bits of hash of all their
   words; the earliest place (doc_id, then position) of a window is its reference.
3. Parse. In each document a factor is proposed at a window with a reference and extended
   greedily while the next window continues in the same block; where it doesn't, the window
   over the boundary opens the next factor.
4. Factors. The proposed stretches of the reference blocks are fetched as words, in pieces of
   ``PIECE`` words, and the document's words are compared with them. Factors are the maximal
   stretches of equal words that continue in one block; those of ``window`` words or more are
   the duplicate spans. No word goes that wasn't compared, whatever the hashes say.

Exact copies of a smaller doc_id (equal SHA-256) are one factor each and skip the index.

Skew: a task sends one entry for each hash it holds, after settling its own repeats, so a
passage that a third of the rows share gives one entry per task, not per row. Each stretch of a
block is fetched once, however many documents refer to it, and frequent ones are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary, bucket_count, join_counted, map_arrow, map_groups, packed, stored, unpacked
from .words import U64, Words, combined, mix, windows, words

WINDOW, GRAM, PIECE = 20, 8, 256
_ENTRIES = "bucket int, doc_id long, key long, hash binary, check binary, doc binary, row binary, at binary, ref binary, refkey binary, start binary"
_FOUND = {"start": np.int32, "ref": np.int64, "refkey": np.int64, "at": np.int32}


def _anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the rows: its row, its start in words, its anchor's start and its anchor's hash."""
    n = np.maximum(w.counts() - window + 1, 0)
    row = np.repeat(np.arange(w.rows), n)
    first = np.concatenate([[0], np.cumsum(n)])
    word = np.arange(first[-1]) - first[row] + w.bounds[row] if len(row) else np.zeros(0, np.int64)
    grams, bounds = windows(w.hashes(), w.bounds, gram)
    if not len(word):
        return row, word, word, grams
    wide = window - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, wide)
    at = bounds[row] + word - w.bounds[row]
    place = np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 16):
        place[i : i + (1 << 16)] = least[at[i : i + (1 << 16)]].argmin(1)
    return row, word - w.bounds[row], word - w.bounds[row] + place, grams[at + place]


def window_hashes(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of the windows that begin at the words ``at``."""
    return combined(h, at, range(window)), (combined(mix(h ^ U64(0x5851F42D4C957F2D)), at, range(window)) >> U64(32)).astype(np.uint32)


def _first_last(hashes: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hashes, doc, at), index of each entry's first of the same hashes, and whether others share them."""
    order = np.lexsort((at, doc, *reversed(hashes)))
    n = len(order)
    new = np.zeros(n, bool)
    new[:1] = True
    for h in hashes:
        new[1:] |= h[order][1:] != h[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(np.flatnonzero(new), n))
    return order, first, np.repeat(size, size) > 1


def _per_row(doc: np.ndarray, key: np.ndarray, n_buckets: int | None, **columns: np.ndarray) -> dict[str, pa.Array]:
    """One row per document (doc_id and key of its text) with its entries packed; n_buckets: also a bucket to travel in."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
    bounds = np.append(first, len(doc))
    doc, key = doc[first], key[first]
    out = {"doc_id": pa.array(doc, pa.int64()), "key": pa.array(key, pa.int64())} | {k: binary(v[order], bounds) for k, v in columns.items()}
    return out | ({"bucket": pa.array(((doc ^ key) % n_buckets).astype(np.int32), pa.int32())} if n_buckets else {})


def _together(table: pa.Table, more: dict[str, pa.Array], names: list[str]) -> dict[str, pa.Array]:
    """What tasks have settled themselves, and what the bucket adds."""
    told = table.filter(table["doc_id"].is_valid())
    return {k: pa.concat_arrays([told[k].combine_chunks() if told.num_rows else pa.nulls(0, more[k].type), more[k]]) for k in names}


def find_anchors(docs: DataFrame, buckets: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document, the starts of its anchors that stand in the corpus more than once: (doc_id, key, start)."""

    def entries(batch: pa.RecordBatch):
        ids = batch.column(0)
        keep = np.asarray(ids.is_valid())
        ids, keys = np.asarray(ids.fill_null(0), np.int64), np.asarray(batch.column(2), np.int64)
        hashes, doc, key, at = [], [], [], []
        for w in words(batch.column(1)):
            row, _, anchor, value = _anchors(w, window, gram)
            if not len(row):
                continue
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) & keep[w.first + row]
            hashes.append(value[new])
            doc.append(ids[w.first + row[new]])
            key.append(keys[w.first + row[new]])
            at.append(anchor[new].astype(np.int32))
        if not hashes:
            return
        hashes, doc, key, at = map(np.concatenate, (hashes, doc, key, at))
        order, first, shared = _first_last((hashes,), doc, at)
        hashes, doc, key, at = hashes[order], doc[order], key[order], at[order]
        one = first == np.arange(len(first))
        sent = np.where(shared, -at - 1, at).astype(np.int32)  # below 0: the document has been told
        yield packed((hashes[one] % U64(buckets)).astype(np.int64), {"hash": hashes[one], "doc": doc[one], "row": key[one], "at": sent[one]})
        if shared.any():
            yield _per_row(doc[shared], key[shared], buckets, start=at[shared])

    def again(table: pa.Table) -> dict[str, pa.Array]:
        hashes, doc, key, at = (unpacked(table[c], kind) for c, kind in (("hash", np.uint64), ("doc", np.int64), ("row", np.int64), ("at", np.int32)))
        order, _, shared = _first_last((hashes,), doc, at)
        new = order[shared]
        new = new[at[new] >= 0]
        return _together(table, _per_row(doc[new], key[new], None, start=at[new]), ["doc_id", "key", "start"])

    sent = map_arrow(docs.select("doc_id", "text", "key"), _ENTRIES, entries)
    return map_groups(sent, ["bucket"], "doc_id long, key long, start binary", again)


def find_references(docs: DataFrame, buckets: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document, its windows that also start earlier and where: (doc_id, key, start, ref, refkey, at).

    ``docs`` has doc_id, text, key and ``anchors``, a list of packed starts (null: none).
    """

    def late_rows(late, buckets, doc, key, at, first):
        return _per_row(doc[late], key[late], buckets, start=at[late], ref=doc[first][late], refkey=key[first][late], at=at[first][late])

    def entries(batch: pa.RecordBatch):
        batch = batch.filter(batch.column(2).is_valid())
        ids, lists, keys = np.asarray(batch.column(0), np.int64), batch.column(2), np.asarray(batch.column(3), np.int64)
        hashes, check, doc, key, at = [], [], [], [], []
        for w in words(batch.column(1)):
            row, start, anchor, _ = _anchors(w, window, gram)
            mark = np.zeros(w.bounds[-1] + 1, bool)  # words at which a repeated anchor starts
            for i in range(w.rows):
                mark[w.bounds[i] + np.frombuffer(b"".join(lists[w.first + i].as_py()), np.int32)] = True
            hit = np.flatnonzero(mark[w.bounds[row] + anchor])
            row, start = row[hit], start[hit]
            for out, value in zip((hashes, check), window_hashes(w.hashes(), w.bounds[row] + start, window), strict=True):
                out.append(value)
            doc.append(ids[w.first + row])
            key.append(keys[w.first + row])
            at.append(start.astype(np.int32))
        if not hashes:
            return
        hashes, check, doc, key, at = map(np.concatenate, (hashes, check, doc, key, at))
        order, first, _ = _first_last((hashes, check), doc, at)
        hashes, check, doc, key, at = (x[order] for x in (hashes, check, doc, key, at))
        one = first == np.arange(len(first))
        yield packed((hashes[one] % U64(buckets)).astype(np.int64), {"hash": hashes[one], "check": check[one], "doc": doc[one], "row": key[one], "at": at[one]})
        late = ~one & ((doc != doc[first]) | (at != at[first]))
        if late.any():
            yield late_rows(late, buckets, doc, key, at, first)

    def earliest(table: pa.Table) -> dict[str, pa.Array]:
        rest = table.filter(table["doc_id"].is_null())
        hashes, check, doc, key, at = (unpacked(rest[c], kind) for c, kind in (("hash", np.uint64), ("check", np.uint32), ("doc", np.int64), ("row", np.int64), ("at", np.int32)))
        order, first, _ = _first_last((hashes, check), doc, at)
        doc, key, at = doc[order], key[order], at[order]
        late = (doc != doc[first]) | (at != at[first])
        return _together(table, late_rows(late, None, doc, key, at, first), ["doc_id", "key", *_FOUND])

    sent = map_arrow(docs.select("doc_id", "text", "anchors", "key"), _ENTRIES, entries)
    return map_groups(sent, ["bucket"], "doc_id long, key long, start binary, ref binary, refkey binary, at binary", earliest)


def parse(start: np.ndarray, ref: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Proposed factors of one document from its windows with references: rows of (start, length, ref, at).

    Starts ascend. A factor goes on while the next word's window refers to the next word of the
    same block; the window that doesn't is the next factor, so that boundaries are covered too.
    """
    if not len(start):
        return np.zeros((0, 4), np.int64)
    new = np.append(True, (np.diff(start) != 1) | (ref[1:] != ref[:-1]) | (np.diff(at) != 1))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(start))) - 1 + window
    return np.column_stack([start[first], length, ref[first], at[first]])


def propose(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """The proposed factors of each document in pieces of PIECE words: (doc_id, key, start, length, ref, refkey, at)."""

    def make(batch: pa.RecordBatch):
        out = {k: [] for k in ("row", "start", "length", "at", "ref", "refkey")}
        for i in range(len(batch)):
            start, ref, refkey, at = (np.frombuffer(b"".join(batch.column(2 + k)[i].as_py()), kind) for k, kind in enumerate(_FOUND.values()))
            order = np.argsort(start, kind="stable")
            start, ref, refkey, at = start[order].astype(np.int64), ref[order], refkey[order], at[order].astype(np.int64)
            block = np.unique(np.column_stack([ref, refkey]), axis=0, return_inverse=True)
            for s, n, b, a in parse(start, block[1].ravel(), at, window).tolist():
                for k in range(0, n, PIECE):
                    for name, v in zip(out, (i, s + k, min(PIECE, n - k), a + k, *block[0][b].tolist()), strict=True):
                        out[name].append(v)
        row = pa.array(out.pop("row"), pa.int64())
        yield {"doc_id": batch.column(0).take(row), "key": batch.column(1).take(row)} | {k: pa.array(v, pa.int64()) for k, v in out.items()}

    own = found.groupBy("doc_id", "key").agg(*(F.collect_list(c).alias(c) for c in _FOUND))
    return map_arrow(own, "doc_id long, key long, start int, length int, ref long, refkey long, at int", make)


def fetch(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """pieces with ``block``, the words of the reference block that each refers to, joined by one space; each stretch is read once."""
    place = F.format_string("%d.%d.%d.%d", "ref", "refkey", "at", "length")
    wanted = pieces.groupBy("ref", "refkey", "at", "length").agg(F.count("*").alias("n"))
    wanted = wanted.groupBy("ref", "refkey").agg(F.collect_list(F.struct("at", "length", "n")).alias("wanted"))

    def read(batch: pa.RecordBatch):
        out = {k: [] for k in ("row", "at", "length", "n", "block")}
        for w in words(batch.column(2)):
            for i in range(w.rows):
                data, a = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes(), w.bounds[i]
                for x in batch.column(3)[w.first + i].as_py():
                    begin, end = w.start[a + x["at"]] - w.offsets[i], w.end[a + x["at"] + x["length"] - 1] - w.offsets[i]
                    for name, v in zip(out, (w.first + i, x["at"], x["length"], x["n"], b" ".join(data[begin:end].split())), strict=True):
                        out[name].append(v)
        row = pa.array(out.pop("row"), pa.int64())
        yield {"ref": batch.column(0).take(row), "refkey": batch.column(1).take(row), "block": pa.array(out.pop("block"), pa.binary())} | {k: pa.array(v, pa.int64()) for k, v in out.items()}

    of = docs.select(F.col("doc_id").alias("ref"), F.col("key").alias("refkey"), "text").join(wanted.hint("shuffle_hash"), ["ref", "refkey"])
    blocks = map_arrow(of, "ref long, refkey long, at int, length int, n long, block binary", read).dropDuplicates(["ref", "refkey", "at", "length"])
    return join_counted(pieces.withColumn("place", place), blocks.select(place.alias("place"), "n", "block"), "place", F.concat_ws(".", "doc_id", "key", "start"), size=F.length("block"))


def factor(words_: list[bytes], pieces: Iterator[tuple[int, int, int, int, bytes]], window: int) -> np.ndarray:
    """Factors (start, length, ref, at) of a document: its words compared with pieces (start, ref, refkey, at, block) in ascending order.

    Equal stretches that continue in one block are one factor, across pieces too.
    """
    out: list[list[int]] = []
    for start, ref, refkey, at, block in pieces:
        block = block.split(b" ")
        same = np.array([x == y for x, y in zip(words_[start : start + len(block)], block, strict=True)]) if words_[start : start + len(block)] != block else np.ones(len(block), bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            last = out[-1] if out else None
            if last and last[0] + last[1] == start + a and last[2:4] == [ref, refkey] and last[4] + last[1] == at + a:
                last[1] += b - a
            else:
                out.append([start + a, b - a, ref, refkey, at + a])
    return np.array([(s, n, r, p) for s, n, r, _, p in out if n >= window], np.int64).reshape(-1, 4)


def exact_copies(docs: DataFrame) -> DataFrame:
    """Documents whose whole text stands under a smaller doc_id: (doc_id, key, original)."""
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", "key", F.sha2("text", 256).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("original < last").drop("last")
    found = join_counted(keyed, first, "digest", F.concat_ws(".", "doc_id", "key"))
    return found.where("doc_id > original").select("doc_id", "key", "original")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove from each document the words under factors of ``window`` words or more.

    Takes doc_id and text; other columns are ignored. Returns a row per input row: doc_id,
    n_words, n_removed, text (the kept words joined by one space), factors (array of start,
    length, ref_doc_id, ref_start, in words). Null and empty texts have no words and stay
    empty. Very long texts are factored whole, their proposals in pieces. Rows without doc_id
    have no place in the order: they stay whole and are no reference. Rows that share a doc_id
    are cut each by its own text, and none is earlier than the other: a window of both at the
    same start stays in both. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    buckets = bucket_count(docs)
    whole = docs.select("doc_id", "key", "text")
    copies = stored(exact_copies(docs), "copies")
    marks = find_anchors(docs, buckets, window, gram).select("doc_id", "key", "start", F.lit(None).cast("long").alias("original"))
    marks = marks.unionByName(copies.select("doc_id", "key", F.lit(None).cast("binary").alias("start"), "original"))
    marks = marks.groupBy("doc_id", "key").agg(F.collect_list("start").alias("anchors"), F.max("original").alias("original"))
    marked = whole.join(marks.hint("shuffle_hash"), ["doc_id", "key"], "left")
    found = find_references(marked.select("doc_id", "text", "key", F.when(F.col("original").isNull(), F.col("anchors")).alias("anchors")), buckets, window, gram)
    pieces = stored(propose(found, window), "pieces")
    fetched = fetch(pieces, docs).select("doc_id", "key", F.struct("start", "ref", "refkey", "at", "block").alias("piece"), F.lit(None).cast("long").alias("original"))
    fetched = fetched.unionByName(copies, allowMissingColumns=True)
    spans = fetched.groupBy("doc_id", "key").agg(F.collect_list("piece").alias("pieces"), F.max("original").alias("original"))

    def cut(batch: pa.RecordBatch):
        ids, text, pieces, original = (batch.column(i) for i in range(4))
        n_words, n_removed, texts, factors = [], [], [], []
        for w in words(text):
            for i in range(w.rows):
                n, row = int(w.bounds[i + 1] - w.bounds[i]), w.first + i
                own = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split()
                if original[row].is_valid and n >= window:
                    rows = np.array([[0, n, original[row].as_py(), 0]])
                else:
                    mine = sorted((p["start"], p["ref"], p["refkey"], p["at"], p["block"]) for p in (pieces[row].as_py() or ()))
                    rows = factor(own, mine, window)
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, rows[:, 0], 1)
                np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
                edge = np.flatnonzero(np.diff(np.concatenate([[1], np.cumsum(gone)[:n] > 0, [1]])))
                kept = [x for b, e in zip(edge[::2], edge[1::2], strict=True) for x in own[b:e]] if len(rows) else own
                n_words.append(n)
                n_removed.append(n - len(kept))
                texts.append(b" ".join(kept))
                factors.append([dict(zip(("start", "length", "ref_doc_id", "ref_start"), map(int, r), strict=True)) for r in rows])
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "ref_doc_id", "ref_start")]))
        yield {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string()), "factors": pa.array(factors, kind)}

    cut_from = whole.join(spans.hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "pieces", "original")
    return map_arrow(cut_from, "doc_id long, n_words long, n_removed long, text string, factors array<struct<start:long,length:long,ref_doc_id:long,ref_start:long>>", cut)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM p) WHERE n > 1),
lead AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM late),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM lead, (SELECT unnest(range(20)) AS k) WHERE k = 19 OR before IS NULL OR before < i - 1 OR k = 19),
words AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS text FROM words x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
