"""Packing tokenised documents into training sequences by non-negative least squares.

1. Lengths. A document of n ids fills n // window sequences by itself; what is left over, less
   than a window, is an item. One count of all items by length is the histogram, of window - 1 rows.
2. Combinations. Lengths are rounded up to units. Shallow combinations that fill a window are
   enumerated: up to ``DEPTH`` lengths, or two lengths repeated.
3. Least squares. How often each combination is to be used so that all together need as many
   items of each length as there are, no count below 0, is solved once for the whole corpus (active
   sets, after Lawson and Hanson); at most one combination a length stays.
4. Rounding. Tasks work on the items as they read them, a bounded cell at a time, and use each
   combination as often as its rate times the items seen so far, rounded down, less what they have
   used; so rounding errors don't add up, whatever the order of the documents.
5. Residuals. Items that no combination took fill, cut where a sequence ends, the gaps that the
   rounding of lengths left; the rest goes on to the next cell, or greedily, longest first, into
   whole sequences. What a task has at its end, less than a window, goes into sequences of powers
   of two, which aren't padded. So no sequence has padding, and most documents aren't cut.

Nothing is shuffled but counts: a document's ids stay in the task that reads them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, stored
from .tokens import encoder

WINDOW, END = 2048, 1
#: Ids in a unit of length, most lengths in a combination without repeats, ids that a task packs at once.
UNIT, DEPTH, CELL = 32, 4, 1 << 22


def tokenized(docs: DataFrame, source: str, end: int = END) -> DataFrame:
    """(doc_id, ids, n) per row: ids, little-endian, of two bytes where the vocabulary allows, ended by ``end``; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(source)  # a vocabulary: its size doesn't follow the data

    def make(batches: Iterator[pa.RecordBatch]):
        encode = encoder(shared.value)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                ids = encode.encode([t or "" for t in part.column(1).to_pylist()])
                yield {
                    "doc_id": part.column(0),
                    "ids": pa.array([np.append(x, encode.kind.type(end)).tobytes() for x in ids], pa.binary()),
                    "n": pa.array([len(x) + 1 for x in ids], pa.int64()),
                    "width": pa.array([encode.kind.itemsize] * len(ids), pa.int32()),
                }

    return map_batches(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n long, width int", make)


def combinations(units: int, depth: int = DEPTH) -> np.ndarray:
    """How often each length (row l: l + 1 units) stands in each combination (column) that fills ``units``."""
    found = set()

    def add(parts: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.add(parts)
        elif len(parts) < depth:
            for p in range(min(left, most), 0, -1):
                if p * (depth - len(parts)) >= left:
                    add((*parts, p), left - p, p)

    add((), units, units)
    for a in range(1, units + 1):
        for times in range(1, units // a + 1):
            left = units - a * times
            if not left:
                found.add((a,) * times)
            for b in range(1, min(a, left + 1)):
                if left % b == 0:
                    found.add((a,) * times + (b,) * (left // b))
    out = np.zeros((units, len(found)))
    for c, parts in enumerate(sorted(found, reverse=True)):
        np.add.at(out[:, c], np.array(parts) - 1, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that makes |a x - b| smallest, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    least = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * n):
        pull = np.where(free, -np.inf, a.T @ (b - a @ x))
        j = int(pull.argmax())
        if pull[j] <= least:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min() > 0:
                break
            below = s <= 0
            step = (x[at][below] / np.maximum(x[at][below] - s[below], 1e-300)).min()
            x[at] += step * (s - x[at])
            free[at[x[at] <= 1e-14]] = False
            x[~free] = 0
            if not free.any():
                return x
        x[:] = 0
        x[at] = s
    return x


def rates(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT) -> list[tuple[list[int], float]]:
    """The combinations to use, each as its lengths in units, longest first, and how often for each item; the most used first."""
    units = -(-window // unit)
    counts = np.zeros(units)
    for length, n in histogram.items():
        counts[-(-length // unit) - 1] += n
    if not counts.sum():
        return []
    a = combinations(units)
    x = nnls(a, counts / counts.sum())
    return [([int(p) + 1 for p in np.repeat(np.arange(units), a[:, c].astype(int))[::-1]], float(x[c])) for c in np.argsort(-x, kind="stable") if x[c] > 0]


class Packer:
    """What one task packs: documents come in, pieces go out. Sequences are numbered from 0."""

    def __init__(self, plan: list[tuple[list[int], float]], window: int, unit: int):
        self.plan, self.window, self.unit = plan, window, unit
        self.seen, self.used, self.sequences = 0, [0] * len(plan), 0
        self.ids: list[np.ndarray] = []  # of the documents of the cell
        self.rows: list = []
        self.known = 0  # of them, documents of earlier cells
        self.item = np.zeros((0, 3), np.int64)  # document, start, length of what waits for a place

    def number(self, n: int) -> np.ndarray:
        self.sequences += n
        return np.arange(self.sequences - n, self.sequences)

    def add(self, row, ids: np.ndarray) -> None:
        self.rows.append(row)
        self.ids.append(ids)

    def pour(self, items: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts items, in order, into the gaps, in order, which they can fill: (document, start, length, gap, place in it) rows, and the items left."""
        ends, full = np.cumsum(items[:, 2]), np.cumsum(gaps)
        total = int(full[-1]) if len(full) else 0
        at = np.unique(np.concatenate([[0], ends[ends < total], full]))
        low, size = at[:-1], np.diff(at)
        i, g = np.searchsorted(ends, low, "right"), np.searchsorted(full, low, "right")
        pieces = np.stack([items[i, 0], items[i, 1] + low - (ends[i] - items[i, 2]), size, g, low - (full[g] - gaps[g])], axis=1) if len(low) else np.zeros((0, 5), np.int64)
        k = int(np.searchsorted(ends, total, "right"))
        rest = items[k:].copy()
        if len(rest):
            done = total - (int(ends[k]) - int(items[k, 2]))
            rest[0] += np.array([0, done, -done])
        return pieces, rest

    def combine(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items by the plan: those taken as (item, sequence, place), and the ids of each sequence."""
        length = -(-items[:, 2] // self.unit)
        order = np.argsort(length, kind="stable")
        units = -(-self.window // self.unit)
        next_ = np.searchsorted(length[order], np.arange(1, units + 2))
        last = next_[1:].copy()
        next_ = next_[:-1].copy()
        taken, filled, n = [], [], 0
        for c, (parts, rate) in enumerate(self.plan):
            kinds, times = np.unique(parts, return_counts=True)
            often = min(int(rate * self.seen) - self.used[c], int(((last - next_)[kinds - 1] // times).min()))
            if often <= 0:
                continue
            self.used[c] += often
            place = np.zeros(often, np.int64)
            for p in parts:
                own = order[next_[p - 1] : next_[p - 1] + often]
                next_[p - 1] += often
                taken.append(np.stack([own, n + np.arange(often), place], axis=1))
                place = place + items[own, 2]
            filled.append(place)
            n += often
        return (np.concatenate(taken) if taken else np.zeros((0, 3), np.int64)), (np.concatenate(filled) if filled else np.zeros(0, np.int64))

    def cell(self, last: bool) -> np.ndarray:
        """(document, start, length, sequence, place) of what finds its place now; with ``last``, of all."""
        n = np.array([len(x) for x in self.ids[self.known :]], np.int64)
        doc = np.arange(self.known, len(self.ids))
        whole = np.repeat(doc, n // self.window)
        start = (np.arange(len(whole)) - np.repeat(np.cumsum(n // self.window) - n // self.window, n // self.window)) * self.window
        out = [np.stack([whole, start, np.full(len(whole), self.window), self.number(len(whole)), np.zeros(len(whole), np.int64)], axis=1)]
        left = n % self.window
        new = np.stack([doc, n - left, left], axis=1)[left > 0]
        self.seen += len(new)
        items = np.concatenate([self.item, new])
        taken, filled = self.combine(items)
        rest = np.ones(len(items), bool)
        rest[taken[:, 0]] = False
        gaps = self.window - filled
        # sequences with the widest gaps are taken apart again until what is left can fill the gaps of the others
        order = np.argsort(-gaps, kind="stable")
        have = int(items[rest, 2].sum()) + np.append(0, np.cumsum(filled[order]))
        need = int(gaps.sum()) - np.append(0, np.cumsum(gaps[order]))
        apart = np.zeros(len(gaps), bool)
        apart[order[: int((have >= need).argmax())]] = True
        back = apart[taken[:, 1]]
        rest[taken[back, 0]] = True
        taken = taken[~back]
        number = np.full(len(gaps), -1)
        number[~apart] = self.number(int((~apart).sum()))
        out.append(np.column_stack([items[taken[:, 0]], number[taken[:, 1]], taken[:, 2]]))
        items = items[rest]
        items = items[np.argsort(-items[:, 2], kind="stable")]
        open_ = np.flatnonzero(~apart & (gaps > 0))
        items = self.filled(out, items, gaps[open_], number[open_], filled[open_])
        total = int(items[:, 2].sum())
        if last or total > CELL // 4:
            n = total // self.window
            items = self.filled(out, items, np.full(n, self.window), self.number(n), np.zeros(n, np.int64))
        if last and len(items):
            total = int(items[:, 2].sum())
            digits = np.array([1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1], np.int64)
            items = self.filled(out, items, digits, self.number(len(digits)), np.zeros(len(digits), np.int64))
        self.item = items
        return np.concatenate(out)

    def filled(self, out: list[np.ndarray], items: np.ndarray, gaps: np.ndarray, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        pieces, items = self.pour(items, gaps)
        pieces[:, 4] += place[pieces[:, 3]]
        pieces[:, 3] = number[pieces[:, 3]]
        out.append(pieces)
        return items

    def forget(self) -> None:
        """Keeps the documents of waiting items only, numbered anew."""
        own, self.item[:, 0] = np.unique(self.item[:, 0], return_inverse=True)
        self.ids, self.rows = [self.ids[i].copy() for i in own], [self.rows[i] for i in own]
        self.known = len(own)


def pack(docs: DataFrame, source: str, end: int = END, window: int = WINDOW, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids.

    Takes doc_id and text, and ``source``, the content of a tokenizer file. Each id of each row,
    the ``end`` id included, lies in one piece; pieces fill sequences from offset 0 without gaps to
    ``window`` or a power of two, and sequences are numbered from 0 without gaps. Null and empty
    texts are the end id alone. Rows without doc_id or with a repeated one are packed for
    themselves; their pieces can be told apart by sequence and offset. Very long texts fill whole
    sequences. Other columns aren't read. An empty table gives no piece.
    """
    rows = stored(tokenized(docs, source, end), "tokens")
    counts = rows.select((F.col("n") % window).alias("length")).where("length > 0").groupBy("length").count().collect()  # a row per length
    plan = rates({r["length"]: r["count"] for r in counts}, window, unit)
    key = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]):
        packer, task = Packer(plan, window, unit), TaskContext.get().partitionId()
        waiting = 0

        def pieces(last: bool):
            found = packer.cell(last)
            doc, start, length, sequence, place = found.T
            cut = [packer.ids[d][s : s + n].astype("<u4") for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            out = {
                "doc_id": pa.array([packer.rows[d] for d in doc.tolist()], kind),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(c.data) for c in cut], pa.int64()),
                "doc_tokens": pa.array([len(packer.ids[d]) for d in doc.tolist()], pa.int64()),
                "task": pa.array(np.full(len(doc), task), pa.int32()),
                "sequence": pa.array(sequence, pa.int64()),
                "offset": pa.array(place, pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64()))
            packer.forget()
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            widths = batch.column(3).to_pylist()
            for row, ids, width in zip(batch.column(0).to_pylist(), batch.column(1), widths):
                packer.add(row, np.frombuffer(ids.as_buffer(), f"<u{width}"))
                waiting += len(packer.ids[-1])
                if waiting >= CELL:
                    yield pieces(False)
                    waiting = 0
        if kind is not None:
            yield pieces(True)

    schema = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, task int, sequence long, offset long" + ", ids array<long>" * with_ids
    found = stored(map_batches(rows, schema, make), "pieces")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = found.groupBy("task").agg((F.max("sequence") + 1).alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = found.join(F.broadcast(tasks), "task")  # a row per task
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        source = file.read()
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), source)
