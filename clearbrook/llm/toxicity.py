"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms; a term's value falls with the share of texts that
hold it. The score is the logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j:
a pair such as an insult and a group's name can weigh more, or less, than its two terms.

The machine is fitted on the driver to a bounded sample of labelled rows (``MOST_ROWS`` and
``MOST_BYTES`` of text, those of smallest hash), of which tasks send the hashed terms only. Every whole text is
scored. Only terms are inputs: not doc_id, lang, source or labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import binary, map_arrow
from .words import TERMS, U64, span_hashes, words

BITS, FACTORS, MOST_ROWS = 20, 6, 20_000
#: Bytes of text that the rows of a fit have together at most.
MOST_BYTES = 64 << 20
MOST_TERMS = 1 << 16
#: Bytes of a word's lead, a term beside the word: inflected forms share it.
LEAD = 5
#: A term is known if it stands in FEWEST rows, whatever its own share of toxic rows: a pair can tell the classes apart where its terms don't.
FEWEST = 5
#: A term that deviates from the share of toxic rows by SURE standard errors is strong: strong terms are fitted first, then all.
SURE = 4.0
#: Of the other terms, the norm that a row's values share at most, and what each step takes off their linear weights.
NORM, SPARSE = 3.0, 3e-4
#: Share of the rows whose loss says which pass is kept, if they are MOST_UNCHECKED at least.
CHECKED, MOST_UNCHECKED = 0.1, 500


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row (words, and their first LEAD bytes), in ascending order, and the row bounds."""
    out, n = [], [0]
    for w in words(column, TERMS):
        lead = span_hashes(w.data, w.start, np.minimum(w.end, w.start + LEAD), lower=True) ^ U64(1 << 63)
        code = (np.concatenate([w.hashes(lower=True), lead]) >> U64(64 - BITS)).astype(np.int64)
        key = np.unique(np.tile(w.owner(), 2) << BITS | code)
        out.append((key & ((1 << BITS) - 1)).astype(np.int32))
        n += (n[-1] + np.cumsum(np.bincount(key >> BITS, minlength=w.rows))).tolist()
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.array(n)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of values over each range of bounds."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about MOST_TERMS terms, which bounds the temporary arrays."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + MOST_TERMS, "right")) - 1)
        yield i, j
        i = j


def counted(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold each hashed term, and the sum of their labels, added up by blocks."""
    size = max((int(r[-1]) + 1 for r in rows if len(r)), default=0)  # a row's terms ascend
    df, toxic = np.zeros(size, np.int64), np.zeros(size)
    for i, j in blocks(np.cumsum([0, *map(len, rows)])):
        some = np.concatenate(rows[i:j])
        df += np.bincount(some, minlength=size)
        toxic += np.bincount(some, np.repeat(labels[i:j], [len(r) for r in rows[i:j]]), minlength=size)
    return df, toxic


@dataclass
class Machine:
    codes: np.ndarray  # known terms, ascending
    value: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    strong: np.ndarray  # terms that tell the classes apart by themselves

    def known(self, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of known terms, and the bounds among them."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros_like(bounds)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return at[hit], np.append(0, np.cumsum(hit))[bounds]

    def inputs(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Values of the terms in their rows; those that aren't strong share a norm of NORM at most, however long the text is."""
        x, weak = self.value[at], ~self.strong[at]
        norm = np.sqrt(np.maximum(sums(x * x * weak, bounds), NORM**2))
        return np.where(weak, x * np.repeat(NORM / norm, np.diff(bounds)), x)

    def parts(self, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each row, and the sums over its terms of value times factors."""
        x = self.inputs(at, bounds)
        vx = self.factors[at] * x[:, None]
        s = sums(vx, bounds)
        return self.bias + sums(self.linear[at] * x, bounds) + 0.5 * (s**2 - sums(vx**2, bounds)).sum(1), s

    def score(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Scores of the rows, by blocks of whole rows of about MOST_TERMS terms, which bounds the temporary arrays."""
        out = [np.zeros(0)]
        for i, j in blocks(bounds):
            margin, _ = self.parts(*self.known(code[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
            out.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
        return np.concatenate(out)


def fit(rows: list[np.ndarray], labels: np.ndarray, fewest: int = FEWEST, sure: float = SURE, steps: int = 600, batch: int = 256, rate: float = 1.0, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, ``steps`` steps at least over the strong terms, then as many over all.

    The pass of least loss on rows set aside is kept. Every term in ``fewest`` rows can get a weight and a part in pairs.
    """
    n = len(rows)
    df, toxic = counted(rows, labels)
    share = (labels.sum() + 0.5) / (n + 1)
    codes = np.flatnonzero(df >= fewest).astype(np.int32)
    df = df[codes]
    strong = np.abs(toxic[codes] - df * share) >= sure * np.sqrt(df * share * (1 - share))
    rng = np.random.default_rng(seed)
    m = Machine(codes, np.log((n + 1) / np.maximum(df, 1)) / np.log(n + 1) if n else np.zeros(0), float(np.log(share / (1 - share))), np.zeros(len(codes)), rng.normal(0, 0.02, (len(codes), FACTORS)), strong)
    if n == 0 or labels.min() == labels.max():
        return m
    given = np.cumsum([0, *map(len, rows)])
    at, bounds = np.empty(given[-1], np.int32), np.zeros(n + 1, np.int64)
    for i, j in blocks(given):
        some, ends = m.known(np.concatenate(rows[i:j]), given[i : j + 1] - given[i])
        bounds[i : j + 1] = bounds[i] + ends
        at[bounds[i] : bounds[j]] = some
    at = at[: bounds[-1]]

    def taken(own: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the rows (the strong ones or all), their bounds and the rows' numbers of terms."""
        length = bounds[own + 1] - bounds[own]
        b = np.append(0, np.cumsum(length))
        a = at[np.arange(b[-1]) + np.repeat(bounds[own] - b[:-1], length)]
        if not every:
            b = np.append(0, np.cumsum(strong[a]))[b]
            a = a[strong[a]]
        return a, b, np.diff(b)

    def loss(own: np.ndarray, every: bool) -> float:
        total = 0.0
        for i in range(0, len(own), batch):
            part = own[i : i + batch]
            total += np.logaddexp(0, (1 - 2 * labels[part]) * m.parts(*taken(part, every)[:2])[0]).sum()
        return total

    used_rows, checked = np.arange(n), np.zeros(0, np.int64)
    if n >= MOST_UNCHECKED:
        mixed = rng.permutation(n)
        checked, rest = mixed[: int(CHECKED * n)], np.sort(mixed[int(CHECKED * n) :])
        if labels[checked].min() == labels[checked].max() or labels[rest].min() == labels[rest].max():
            checked = checked[:0]
        else:
            used_rows = rest
    best = np.inf
    for every in (False, True):
        if strong.all() if every else not strong.any():
            continue
        seen_w, seen_v, seen_b = np.full(len(codes), 1e-4), np.full((len(codes), FACTORS), 1e-4), 1e-4
        for _ in range(-(-steps // -(-len(used_rows) // batch))):
            order = rng.permutation(used_rows)
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                a, b, length = taken(own, every)
                margin, s = m.parts(a, b)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]) / len(own)
                seen_b += g.sum() ** 2
                m.bias -= rate * g.sum() / np.sqrt(seen_b)
                x = m.inputs(a, b)
                gx = np.repeat(g, length) * x
                used, inverse = np.unique(a, return_inverse=True)
                gw = np.bincount(inverse, gx, len(used)) + decay * m.linear[used]
                gv = gx[:, None] * (np.repeat(s, length, 0) - m.factors[a] * x[:, None])
                gv = np.stack([np.bincount(inverse, gv[:, f], len(used)) for f in range(FACTORS)], 1) + decay * m.factors[used]
                seen_w[used] += gw**2
                seen_v[used] += gv**2
                w = m.linear[used] - rate * gw / np.sqrt(seen_w[used])
                m.linear[used] = np.where(strong[used], w, np.sign(w) * np.maximum(np.abs(w) - SPARSE * rate / np.sqrt(seen_w[used]), 0))
                m.factors[used] -= 0.3 * rate * gv / np.sqrt(seen_v[used])
            if len(checked) and (now := loss(checked, True)) < best:
                best, kept = now, (m.bias, m.linear.copy(), m.factors.copy())
        if best < np.inf:
            m.bias, m.linear, m.factors = kept[0], kept[1].copy(), kept[2].copy()
    return m


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Machine:
    """Fit to labelled rows that have a document and aren't held out.

    Of repeated labels of a doc_id the largest counts, of its different texts that of smallest hash.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    first = texts.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("mark", "size")).alias("text"), F.max("toxic").alias("toxic"))
    chosen = first.select("doc_id", "text.mark", "text.size", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).collect()
    upto = np.cumsum([r["size"] for r in chosen])
    chosen = [(r["doc_id"], r["mark"], r["toxic"]) for r, n in zip(chosen, upto, strict=True) if n <= most_bytes]
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, mark long, toxic int")

    def send(batch):
        code, bounds = terms(batch.column(1))
        yield {"doc_id": batch.column(0), "toxic": batch.column(2), "terms": binary(code, bounds)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).join(F.broadcast(picked), ["doc_id", "mark"])
    rows = map_arrow(rows.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic"), "doc_id long, toxic int, terms binary", send).toPandas().sort_values("doc_id")
    return fit([np.frombuffer(t, np.int32) for t in rows["terms"]], rows["toxic"].to_numpy(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """A row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without known terms; very long ones are scored
    whole, by blocks. An empty table gives an empty result. Rows without doc_id are
    scored like all others and are not held out. Repeated rows score alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch):
        yield {"doc_id": batch.column(0), "score": pa.array(held.value.score(*terms(batch.column(1))), pa.float64())}

    scored = map_arrow(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, score double", run)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
