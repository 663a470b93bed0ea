"""Hard negatives by a pivot table.

Vectors are augmented so that the inner product becomes a distance: with M the longest length, a
row x gets the coordinate sqrt(M^2 - |x|^2) and an anchor q a 0, so that
|q - x|^2 = M^2 + |q|^2 - 2 q.x. Every row is stored with its distances to ``PIVOTS`` rows far from
each other, nearest pivot first, as the pivot table. By the triangle inequality the distances of
anchor and row to a pivot bracket the distance between them, so they bracket the score: first
those of whole blocks of rows, which lie in intervals, then those of the rows. Only rows whose
bracket meets what the anchor still looks for are scored, exactly, in whole numbers.

Anchors go through the table in groups of bounded bytes, each group twice: for the best rows of
the anchor's label, and, once the positives' scores are known, for the best rows of other labels
in each positive's range. A task keeps the few best of each anchor and range, so its memory and
what it sends follow the group, not the rows that it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, shared_folder, stored

#: Pivots, the sample that they are chosen from (and that gives anchors a first bound), rows of a block, bytes of a group of anchors.
PIVOTS, SAMPLE, BLOCK, GROUP_BYTES = 16, 2048, 512, 8 << 20
POSITIVES, NEGATIVES = 5, 5
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)


def quantised(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v, norm) of the rows that take part: v the whole numbers, norm their squares' sum."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda c: F.floor(256 * c.cast("double")).cast("double")).alias("f"))
    norm = F.aggregate("f", F.lit(0.0), lambda s, c: s + c * c)
    rows = rows.withColumn("norm", norm).where(f"norm < {2.0**62}")
    return rows.select("vec_id", "label", F.transform("f", lambda c: c.cast("int")).alias("v"), "norm")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of an array column, those that are shorter filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(column.offsets))
    if len(flat) == len(size) * dims and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), flat.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def augmented(v: np.ndarray, top: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before; fewer where rows are equal."""
    chosen, far = [], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        k = int(far.argmax()) if chosen else 0
        chosen.append(k)
        far = np.minimum(far, ((sample - sample[k]) ** 2).sum(1))
    return sample[chosen]


class Bounds:
    """Brackets of scores between a group's anchors and rows."""

    def __init__(self, anchors: np.ndarray, top: float, pivots: np.ndarray):
        anchors = anchors.astype(np.float64)
        self.square = top + (anchors * anchors).sum(1)
        self.to_pivots = distances(np.column_stack([anchors, np.zeros(len(anchors))]), pivots)
        self.slack = 1e-6 + 1e-9 * self.square  # more than rounding can be off

    def highest(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most that anchors (rows) can score with what lies within [low, high] of each pivot (rows of ``low`` and ``high``)."""
        least = np.zeros((len(anchors), len(low)))
        for k in range(self.to_pivots.shape[1]):
            d = self.to_pivots[anchors, k][:, None]
            np.maximum(least, np.maximum(low[None, :, k] - d, d - high[None, :, k]), out=least)
        return (self.square[anchors, None] - least**2) / 2 + self.slack[anchors, None]

    def lowest(self, anchors: np.ndarray, high: np.ndarray) -> np.ndarray:
        most = np.full((len(anchors), len(high)), np.inf)
        for k in range(self.to_pivots.shape[1]):
            np.minimum(most, self.to_pivots[anchors, k][:, None] + high[None, :, k], out=most)
        return (self.square[anchors, None] - most**2) / 2 - self.slack[anchors, None]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers."""
    bound = np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0) * (b.astype(np.float64) ** 2).sum(1).max(initial=0))
    if bound < EXACT / 2:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.stack([b.astype(np.int64) @ x for x in a.astype(np.int64)]) if len(a) else np.zeros((0, len(b)), np.int64)


class Best:
    """The best rows of each slot so far: highest scores, then smallest ids."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, np.iinfo(np.int64).min)  # a row below can't come in

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        slot, score, id_ = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, id_)
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        first = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - first
        last = place == self.keep - 1
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])
        kept = place < self.keep
        self.slot, self.score, self.id = slot[kept], score[kept], id_[kept]

    def add_block(self, slots: np.ndarray, s: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Rows (columns of s) that fit a slot (rows of s); only those that can be among a slot's best are sorted."""
        fits = fits & (s >= self.least[slots][:, None])
        if s.shape[1] > self.keep:
            of = np.where(fits, s, np.iinfo(np.int64).min)
            fits &= s >= np.partition(of, s.shape[1] - self.keep, axis=1)[:, s.shape[1] - self.keep][:, None]
        i, j = np.nonzero(fits)
        if len(i):
            self.add(slots[i], s[i, j], ids[j])


class Group:
    """Anchors of one group with what tasks need to look for their rows."""

    def __init__(self, rows: list, dims: int, top: float, pivots: np.ndarray, sample: dict[str, np.ndarray]):
        self.row, self.id, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("row", "vec_id", "label"))
        self.v = np.zeros((len(rows), dims), np.int32)
        for k, r in enumerate(rows):
            self.v[k, : len(r["v"])] = r["v"]
        self.bounds = Bounds(self.v, top, pivots)
        # the sample's rows are rows of the table, so the score of the last positive among them can only rise
        s = scores(self.v, sample["v"])
        own = (self.label[:, None] == sample["label"]) & (self.row[:, None] != sample["row"])
        of = np.where(own, s, np.iinfo(np.int64).min)
        self.first = np.partition(of, of.shape[1] - POSITIVES, axis=1)[:, of.shape[1] - POSITIVES] if of.shape[1] >= POSITIVES else np.full(len(rows), np.iinfo(np.int64).min)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, pivots: int):
    """(row, vec_id, label, v, distances) of successive blocks of rows."""
    for batch in batches:
        row, id_, label = (np.asarray(batch.column(k), np.int64) for k in range(3))
        v, d = matrix(batch.column(3), dims), matrix(batch.column(4), pivots)
        for i in range(0, len(row), BLOCK):
            part = slice(i, i + BLOCK)
            yield row[part], id_[part], label[part], v[part], d[part]


def _found(slots: Best) -> dict[str, pa.Array]:
    return {"slot": pa.array(slots.slot, pa.int64()), "score": pa.array(slots.score, pa.int64()), "id": pa.array(slots.id, pa.int64())}


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The best rows of each slot over all tasks, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def positives(table: DataFrame, group, dims: int, pivots: int, keep: int = POSITIVES) -> DataFrame:
    """(slot, rank, id, score): the best rows of an anchor's label; slot is the anchor's place in the group."""

    def make(batches: Iterator[pa.RecordBatch]):
        g: Group = group.value
        best = Best(len(g.id), keep)
        best.least = g.first.copy()
        for row, id_, label, v, d in _blocks(batches, dims, pivots):
            at = np.flatnonzero(np.isin(g.label, label))
            if pivots:
                at = at[g.bounds.highest(at, d.min(0)[None], d.max(0)[None])[:, 0] >= best.least[at]]
            if not len(at):
                continue
            fits = (g.label[at][:, None] == label) & (g.row[at][:, None] != row)
            if pivots:
                fits &= g.bounds.highest(at, d, d) >= best.least[at][:, None]
            some, any_ = fits.any(1), fits.any(0)
            if some.any():
                best.add_block(at[some], scores(g.v[at[some]], v[any_]), fits[np.ix_(some, any_)], id_[any_])
        if len(best.slot):
            yield _found(best)

    return _best(map_batches(table, "slot long, score long, id long", make), keep)


def negatives(table: DataFrame, group, known, dims: int, pivots: int, keep: int = NEGATIVES) -> DataFrame:
    """(slot, rank, id, score): the best rows of other labels in the range of each positive; slot is the positive's place in ``known``."""

    def make(batches: Iterator[pa.RecordBatch]):
        g: Group = group.value
        anchor, score = known.value  # of each positive, ascending by anchor
        low = score - score // 5  # 80 p <= 100 s, in whole numbers
        best = Best(len(score), keep)
        own = np.unique(anchor)
        first, last = np.searchsorted(anchor, own), np.searchsorted(anchor, own, "right")
        lowest, highest = np.minimum.reduceat(low, first) if len(own) else low, np.maximum.reduceat(score, first) if len(own) else score
        for _, id_, label, v, d in _blocks(batches, dims, pivots):
            at = np.arange(len(own))
            # from here on, what a row has to score for any of the anchor's positives
            need = np.maximum(lowest, np.minimum.reduceat(best.least, first) if len(own) else lowest)
            if pivots:
                at = at[g.bounds.highest(own, d.min(0)[None], d.max(0)[None])[:, 0] >= need]
            if not len(at):
                continue
            who = own[at]
            fits = g.label[who][:, None] != label
            if pivots:
                fits &= (g.bounds.highest(who, d, d) >= need[at][:, None]) & (g.bounds.lowest(who, d) <= highest[at][:, None])
            some, any_ = fits.any(1), fits.any(0)
            if not some.any():
                continue
            at, fits, id_ = at[some], fits[np.ix_(some, any_)], id_[any_]
            s = scores(g.v[own[at]], v[any_])
            for k in range(int((last - first).max())):
                has = np.flatnonzero(first[at] + k < last[at])
                slot = first[at[has]] + k
                best.add_block(slot, s[has], fits[has] & (s[has] >= low[slot][:, None]) & (s[has] <= score[slot][:, None]), id_)
        if len(best.slot):
            yield _found(best)

    return _best(map_batches(table, "slot long, score long, id long", make), keep)


def mine(table: DataFrame, vector: str = "embedding", every: int = 100, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the query's contract.

    Takes vec_id, label and the vector. Rows with a null in one of them or among the components, or
    with a component that isn't finite, take no part, nor do rows whose squared length is 2^62 or
    more, since scores are longs. Shorter vectors count as filled up with 0; empty ones score 0.
    Ties go by the smaller vec_id. Every row counts for itself: a repeated vec_id is a further
    row, and as an anchor has results of its own. Other columns aren't read. An empty table, or one
    without anchors, gives an empty result. Anchors are rows whose vec_id is divisible by ``every``.
    """
    spark = table.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stored(quantised(table, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    top, dims = rows.agg(F.max("norm"), F.max(F.size("v"))).first()
    if top is None:
        return spark.createDataFrame([], schema)
    picked = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).collect()
    sample = {c: np.array([r[c] for r in picked], np.int64) for c in ("row", "label")}
    sample["v"] = np.zeros((len(picked), dims), np.int32)
    for k, r in enumerate(picked):
        sample["v"][k, : len(r["v"])] = r["v"]
    pivots = choose_pivots(augmented(sample["v"], top)) if dims else np.zeros((0, 1))
    table = pivot_table(rows, top, dims, pivots)
    anchors = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v")
    size = max(1, group_bytes // (8 * dims + 64))
    n, out = anchors.count(), None
    groups = -(-n // size)
    # groups by hash of the row's number: each has about ``size`` anchors
    for k in range(groups):
        members = anchors.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == k).collect()
        if not members:
            continue
        members.sort(key=lambda r: (r["label"], r["vec_id"], r["row"]))
        made = Group(members, dims, top, pivots, sample)
        group = spark.sparkContext.broadcast(made)
        # five rows at most for each anchor of the group
        good = sorted((r["slot"], r["rank"], r["id"], r["score"]) for r in positives(table, group, dims, len(pivots)).collect())
        good = [r for r in good if r[3] >= 0]  # below 0 no score lies in the range
        known = spark.sparkContext.broadcast((np.array([r[0] for r in good], np.int64), np.array([r[3] for r in good], np.int64)))
        names = spark.createDataFrame([(i, int(made.id[s]), p, score) for i, (s, _, p, score) in enumerate(good)], "slot long, anchor_id long, positive_id long, positive_score long")
        found = negatives(table, group, known, dims, len(pivots)).join(F.broadcast(names), "slot")
        found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        if groups == 1:
            return found
        out = out or shared_folder(spark, "negatives")
        found.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if out else spark.createDataFrame([], schema)


def pivot_table(rows: DataFrame, top: float, dims: int, pivots: np.ndarray) -> DataFrame:
    """(row, vec_id, label, v, d) stored by nearest pivot and distance to it, so that blocks of rows lie close together."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v = matrix(batch.column(3), dims)
            d = distances(augmented(v, top), shared.value) if len(shared.value) else np.zeros((len(v), 0))
            at = pa.array(np.arange(len(v) + 1) * d.shape[1], pa.int32())
            yield {
                **{c: batch.column(k) for k, c in enumerate(("row", "vec_id", "label", "v"))},
                "d": pa.ListArray.from_arrays(at, pa.array(d.ravel())),
                "near": pa.array(d.argmin(1) if d.shape[1] else np.zeros(len(v), np.int64), pa.int32()),
                "far": pa.array(d.min(1) if d.shape[1] else np.zeros(len(v))),
            }

    with_distances = stored(map_batches(rows.select("row", "vec_id", "label", "v"), "row long, vec_id long, label long, v array<int>, d array<double>, near int, far double", make), "distances")
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-with_distances.count() // (BLOCK * 64)))
    return stored(with_distances.repartitionByRange(n, "near", "far", "row").sortWithinPartitions("near", "far", "row").select("row", "vec_id", "label", "v", "d"), "pivot-table")


def query(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
