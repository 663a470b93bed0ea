"""Columns that are the product of two others: discovery, mismatches, cells that can be filled.

A table of m numeric columns has m (m - 1) (m - 2) / 2 candidates a * b = c. Discovery reads it
three times, however many columns it has: for what each column holds, for a sketch of
``SKETCH`` rows, and once more for all candidates that the sketch leaves.

The sketch is a set of rows drawn with a fixed seed, held as a numpy matrix. In each of its rows the
targets are sorted, and an interval about each pair's product is looked up among them, so that a
row costs m^2 log m steps and what it matches, not m^3. A candidate goes only if so few of the
rows that tell about it fit that a share of ``RATE`` in the table would have shown this with a
chance below ``MISS`` (Hoeffding's bound, which holds for rows drawn without replacement); one
with few telling rows stays. Of a table no larger than the sketch the sketch sees all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..functions.text import strip
from .cleaning import TOLERANCE, mismatch

LEAST_ROWS, LEAST_INFORMATIVE, SHARE, RATE, BEST, TINY = 100, 50, 0.15, 0.95, 3, 1e-9
#: Rows of the sketch, the chance that it discards a candidate wrongly, candidates counted in one pass over the table.
SKETCH, MISS, MOST_AT_ONCE = 4096, 1e-12, 20_000


def as_number(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.cast("double") if isinstance(df.schema[name].dataType, T.NumericType) else numbers.strict(strip(c))["value"]


def parsed(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """Columns x0, x1 ... with the columns' finite numbers, null where there is none. Texts are parsed in a projection of their own, once."""
    raw = df.select(*(as_number(df, n).alias(f"x{i}") for i, n in enumerate(names)), *more)
    return raw.select(*(F.when(numbers.finite(F.col(f"x{i}")), F.col(f"x{i}")).alias(f"x{i}") for i in range(len(names))), *raw.columns[len(names) :])


def candidates(df: DataFrame, columns: list[str], skip: set[str], facts: dict[str, dict] | None = None, rows: int | None = None) -> tuple[list[str], int]:
    """Columns with numbers that vary and aren't 0 and 1 alone, in the table's order, and the table's rows.

    ``facts``, what a scan counted of each column (numbers, min, max, flags), saves parsing the texts once more, with ``rows`` all reading.
    """
    named = [c for c in columns if c not in skip and isinstance(df.schema[c].dataType, T.NumericType | T.StringType)]
    told = {c: facts[c] for c in named if facts and isinstance(df.schema[c].dataType, T.StringType)}
    read = [c for c in named if c not in told]
    aggs = [f(F.col(f"x{i}")).alias(f"{k}{i}") for i in range(len(read)) for k, f in (("min", F.min), ("max", F.max), ("numbers", F.count), ("flags", lambda v: F.count_if(v.isin(0.0, 1.0))))]
    row = {"rows": rows} if not read and rows is not None else parsed(df, read).agg(F.count("*").alias("rows"), *aggs).first()
    told |= {c: {k: row[f"{k}{i}"] for k in ("min", "max", "numbers", "flags")} for i, c in enumerate(read)}
    return [c for c in named if told[c]["numbers"] >= LEAST_ROWS and told[c]["min"] < told[c]["max"] and told[c]["flags"] < told[c]["numbers"]], row["rows"]


def sketch(df: DataFrame, names: list[str], rows: int = SKETCH) -> np.ndarray:
    """Numbers of rows drawn without replacement, nan where there is none; equal rows are drawn one by one."""
    drawn = parsed(df, names, F.rand(seed=7).alias("_draw")).orderBy("_draw").limit(rows)
    found = drawn.drop("_draw").toPandas()
    return found.to_numpy(np.float64).reshape(-1, len(names))


def fitting(product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval of targets z with |product - z| <= TOLERANCE * max(|z|, 1), widened by rounding errors."""
    size = np.abs(product)
    low = np.where(size >= 1 + TOLERANCE, size / (1 + TOLERANCE), size - TOLERANCE)
    high = np.where(size >= 1 - TOLERANCE, size / (1 - TOLERANCE), size + TOLERANCE)
    low, high = low - 1e-9 * (1 + size), high + 1e-9 * (1 + size)
    return np.where(product < 0, -high, low), np.where(product < 0, -low, high)


def surviving(x: np.ndarray, whole: bool, miss: float = MISS) -> list[tuple[int, int, int]]:
    """Candidates (a, b, c), a before b, that the sketch can't rule out; ``whole``: it is all of the table."""
    m = x.shape[1]
    a, b = np.triu_indices(m, 1)
    known = ~np.isnan(x)
    filled = np.where(known, x, np.inf)
    order = np.argsort(filled, axis=1)
    fits = np.zeros(len(a) * m, np.int64)
    for r in range(len(x)):
        pair = np.flatnonzero(known[r, a] & known[r, b])
        with np.errstate(over="ignore"):
            p = x[r, a[pair]] * x[r, b[pair]]
        held = int(known[r].sum())
        z = filled[r, order[r]][:held]
        low, high = fitting(p)
        i, j = np.searchsorted(z, low), np.searchsorted(z, high, "right")
        n = np.maximum(j - i, 0)
        of = np.repeat(np.arange(len(pair)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + i[of]
        telling = (np.abs(p[of]) > TINY) | (np.abs(z[at]) > TINY)
        fits += np.bincount((pair[of] * m + order[r][at])[telling], minlength=len(fits))
    tell = np.zeros((len(a), m))
    near = (known & (np.abs(np.where(known, x, 1)) <= TINY)).astype(np.float32)
    solid = known.astype(np.float32)
    for i in range(0, len(a), 1024):  # pairs at once
        both = known[:, a[i : i + 1024]] & known[:, b[i : i + 1024]]
        with np.errstate(over="ignore", invalid="ignore"):
            nothing = both & (np.abs(x[:, a[i : i + 1024]] * x[:, b[i : i + 1024]]) <= TINY)
        tell[i : i + 1024] = both.astype(np.float32).T @ solid - nothing.astype(np.float32).T @ near
    slack = 1e-9 if whole else np.sqrt(math.log(1 / miss) / (2 * np.maximum(tell, 1)))
    keep = fits.reshape(-1, m) >= (RATE - slack) * tell
    keep[np.arange(len(a)), a] = keep[np.arange(len(a)), b] = False
    if whole:
        keep &= tell >= LEAST_INFORMATIVE
    return [(int(a[i]), int(b[i]), int(c)) for i, c in zip(*np.nonzero(keep))]


#: What is added up of a candidate; the rest are extremes.
_SUMS, _EXTREMES = ("rows", "odd", "telling", "match"), ("loa", "lob", "loc", "hia", "hib", "hic")


def triple_counts(df: DataFrame, names: list[str], triples: list[tuple[int, int, int]]) -> list[dict]:
    """Counts of each candidate over all rows, in one pass for MOST_AT_ONCE of them: tasks add up, by batches, what Spark then adds up."""
    out: list[dict] = []
    for k in range(0, len(triples), MOST_AT_ONCE):
        some = triples[k : k + MOST_AT_ONCE]

        def counted(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(_SUMS), len(some)), np.int64)
            ends = np.concatenate([np.full((3, len(some)), np.inf), np.full((3, len(some)), -np.inf)])
            for batch in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) if batch.num_rows else np.zeros((0, batch.num_columns))
                known = ~np.isnan(x)
                for t, (a, b, c) in enumerate(some):
                    full = known[:, a] & known[:, b] & known[:, c]
                    u, v, z = x[full, a], x[full, b], x[full, c]
                    with np.errstate(over="ignore"):
                        p = u * v
                    telling = (np.abs(p) > TINY) | (np.abs(z) > TINY)
                    u, v, z, q = u[telling], v[telling], z[telling], p[telling]
                    sums[:, t] += (len(p), int((~np.isfinite(p)).sum()), len(q), int((np.abs(q - z) <= TOLERANCE * np.maximum(np.abs(z), 1)).sum()))
                    if len(q):
                        ends[:3, t] = np.minimum(ends[:3, t], (u.min(), v.min(), z.min()))
                        ends[3:, t] = np.maximum(ends[3:, t], (u.max(), v.max(), z.max()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(some)), pa.int64()), *map(pa.array, sums), *map(pa.array, ends)], names=["t", *_SUMS, *_EXTREMES])

        kinds = ", ".join([*(f"{c} long" for c in _SUMS), *(f"{c} double" for c in _EXTREMES)])
        rows = parsed(df, names).mapInArrow(counted, f"t long, {kinds}")
        each = rows.groupBy("t").agg(*(F.sum(c).alias(c) for c in _SUMS), *((F.min if c.startswith("lo") else F.max)(c).alias(c) for c in _EXTREMES))
        out += [{"left": names[a], "right": names[b], "target": names[c]} | r.asDict() for r in each.collect() for a, b, c in [some[r["t"]]]]
    return out


def discover(df: DataFrame, columns: list[str], skip: set[str] = frozenset(), facts: dict[str, dict] | None = None, rows: int | None = None) -> list[dict]:
    """The best product relations: left, right, target, rate, rows, mismatch_rows. Ties go by the columns' order in ``columns``, left and right by name."""
    names, n = candidates(df, columns, skip, facts, rows)
    if len(names) < 3:
        return []
    by_name = sorted(names)
    triples = surviving(sketch(df, by_name), n <= SKETCH)
    found = []
    for t in triple_counts(df, by_name, triples):
        enough = max(LEAST_INFORMATIVE, math.ceil(t["rows"] * SHARE))
        varies = all(t[f"lo{k}"] < t[f"hi{k}"] for k in "abc")
        if t["rows"] >= LEAST_ROWS and not t["odd"] and t["telling"] >= enough and varies and t["match"] / t["telling"] >= RATE:
            found.append({"left": t["left"], "right": t["right"], "target": t["target"], "rate": round(t["match"] / t["telling"], 4), "rows": t["rows"], "mismatch_rows": t["telling"] - t["match"]})
    place = {c: i for i, c in enumerate(names)}
    best: dict[str, dict] = {}
    for f in sorted(found, key=lambda f: (-f["rate"], f["mismatch_rows"], place[f["left"]], place[f["right"]], place[f["target"]])):
        best.setdefault(f["target"], f)
    return list(best.values())[:BEST]


def relation_counts(df: DataFrame, left: str, right: str, target: str) -> DataFrame:
    """complete, mismatches, fillable_left, fillable_right, fillable_target."""
    a, b, t = (as_number(df, c) for c in (left, right, target))
    return df.agg(
        F.count_if(a.isNotNull() & b.isNotNull() & t.isNotNull()).alias("complete"),
        F.count_if(mismatch(a, b, t)).alias("mismatches"),
        F.count_if(a.isNull() & b.isNotNull() & t.isNotNull() & (b != 0)).alias("fillable_left"),
        F.count_if(b.isNull() & a.isNotNull() & t.isNotNull() & (a != 0)).alias("fillable_right"),
        F.count_if(t.isNull() & a.isNotNull() & b.isNotNull()).alias("fillable_target"),
    )


__all__ = ["discover", "relation_counts", "triple_counts", "TOLERANCE"]
