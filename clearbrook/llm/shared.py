"""What several operators share: stored tables, packed buckets, connected components.

Packed buckets keep an inverted index small while Spark shuffles it: a task sorts its
entries by bucket and sends one row per bucket, whose binary columns hold the entries of
that bucket as numpy arrays. ``groupBy("bucket").applyInArrow`` then sees all entries of
a hash range. The number of buckets follows the bytes of the input, so a bucket stays
bounded, and operators send one entry per hash and task, so a hot hash can't fill one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text per bucket of an inverted index: about as many bytes of entries.
BUCKET_BYTES = 16 << 20
#: Most frequent keys that a join may broadcast, and the bytes of a key's values where those vary: 16 MB together at most.
MOST_HOT, MOST_HOT_BYTES = 1000, 16 << 10


_local: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a temporary folder; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="clearbrook-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def set_apart(columns: list[str], new: tuple[str, ...]) -> list[Column]:
    """The columns under names that don't clash with ``new``, whatever the case: those that would are called input_ and their name."""
    taken, out = {c.lower() for c in (*columns, *new)}, []
    for c in columns:
        name = c
        if c.lower() in new:
            while name.lower() in taken:
                name = f"input_{name}"
            taken.add(name.lower())
        out.append(F.col("`" + c.replace("`", "``") + "`").alias(name))
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run within sends at most so many rows to Python at once: for rows that can be large, since Spark bounds their number only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def bucket_count(df: DataFrame, column: str = "text") -> int:
    """Buckets for an inverted index over a text column, at least 64."""
    return max(64, -(-text_bytes(df, column) // BUCKET_BYTES))


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[bounds[i]:bounds[i + 1]], without copying each."""
    values = np.ascontiguousarray(values)
    at = (np.asarray(bounds, np.int64) * values.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)]).cast(pa.binary())


def unpacked(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """All values of a packed binary column, row after row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros(0, kind)
    column = column.cast(pa.large_binary()).drop_null()
    if not len(column):
        return np.zeros(0, kind)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view(kind) if at[-1] > at[0] else np.zeros(0, kind)


def packed(buckets: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """One row per bucket: its number and, for each column, the entries that belong to it."""
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    first = np.flatnonzero(np.diff(buckets, prepend=-1)) if len(buckets) else np.zeros(0, np.int64)
    bounds = np.append(first, len(buckets))
    return {"bucket": pa.array(buckets[first], pa.int32())} | {k: binary(v[order], bounds) for k, v in columns.items()}


def by_group(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Entries ordered by key (stable): the distinct keys, their bounds, the columns in that order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.append(first, len(key)), [c[order] for c in columns]


def map_batches(df: DataFrame, schema: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, pa.Array]]]) -> DataFrame:
    """mapInArrow with ``make`` giving dicts of columns for the batches of a partition; columns that it leaves out are null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for columns in make(batches):
            n = len(next(iter(columns.values())))
            if n:
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], names=[f.name for f in fields])

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterator[dict[str, pa.Array]]]) -> DataFrame:
    """map_batches where each batch stands for itself."""
    return map_batches(df, schema, lambda batches: (columns for batch in batches for columns in make(batch)))


def map_groups(df: DataFrame, keys: list[str], schema: str, make: Callable[[pa.Table], dict[str, pa.Array]]) -> DataFrame:
    """groupBy(keys).applyInArrow with ``make`` giving a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(table: pa.Table) -> pa.Table:
        columns = make(table)
        n = len(next(iter(columns.values())))
        return pa.Table.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], names=[f.name for f in fields])

    return df.groupBy(*keys).applyInArrow(run, schema)


def join_counted(rows: DataFrame, keyed: DataFrame, on: str, spread: Column, size: Column | None = None) -> DataFrame:
    """rows left-joined with ``keyed`` on a text column; ``keyed`` has a row per key and in ``n`` the rows that have it.

    Keys that hold a MOST_HOT-th of those rows are MOST_HOT at most, so they can be broadcast; with
    ``size``, the bytes of a key's values, only those of MOST_HOT_BYTES. A row that is served so goes
    on under a key of its own, ``spread``, so no task of the shuffled join gets a frequent key.
    """
    keyed = stored(keyed, "keyed")
    least = max(2, keyed.agg(F.ceil(F.sum("n") / MOST_HOT).alias("n")).first()["n"] or 0)
    hot = F.col("n") >= least if size is None else (F.col("n") >= least) & (size <= MOST_HOT_BYTES)
    values = [c for c in keyed.columns if c not in (on, "n")]
    first = keyed.where(hot).select(F.col(on).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values))
    rest = keyed.where(~hot).select(F.col(on).alias("_cold"), *(F.col(c).alias(f"_cold_{c}") for c in values))
    rows = rows.join(F.broadcast(first), F.col(on) == F.col("_hot"), "left")
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull() & F.col(on).isNotNull(), F.col(on)).otherwise(F.concat(F.lit("\0"), F.coalesce(spread.cast("string"), F.lit("")))))
    out = rows.join(rest, F.col("_key") == F.col("_cold"), "left")
    return out.select(*(F.col(c) for c in rows.columns if not c.startswith("_hot") and c != "_key"), *(F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an undirected graph with columns a, b: component is the smallest node reached.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so chains shorten by halves; only a count of changes reaches the driver.
    """
    both = edges.select("a", "b").where("a <> b")
    both = stored(both.union(both.select("b", "a")).distinct().toDF("node", "other"), "edges")
    label = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label"))
    label = stored(label, "labels")
    while True:
        near = both.join(label.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        new = label.join(near, "node").select("node", F.least("label", "seen").alias("next"), F.col("label").alias("old"))
        up = label.select(F.col("node").alias("next"), F.col("label").alias("above"))
        new = new.join(up, "next", "left").select("node", F.least("next", "above").alias("label"), "old")
        new = stored(new, "labels")
        changed = new.where("label <> old").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            return label.toDF("node", "component")


def words_column(text: Column) -> Column:
    """The words of a text as an array, in the JVM; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
