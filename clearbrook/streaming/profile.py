"""A stream's value table, kept up batch by batch in versions that a replay doesn't change.

The counts of two batches add up and their first rows compare, so the state after a batch is the
state before it merged with the batch's own value table. Each batch writes one version, named by
its id, in a folder that is complete or absent; a batch that Spark delivers again, after a failure
or a restart, finds its version written, or writes it anew from the one before. Every figure
that a scan derives from the value table (facts, lists, profile counts) can be had of any version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import facts_of, listed
from ..operators.values import forms, value_table

SCHEMA = "name string, value string, n long, first {}"


class StreamValues:
    """The state in ``folder``, a path that all executors share. ``order`` names the column that says which row is first."""

    def __init__(self, spark: SparkSession, folder: str, columns: list[str], order: str, kind: str = "long", keep: int = 2):
        self.spark, self.folder, self.columns, self.order, self.kind, self.keep = spark, folder.rstrip("/"), columns, order, kind, keep

    def _path(self, version: int) -> str:
        return f"{self.folder}/batch={version:019d}"

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return root, root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Ids of the batches whose versions are complete, ascending."""
        root, files = self._files()
        if not files.exists(root):
            return []
        found = [f.getPath() for f in files.listStatus(root)]
        done = [p.getName() for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done if n.startswith("batch="))

    def values(self, version: int | None = None) -> DataFrame:
        """The value table after a batch, the last one unless said otherwise; empty before the first."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        if version is None:
            return self.spark.createDataFrame([], SCHEMA.format(self.kind))
        return self.spark.read.schema(SCHEMA.format(self.kind)).parquet(self._path(version))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Takes a batch in; one that was taken in before changes nothing. Made for foreachBatch."""
        known = self.versions()
        if batch_id in known:
            return
        earlier = [v for v in known if v < batch_id]
        own = value_table(batch, self.columns, self.order).select("name", "value", F.col("n").cast("long").alias("n"), F.col("first").cast(self.kind).alias("first"))
        both = own.union(self.values(earlier[-1])) if earlier else own
        both.groupBy("name", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first")).write.mode("overwrite").parquet(self._path(batch_id))
        _, files = self._files()
        for old in earlier[: max(0, len(earlier) + 1 - self.keep)]:  # this folder's own, no longer needed for a replay
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(old)), True)

    def start(self, stream: DataFrame, checkpoint: str, trigger: Callable | None = None):
        """A query that keeps the state up with a stream; ``trigger`` may set one on the writer."""
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (trigger(writer) if trigger else writer).start()

    def facts(self) -> DataFrame:
        """column_facts of all that came so far."""
        values = self.values()
        return facts_of(values, self.columns, forms(values))

    def lists(self, *what: str) -> DataFrame:
        """The capped lists of a scan (null_tokens, format_patterns ...) of all that came so far."""
        values = self.values()
        return listed(values, forms(values), what)
