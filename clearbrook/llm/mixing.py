"""Mixing sources to target weights, in DataFrame functions alone.

Tokens are added up per source; a target per source follows from its weight; target over
size is the source's repetition rate. Each document is emitted floor(rate) times, and once
more where a hash of its id, taken as a draw from [0, 1), is below the rate's fraction. A
rerun draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import set_apart, stored

LIMIT = 3
#: Bytes of rates that may be broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 16 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: str | Column, *of: Column) -> Column:
    """52 bits of an MD5 over seed and values, as a double in [0, 1)."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed, *of)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the running sums in the given order, each row's own value included; the order has no ties.

    Range partitions are summed by themselves and start from the sums of those before them, so no
    task sees all rows. The partitions are stored first: a repeated sampling can't move a row.
    """
    parts = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    base = parts.groupBy("_part").agg(*(F.sum(v).alias(f"_all_{k}") for k, v in sums.items()))
    base = base.select("_part", *(F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_all_{k}") for k in sums))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.join(base, "_part").select(*rows.columns, *((F.col(f"_all_{k}") + F.sum(v).over(upto)).alias(k) for k, v in sums.items()))


def targets(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from source and size.

    Sources by code point, null last, weigh 1, 2, 3 and so on in turn and share the total of all
    sizes. No target exceeds ``limit`` times its source; what is cut off goes to the others by
    weight. Ordered by limit over weight, the sources at their limit come first, so running sums
    find the level at which the rest stand.
    """
    by_name = F.col("source").asc_nulls_last()
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(per, [by_name], {"number": F.lit(1)}).withColumn("weight", (F.col("number") - 1) % 3 + 1)
    per = per.withColumn("most", limit * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    per = running(per, [F.col("ratio").asc(), by_name], {"mosts": F.col("most"), "weights": F.col("weight")})
    all_ = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    per = per.withColumn("level", (F.lit(all_["size"]) - F.col("mosts") + F.col("most")) / (F.lit(all_["weight"]) - F.col("weights") + F.col("weight")))
    least = per.where("ratio > level").agg(F.min(F.struct("ratio", "level"))["level"].alias("level")).first()["level"]
    return per.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(least or 0.0) * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, copies and taken added; input columns of these names, in any case, are called input_ and their name.

    Takes doc_id, text and source. Null, empty and blank texts have size 0; very long texts are
    only counted. A source of size 0 has target 0 and its documents no copy. Rows without doc_id
    draw by their text; repeated rows draw alike. Rows without source are a source of their own.
    An empty table gives an empty result.
    """
    kept = set_apart(docs.columns, ("size", "source_size", "target", "copies", "taken"))
    docs = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).alias("key"), F.col("source").alias("_of"), word_count(F.col("text")).alias("size"))
    rates = stored(targets(docs.select(F.col("_of").alias("source"), "size"), limit), "targets").withColumnRenamed("source", "_source")
    few = (rates.agg(F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 32).alias("n")).first()["n"] or 0) <= MOST_BROADCAST
    docs = docs.join(F.broadcast(rates) if few else rates, F.col("_of").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    docs = docs.withColumn("copies", (F.floor(rate) + F.when(draw(seed, F.col("key")) < rate - F.floor(rate), 1).otherwise(0)).cast("long"))
    return docs.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as often as its plan says, with the columns of docs."""
    planned = plan_mix(docs.select(F.struct("*").alias("whole"), "doc_id", "text", "source"), limit, seed).where("copies > 0")
    return planned.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, 3 * source_size AS most, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
c AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, ratio) AS stand FROM c WHERE ratio > level),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(stand, 0.0) * weight) AS target FROM c, (SELECT coalesce((SELECT stand FROM v), 0.0) AS stand)),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken FROM k
"""
