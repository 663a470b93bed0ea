"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

Shards fill racks of ``RACK`` and racks fill regions of ``RACKS``, in the order of their
numbers, so a shard's place in the tree never moves. A row descends from region to rack to
shard. At each level every child draws u in (0, 1] from a hash of its name and the row's
key. With ``before`` shards added before the child's first, the child needs a weight of
ceil(before / u - before), at least 1, to take the row: that is the number of its own shards
from which on its share of all shards outweighs the draw. Of the children that weigh what
they need the last takes the row, and it takes it first with its need-th shard, so within
that child only later racks and shards can still draw for it.

So each shard gets an equal share of the keys, and a subtree wins rows only by gaining
weight. A further shard changes no draw and no need: the rows that its region, its rack or
the shard itself newly can take are exactly those whose need it meets, and they go into the
new shard. No row moves between old shards, and the same draws give the shard with one more. A row costs a
draw per region, per rack of its region and per shard of its rack, not one per shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import draw
from .shared import set_apart, stored

#: Shards of a rack and racks of a region: part of the law, so fixed.
RACK, RACKS = 5, 4
#: Blocks that number the rows of a shard independently of each other: of all shards so many at most, which bounds what is broadcast.
MOST_BLOCKS = 1 << 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, within one expression: chains of projections take the optimizer long."""
    return F.transform(F.array(value), use)[0]


def _level(name: Column, base: Column, size: int, children: int, shards: int, key: Column, entry: Column) -> Column:
    """The shards, now and with one more, with which the last child that can takes the row, else ``entry``.

    Child i begins with shard base + size * (i + 1); four children share an MD5 of the level's name and the key.
    """
    each = F.sequence(F.lit(0), F.lit(children - 1))
    before = lambda i: base + size * (i + 1)

    def need(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.concat(name, F.lit("."), F.shiftright(i, 2).cast("string")), key))
        u = (F.conv(F.substring(digest, i % 4 * 8 + 1, F.lit(8)), 16, 10).cast("double") + 1) / 2.0**32
        return F.greatest(F.lit(1), F.ceil(before(i) / u - before(i)))

    def last(needs: Column, limit: int) -> Column:
        taken = F.transform(each, lambda i: F.when((before(i) > entry) & (needs[i] <= F.least(F.lit(size), limit - before(i))), before(i) + needs[i] - 1))
        return F.coalesce(F.array_max(taken).cast("int"), entry)

    return let(F.transform(each, need), lambda needs: F.array(last(needs, shards), last(needs, shards + 1)))


def descend(docs: DataFrame, shards: int, key: str, to: str, grown: str | None = None) -> DataFrame:
    """docs with the shard, of 0 to shards - 1, of each row's key in column ``to``, and in ``grown`` the shard with one more."""
    k, width = F.col(key), RACK * RACKS

    def leaf(entry: Column) -> Column:
        base = entry - entry % RACK
        return _level(F.concat(F.lit("shard"), base.cast("string")), base, 1, RACK - 1, shards, k, entry)

    def rack(entry: Column) -> Column:
        base = entry - entry % width
        return _level(F.concat(F.lit("rack"), base.cast("string")), base, RACK, RACKS - 1, shards, k, entry)

    # the first region takes what no other takes
    region = _level(F.lit("region"), F.lit(0), width, shards // width, shards, k, F.lit(0)) if shards >= width else F.array(F.lit(0), F.lit(0))
    differs = lambda x: x[0] != x[1]
    way = let(region, lambda r: let(rack(r[0]), lambda q: let(leaf(q[0]), lambda s: F.struct(s[0].alias("shard"), (differs(r) | differs(q) | differs(s)).alias("new")))))
    docs = docs.withColumn("_way", way)
    grew = [F.when(F.col("_way.new"), shards).otherwise(F.col("_way.shard")).cast("int").alias(grown)] if grown else []
    return docs.select(*(c for c in docs.columns if c not in ("_way", to, grown)), F.col("_way.shard").alias(to), *grew)


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot, grown_shard added; input columns of these names, in any case, are called input_ and their name.

    Takes doc_id and text. size is the text's UTF-8 bytes (null: none) plus 16; law is ``key``:
    doc_id and the number of shards decide. ``assign(docs, n + 1)`` gives each row the shard
    that is its grown_shard under ``assign(docs, n)``. Slots of a shard run from 0 without gaps:
    its rows are numbered within blocks by hash of doc_id and text, after all rows of the blocks
    before, so no task holds a whole shard. Rows without doc_id share one key and so one shard,
    and so do rows that repeat a doc_id; their texts deal them over the blocks. Repeated rows
    get slots of their own, in any order among them. Very long texts are only measured. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    blocks = max(1, MOST_BLOCKS // shards)

    def placed(rows: DataFrame) -> DataFrame:
        # the text takes part, so that a doc_id which many rows share, or lack, isn't one block
        return descend(rows, shards, "key", "shard", "grown_shard").withColumn("block", F.floor(draw("slot", F.col("key"), F.col("text_crc32"), F.col("size")) * blocks).cast("int"))

    facts = (key, (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = docs.select(F.struct(*set_apart(docs.columns, ("size", "text_crc32", "law", "shard", "slot", "grown_shard"))).alias("row"), *facts)
    rows = placed(rows)
    counts = placed(docs.select(*facts)).groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "block").orderBy("key", "text_crc32", "size")
    rows = rows.withColumn("place", F.row_number().over(within) - 1)
    # an outer join with a stored table: for an inner one the optimizer traces the keys through all levels of the descent, which takes it long
    counts = stored(counts.toDF("_shard", "_block", "before"), "slots")
    rows = rows.join(F.broadcast(counts) if shards <= MOST_BLOCKS else counts, (F.col("shard") == F.col("_shard")) & (F.col("block") == F.col("_block")), "left")
    return rows.select("row.*", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _descent(shards: int) -> str:
    """The descent in SQL, from (id, key) rows ``d``: b is a child's first shard, i its place among those that draw."""
    need = "greatest(1, CAST(ceil(b / ((CAST(CAST('0x' || substr(md5({name} || '.' || (i // 4) || ':' || key), i % 4 * 8 + 1, 8) AS BIGINT) AS DOUBLE) + 1) / 4294967296.0) - b) AS BIGINT))"

    def level(name: str, base: str, size: int, n: str, own: str, otherwise: str) -> str:
        return f"coalesce((SELECT arg_max(b + need - 1, b) FROM (SELECT b, {need.format(name=name)} AS need FROM (SELECT i, {base} + {size} * (i + 1) AS b FROM (SELECT unnest(range({n})) AS i))) WHERE b > {otherwise} AND need <= {own}), {otherwise})"

    width = RACK * RACKS
    region = level("'region'", "0", width, f"{max(0, (shards - 1) // width)}", f"least({width}, {shards} - b)", "0")
    rack = level(f"'rack' || (e - e % {width})", f"e - e % {width}", RACK, f"{RACKS - 1}", f"least({RACK}, {shards} - b)", "e")
    leaf = level(f"'shard' || (e - e % {RACK})", f"e - e % {RACK}", 1, f"{RACK - 1}", f"CASE WHEN b < {shards} THEN 1 ELSE 0 END", "e")
    return f"(SELECT id, {leaf} AS shard FROM (SELECT id, key, {rack} AS e FROM (SELECT id, key, {region} AS e FROM d)))"


#: CRC-32 is folded over the bytes with its table of 256; the descent follows the rules of the module's docstring.
SQL = rf"""
WITH t AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS n))),
b AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS x, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
d AS (SELECT id, doc_id, key, octet_length(x) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295, [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(x), '..')]), lambda c, v: xor(c // 256, crc[xor(c % 256, v) + 1])), 4294967295) AS text_crc32 FROM b, t),
a AS (SELECT d.*, s.shard, g.shard AS grown_shard,
  CAST(floor(CAST(CAST('0x' || substr(md5('slot:' || key || ':' || text_crc32 || ':' || size), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * {MOST_BLOCKS // 40}) AS BIGINT) AS block
  FROM d JOIN {_descent(40)} s USING (id) JOIN {_descent(41)} g USING (id))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY block, key, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM a
"""
