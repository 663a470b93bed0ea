"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct shingles of ``size`` lower-cased words. Two sets
link when 100 * |x & y| >= ``percent`` * |x | y|. Equal sets are one node from the start, named
by 64 bits; where sets share a name but not 64 further bits, all but one are renamed.

Prefixes. At least c = ceil(percent * n / 100) of the n tokens of a set must be in a set
that it links to, so d = n - c may be missing. All sets order their tokens the same way,
rare tokens first, then frequent ones by class, and index the start of that order:

* a rare token is a signature by itself and is worth 1;
* frequent tokens are dealt into small groups by their hash, and the signatures are the
  2-token combinations within a group. p tokens of a group are worth p - 1, because that
  many must be missing before no combination is left.

A prefix is extended until it is worth d + 1; then two sets that link share a signature.
Groups number about n / 4, by the power of two below n. As partners can be larger, a set
also files its combinations under the power above when it can have a partner there.

Verification is exact, in the order of what it costs. The members of a signature's list
are compared with one of them; then, in lists that hold more than one component so far,
the members of different components with each other: as pairs where a list is short, in
blocks of packed sets where it is long. No link between components is left out; links
within a component aren't all drawn, since membership is what is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import binary, bucket_count, components, join_counted, map_arrow, map_groups, packed, small_batches, stored, unpacked
from .words import U64, Words, combined, mix, windows, words

SIZE, PERCENT = 5, 75
#: Documents that make a token frequent; the level is raised until at most MOST_FREQUENT tokens are, which bounds what is broadcast.
FREQUENT, MOST_FREQUENT = 4, 1 << 20
#: Lists up to this length are finished pair by pair, longer ones in blocks of about so many tokens.
SHORT, BLOCK_TOKENS = 32, 1 << 20
#: Pairs of whole sets that a task is sent at once: a long pivot stands in each of its pairs.
PAIRS_AT_ONCE = 256
#: Bytes of ids that may be broadcast to pick rows; beyond, they are joined by a shuffle.
MOST_BROADCAST = 32 << 20


def shingle_sets(w: Words, size: int = SIZE) -> list[np.ndarray]:
    """For each row, its distinct shingle hashes in ascending order."""
    h = w.hashes(lower=True)
    all_, bounds = windows(h, w.bounds, size)
    out = []
    for i in range(w.rows):
        a, n = w.bounds[i], w.bounds[i + 1] - w.bounds[i]
        if n >= size:
            s = np.sort(all_[bounds[i] : bounds[i + 1]])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            out.append(combined(h, np.array([a]), range(n)) ^ U64(n))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Twice 64 bits that stand for a whole set: its name, and what tells sets of one name apart."""
    return tuple(int(mix(np.array([np.add.reduce(mix(s ^ U64(salt)), dtype=U64) + U64(len(s))]))[0].astype(np.int64)) for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D))


def few(df: DataFrame, row_bytes: int) -> bool:
    """Whether a table of rows of fixed size may be broadcast."""
    most = MOST_BROADCAST // row_bytes
    return df.limit(most + 1).count() <= most


def must_share(n, percent: int):
    """Tokens of n that any linked set has."""
    return -(-percent * n // 100)


def powers(n: int, percent: int) -> range:
    """Powers of two below the sizes that a linked set of n tokens or more can have."""
    return range(int(n).bit_length() - 1, (100 * n // percent).bit_length())


def signatures(s: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set; s ascends, level is 0 for rare tokens, else the class of the token."""
    n = len(s)
    need = n - must_share(n, percent) + 1
    rare = s[level == 0]
    if len(rare) >= need:
        return rare[:need]
    order = np.argsort(level, kind="stable")
    frequent = s[order[len(rare) :]]
    out = [rare]
    for power in powers(n, percent):
        group = mix(frequent) % U64(max(1, (1 << power) // 4))
        by = np.argsort(group, kind="stable")
        worth = np.ones(len(frequent), np.int64)
        worth[by[np.append(True, group[by][1:] != group[by][:-1])]] = 0
        end = int(np.searchsorted(np.cumsum(worth), need - len(rare))) + 1
        x, g = frequent[:end], group[:end]
        by = np.lexsort((x, g))
        x, g = x[by], g[by]
        for lag in range(1, len(x)):
            same = g[lag:] == g[:-lag]
            if not same.any():
                break
            out.append(mix(mix(x[:-lag][same] + U64(power)) + x[lag:][same]))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch, size: int, renamed: dict[tuple[int, int], int]):
    """(row, set, key) of each row of a batch whose second column is the text."""
    for w in words(batch.column(1)):
        for i, s in enumerate(shingle_sets(w, size)):
            key = set_key(s)
            yield w.first + i, s, renamed.get(key, key[0])


def identify(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, dict[tuple[int, int], int]]:
    """(doc_id, mark, n_shingles, key) of every row, where mark is the third column; (key, doc_id) of every set, its smallest; and new names.

    Names that different sets share are few, a pair in 2**64 of sets; only those reach the driver.
    """

    def make(batch):
        rows = [(len(s), *set_key(s)) for w in words(batch.column(1)) for s in shingle_sets(w, size)]
        n, key, check = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        yield {"doc_id": batch.column(0), "mark": batch.column(2), "n_shingles": pa.array(n, pa.int64()), "key": pa.array(key, pa.int64()), "check": pa.array(check, pa.int64())}

    ids = stored(map_arrow(docs, "doc_id long, mark long, n_shingles long, key long, check long", make), "ids")
    nodes = stored(ids.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("low"), F.max("check").alias("high")), "nodes")
    shared = nodes.where("low <> high").select("key", "low")
    renamed = {(r["key"], r["check"]): int(mix(np.array([r["key"] ^ r["check"]], np.int64).view(U64))[0].astype(np.int64)) for r in ids.where("n_shingles > 0").join(shared, "key").where("check <> low").select("key", "check").distinct().collect()}
    if renamed:
        names = ids.sparkSession.createDataFrame([(k, c, new) for (k, c), new in renamed.items()], "key long, check long, new long")
        ids = stored(ids.join(F.broadcast(names), ["key", "check"], "left").select("doc_id", "mark", "n_shingles", F.coalesce("new", "key").alias("key")), "ids")
        nodes = stored(ids.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "nodes")
    return ids.select("doc_id", "mark", "n_shingles", "key"), nodes.select("key", "doc_id"), renamed


def frequent_tokens(docs: DataFrame, buckets: int, size: int, renamed: dict, least: int = FREQUENT, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Codes (sorted) and classes of the frequent tokens, at most ``most`` of them.

    Counted over all documents, in the half of each set that has the smaller hashes; that is
    where rare tokens are indexed. A class only steers where prefixes are cut: it must be the
    same for all documents, not exact, so tokens are counted by 32 bits within their bucket.
    """

    def entries(batch):
        seen, parts = set(), []
        for _, s, key in _sets(batch, size, renamed):
            if len(s) > 1 and key not in seen:
                seen.add(key)
                parts.append(s[: (len(s) + 1) // 2])
        if parts:
            token, n = np.unique(np.concatenate(parts), return_counts=True)
            yield packed((token % U64(buckets)).astype(np.int64), {"token": (token >> U64(32)).astype(np.uint32), "n": np.minimum(n, 65535).astype(np.uint16)})

    def count(table):
        token, n = unpacked(table["token"], np.uint32), unpacked(table["n"], np.uint16)
        order = np.argsort(token, kind="stable")
        token = token[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        total = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        keep = total >= least
        bucket = table["bucket"][0].as_py() if table.num_rows else 0
        return {"code": pa.array((np.int64(bucket) << np.int64(32)) | token[first][keep].astype(np.int64)), "class": pa.array(np.log2(total[keep]).astype(np.int32) if keep.any() else np.zeros(0, np.int32))}

    counted = stored(map_groups(map_arrow(docs, "bucket int, token binary, n binary", entries), ["bucket"], "code long, class int", count), "frequent")
    held, lowest = 0, 99
    for row in sorted(counted.groupBy("class").count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        lowest = row["class"]
    found = counted.where(F.col("class") >= lowest).toPandas()
    order = np.argsort(found["code"].to_numpy(), kind="stable")
    return found["code"].to_numpy(np.int64)[order], found["class"].to_numpy(np.int32)[order]


def signature_lists(docs: DataFrame, buckets: int, size: int, percent: int, renamed: dict, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Members of all lists of two sets or more: (list, length, key, n, pivot, pivot_n).

    Lists with the same members have the same name, and stand here once.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def entries(batch):
        code, level = known.value
        seen, sig, own, size_ = set(), [], [], []
        for _, s, key in _sets(batch, size, renamed):
            if len(s) < 2 or key in seen:
                continue
            seen.add(key)
            classes = np.zeros(len(s), np.int32)
            if len(code):
                mine = ((s % U64(buckets)).astype(np.int64) << np.int64(32)) | (s >> U64(32)).astype(np.int64)
                at = np.minimum(np.searchsorted(code, mine), len(code) - 1)
                classes = np.where(code[at] == mine, level[at], 0)
            x = signatures(s, classes, percent)
            sig.append(x)
            own.append(np.full(len(x), key, np.int64))
            size_.append(np.full(len(x), len(s), np.int32))
        if sig:
            sig = np.concatenate(sig)
            yield packed((sig % U64(buckets)).astype(np.int64), {"sig": (sig >> U64(32)).astype(np.uint32), "key": np.concatenate(own), "n": np.concatenate(size_)})

    def lists(table):
        sig, key, n = unpacked(table["sig"], np.uint32), unpacked(table["key"], np.int64), unpacked(table["n"], np.int32).astype(np.int64)
        order = np.lexsort((key, n, sig))
        sig, key, n = sig[order], key[order], n[order]
        keep = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])) if len(sig) else np.zeros(0, bool)
        sig, key, n = sig[keep], key[keep], n[keep]
        # by ascending size, no set before a gap can link to one after it
        first = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (100 * n[:-1] < percent * n[1:]))) if len(sig) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(sig)))
        if len(first):
            name = mix(np.add.reduceat(mix(key.view(U64)), first)).view(np.int64)
            pivot = np.minimum.reduceat(key, first)
            pivot_n = n[key == np.repeat(pivot, length)]
        else:
            name = pivot = pivot_n = np.zeros(0, np.int64)
        many = np.repeat(length > 1, length)
        return {k: pa.array(v[many]) for k, v in (("list", np.repeat(name, length)), ("length", np.repeat(length, length)), ("key", key), ("n", n), ("pivot", np.repeat(pivot, length)), ("pivot_n", np.repeat(pivot_n, length)))}

    sent = map_arrow(docs, "bucket int, sig binary, key binary, n binary", entries)
    return map_groups(sent, ["bucket"], "list long, length long, key long, n long, pivot long, pivot_n long", lists).dropDuplicates(["list", "key"])


def packed_sets(docs: DataFrame, chosen: DataFrame, size: int, renamed: dict) -> DataFrame:
    """(key, tokens) of the documents whose ids are in ``chosen``, null included; rows that share an id can repeat a key."""
    chosen = chosen.select(F.col("doc_id").alias("_id")).distinct()
    docs = docs.join(F.broadcast(chosen) if few(chosen, 16) else chosen, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def make(batch):
        rows = [(key, s) for _, s, key in _sets(batch, size, renamed)]
        if rows:
            bounds = np.cumsum([0, *(len(s) for _, s in rows)])
            yield {"key": pa.array([k for k, _ in rows], pa.int64()), "tokens": binary(np.concatenate([s for _, s in rows]), bounds)}

    return map_arrow(docs, "key long, tokens binary", make)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    both = pairs.join(sets.toDF("b", "tokens_b"), "b").join(sets.toDF("a", "tokens_a"), "a").select("a", "b", "tokens_a", "tokens_b")

    def make(batch):
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
        keep = batch.filter(pa.array(ok, pa.bool_()))
        yield {"a": keep.column(0), "b": keep.column(1)}

    return map_arrow(both, "a long, b long", make)


def fits(n, m, percent: int):
    """Sizes that a link allows."""
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def linked_in_blocks(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within families, that is, within sets that long lists connect.

    Members outside their family's largest component are compared with all members, block by
    block; of each (member, component) one link is returned.
    """
    family = components(lists.select(F.col("key").alias("a"), F.col("pivot").alias("b"))).toDF("key", "family")
    member = lists.select("key", "n", "component").distinct().join(family, "key")
    size = member.groupBy("family", "component").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    largest = size.groupBy("family").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.sum("tokens").alias("tokens"), F.sum("members").alias("members"))
    apart = size.join(largest.select("family", "largest"), "family").groupBy("family").agg(F.sum(F.when(F.col("component") != F.col("largest"), F.col("tokens")).otherwise(0)).alias("apart"))
    blocks = largest.join(apart, "family").select("family", "members", "largest", *(F.ceil(F.col(c) / BLOCK_TOKENS).alias(f"{c}_blocks") for c in ("tokens", "apart")))
    # a family can hold a large share of the members, so its figures come to them, not they to it
    blocks = blocks.select(F.col("family").cast("string").alias("name"), F.col("members").alias("n"), "largest", "tokens_blocks", "apart_blocks")
    member = join_counted(member.withColumn("name", F.col("family").cast("string")), blocks, "name", F.col("key")).where("apart_blocks > 0")
    own = F.pmod(F.xxhash64("key"), F.col("tokens_blocks"))
    all_ = member.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("apart_blocks") - 1)).alias("row"), own.alias("col"), "key", "component", F.lit(False).alias("asks"))
    asks = member.where("component <> largest").select("family", F.pmod(F.xxhash64("key"), F.col("apart_blocks")).alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens_blocks") - 1)).alias("col"), "key", "component", F.lit(True).alias("asks"))
    tiles = all_.union(asks).join(sets, "key").select("family", "row", "col", "key", "component", "asks", "tokens")

    def compare(table):
        a, b = [], []
        asking = np.asarray(table["asks"])
        rest, asking = table.filter(pa.array(~asking)), table.filter(pa.array(asking))
        if rest.num_rows and asking.num_rows:
            key, component = np.asarray(rest["key"]), np.asarray(rest["component"])
            n = np.array([len(v.as_buffer()) // 8 for c in rest["tokens"].chunks for v in c])
            known, code = np.unique(unpacked(rest["tokens"], U64), return_inverse=True)
            first = np.append(0, np.cumsum(n)[:-1])
            mark = np.zeros(len(known), np.int32)
            for k, c, t in zip(asking["key"].to_pylist(), asking["component"].to_pylist(), asking["tokens"], strict=True):
                t = np.frombuffer(t.as_buffer(), U64)
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                at = at[known[at] == t]
                mark[at] = 1
                shared = np.add.reduceat(mark[code], first)
                mark[at] = 0
                hit = np.flatnonzero((100 * shared >= percent * (len(t) + n - shared)) & (component != c))
                hit = hit[np.unique(component[hit], return_index=True)[1]]
                a += [k] * len(hit)
                b += key[hit].tolist()
        return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}

    return map_groups(tiles, ["family", "row", "col"], "a long, b long", compare)


def _linked_keys(docs: DataFrame, size: int, percent: int, frequent: int, short: int) -> tuple[DataFrame, DataFrame]:
    """Per row its doc_id, mark, n_shingles and key; per key its smallest doc_id and the component, named by one of its keys."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(docs)
    ids, nodes, renamed = identify(docs.select("*", F.xxhash64("text").alias("mark")), size)
    lists = stored(signature_lists(docs, buckets, size, percent, renamed, frequent_tokens(docs, buckets, size, renamed, frequent)), "lists")
    sets = stored(packed_sets(docs, nodes.join(lists.select("key").distinct(), "key", "left_semi").select("doc_id"), size, renamed), "sets")
    if sets.groupBy("key").count().where("count > 1").limit(1).count():
        sets = stored(sets.dropDuplicates(["key"]), "sets")

    stars = lists.where((F.col("key") != F.col("pivot")) & fits(F.col("n"), F.col("pivot_n"), percent)).select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    with small_batches(docs.sparkSession, PAIRS_AT_ONCE):
        links = stored(linked(stars, sets, percent), "links")
    known = components(links).toDF("key", "component")
    mixed = lists.where("length > 2").join(known, "key", "left").withColumn("component", F.coalesce("component", "key"))
    # a list can hold a large share of the members: its summary comes to them
    mixed = stored(mixed.withColumn("name", F.col("list").cast("string")), "members")
    several = mixed.groupBy("name").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("name", "n", "low")
    mixed = stored(join_counted(mixed, several, "name", F.col("key")).where("low is not null").drop("name", "low"), "mixed")
    some = mixed.where((F.col("length") <= short) & (F.col("key") != F.col("pivot")))
    left, right = (some.select("list", F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("component").alias(f"c_{k}")) for k in "ab")
    pairs = left.join(right, "list").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & fits(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()
    links = links.union(linked(pairs, sets, percent)).union(linked_in_blocks(mixed.where(F.col("length") > short), sets, percent))
    with small_batches(docs.sparkSession, PAIRS_AT_ONCE):
        links = stored(links, "all-links")
    known = components(links).toDF("key", "component")

    named = nodes.join(known, "key", "left").withColumn("component", F.coalesce("component", "key"))
    return ids, named.select("key", "doc_id", "component")


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT, short: int = SHORT) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Takes doc_id and text; other columns are ignored. Null, empty and blank texts have no
    shingle and link with nothing, each is its own component. Rows without doc_id take part in
    links; their component_id is null only if no linked row has a doc_id. Repeated rows are
    equal sets and so link. Very long texts are taken whole. An empty table gives an empty result.
    """
    ids, named = _linked_keys(docs, size, percent, frequent, short)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("key", "component_id")
    full = ids.where("n_shingles > 0").join(named, "key").select("doc_id", "n_shingles", "component_id")
    return full.union(ids.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates: of each component one row, that of smallest doc_id, with all its columns.

    Rows without doc_id come last, and of rows that share a doc_id that of smallest text hash is
    first, so each component keeps a row whatever other rows have its doc_id. Of texts without
    shingles one for each doc_id stays, and all without doc_id. Only rows that repeat both doc_id
    and text are shuffled with their texts.
    """
    ids, named = _linked_keys(docs, size, percent, FREQUENT, SHORT)
    full = ids.where("n_shingles > 0").join(named.select("key", "component"), "key").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("rows"))
    found = full.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "rows")).alias("first")).select("first.doc_id", "first.mark", "first.rows")
    blank = ids.where("n_shingles = 0").groupBy("doc_id", "mark").agg(F.count("*").alias("rows"))
    found = found.union(blank.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("mark", "rows")).alias("first")).select("doc_id", "first.mark", "first.rows"))
    found = found.union(blank.where("doc_id is null").select("doc_id", "mark", F.lit(1).cast("long")))
    found = stored(found.toDF("_id", "_mark", "_rows"), "firsts")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("kept"), F.xxhash64("text").alias("mark"))
    rows = rows.join(F.broadcast(found) if few(found, 100) else found, F.col("kept").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    once = Window.partitionBy("kept", "mark").orderBy("mark")
    several = rows.where("_rows > 1").withColumn("place", F.row_number().over(once)).where("place = 1").select("row")
    return rows.where("_rows = 1").select("row").union(several).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
