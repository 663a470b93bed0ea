"""The value table of a cleaned table, kept up from the value table before instead of read again.

A row-local action gives a cell a value that depends on its old value alone, so it's applied to
the distinct values with their counts. Removed duplicates have the same cells as the row that
stays, so their cells are subtracted: a group of k equal rows gives each of its values k - 1 less,
and what appeared first stays first. Rows without any value take missing cells with them. Columns
that a formula fills are counted again in the result, and so is the whole table after rows were
dropped by some of their columns, since those rows differ from the ones that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text
from ..plans.model import Action, actions_of, header, resolve
from .cleaning import MOST_LITERAL_PAIRS, _projection, _quoted, clean
from .values import value_table

_WHOLE_ROWS = ("drop_duplicate_rows", "drop_duplicate_rows_after_cleaning")


def _mapped(frame: DataFrame, a: Action, columns: list[str], kinds: dict) -> DataFrame:
    """The action on distinct values; ``kinds`` follows the columns' types."""
    by_kind: dict[str, list[str]] = {}  # columns of one type share one expression
    for c in columns:
        by_kind.setdefault(kinds[c].simpleString(), []).append(c)
    typed = frame.select("name", "value", "n", "first", *(F.col("value").try_cast(kind).alias(f"_{i}") for i, kind in enumerate(by_kind)))
    value = F.col("value")
    for i, own in enumerate(by_kind.values()):
        for c, new in _projection(typed, a, [f"_{i}"]).items():
            to = typed.select(new.alias(c)).schema[c].dataType
            value = F.when(F.col("name").isin(*own), as_text(new, to)).otherwise(value)
            kinds |= dict.fromkeys(own, to)
    return typed.select("name", value.alias("value"), "n", "first")


def _removed(state: DataFrame, data: list[str]) -> DataFrame:
    """Cells of the rows that whole-row deduplication drops, with negative counts."""
    groups = state.groupBy(*map(_quoted, data)).agg(F.count("*").alias("_k")).where("_k > 1")
    cells = [F.struct(F.lit(c).alias("name"), as_text(_quoted(c), state.schema[c].dataType).alias("value")) for c in data]
    return groups.select((1 - F.col("_k")).alias("n"), F.explode(F.array(*cells)).alias("c")).groupBy("c.name", "c.value").agg(F.sum("n").alias("n")).withColumn("first", F.lit(None))


def value_table_after(values: DataFrame, before: DataFrame, plan, order: str) -> DataFrame:
    """value_table of ``clean(before, plan, order).df``, given ``values`` = value_table(before). ``first`` of missing cells isn't kept up."""
    actions = actions_of(plan)
    if any(a.operation == "drop_duplicates_by_columns" or a.replacements_path or len(a.replacements or ()) > MOST_LITERAL_PAIRS for a in actions):
        after = clean(before, actions, order, count=False).df
        return value_table(after, [c for c in after.columns if c != order], order, before.count())
    kinds = {c: before.schema[c].dataType for c in before.columns if c != order}
    aliases: dict[str, str] = {}
    stale: set[str] = set()
    frame = values.select("name", "value", "n", "first")
    for k, a in enumerate(actions):
        columns = list(dict.fromkeys(resolve(c, list(kinds), aliases) for c in a.columns))
        if a.operation == "normalize_column_names":
            names = {c: header(c) for c in kinds}
            aliases |= names
            renamed = [x for c, new in names.items() if c != new for x in (F.lit(c), F.lit(new))]
            if renamed:
                frame = frame.withColumn("name", F.coalesce(F.create_map(*renamed)[F.col("name")], F.col("name")))
            kinds, stale = {names[c]: t for c, t in kinds.items()}, {names[c] for c in stale}
        elif a.operation in (*_WHOLE_ROWS, "drop_empty_rows"):
            state = clean(before, actions[:k], order, count=False).df
            if a.operation in _WHOLE_ROWS:
                gone = _removed(state, list(kinds))
            else:
                empty = state.where(F.coalesce(*(F.when(_quoted(c).isNotNull(), True) for c in kinds)).isNull()).agg(F.count("*").alias("k"))
                gone = empty.select((-F.col("k")).alias("n"), F.explode(F.array(*map(F.lit, kinds))).alias("name")).select("name", F.lit(None).cast("string").alias("value"), "n", F.lit(None).alias("first"))
            frame = frame.union(gone.select("name", "value", "n", "first"))
        elif a.operation == "drop_empty_columns":
            kept = {c for c in clean(before, actions[: k + 1], order, count=False).df.columns}
            kinds = {c: t for c, t in kinds.items() if c in kept}
        elif a.operation in ("fill_missing_from_formula", "recalculate_from_columns"):
            names = [resolve(c, list(kinds), aliases) for c in (*a.source_columns, *a.columns)]
            stale |= set(names if a.operation == "fill_missing_from_formula" else names[2:])
        elif a.operation != "no_change" and (own := [c for c in columns if c not in stale]):
            frame = _mapped(frame, a, own, kinds)
    fresh = [c for c in kinds if c not in stale]
    out = frame.where(F.col("name").isin(*fresh)).groupBy("name", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 0")
    if stale:
        after = clean(before, actions, order, count=False).df
        out = out.union(value_table(after, [c for c in after.columns if c in stale], order, before.count()))
    return out
