"""The allow-listed cleaning operations, compiled into one lazy DataFrame.

Row-local operations are projections that Catalyst collapses; a value's change is counted
by an Observation on the way, so the log costs no job of its own. Deduplication groups
with map-side combining and takes the first row by the order column, so that a row that
makes up a third of the table is combined before it is shuffled. Two operations look at
the data before they can be compiled: drop_empty_columns and fill_missing_from_formula.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numbers, text
from ..plans.model import Action, LogEntry, PlanError, actions_of, header, resolve

TOLERANCE = 0.02
#: Replacement pairs beyond which a map is joined instead of being a literal.
MOST_LITERAL_PAIRS = 1000
#: Characters of listed pairs that may be broadcast; beyond, Spark chooses.
MOST_BROADCAST = 8 << 20


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return _quoted(name).cast("double") if isinstance(kind, T.NumericType) else numbers.lenient(text.as_text(_quoted(name), kind))


@dataclass
class Cleaned:
    df: DataFrame
    steps: list = field(default_factory=list)

    def log(self, run: bool = True) -> list[LogEntry]:
        """A log entry per action. The counts come with the first job over ``df``; ``run`` starts one if need be."""
        if run and any(s[2] is not None for s in self.steps):
            self.df.write.format("noop").mode("overwrite").save()
        out = []
        for n, (action, columns, before, after, fixed) in enumerate(self.steps, 1):
            a, b = (o.get if o is not None else {} for o in (before, after))
            rows_before = a.get("rows", 0)
            rows_after = b.get("rows", rows_before)
            affected = fixed if fixed is not None else a.get("changed") if "changed" in a else rows_before - rows_after
            out.append(LogEntry(n, action.operation, tuple(columns), action.reason, int(affected or 0), rows_before, rows_after))
        return out


def first_rows(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per distinct key (null equals null): that of smallest order, else any."""
    names = df.columns
    rest = [c for c in names if c not in keys and c != order]
    if order is None:
        return df.dropDuplicates(keys)
    own = [_quoted(k) for k in keys]
    if not rest:
        return df.groupBy(*own).agg(F.min(_quoted(order)).alias(order)).select(*map(_quoted, names))
    kept = df.groupBy(*own).agg(F.min_by(F.struct(_quoted(order), *map(_quoted, rest)), F.struct(_quoted(order))).alias("_kept"))
    return kept.select(*own, F.col("_kept.*")).select(*map(_quoted, names))


def _projection(df: DataFrame, a: Action, columns: list[str]) -> dict[str, Column]:
    """New values of the columns that a row-local action changes."""
    out = {}
    for c in columns:
        old, kind = _quoted(c), df.schema[c].dataType
        stringy = isinstance(kind, T.StringType)
        if a.operation == "strip_whitespace":
            if stringy:
                out[c] = text.strip(old)
        elif a.operation == "replace_null_like":
            tokens = a.null_tokens if a.null_tokens is not None else text.CLEAN_NULLS
            out[c] = F.when(F.lower(text.strip(text.as_text(old, kind))).isin(*[t.strip().lower() for t in tokens]), None).otherwise(old)
        elif a.operation == "to_numeric":
            out[c] = old.cast("double") if isinstance(kind, T.NumericType) else numbers.lenient(text.as_text(old, kind), a.decimal_comma)
        elif a.operation == "to_datetime":
            out[c] = old.cast("timestamp_ntz") if isinstance(kind, T.TimestampType | T.DateType | T.TimestampNTZType) else dates.mixed(text.strip(text.as_text(old, kind)), a.dayfirst)
        elif a.operation == "replace_values":
            if not a.replacements:
                raise PlanError("replace_values needs replacements")
            pairs = [F.lit(x) for k, v in a.replacements.items() for x in (str(k), None if v is None else str(v))]
            found = F.create_map(*pairs)[text.as_text(old, kind)]
            known = text.as_text(old, kind).isin(*[str(k) for k in a.replacements])
            out[c] = F.when(known, found.cast(kind)).otherwise(old)
        elif a.operation == "normalize_case":
            if a.case_mode not in ("lower", "upper", "title"):
                raise PlanError(f"unknown case mode: {a.case_mode}")
            if stringy:
                out[c] = text.cased(old, a.case_mode)
        elif a.operation == "set_negative_to_null":
            out[c] = F.when(numbers.plain(text.as_text(old, kind)) < 0, None).otherwise(old)
    return out


def fill_expressions(a: Column, b: Column, t: Column, whole: tuple[bool, bool, bool]) -> tuple[Column, Column, Column]:
    """t = a * b with the one missing operand filled; a column of whole numbers takes whole results only."""

    def fitted(value: Column, only_whole: bool) -> Column:
        near = F.abs(value - F.rint(value)) < 1e-9
        return F.when(near, F.rint(value)) if only_whole else numbers.round_even(value)

    known = lambda *c: F.lit(True) if not c else c[0].isNotNull() & known(*c[1:])
    return (
        F.when(a.isNull() & known(b, t) & (b != 0), fitted(F.try_divide(t, b), whole[0])).otherwise(a),
        F.when(b.isNull() & known(a, t) & (a != 0), fitted(F.try_divide(t, a), whole[1])).otherwise(b),
        F.when(t.isNull() & known(a, b), fitted(a * b, whole[2])).otherwise(t),
    )


def mismatch(a: Column, b: Column, t: Column) -> Column:
    return F.coalesce(F.abs(a * b - t) > TOLERANCE * F.greatest(F.abs(t), F.lit(1.0)), F.lit(False))


def clean(df: DataFrame, plan, order: str | None = None, count: bool = True, carry: tuple[str, ...] = ()) -> Cleaned:
    """Apply a plan's actions in their order. ``order`` names the column that says which row is first; it isn't data.

    Without ``count`` nothing is observed and the log has no figures, as on streams. Columns in
    ``carry`` aren't data either: they stay with the rows that stay.
    """

    def seen(df: DataFrame, by: Observation, *metrics: Column) -> DataFrame:
        return df.observe(by, F.count("*").alias("rows"), *metrics) if count else df

    aliases: dict[str, str] = {}
    out = Cleaned(df)
    for a in actions_of(plan):
        df = out.df
        data = [c for c in df.columns if c != order and c not in carry]
        columns = list(dict.fromkeys(resolve(c, data, aliases) for c in a.columns))
        before, after, fixed = Observation(), None, None
        new: dict[str, Column] = {}
        op = a.operation
        if op == "normalize_column_names":
            names = {c: header(c) for c in data}
            if len(set(names.values())) < len(names):
                raise PlanError("two columns would have the same name")
            fixed = sum(k != v for k, v in names.items())
            aliases |= names
            df = seen(df, before).select(*(_quoted(c).alias(names.get(c, c)) for c in df.columns))
        elif op in ("drop_empty_rows", "drop_duplicate_rows", "drop_duplicate_rows_after_cleaning", "drop_duplicates_by_columns"):
            if op == "drop_duplicates_by_columns" and not columns:
                raise PlanError(f"{op} needs columns")
            df = seen(df, before)
            df = df.where(F.coalesce(*(F.when(_quoted(c).isNotNull(), True) for c in data))) if op == "drop_empty_rows" else first_rows(df, columns if op == "drop_duplicates_by_columns" else data, order)
            after = Observation()
            df = seen(df, after)
        elif op == "drop_empty_columns":
            held = df.agg(*(F.count(_quoted(c)).alias(f"c{i}") for i, c in enumerate(data))).first()
            empty = [c for i, c in enumerate(data) if not held[f"c{i}"]]
            fixed = len(empty)
            df = seen(df, before).drop(*empty)
        elif op in ("fill_missing_from_formula", "recalculate_from_columns"):
            names = [resolve(c, data, aliases) for c in (*a.source_columns, *a.columns)]
            if len(names) != 3 or (op == "recalculate_from_columns" and len(a.source_columns) != 2):
                raise PlanError(f"{op} needs two source columns and a target")
            columns = names if op == "fill_missing_from_formula" else names[2:]
            x = [_number(df, c) for c in names]
            if op == "fill_missing_from_formula":
                whole = df.agg(*(F.bool_and(c % 1 == 0).alias(f"w{i}") for i, c in enumerate(x))).first()
                new = dict(zip(names, fill_expressions(*x, tuple(bool(w) for w in whole)), strict=True))
            else:
                new = {names[2]: F.when(mismatch(*x), numbers.round_even(x[0] * x[1])).otherwise(x[2])}
            changed = sum((F.count_if(~v.eqNullSafe(_number(df, c))) for c, v in new.items()), F.lit(0))
            df = seen(df, before, changed.alias("changed"))
        elif op == "no_change":
            fixed = 0
            df = seen(df, before)
        else:
            if op == "replace_values" and (a.replacements_path or (a.replacements and len(a.replacements) > MOST_LITERAL_PAIRS)):
                df = _replaced_by_join(df, columns, a)
                df = seen(df, before, F.sum("_changed").alias("changed")).drop("_changed")
            else:
                new = _projection(df, a, columns)
                kinds = {c: df.schema[c].dataType for c in new}
                same = lambda c, v: text.as_text(v, df.select(v).schema[0].dataType).eqNullSafe(text.as_text(_quoted(c), kinds[c])) if op == "replace_values" else v.isNull().eqNullSafe(_quoted(c).isNull()) if op not in ("strip_whitespace", "normalize_case") else v.eqNullSafe(_quoted(c))
                changed = sum((F.count_if(~same(c, v)) for c, v in new.items()), F.lit(0))
                if op in ("to_numeric", "to_datetime"):
                    changed = sum((F.count_if(_quoted(c).isNotNull()) for c in new), F.lit(0))
                df = seen(df, before, changed.alias("changed"))
        if new:
            df = df.select(*(new[c].alias(c) if c in new else _quoted(c) for c in df.columns))
        out = Cleaned(df, [*out.steps, (a, columns, before if count else None, after if count else None, fixed)])
    return out


def _replaced_by_join(df: DataFrame, columns: list[str], a: Action) -> DataFrame:
    """Replace through a join with the pairs: broadcast if the plan lists them; a stored table of them may be as large as the column."""
    if a.replacements_path:
        table = df.sparkSession.read.schema("_old string, _new string").parquet(a.replacements_path)
    else:
        pairs = [(str(k), None if v is None else str(v)) for k, v in a.replacements.items()]
        table = df.sparkSession.createDataFrame(pairs, "_old string, _new string")
        table = F.broadcast(table) if sum(len(k) + len(v or "") for k, v in pairs) <= MOST_BROADCAST else table
    df = df.withColumn("_changed", F.lit(0))
    for c in columns:
        kind = df.schema[c].dataType
        found = df.join(table, text.as_text(_quoted(c), kind) == F.col("_old"), "left")
        df = found.withColumn("_changed", F.col("_changed") + F.when(F.col("_old").isNotNull(), 1).otherwise(0)).withColumn(c, F.when(F.col("_old").isNotNull(), F.col("_new").cast(kind)).otherwise(_quoted(c))).drop("_old", "_new")
    return df
