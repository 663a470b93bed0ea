"""A plan's row-local actions on a stream, with deduplication bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cleaning import clean
from ..plans.model import PlanError, actions_of

ROW_LOCAL = frozenset(("normalize_column_names", "strip_whitespace", "replace_null_like", "replace_values", "normalize_case", "to_numeric", "to_datetime", "set_negative_to_null", "recalculate_from_columns", "drop_empty_rows", "no_change"))


def clean_stream(stream: DataFrame, plan, event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Row-local actions as they are; deduplication of rows that arrive within ``delay`` of each other.

    Actions that have to see the whole table (empty columns, formulas' whole numbers) are refused.
    """
    local = []
    for a in actions_of(plan):
        if a.operation.startswith("drop_duplicate"):
            if event_time is None:
                raise PlanError(f"{a.operation} on a stream needs an event time")
            stream = clean(stream, local, count=False).df if local else stream
            local = []
            keys = list(a.columns) if a.operation == "drop_duplicates_by_columns" else [c for c in stream.columns if c != event_time]
            stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
        elif a.operation in ROW_LOCAL:
            local.append(a)
        else:
            raise PlanError(f"{a.operation} needs the whole table")
    return clean(stream, local, count=False).df if local else stream
