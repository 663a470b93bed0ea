"""Actions, plans, log entries and requirements: the engine's logical plan."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

#: Operations in execution order.
OPERATIONS = (
    "normalize_column_names", "drop_duplicate_rows", "strip_whitespace", "replace_null_like", "replace_values", "normalize_case",
    "to_numeric", "to_datetime", "set_negative_to_null", "fill_missing_from_formula", "recalculate_from_columns", "drop_empty_rows",
    "drop_empty_columns", "drop_duplicate_rows_after_cleaning", "drop_duplicates_by_columns", "no_change",
)
#: What a reviewer may not propose: destructive, or decided by rule.
NOT_FOR_REVIEWERS = frozenset(("set_negative_to_null", "drop_duplicate_rows", "drop_duplicates_by_columns", "drop_duplicate_rows_after_cleaning", "recalculate_from_columns", "fill_missing_from_formula"))


class PlanError(ValueError):
    """A plan that can't be run: unknown operation, unknown column, wrong shape."""


@dataclass(frozen=True)
class Action:
    operation: str
    columns: tuple[str, ...] = ()
    reason: str = ""
    confidence: str = "high"
    requires_review: bool = False
    replacements: dict | None = field(default=None, hash=False)
    null_tokens: tuple[str, ...] | None = None
    case_mode: str | None = None
    decimal_comma: bool = False
    dayfirst: bool = False
    source_columns: tuple[str, ...] = ()
    replacements_path: str | None = None  # Parquet with _old and _new, in place of replacements, where they are too many to list

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise PlanError(f"unknown operation: {self.operation}")

    @classmethod
    def of(cls, action: dict | Action) -> Action:
        if isinstance(action, cls):
            return action
        if not isinstance(action, dict) or "operation" not in action:
            raise PlanError("an action is an object with an operation")
        known = {k: v for k, v in action.items() if k in cls.__dataclass_fields__}
        columns = [*([action["column"]] if action.get("column") else []), *(action.get("columns") or [])]
        known["columns"] = tuple(dict.fromkeys(columns))
        for k in ("null_tokens", "source_columns"):
            if known.get(k) is not None:
                known[k] = tuple(known[k])
        return cls(**known)

    def json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)


@dataclass(frozen=True)
class LogEntry:
    number: int
    operation: str
    columns: tuple[str, ...]
    reason: str
    affected: int
    rows_before: int
    rows_after: int
    details: str = ""


@dataclass(frozen=True)
class Requirement:
    id: str
    column: str | None
    issue: str
    use_one_of: tuple[str, ...]
    review_required: bool = False
    required_tokens: tuple[str, ...] = ()


def actions_of(plan: dict | Iterable) -> list[Action]:
    actions = plan.get("actions") if isinstance(plan, dict) else plan
    if not isinstance(actions, list | tuple):
        raise PlanError("a plan holds a list of actions")
    return [Action.of(a) for a in actions]


def header(name: str) -> str:
    """A column name without byte order marks and with single spaces."""
    return re.sub(r"\s+", " ", str(name).replace("﻿", "")).strip()


def resolve(name: str, columns: list[str], aliases: dict[str, str]) -> str:
    """Exact name, then alias of a renamed column, then the only column with the same normalised name."""
    if name in columns:
        return name
    if aliases.get(name) in columns:
        return aliases[name]
    same = [c for c in columns if header(c).lower() == header(name).lower()]
    if len(same) != 1:
        raise PlanError(f"unknown column: {name}")
    return same[0]


_RANK = {"low": 0, "medium": 1, "high": 2}


def merge_replacements(actions: list[Action]) -> list[Action]:
    """One replace_values per column and review flag; later pairs win, confidence is the least."""
    out: dict = {}
    for i, a in enumerate(actions):
        key = (a.columns, a.requires_review) if a.operation == "replace_values" and len(a.columns) == 1 and not a.replacements_path else i
        if key in out:
            b = out[key]
            out[key] = replace(b, replacements={**(b.replacements or {}), **(a.replacements or {})}, confidence=min(a.confidence, b.confidence, key=_RANK.get), reason=b.reason or a.reason)
        else:
            out[key] = a
    return list(out.values())


def resolve_chains(actions: list[Action]) -> list[Action]:
    """a to b and b to c becomes a to c, in automatic actions; a cycle is followed once round and stays. What maps to itself goes."""
    out = []
    for a in actions:
        if a.operation == "replace_values" and not a.requires_review and a.replacements:
            mapped = {}
            for old, new in a.replacements.items():
                seen: set = set()
                while new in a.replacements and new not in seen and a.replacements[new] != new:
                    seen.add(new)
                    new = a.replacements[new]
                if new != old:
                    mapped[old] = new
            if not mapped:
                continue
            a = replace(a, replacements=mapped)
        out.append(a)
    return out


def without_repeats(actions: list[Action]) -> list[Action]:
    return list({a.json(): a for a in reversed(actions)}.values())[::-1]


def ordered(actions: list[Action]) -> list[Action]:
    return sorted(actions, key=lambda a: OPERATIONS.index(a.operation))


def covers(action: Action, need: Requirement) -> bool:
    if action.operation not in (*need.use_one_of, "no_change"):
        return False
    if need.column is not None and need.column not in action.columns:
        return False
    if action.operation == "no_change":
        return action.requires_review
    return action.requires_review or not need.review_required


def uncovered(actions: list[Action], needs: list[Requirement]) -> list[Requirement]:
    """Requirements that no action covers; those with tokens need all tokens among the actions that cover them."""
    out = []
    for need in needs:
        own = [a for a in actions if covers(a, need)]
        given = {t.lower() for a in own for t in (*(a.null_tokens or ()), *map(str, a.replacements or {}))}
        if not own or (not any(a.operation == "no_change" for a in own) and not {t.lower() for t in need.required_tokens} <= given):
            out.append(need)
    return out


def finalise(actions: list[Action], extra: list[Action], needs: list[Requirement]) -> list[Action]:
    """The final plan: merged, chains resolved, without repeats, what isn't covered noted, in execution order."""
    plan = without_repeats(resolve_chains(merge_replacements([*actions, *extra])))
    notes = [Action("no_change", (n.column,) if n.column else (), f"not covered: {n.issue}", "low", True) for n in uncovered(plan, needs)]
    return ordered([*plan, *notes])


def reviewed(proposed: list[dict], null_like) -> list[Action]:
    """What a reviewer may add: replace_values alone, with sane flags, and never to a null marker or blank."""
    out = []
    for a in proposed:
        if not isinstance(a, dict) or a.get("operation") != "replace_values" or a["operation"] in NOT_FOR_REVIEWERS:
            continue
        pairs = {k: v for k, v in (a.get("replacements") or {}).items() if v is not None and str(v).strip() and not null_like(str(v))}
        if pairs:
            out.append(Action.of({**a, "replacements": pairs, "confidence": a.get("confidence") if a.get("confidence") in _RANK else "medium", "requires_review": a["requires_review"] if isinstance(a.get("requires_review"), bool) else True}))
    return out


def default_selection(plan: list[Action]) -> list[Action]:
    """What runs unless somebody decides otherwise: all that needs no review; notes never run."""
    return [a for a in plan if not a.requires_review and a.operation != "no_change"]
