"""Guards: small JSON conditions on a subject, compiled to Columns.

``{"absent": path}``, ``{"present": path}``, ``{"equals": {"path": .., "value": ..}}``, ``{"allOf": [..]}``,
``{"anyOf": [..]}``, ``{"not": ..}``. A path is ``subject.data.<field>`` or ``subject.<aspect>.data.<field>``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import is_absent, kind


def compile_guard(guard: dict | str, column: Callable[[str | None, str], Column], dtype: Callable[[str | None, str], str]) -> Column:
    """``column(aspect, field)`` gives a path's Column and ``dtype(aspect, field)`` its Spark type name."""
    found = json.loads(guard) if isinstance(guard, str) else guard
    if not isinstance(found, dict) or len(found) != 1:
        raise ValueError("a guard has exactly one key")
    (op, body), = found.items()
    again = lambda g: compile_guard(g, column, dtype)
    if op in ("absent", "present"):
        path = split_path(body)
        missing = is_absent(column(*path), dtype(*path))
        return missing if op == "absent" else ~missing
    if op == "equals":
        path = split_path(body["path"])
        value, here = body["value"], kind(dtype(*path))
        want = "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else None
        if want != here:  # types are not converted
            return F.lit(False)
        return ~is_absent(column(*path), dtype(*path)) & (column(*path) == F.lit(value))
    if op in ("allOf", "anyOf"):
        parts = [again(g) for g in body]
        if not parts:
            raise ValueError(f"{op} of nothing")
        total = parts[0]
        for p in parts[1:]:
            total = total & p if op == "allOf" else total | p
        return total
    if op == "not":
        return ~again(body)
    raise ValueError(f"no guard {op}")


def split_path(path: str) -> tuple[str | None, str]:
    parts = path.split(".")
    if len(parts) == 3 and parts[0] == "subject" and parts[1] == "data":
        return None, parts[2]
    if len(parts) == 4 and parts[0] == "subject" and parts[2] == "data":
        return parts[1], parts[3]
    raise ValueError(f"no path {path}")


def apply_effects(state: dict[str, object], effects: list[dict | str]) -> dict[str, object]:
    """A planned action's effects on what is known of a subject, by path: ``present`` makes it true, ``absent`` takes it
    away, ``equals`` sets it, ``allOf`` does each; anything else is no effect. The given state stays as it is."""
    found = dict(state)
    for effect in effects:
        body = json.loads(effect) if isinstance(effect, str) else effect
        (op, value), = body.items()
        if op in ("present", "absent"):
            split_path(value)
            found.pop(value, None)
            if op == "present":
                found[value] = True
        elif op == "equals":
            split_path(value["path"])
            found[value["path"]] = value["value"]
        elif op == "allOf":
            found = apply_effects(found, value)
        else:
            raise ValueError(f"{op} is no effect")
    return found
