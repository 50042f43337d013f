"""Folding event streams into history rows, in batch.

A definition names the key and how each column takes its value from an event; a column that an event doesn't set
carries its last value forward, and listed event types clear it. The fold over a key's events in sequence order
is three window or grouping steps, never a loop over rows: the last set value after the last clear.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOTS = {"eventType": "event_type", "domain": "domain", "targetKey": "target_key", "requestId": "request_id", "eventId": "event_id", "timestamp": "timestamp", "message.sequence": "seq"}


@dataclass(frozen=True)
class ColumnRule:
    """``path``: copied; with ``mapping`` looked up there (an unknown value rejects the event); ``value`` with
    ``when``: that constant, for those event types only. ``clear_on``: event types that empty the column."""

    name: str
    path: str | None = None
    mapping: tuple[tuple[str, str], ...] = ()
    when: tuple[str, ...] = ()
    value: str | None = None
    clear_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class HistoryDefinition:
    key: str
    columns: tuple[ColumnRule, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not self.key or not self.columns:
            raise ValueError("a history needs a key and at least one column")


def at_path(path: str) -> Column:
    """A column or, for ``payload.<field>``, an entry of the payload map."""
    if path in ROOTS:
        return F.col(ROOTS[path]).cast("string")
    if path.startswith("payload.") and path.count(".") == 1:
        return F.try_element_at("payload", F.lit(path.split(".")[1]))
    raise ValueError(f"no path {path}")


def is_set(path: str) -> Column:
    """A field that is there counts as set even if it is null; a missing one doesn't."""
    if path in ROOTS:
        return F.lit(True)
    return F.coalesce(F.array_contains(F.map_keys("payload"), path.split(".")[1]), F.lit(False))


def _lookup(rule: ColumnRule) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rule.mapping for x in pair])
    return F.try_element_at(table, F.coalesce(at_path(rule.path), F.lit("")))


def rejected(events: DataFrame, definition: HistoryDefinition) -> DataFrame:
    """Events that can't be folded, with the reason: no usable key, a value that a mapping doesn't know, no sequence."""
    key = at_path(definition.key)
    reason = F.when(F.coalesce(F.col("seq"), F.lit(0)) <= 0, "no sequence").when(key.isNull() | (key == ""), "no key")
    for c in definition.columns:
        if c.mapping:
            reason = reason.when(is_set(c.path) & _lookup(c).isNull(), f"unknown value for {c.name}")
    return events.withColumn("reason", reason).where("reason IS NOT NULL")


def _maxima(events: DataFrame, definition: HistoryDefinition) -> DataFrame:
    """Per key and column the last event that sets it and the last that clears it, and the last sequence of all."""
    key = at_path(definition.key)
    bad = F.lit(False)
    for c in definition.columns:
        if c.mapping:
            bad = bad | (is_set(c.path) & _lookup(c).isNull())
    rows = events.where((F.col("seq") > 0) & key.isNotNull() & (key != "") & ~bad).withColumn("_key", key)
    folded = []
    for c in definition.columns:
        kind = F.col("event_type")
        if c.when:
            there, value = kind.isin(*c.when), F.lit(c.value)
        elif c.mapping:
            there, value = is_set(c.path), _lookup(c)
        else:
            there, value = is_set(c.path), at_path(c.path)
        clears = kind.isin(*c.clear_on) if c.clear_on else F.lit(False)
        folded.append(F.max(F.when(there & ~clears, F.struct(F.col("seq").alias("s"), value.alias("v")))).alias(f"_set_{c.name}"))
        folded.append(F.max(F.when(clears, F.col("seq"))).alias(f"_clear_{c.name}"))
    return rows.groupBy("_key").agg(*folded, F.max("seq").alias("projection_seq"))


def _value(name: str, before: Column) -> Column:
    """A column's value: the last one set if nothing clears it at or after that, else null if it was cleared, else ``before``."""
    last, cleared = F.col(f"_set_{name}"), F.col(f"_clear_{name}")
    keeps = cleared.isNull() | (last["s"] > cleared)
    return F.when(last.isNotNull() & keeps, last["v"]).when(cleared.isNull(), before)


def fold(events: DataFrame, definition: HistoryDefinition) -> DataFrame:
    """``(key, columns.., projection_seq)``: the history rows after all sound events.

    Per column the value of the last event that sets it, if no clearing event comes at or after it: two maxima per
    key, combined on the map side, so a key with very many events is never gathered or sorted.
    """
    none = F.lit(None).cast("string")
    return _maxima(events, definition).select(F.col("_key").alias("key"), *[_value(c.name, none).alias(c.name) for c in definition.columns], "projection_seq")


def fold_into(stored: DataFrame, events: DataFrame, definition: HistoryDefinition) -> DataFrame:
    """``stored`` history rows after more events: columns that these neither set nor clear keep what is stored; events at or
    before a row's sequence are not folded again."""
    key = at_path(definition.key)
    seen = stored.select(F.col("key").alias("_known"), F.col("projection_seq").alias("_seen"))
    fresh = events.join(seen, key == F.col("_known"), "left").where(F.col("_seen").isNull() | (F.col("seq") > F.col("_seen"))).select(*events.columns)
    old = stored.select("key", *[F.col(c.name).alias(f"_old_{c.name}") for c in definition.columns], F.col("projection_seq").alias("_old_seq"))
    both = old.join(_maxima(fresh, definition), F.col("key") == F.col("_key"), "full_outer")
    shown = [_value(c.name, F.col(f"_old_{c.name}")).alias(c.name) for c in definition.columns]
    return both.select(F.coalesce("key", "_key").alias("key"), *shown, F.coalesce("projection_seq", "_old_seq").alias("projection_seq"))
