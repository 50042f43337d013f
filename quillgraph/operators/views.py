"""Keeping a view's rows: guarded upserts, tombstones, retraction, transitions and output shapes.

A stored view is a DataFrame with its key columns, its values, ``projection_seq`` and ``is_deleted``. Every operation
is one grouping or join on the key; nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], seq: str = "projection_seq") -> DataFrame:
    """The row with the largest ``seq`` of each key (ties: the largest row), tombstones included."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = F.struct(seq, *[c for c in rest if c != seq])
    return rows.groupBy(*keys).agg(F.max(ordered).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns])


def guarded_merge(stored: DataFrame, incoming: DataFrame, keys: list[str], seq: str = "projection_seq") -> DataFrame:
    """Upserts and tombstones of ``incoming`` that are newer than what is stored; older and equal ones are dropped.

    Incoming rows without a positive ``seq`` can't be ordered and are dropped. A key keeps its sequence when it is
    deleted, so a late upsert doesn't bring it back.
    """
    mark = stored.withColumn("_stored", F.lit(1)).unionByName(incoming.where(F.coalesce(F.col(seq), F.lit(0)) > 0).withColumn("_stored", F.lit(0)))
    rest = [c for c in stored.columns if c not in keys and c != seq]
    ordered = F.struct(F.col(seq), "_stored", *rest)
    return mark.groupBy(*keys).agg(F.max(ordered).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in stored.columns])


def live(view: DataFrame) -> DataFrame:
    return view.where(~F.coalesce("is_deleted", F.lit(False)))


def soft_delete(view: DataFrame, gone: DataFrame, keys: list[str], now: str) -> DataFrame:
    """Flags the keys of ``gone`` as deleted at ``now``; idempotent."""
    marked = view.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), keys, "left")
    hit = F.coalesce("_gone", F.lit(False)) & ~F.coalesce("is_deleted", F.lit(False))
    stamped = F.when(hit, F.lit(now)).otherwise(F.col("deleted_at")) if "deleted_at" in view.columns else F.when(hit, F.lit(now))
    return marked.withColumn("deleted_at", stamped).withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)) | hit).drop("_gone")


def hard_delete(view: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return view.join(gone.select(*keys), keys, "left_anti")


def retractions(view: DataFrame, fresh: DataFrame, keys: list[str], scope: DataFrame | None = None, scope_keys: list[str] | None = None) -> DataFrame:
    """Keys that are live in the view but not among the fresh rows; with ``scope`` only those of its anchors.

    Keys that the view never had are not returned, so nothing is deleted that was never projected.
    """
    rows = live(view).select(*keys)
    if scope is not None:
        rows = rows.join(scope.select(*scope_keys), scope_keys, "left_semi")
    return rows.join(fresh.select(*keys), keys, "left_anti")


def changed_only(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Incoming rows whose values differ from what is stored: identical writes are suppressed. Values are compared one by
    one, null with null; a key that isn't stored is a change."""
    old = stored.select(*[F.col(k).alias(f"_old_{k}") for k in keys], F.struct(*values).alias("_old"))
    same = F.col("_old").eqNullSafe(F.struct(*values))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_old_{k}"))
    return incoming.join(old, same, "left_anti")


def transitions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, transition)``: granted, revoked or none, by whether a key's row was live before and is live now; unknown
    where a row is there but doesn't say (a null ``is_deleted``)."""
    state = lambda rows, name: rows.select(*keys, F.lit(True).alias(f"{name}_there"), (~F.col("is_deleted")).alias(name))
    both = state(before, "was").join(state(after, "now"), keys, "full_outer")
    unsure = (F.col("was_there") & F.col("was").isNull()) | (F.col("now_there") & F.col("now").isNull())
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    named = F.when(F.coalesce(unsure, F.lit(False)), "unknown").when(~was & now, "granted").when(was & ~now, "revoked").otherwise("none")
    return both.select(*keys, named.alias("transition"))


def collisions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Output keys that more than one live row claims."""
    return live(rows).groupBy(*keys).agg(F.count("*").alias("claims")).where("claims > 1") if "is_deleted" in rows.columns else rows.groupBy(*keys).agg(F.count("*").alias("claims")).where("claims > 1")


def key_sets(rows: DataFrame, actor: str, key: str) -> DataFrame:
    """For each actor the sorted list of all keys, by which clients prune what they hold."""
    return rows.groupBy(actor).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def merge_branches(branches: list[DataFrame], keys: list[str], agreed: list[str], owned: list[str]) -> DataFrame:
    """Rows of several walks with one output shape, merged by key.

    ``agreed`` columns come from the anchor and must not differ (null yields to a value; a conflict is an error);
    ``owned`` columns are taken together from the row whose encoding is smallest.
    """
    rows = branches[0]
    for b in branches[1:]:
        rows = rows.unionByName(b)
    taken = F.struct(*owned)
    found = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in agreed], *[F.min(c).alias(f"_low_{c}") for c in agreed], F.min_by(taken, F.to_json(taken)).alias("_row"))
    for c in agreed:
        clash = F.raise_error(F.lit(f"branches disagree on {c}")).cast(dict(rows.dtypes)[c])
        found = found.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_low_{c}")), F.col(c)).otherwise(clash))
    return found.select(*keys, *agreed, *[F.col(f"_row.{c}").alias(c) for c in owned])


def union_views(parts: dict[str, DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of several views that share one target, with the view's name in ``lens``; and the keys that more than one of
    them claims, with the number of views. Columns are matched by name; one that a view lacks is null."""
    rows = None
    for name, part in parts.items():
        one = part.withColumn("lens", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    claims = rows.select(*keys, "lens").distinct().groupBy(*keys).agg(F.count("*").alias("claims")).where("claims > 1")
    return rows, claims


def keep_real(entries: Column, name: str) -> Column:
    """Entries of a list of structs whose field ``name`` is neither null nor empty; never null."""
    return F.coalesce(F.filter(entries, lambda e: e[name].isNotNull() & (e[name].cast("string") != "")), F.array())


def empty_behaviour(size: Column, behaviour: str) -> Column:
    """What is done with a row whose list came out empty: ``delete``, ``softDelete``, ``emptyDoc`` or ``skip``."""
    if behaviour not in ("delete", "softDelete", "emptyDoc", "skip"):
        raise ValueError(f"no behaviour {behaviour}")
    return F.when(size > 0, F.lit("upsert")).otherwise(F.lit({"emptyDoc": "upsert"}.get(behaviour, behaviour)))


def explode_entries(rows: DataFrame, base_key: str, entries: str, entry_id: str) -> DataFrame:
    """One row for each list entry, keyed ``<base>.<entry id>``; of equal ids the last entry wins."""
    each = rows.select(F.col(base_key).alias("_base"), F.posexplode(entries).alias("_pos", "_entry")).where(F.col(f"_entry.{entry_id}").isNotNull())
    last = each.groupBy("_base", F.col(f"_entry.{entry_id}").alias("_id")).agg(F.max_by("_entry", "_pos").alias("entry"))
    return last.select(F.concat_ws(".", "_base", F.col("_id").cast("string")).alias("key"), F.col("_base").alias("base_key"), "entry")


def provenance(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, source)``: every vertex or link key that a row's columns hold."""
    each = rows.select(key, F.explode(F.array_distinct(F.filter(F.array(*columns), lambda x: x.rlike("^(vtx|lnk)\\.")))).alias("source"))
    return each


def page(rows: DataFrame, key: str, cursor: str | None, size: int, prefix: str = "") -> DataFrame:
    """A page in key order after ``cursor``, of the keys that begin with ``prefix``."""
    held = rows.where(F.col(key).startswith(prefix)) if prefix else rows
    return (held if cursor is None else held.where(F.col(key) > cursor)).orderBy(key).limit(size)


def at_keys(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``(key, row)`` for every wanted key, once; ``row`` is null where there is none."""
    held = rows.select(F.col(key).alias("_key"), F.struct(*rows.columns).alias("row"))
    return wanted.select(key).distinct().join(held, F.col(key) == F.col("_key"), "left").select(key, "row")
