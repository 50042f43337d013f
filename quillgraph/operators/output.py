"""Output shapes: keys and envelopes of documents, tables of grants and protected rows, per-actor deltas, audit rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .authz import interested, readable
from .views import guarded_merge, keep_real

SUFFIX = "{actorSuffix}"
VERSION = "1.0"


class ShapeError(ValueError):
    """A declared output that its rows can't have: refused when it is declared."""


def check_key_columns(columns: list[str], keys: list[str] | None = None) -> list[str]:
    """The key columns of a result: those declared, which must be among its columns and named once; else its first column."""
    if len(set(columns)) != len(columns):
        raise ShapeError("a result names a column twice")
    chosen = keys or columns[:1]
    if missing := [k for k in chosen if k not in columns]:
        raise ShapeError(f"key columns {missing} are not returned")
    return chosen


@dataclass(frozen=True)
class OutputKey:
    """Keys made from an anchor's key by a pattern with one ``{actorSuffix}``: ``<type>.<id>``, or with ``bare`` the id."""

    pattern: str
    anchor: str
    bare: bool = False

    def __post_init__(self):
        if self.pattern.count(SUFFIX) != 1:
            raise ShapeError(f"a key pattern has one {SUFFIX}")

    def build(self, anchor_key: Column) -> Column:
        before, after = self.pattern.split(SUFFIX)
        suffix = F.regexp_extract(anchor_key, f"^vtx\\.{re.escape(self.anchor)}\\.([^.]+)$" if self.bare else f"^vtx\\.({re.escape(self.anchor)}\\.[^.]+)$", 1)
        return F.when(suffix != "", F.concat(F.lit(before), suffix, F.lit(after)))

    def anchor_of(self, key: Column, per_entry: bool = False) -> Column:
        """The anchor's key of an output key (with ``per_entry`` of one with an entry's id behind it); null if it has
        none of this pattern's."""
        before, after = (re.escape(x) for x in self.pattern.split(SUFFIX))
        stem = "([^.]+)" if self.bare else f"({re.escape(self.anchor)}\\.[^.]+)"
        entry = "\\.[^.]+" if per_entry else ""
        found = F.regexp_extract(key, f"^{before}{stem}{entry}{after}$", 1)
        return F.when(found != "", F.concat(F.lit(f"vtx.{self.anchor}." if self.bare else "vtx."), found))


def envelope(rows: DataFrame, key: OutputKey, body: list[str], projected_at: str, lists: dict[str, str] | None = None, empty: str = "delete", lanes: list[str] | None = None, static: list[str] = [], actor: str = "actor", sources: str | None = None) -> DataFrame:
    """One document an anchor: key, actor, version, time, body columns, and what to do with it, ``op``.

    ``rows`` has ``actorKey``; rows of other anchor types give none. ``lists`` names the field by which the entries of a
    body list are real; where no list has one left, ``op`` follows ``empty`` (delete, softDelete, skip or emptyDoc). ``sources``:
    a column of contributing keys and revisions, returned as ``projectedFromRevisions``.
    """
    lists = lists or {}
    out = key.build(F.col("actorKey"))
    kept = rows.withColumn("_out", out).where("_out IS NOT NULL")
    for c, name in lists.items():
        kept = kept.withColumn(c, keep_real(F.col(c), name))
    real = F.lit(not lists)
    for c in lists:
        real = real | (F.size(c) > 0)
    op = F.when(real, "upsert").otherwise({"delete": "delete", "softDelete": "delete", "skip": "skip", "emptyDoc": "upsert"}[empty])
    columns = [F.col("_out").alias("key"), F.col("actorKey").alias(actor), F.lit(VERSION).alias("version"), F.lit(projected_at).alias("projectedAt")]
    columns += [F.col(sources).alias("projectedFromRevisions")] if sources else []
    columns += [F.array(*map(F.lit, lanes)).alias("lanes")] if lanes else []
    return kept.select(*columns, *body, *[F.array().cast("array<string>").alias(c) for c in static], op.alias("op")).where("op <> 'skip'")


def revisions(rows: DataFrame, key: str, columns: list[str], current: DataFrame, always: list[Column] = []) -> DataFrame:
    """``(key, source, revision)``: the vertices and links that a row's columns hold, and ``always`` (the actor, the
    view), with their revisions in ``current`` (key, seq); null where one is not known."""
    each = F.filter(F.array(*columns), lambda x: x.rlike("^(vtx|lnk)\\."))
    held = rows.select(key, F.explode(F.array_distinct(F.concat(each, F.array(*always)) if always else each)).alias("source"))
    return held.join(current.select(F.col("key").alias("source"), F.col("seq").alias("revision")), "source", "left").select(key, "source", "revision")


def keyed_documents(rows: DataFrame, keys: list[str], body: list[str]) -> DataFrame:
    """``(key, document)``: key fields joined by dots, the rest as JSON. A row with a null or dotted key field is refused."""
    check_key_columns(rows.columns, keys)
    field = lambda c: F.when(F.col(c).isNull() | F.col(c).cast("string").contains("."), F.raise_error(F.lit(f"{c} can't be a part of a key")).cast("string")).otherwise(F.col(c).cast("string"))
    return rows.select(F.concat_ws(".", *map(field, keys)).alias("key"), F.to_json(F.struct(*body)).alias("document"))


def key_fields(documents: DataFrame, keys: list[str]) -> DataFrame:
    """A document table's keys taken apart again into their fields, as texts."""
    return documents.select(*[F.get(F.split("key", "\\."), F.lit(k)).alias(c) for k, c in enumerate(keys)], "document")


def truncate(view: DataFrame, prefix: str = "", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """What stays when the keys that begin with ``prefix`` are emptied (all, without one), and the keys that went."""
    gone = F.col(key).startswith(prefix)
    return view.where(~F.coalesce(gone, F.lit(False))), view.where(gone).select(key)


def write_grants(stored: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """The grants table (actor_id, anchor_id, grant_source, projection_seq, is_deleted) after a guarded write of one
    source's grants: rows of other sources are not touched, whatever the incoming rows say."""
    keys = ["actor_id", "anchor_id", "grant_source"]
    mine = incoming.withColumn("grant_source", F.lit(source)).select(*stored.columns)
    own = F.col("grant_source") == source
    return stored.where(~own).unionByName(guarded_merge(stored.where(own), mine, keys))


def write_protected(stored: DataFrame, incoming: DataFrame, keys: list[str], now: str) -> DataFrame:
    """A protected table (its columns, authz_anchors, projection_seq, is_deleted, deleted_at) after a guarded write; a
    deletion keeps the row, stamped. Rows without anchors are visible to no one but wildcard holders."""
    rows = incoming.withColumn("authz_anchors", F.coalesce("authz_anchors", F.array().cast("array<string>")))
    stamped = rows.withColumn("deleted_at", F.when(F.coalesce("is_deleted", F.lit(False)), F.lit(now)))
    return guarded_merge(stored, stamped.select(*stored.columns), keys)


def personal_rows(rows: DataFrame, grants: DataFrame, interest: DataFrame | None) -> DataFrame:
    """Rows (actor_id, kind, anchor, ...) that go out to their recipients: with an anchor, which the actor may read (the
    grant comes first), and of a kind or anchor in which some device of theirs is interested."""
    named = rows.where("anchor <> ''")
    allowed = readable(named.select("actor_id", F.col("anchor").alias("anchor_id")).distinct(), grants)
    held = named.join(allowed.withColumnRenamed("anchor_id", "anchor"), ["actor_id", "anchor"], "left_semi").select(*rows.columns)
    if interest is None:
        return held
    return interested(held.withColumnRenamed("kind", "type"), interest).withColumnRenamed("type", "kind").select(*rows.columns)


def deltas(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], sealed: list[str] = []) -> DataFrame:
    """``(actor_id, op, keys, data)``: what each actor's copy has to change, by actor and key. Columns that are
    ``sealed`` (still encrypted) may not leave: naming one is refused."""
    if bad := [v for v in values if v in sealed]:
        raise ShapeError(f"{bad} are encrypted and stay here")
    same = ["actor_id", *keys]
    side = lambda rows, name: rows.select(*same, F.struct(*values).alias(name))
    both = side(before, "was").join(side(after, "now"), same, "full_outer")
    op = F.when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "upsert")
    return both.select("actor_id", op.alias("op"), *keys, F.when(F.col("now").isNotNull(), F.to_json("now")).alias("data")).where("op IS NOT NULL")


def hydration(rows: DataFrame, actor: str, seq: str = "projection_seq") -> DataFrame:
    """A recipient's whole set in order of revision, ended by a marker row with the highest revision (0 for none):
    ``(op, revision, data)``."""
    mine = rows.where(F.col("actor_id") == actor)
    kept = [c for c in rows.columns if c not in ("actor_id", seq)]
    body = mine.select(F.lit("upsert").alias("op"), F.col(seq).cast("long").alias("revision"), F.to_json(F.struct(*kept)).alias("data"))
    mark = mine.agg(F.coalesce(F.max(seq), F.lit(0)).cast("long").alias("revision")).select(F.lit("hydrated").alias("op"), "revision", F.lit(None).cast("string").alias("data"))
    return body.unionByName(mark)


def audit(written: DataFrame, view: str, at: str, keys: list[str]) -> DataFrame:
    """One record an effective write: ``(view, key, row_hash, at)``; a hash of the whole row as JSON."""
    return written.select(F.lit(view).alias("view"), F.concat_ws(".", *[F.col(k).cast("string") for k in keys]).alias("key"), F.sha2(F.to_json(F.struct(*written.columns)), 256).alias("row_hash"), F.lit(at).alias("at"))

