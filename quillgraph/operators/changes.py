"""From a change log to what has to be evaluated anew: dispatch by kind of key, fan-out to actors, verdicts, shreds.

Changes are rows (key, seq, is_deleted). Everything works on a batch of changes at once: keys are taken apart by
expressions, and what a change touches is found by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from ..sources.tables import Written
from .mutations import key_kind
from .views import live, transitions

#: Steps of a fan-out, and actors that one change may reach, at most (above: refused, never cut).
MOST_DEPTH, MOST_ACTORS = 10, 10_000


class ActorSetTooWide(ValueError):
    """A change reaches more actors than the bound: a part of them would look like all of them."""


def part(key: Column, n: int) -> Column:
    """The n-th segment of a key, from 0; null if it has fewer."""
    return F.get(F.split(key, "\\."), F.lit(n))


def touched(changes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``(seq, kind, label, id, is_deleted)``: the vertices whose rows a change concerns, one row each.

    A vertex's change touches it, an aspect's its owner, a link's both ends. Only a vertex's own change can delete it.
    ``labels``: the types that matter; changes of others are left out before anything is joined. Keys of no kind touch
    nothing (see ``unknown_keys``). ``id`` is the text after the type.
    """
    key = F.col("key")
    end = lambda k: F.struct(part(key, k).alias("label"), part(key, k + 1).alias("id"))
    ends = F.when(key_kind(key) == "link", F.array(end(1), end(4))).otherwise(F.array(end(1)))
    rows = changes.select("seq", key_kind(key).alias("kind"), "is_deleted", F.when(key_kind(key).isNotNull(), ends).alias("ends"))
    each = rows.select("seq", "kind", F.explode("ends").alias("end"), "is_deleted")
    found = each.select("seq", "kind", "end.label", "end.id", (F.coalesce("is_deleted", F.lit(False)) & (F.col("kind") == "vertex")).alias("is_deleted"))
    return found if labels is None else found.where(F.col("label").isin(*labels))


def unknown_keys(changes: DataFrame) -> DataFrame:
    """Changes whose key is of no kind: they are set aside, not dropped unseen."""
    return changes.where(key_kind(F.col("key")).isNull())


def anchor_tombstones(changes: DataFrame, label: str, key: Column) -> DataFrame:
    """``(key, projection_seq, is_deleted)`` for deleted anchors: their rows' keys follow from the anchors' ids alone
    (``key``, an expression over ``id``), so nothing is read."""
    gone = touched(changes, [label]).where("is_deleted").groupBy("id").agg(F.max("seq").alias("projection_seq"))
    return gone.select(key.alias("key"), "projection_seq", F.lit(True).alias("is_deleted"))


def every_edge(graph: Graph, names: list[str]) -> DataFrame:
    """``(label, id, name, to_label, to_id)``: live links of several names, seen from either end."""
    rows = None
    for name in names:
        link = graph.links[name]
        for way, here, there in (("out", link.src_label, link.dst_label), ("in", link.dst_label, link.src_label)):
            one = link.pairs(way).select(F.lit(here).alias("label"), F.col("here").cast("string").alias("id"), F.lit(name).alias("name"), F.lit(there).alias("to_label"), F.col("there").cast("string").alias("to_id"))
            rows = one if rows is None else rows.unionByName(one)
    return rows


def affected_actors(graph: Graph, changed: DataFrame, names: list[str], actor: str, depth: int = MOST_DEPTH, most: int = MOST_ACTORS, reports_to: str | None = None) -> DataFrame:
    """``(seq, actor_id)``: the actors that each change (seq, label, id) reaches over links in either direction.

    The walk goes level by level, for all changes at once, and doesn't go on from an actor; each found actor adds the
    actors that it ``reports_to`` (one hop, not a chain). A change with over ``most`` actors raises ``ActorSetTooWide``.
    """
    edges = Written(every_edge(graph, names), "edges")
    start = changed.select("seq", "label", F.col("id").cast("string").alias("id")).distinct()
    seen = frontier = Written(start, "frontier")
    levels, tables = [start.where(F.col("label") == actor)], [edges, frontier]
    for step in range(1, depth + 1):
        # A change of an actor still walks on from there: it is the start, not a find.
        rows = frontier.df if step == 1 else frontier.df.where(F.col("label") != actor)
        reached = rows.join(edges.df, ["label", "id"]).select("seq", F.col("to_label").alias("label"), F.col("to_id").alias("id")).distinct()
        frontier = Written(reached.join(seen.df, ["seq", "label", "id"], "left_anti"), "frontier")
        tables.append(frontier)
        if frontier.df.isEmpty():
            break
        levels.append(frontier.df.where(F.col("label") == actor))
        seen = Written(seen.df.unionByName(frontier.df), "seen")
        tables.append(seen)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    actors = found.select("seq", F.col("id").alias("actor_id"))
    if reports_to is not None:
        link = graph.links[reports_to].pairs("out").select(F.col("here").cast("string").alias("actor_id"), F.col("there").cast("string").alias("boss"))
        below = levels[1].limit(0) if len(levels) > 1 else levels[0].limit(0)
        for level in levels[1:]:  # a change's own actor adds none
            below = below.unionByName(level)
        actors = actors.unionByName(below.select("seq", F.col("id").alias("actor_id")).join(link, "actor_id").select("seq", F.col("boss").alias("actor_id")))
    result = Written(actors.distinct(), "actors")
    for table in tables:
        table.drop()
    wide = result.df.groupBy("seq").count().where(F.col("count") > most).orderBy("seq").first()
    if wide is not None:
        raise ActorSetTooWide(f"change {wide['seq']} reaches {wide['count']} actors, above the bound of {most}")
    return result.df


def verdicts(stored: DataFrame, computed: DataFrame, keys: list[str], content: list[str], provenance: list[str] = []) -> DataFrame:
    """``(keys, verdict)`` of a view's rows against a fresh evaluation: ``converged``, ``provenance`` (only where it came
    from differs), ``content``, ``missing`` (not stored, or deleted) or ``stale`` (stored, no longer computed).

    Values are compared one by one with nulls as values. One full outer join, for one anchor or all (a sweep).
    """
    side = lambda rows, name: rows.select(*keys, F.struct(*content).alias(f"{name}_c"), F.struct(F.lit(1).alias("one"), *provenance).alias(f"{name}_p"))
    both = side(live(stored) if "is_deleted" in stored.columns else stored, "s").join(side(computed, "n"), keys, "full_outer")
    verdict = (
        F.when(F.col("s_p").isNull(), "missing")
        .when(F.col("n_p").isNull(), "stale")
        .when(~F.col("s_c").eqNullSafe(F.col("n_c")), "content")
        .when(~F.col("s_p").eqNullSafe(F.col("n_p")), "provenance")
        .otherwise("converged")
    )
    return both.select(*keys, verdict.alias("verdict"))


def heal(stored: DataFrame, computed: DataFrame, keys: list[str], content: list[str], provenance: list[str] = []) -> DataFrame:
    """Computed rows that a reconciliation has to write: all but those that have converged."""
    found = verdicts(stored, computed, keys, content, provenance).where(F.col("verdict").isin("missing", "content", "provenance"))
    return computed.join(found.select(*keys), keys, "left_semi")


def dirty_actors(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(actor_id)`` of actors of whom some read grant (actor_id, anchor_id, is_deleted) was granted or revoked: their
    personal rows are evaluated again."""
    return transitions(before, after, ["actor_id", "anchor_id"]).where(F.col("transition").isin("granted", "revoked")).select("actor_id").distinct()


def shred(view: DataFrame, shredded: DataFrame, owner: str, secured: list[str], seq: int, retract: bool = False) -> DataFrame:
    """New versions of the live rows whose owner's key was shredded: secured columns emptied, or with ``retract`` the
    whole row deleted. ``shredded``: (owner_id). Other rows are not returned; a guarded merge writes these."""
    rows = live(view).join(shredded.select(F.col("owner_id").alias(owner)).distinct(), owner, "left_semi")
    kinds = dict(view.dtypes)
    out = [F.lit(None).cast(kinds[c]).alias(c) if c in secured else F.lit(seq).cast(kinds[c]).alias(c) if c == "projection_seq" else F.lit(retract).alias(c) if c == "is_deleted" else F.col(c) for c in view.columns]
    return rows.select(*out)
