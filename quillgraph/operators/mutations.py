"""The write path: batches of create, update and tombstone mutations, validated and applied as a new snapshot.

State: (key, class, data, is_deleted, seq). Mutations: (batch_id, key, op, class, data, expected_seq). A batch takes
effect as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTEX = "^vtx\\.[a-z][a-z0-9]*\\.[^.]+$"
ASPECT = "^vtx\\.[a-z][a-z0-9]*\\.[^.]+\\.[a-z][a-zA-Z0-9]*$"
LINK = "^lnk(\\.[a-z][a-z0-9]*\\.[^.]+)\\.[a-z][a-zA-Z0-9]*(\\.[a-z][a-z0-9]*\\.[^.]+)$"


def key_kind(key):
    """``vertex``, ``aspect``, ``link`` or null by a key's shape."""
    return F.when(key.rlike(VERTEX), "vertex").when(key.rlike(ASPECT), "aspect").when(key.rlike(LINK), "link")


def violations(mutations: DataFrame, state: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``(batch_id, key, violation)``: what is wrong with a mutation. With ``classes(class, abstract)`` the class must be
    declared and not abstract."""
    now = state.select("key", F.col("is_deleted").alias("_gone"), F.col("seq").alias("_seq"))
    rows = mutations.join(now, "key", "left")
    there = F.col("_seq").isNotNull()
    checks = [
        F.when(key_kind(F.col("key")).isNull(), "malformed key"),
        F.when(~F.coalesce(F.col("op"), F.lit("")).isin("create", "update", "tombstone"), "unknown operation"),
        F.when((F.col("op") == "create") & there, "key exists"),
        F.when(F.col("op").isin("update", "tombstone") & ~there, "no such key"),
        F.when((F.col("op") == "update") & F.coalesce("_gone", F.lit(False)), "key is deleted"),
        F.when(F.col("expected_seq").isNotNull() & ~F.col("_seq").eqNullSafe(F.col("expected_seq")), "stale revision"),
    ]
    if classes is not None:
        rows = rows.join(classes.select(F.col("class"), F.col("abstract").alias("_abstract")), "class", "left")
        checks.append(F.when((F.col("op") == "create") & F.col("_abstract").isNull(), "unknown class"))
        checks.append(F.when((F.col("op") == "create") & F.col("_abstract"), "abstract class"))
    found = rows.select("batch_id", "key", F.explode(F.filter(F.array(*checks), lambda v: v.isNotNull())).alias("violation"))
    twice = mutations.groupBy("batch_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("batch_id", "key", F.lit("key twice in a batch").alias("violation"))
    return found.unionByName(twice)


def apply_batches(mutations: DataFrame, state: DataFrame, seq: int, classes: DataFrame | None = None) -> DataFrame:
    """The state after the batches without a violation; ``seq`` is their sequence. Of batches that meet on a key the
    first by id takes effect, the others conflict and are left out."""
    bad = violations(mutations, state, classes).select("batch_id")
    meets = mutations.groupBy("key").agg(F.min("batch_id").alias("_first"), F.max("batch_id").alias("_last")).where("_first <> _last")
    late = mutations.join(meets, "key").where("batch_id <> _first").select("batch_id")
    good = mutations.join(bad.unionByName(late).distinct(), "batch_id", "left_anti").select(F.col("key").alias("_key"), "op", F.col("class").alias("_class"), F.col("data").alias("_data"))
    both = state.join(good, state["key"] == good["_key"], "full_outer")
    hit = F.col("_key").isNotNull()
    return both.select(
        F.coalesce("key", "_key").alias("key"),
        F.when(hit & (F.col("op") == "create"), F.col("_class")).otherwise(F.col("class")).alias("class"),
        F.when(hit & (F.col("op") != "tombstone"), F.col("_data")).otherwise(F.col("data")).alias("data"),
        F.when(hit, F.col("op") == "tombstone").otherwise(F.col("is_deleted")).alias("is_deleted"),
        F.when(hit, F.lit(seq)).otherwise(F.col("seq")).cast("long").alias("seq"),
    )


def dedupe_requests(operations: DataFrame) -> DataFrame:
    """Each request once: the first by sequence of those with an id; what has no id is kept."""
    named = operations.where("request_id IS NOT NULL")
    rest = [c for c in operations.columns if c not in ("request_id", "seq")]
    first = named.groupBy("request_id").agg(F.min(F.struct("seq", *rest)).alias("_row"))
    return first.select(*[F.col(c) if c == "request_id" else F.col(f"_row.{c}") for c in operations.columns]).unionByName(operations.where("request_id IS NULL"))


def events_of(specs: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """The events of operations: ``specs`` (request_id, position, event_class, data map<string,string>), ``batch`` the
    operations' mutations (request_id, position, key).

    A class is ``<domain>.<event name>`` (else ``problem`` says so); the target is the event's ``targetKey``, or the
    mutation at the same position.
    """
    domain = F.regexp_extract("event_class", "^([^.]+)\\..+$", 1)
    rows = specs.join(batch.select("request_id", "position", F.col("key").alias("_key")), ["request_id", "position"], "left")
    target = F.coalesce(F.nullif(F.try_element_at("data", F.lit("targetKey")), F.lit("")), F.col("_key"))
    return rows.select(
        F.concat_ws("-", "request_id", F.col("position").cast("string")).alias("event_id"), "request_id", F.col("event_class").alias("event_type"), domain.alias("domain"),
        target.alias("target_key"), F.col("data").alias("payload"), F.lit(now).alias("timestamp"), F.when(F.coalesce(domain, F.lit("")) == "", "class has no domain and name").alias("problem"),
    )
