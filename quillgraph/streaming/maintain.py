"""Views kept up to date by Structured Streaming, and stateful folds of event streams."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.views import guarded_merge, retractions


class Sink(ABC):
    """Where a view's keyed rows go. A batch's number is its version: a batch that comes again changes nothing."""

    @abstractmethod
    def upsert(self, rows: DataFrame, version: int) -> None:
        """Rows with ``projection_seq``; what is stored and newer stays."""

    @abstractmethod
    def delete(self, gone: DataFrame, version: int) -> None:
        """Keys with ``projection_seq``; they are kept as tombstones."""

    @abstractmethod
    def probe(self, wanted: DataFrame) -> DataFrame:
        """The stored rows of some keys."""

    def close(self) -> None:  # noqa: B027  (most sinks have nothing to close)
        """After the last batch."""


def change_stream(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """A stream of changes (key, label, seq, is_deleted) from a folder of Parquet files; those of other types than ``labels``
    are filtered out at the files."""
    rows = spark.readStream.schema("key string, label string, seq long, is_deleted boolean").parquet(path)
    return rows if labels is None else rows.where(F.col("label").isin(*labels))


class SnapshotTable(Sink):
    """A view in versions, in ``buckets`` by the hash of its keys. A merge reads and writes only the buckets that its rows
    fall into; a version is a small list that says which version last wrote each bucket. Readers see whole versions,
    and a batch that is replayed after a failure writes the same version again. The last ``keep`` versions can be read;
    files that none of them needs are deleted."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16, keep: int = 8):
        self.spark, self.path, self.keys, self.buckets, self.kept = spark, path.rstrip("/"), keys, buckets, keep
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def version(self) -> int:
        return max([int(n.split("-")[0]) for n in self._names("done")], default=-1)

    def _writers(self, version: int) -> dict[int, int]:
        """For each bucket that has rows, the version that last wrote it: it stands in the name of an empty file."""
        found = [n for n in self._names("done") if int(n.split("-")[0]) == version]
        pairs = found[0].split("-")[1] if found else ""
        return {int(b): int(v) for b, v in (p.split(".") for p in pairs.split("_") if p)}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        at = self.version() if version is None else version
        writers = {b: v for b, v in self._writers(at).items() if only is None or b in only} if at >= 0 else {}
        if not writers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/v{v}/bucket={b}" for b, v in writers.items()])

    def write(self, rows: DataFrame, version: int, only: set[int] | None = None) -> None:
        """A version of these rows; with ``only``, of these buckets, the others stay as the version before has them."""
        where = f"{self.path}/v{version}"
        dealt = rows.select(*self.schema.names, self._bucket().alias("bucket")).repartition(self.buckets, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(where)
        writers = {} if only is None or version <= 0 else {b: v for b, v in self._writers(version - 1).items() if b not in only}
        writers |= {int(n.split("=")[1]): version for n in self._names(f"v{version}") if n.startswith("bucket=")}
        for old in [n for n in self._names("done") if int(n.split("-")[0]) == version]:
            self._delete(f"done/{old}")
        fs, done = self._fs(f"{self.path}/done/{version}-" + "_".join(f"{b}.{v}" for b, v in sorted(writers.items())))
        fs.create(done, True).close()
        self._forget(version)

    def _delete(self, name: str) -> None:
        fs, where = self._fs(f"{self.path}/{name}")
        fs.delete(where, True)

    def _forget(self, version: int) -> None:
        for name in self._names("done"):
            if int(name.split("-")[0]) <= version - self.kept:
                self._delete(f"done/{name}")
        needed = {v for n in self._names("done") for v in self._writers(int(n.split("-")[0])).values()} | {version}
        for name in self._names(""):
            if name.startswith("v") and int(name[1:]) not in needed:
                self._delete(name)

    def upsert(self, rows: DataFrame, version: int) -> None:
        self.merge(rows.withColumn("is_deleted", F.lit(False)), version)

    def delete(self, gone: DataFrame, version: int) -> None:
        kinds = {f.name: f.dataType for f in self.schema}
        rows = gone.withColumn("is_deleted", F.lit(True))
        self.merge(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in self.schema.names]), version)

    def probe(self, wanted: DataFrame) -> DataFrame:
        touched = {r["b"] for r in wanted.select(self._bucket().alias("b")).distinct().collect()}
        return self.read(only=touched).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def merge(self, incoming: DataFrame, version: int) -> None:
        """Guarded upserts and tombstones on the version before; ``incoming`` has the view's columns."""
        rows = incoming.select(*self.schema.names)
        # At most ``buckets`` numbers.
        touched = {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}
        before = self.read(version - 1 if version > 0 else -1, touched)
        self.write(guarded_merge(before, rows, self.keys), version, touched)


@dataclass
class MaintainedView:
    """A view whose rows are made by ``evaluate(anchors)`` for a set of anchor ids (all for None), set at a time.

    ``anchor`` names the view's column that holds the anchor's id, ``affected`` maps a batch of changes to anchor ids.
    """

    table: SnapshotTable
    evaluate: Callable[[DataFrame | None], DataFrame]
    affected: Callable[[DataFrame], DataFrame]
    anchor: str

    def apply(self, changes: DataFrame, version: int) -> None:
        """One micro-batch: affected anchors, their fresh rows, tombstones for rows that are gone, a guarded merge."""
        seq = changes.agg(F.max("seq").alias("seq")).first()["seq"]
        if seq is None:
            self.table.merge(self.table.read(-1), version)
            return
        anchors = self.affected(changes).select(F.col("id").alias(self.anchor)).distinct()
        fresh = self.evaluate(anchors).withColumn("projection_seq", F.lit(seq)).withColumn("is_deleted", F.lit(False))
        before = self.table.read(version - 1)
        gone = retractions(before, fresh, self.table.keys, anchors, [self.anchor]) if self.anchor in self.table.keys else retractions(before.join(anchors, self.anchor, "left_semi"), fresh, self.table.keys)
        tombs = before.join(gone, self.table.keys, "left_semi").withColumn("projection_seq", F.lit(seq)).withColumn("is_deleted", F.lit(True))
        self.table.merge(fresh.unionByName(tombs, allowMissingColumns=True), version)

    def rebuild(self, seq: int, version: int) -> None:
        """All rows anew."""
        self.table.write(self.evaluate(None).withColumn("projection_seq", F.lit(seq)).withColumn("is_deleted", F.lit(False)), version)

    def start(self, changes: DataFrame, checkpoint: str):
        """Runs ``apply`` on each micro-batch of a change stream; batch ids are versions, so replays are idempotent."""
        return changes.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_stream(events: DataFrame, clear_on: dict[str, list[str]]) -> DataFrame:
    """History rows from a stream of (key, event_type, seq, sets map<string,string>): each key's state holds its columns
    and the sequence up to which it has folded; older sequences are dropped, ``clear_on`` empties columns."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns, seen = ({}, 0) if not state.exists else (dict(zip(state.get[0], state.get[1])), state.get[2])
        rows = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.seq)
        for r in rows:
            if r.seq <= seen:
                continue
            seen = r.seq
            columns.update(dict(r.sets or {}))
            for name, kinds in clear_on.items():
                if r.event_type in kinds:
                    columns.pop(name, None)
        state.update((list(columns), list(columns.values()), int(seen)))
        yield pd.DataFrame({"key": [key[0]], "columns": [columns], "projection_seq": [int(seen)]})

    return events.groupBy("key").applyInPandasWithState(
        step, "key string, columns map<string,string>, projection_seq long", "names array<string>, vals array<string>, seen long", "update", GroupStateTimeout.NoTimeout
    )
