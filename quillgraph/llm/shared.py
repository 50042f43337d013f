"""Helpers that several operators share: lineage cuts and connected components.

Lineage is cut by writing Parquet into the folder that the cluster names in ``spark.checkpoint.dir``, so a lost
executor costs only the tasks that read a finished table, never the work that made it.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a folder of our own on one machine, an error on several
    (each would write to its own disk)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # C libraries that have no such call
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """A task's function over batches that gives freed memory back when it ends: Spark keeps its Python workers for later
    tasks, and what one has once used would stay with it."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Bytes of a batch of rows that goes to a Python worker, about.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(giving_back(run), schema)`` in small batches.

    An executor holds each batch several times: as vectors, in its workers, and a worker two in turn. Spark's own bound
    of 64 MB makes that hundreds of megabytes. A bound that the session was given stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(giving_back(run), schema)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or a name like it that no column of ``df`` has (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps are deleted when the driver collects its garbage; after a large step, ask for it."""
    give_back()
    for _ in range(2):  # the first round lets go of what Python holds, the second of what that held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


#: Edges that one task settles: a few arrays of two numbers an edge. Rounds over fewer would cost the driver more, which
#: keeps what it knows of every stage and task.
FEW_EDGES = 100_000


class Table:
    """A written intermediate: ``df`` reads it, ``drop`` deletes its files once nothing needs them."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Forest:
    """Union-find over rows 0..n-1 as arrays; ``kept`` are the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Links; those within a tree are passed over."""
        apart = self.root[left] != self.root[right]
        for a, b in zip(left[apart].tolist(), right[apart].tolist()):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.kept.append((a, b))
        if apart.any():  # point every row at its root again, so that later links within a tree are seen at once
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def stars(pairs) -> list[tuple[int, int]]:
    """Each member of what the pairs connect with its smallest member: short ways, so that components settle in few rounds."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in list(root) if find(x) != x]


def link_by_offset(group: np.ndarray, near, most: int | None = None) -> Forest:
    """A spanning forest of the near pairs among rows of the same group, rows sorted by group.

    Offset by offset, row i against row i + k for every row at once, as long as some group is longer than k (or up to
    ``most``); pairs that are connected already are not compared. ``near(a, b)``: which of the pairs are near.
    """
    n, forest = len(group), Forest(len(group))
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    left_of = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n])) - np.arange(n)  # rows of the group from here on
    rows, k = np.arange(n), 1
    while most is None or k <= most:
        rows = rows[left_of[rows] > k]
        if not len(rows):
            break
        some = rows[forest.root[rows] != forest.root[rows + k]]
        if len(some) and (close := near(some, some + k)).any():
            forest.join(some[close], some[close] + k)
        k += 1
    return forest


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and return a DataFrame that reads it."""
    return Table(df, name).df


def _labels(batches):
    """``(node, root)`` of few edges, in one task: every node takes the least of its neighbours' labels until none changes."""
    held = list(batches)
    if not held:
        return
    ends = np.concatenate([np.asarray(b.column(k)) for k in (0, 1) for b in held])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (new == label).all():
            break
        label = new
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find over ``edges(src, dst)``: rows ``(node, root)``, root the smallest node reachable.

    Each round lets every node hand its larger neighbours to the smallest node that it sees, then its smaller ones
    (the large-star and small-star operations of the map-reduce literature), and is written out. Edges only ever
    point to smaller nodes, so the number of rows never grows, and the rounds grow with the logarithm of the
    longest chain. Minima are combined before the shuffle; no node's neighbours are gathered in one place.
    Nodes without an edge to another node are not returned. Empty input: empty output. Up to ``FEW_EDGES`` edges (a fixed
    bound, far below a task's memory) are settled by one task instead of many rounds of jobs; the rows are the same.
    """
    pair = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    now = Table(pair.distinct(), "edges")
    if now.df.count() <= FEW_EDGES:
        few = Table(now.df.select("u", "v").coalesce(1).mapInArrow(_labels, "node long, root long"), "labels")
        now.drop()
        return few.df
    last = None
    for _ in range(max_rounds):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes whose neighbours are all smaller keep their edges: those are seen from the other end.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        step = Table(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        mark = step.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        now.drop()
        now = step
        release(now.spark)
        if (mark["n"], mark["h"]) == last:
            break
        last = (mark["n"], mark["h"])
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
