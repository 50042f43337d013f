"""SimHash near-duplicate classes by pivot distance tables.

1. ``fingerprints``: a 64-bit SimHash of each text's word shingles.
2. ``near_links``: fingerprints within a few bits of each other. Two words that differ in at most ``max_bits`` of
   ``max_bits + 2`` bit segments agree in two segments at least, so rows that share the value of one pair of
   segments are the only ones compared (no pair is missed). Among them, each fingerprint's precomputed table of
   Hamming distances to ``PIVOTS`` reference fingerprints discards a pair as soon as one coordinate differs by
   more than ``max_bits`` (the triangle inequality); the survivors are verified bit by bit.
3. ``components``: classes of linked fingerprints by distributed union-find.

A bucket emits one row for each fingerprint that its verified links connect to another, never all of its pairs, and a bucket above ``BLOCK`` rows is
dealt out as blocks (chunk i against chunk j), so that no task holds more than two chunks of it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, connected_components, link_by_offset, map_batches, stars

SEED = 42
#: Reference fingerprints; any fixed spread of bits serves, so they come from a rule.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED) for k in range(16)]
#: Rows of a bucket that one block holds at most, about.
BLOCK = 2048


def simhash(text: str | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text; 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return _majority([xxhash.xxh64_intdigest(joined, SEED)])
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[shingle - 1 :]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return _majority([digest(joined[a:b], seed) for a, b in zip(starts, stops)])


def _majority(hashes: list[int]) -> int:
    """Bits set in over half of the hashes. Counted in slices, so memory stays flat for very long texts."""
    every = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(every), 65536):
        part = every[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp long, text_key long)`` per row; ``fp`` holds the fingerprint's bits (so it may be negative), ``text_key``
    is Spark's ``xxhash64`` of the text.
    """

    def run(batches):
        for batch in batches:
            found = [simhash(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64)), batch.column(2)], ["id", "fp", "text_key"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return map_batches(kept, run, "id long, fp long, text_key long")


def _segment_keys(max_bits: int):
    """One long per pair of segments: the pair's number above, both segments' bits below."""
    n = max_bits + 2
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    starts = np.cumsum([0, *widths[:-1]]).tolist()
    part = lambda k: F.shiftrightunsigned("fp", starts[k]).bitwiseAND(F.lit((1 << widths[k]) - 1))
    return [
        F.shiftleft(part(a), widths[b]).bitwiseOR(part(b)).bitwiseOR(F.lit(number << 48))
        for number, (a, b) in enumerate(combinations(range(n), 2))
    ]


def _pivot_table():
    """Two longs that hold the distances to the 16 pivots, a byte each."""
    signed = [p - (1 << 64) if p >> 63 else p for p in PIVOTS]
    packed = []
    for half in (signed[:8], signed[8:]):
        whole = F.lit(0).cast("long")
        for k, pivot in enumerate(half):
            whole = whole.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(pivot))).cast("long"), 8 * k))
        packed.append(whole)
    return packed


def _block_links(fp: np.ndarray, table: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """The rows of the same group that verified links connect, each with the first of them; rows sorted by group.

    Rows of a block of two chunks (side 0 and 1) are compared across sides only. A pair whose distances to one pivot
    differ by more than ``max_bits`` is discarded; the others are verified bit by bit.
    """

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = (side[a] < 0) | (side[a] != side[b])
        found[found] = np.abs(table[a[found]] - table[b[found]]).max(axis=1, initial=0) <= max_bits
        found[found] = np.bitwise_count(fp[a[found]] ^ fp[b[found]]) <= max_bits
        return found

    return stars(link_by_offset(group, near).kept)


def near_links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(src, dst)`` that connect the distinct ``fp`` of which Hamming distances of at most ``max_bits`` make chains."""
    spark = distinct.sparkSession
    tables = _pivot_table()
    rows = distinct.select("fp", tables[0].alias("p0"), tables[1].alias("p1"), F.explode(F.array(*_segment_keys(max_bits))).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, "key").withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int"))
    chunk = F.pmod(F.xxhash64("fp", "key"), F.col("g")).cast("int")
    rows = rows.withColumn("c", chunk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    blocks = rows.select("key", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"), "c", "fp", "p0", "p1")
    dealt = blocks.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")

    def solve(columns):
        key, ci, cj, c, fp, p0, p1 = columns
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])])
        table = np.concatenate([p0.view(np.uint8).reshape(-1, 8), p1.view(np.uint8).reshape(-1, 8)], axis=1).astype(np.int8)
        side = np.where(ci == cj, -1, c)
        kept = _block_links(fp.view(np.uint64), table, group, side, max_bits)
        a, b = np.array(kept, dtype=np.int64).reshape(-1, 2).T
        return pa.record_batch([pa.array(fp[a]), pa.array(fp[b])], ["src", "dst"])

    def run(batches):
        held = None
        for batch in batches:
            new = [np.asarray(batch.column(k)) for k in ("key", "ci", "cj", "c", "fp", "p0", "p1")]
            if not len(new[0]):
                continue
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = (held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:  # the last group may go on in the next batch
                yield solve([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield solve(held)

    return map_batches(dealt.select("key", "ci", "cj", "c", "fp", "p0", "p1"), run, "src long, dst long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``fingerprints`` with ``root``, the class's smallest fingerprint, and ``component_id``, its smallest id."""
    marked = Table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = Table(marked.df.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = Table(connected_components(near_links(distinct.df.select("fp"), max_bits)), "roots")
    # What is joined by fingerprint or by root is written out first: Spark then splits the rows of a common one.
    grouped = Table(distinct.df.join(roots.df, F.col("fp") == F.col("node")).select("fp", "low", "root"), "grouped")
    lowest = Table(grouped.df.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    alone = distinct.df.join(roots.df, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("fp").alias("root"), F.col("low").alias("component_id"))
    named = Table(grouped.df.join(lowest.df, "root").select("fp", "root", "component_id").unionByName(alone), "named")
    for table in (distinct, roots, grouped, lowest):
        table.drop()
    return marked.df.join(named.df, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` (long) and ``component_id``, the smallest id reachable by links.

    Null texts and texts without words get fingerprint 0, linked like any other. Texts of fewer words than a shingle
    are hashed whole. Repeated ids and equal texts share a class. A null id is returned as it is; a class of only
    null ids has a null ``component_id``. Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    return classes(docs, id_col, text_col, shingle, max_bits).select(F.col("id").alias("doc_id"), "fp", "component_id")
