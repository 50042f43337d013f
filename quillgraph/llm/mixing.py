"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are dealt into blocks. With a target weight w = share / cycle, block j (from 1) of a source may
run from slot floor((j-1)/w), its release, and must run before slot ceil(j/w), its deadline. Earliest deadline first
over the released blocks fills every slot, and at every slot each source has run its fair part to within one block.

Weights are whole shares of a cycle, so windows repeat from cycle to cycle and one cycle is scheduled once, by a fold
over its slots; every block then finds its slot from its number in its source. More sources than ``GROUP`` are scheduled
in levels: groups of sources share a cycle among themselves, and the groups another one; a block's place in its
group's cycle is the number of the group's block. Each level adds less than one block to the deviation. Only Spark SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Table

#: Slots of one cycle: weights are multiples of 1/CYCLE.
CYCLE = 1000
#: Sources (or groups) that share a cycle at most; more of them are dealt into groups.
GROUP = 500
#: Rows of one block.
BLOCK_ROWS = 32
#: Rows of a source that are numbered together, about, and parts whose sizes are added up together.
PART_ROWS, PART_RUN = 1_000, 1_000


def shares(sizes: DataFrame, temperature: float = 0.5, cycle: int = CYCLE, group: str | None = None) -> DataFrame:
    """``sizes`` with target shares ``share`` of the cycle, proportional to ``n ** temperature``, in each ``group``.

    Whole shares by largest remainder, ties by ``source``; they add up to ``cycle``. Every source gets one share at least,
    so there may be no more sources than slots in a cycle (a plain error otherwise).
    """
    together = Window.partitionBy(F.col(group) if group else F.lit(0))
    rated = sizes.withColumn("rate", F.pow("n", F.lit(temperature)))
    rated = rated.withColumn("k", F.count("*").over(together)).withColumn("part", F.col("rate") / F.sum("rate").over(together))
    exact = rated.withColumn("exact", F.col("part") * (cycle - F.col("k"))).withColumn("whole", F.floor("exact"))
    left = F.lit(cycle) - F.col("k") - F.sum("whole").over(together)
    order = F.row_number().over(together.orderBy(F.desc(F.col("exact") - F.col("whole")), F.asc_nulls_first("source")))
    share = F.col("whole") + 1 + (order <= left).cast("long")
    checked = F.when(F.col("k") > cycle, F.raise_error(F.lit(f"more than {cycle} sources need a longer cycle")).cast("long")).otherwise(share)
    return exact.withColumn("share", checked).select(*sizes.columns, "share")


def cycle_slots(weights: DataFrame, cycle: int = CYCLE, group: str | None = None) -> DataFrame:
    """The schedule of one cycle of each ``group``, ``(group, source, slots)``: the sorted slots of each source's blocks.

    One row of arrays a group folds over the slots; it holds the shares of at most ``cycle`` sources.
    """
    name = group or "one"
    rows = weights if group else weights.withColumn(name, F.lit(0))
    gathered = rows.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("share", "source"))).alias("sources"))
    start = F.struct(
        F.transform("sources", lambda s: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<int>").alias("picked"),
    )

    def step(state: Column, slot: Column) -> Column:
        def window(s: Column, i: Column) -> Column:
            done, share = F.get(state["done"], i), s["share"]
            deadline = F.ceil((done + 1) * cycle / share)
            released = F.floor(done * cycle / share) <= slot
            return F.when(released & (done < share), F.struct(deadline.alias("d"), i.alias("i")))

        first = F.array_min(F.transform("sources", window))["i"]
        done = F.transform(state["done"], lambda n, i: n + (i == first).cast("long"))
        return F.struct(done.alias("done"), F.concat(state["picked"], F.array(first)).alias("picked"))

    order = F.aggregate(F.sequence(F.lit(0), F.lit(cycle - 1)), start, step)["picked"]
    slots = gathered.select(name, "sources", F.posexplode(order).alias("slot", "i")).select(name, F.get("sources", F.col("i"))["source"].alias("source"), "slot")
    found = slots.groupBy(name, "source").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return found if group else found.drop(name)


def levels(sizes: DataFrame, temperature: float, cycle: int, most: int = GROUP) -> DataFrame:
    """``(source, n, shares, slots)``: of each source its share and slots in its cycle, then those of its group, and so on.

    ``sizes`` (source, n) has a row a source and its rate is ``n ** temperature``; a group's rate is its members' sum.
    """
    now = sizes.withColumn("top", F.col("source")).withColumn("rate", F.pow("n", F.lit(temperature))).withColumn("shares", F.array().cast("array<long>")).withColumn("slots", F.array().cast("array<array<int>>"))
    while True:
        items = Table(now.groupBy("top").agg(F.max("rate").alias("n")).withColumnRenamed("top", "source"), "items")
        several = items.df.limit(most + 1).count() > most
        # Runs of neighbours by name; one small number a source passes through this window, no rows of documents.
        numbered = items.df.withColumn("group", F.floor((F.row_number().over(Window.orderBy(F.asc_nulls_first("source"))) - 1) / most) if several else F.lit(0).cast("long"))
        weighed = shares(numbered, 1.0, cycle, "group")
        done = Table(weighed.join(cycle_slots(weighed, cycle, "group").withColumnRenamed("group", "_g").withColumnRenamed("source", "_s"), (F.col("group") == F.col("_g")) & F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), "group", "share", F.col("slots").alias("_slots"), F.sum("n").over(Window.partitionBy("group")).alias("_rate")), "level")
        items.drop()
        joined = now.join(done.df, F.col("top").eqNullSafe(F.col("_s")))
        now = joined.select("source", "n", F.col("group").cast("string").alias("top"), F.col("_rate").alias("rate"), F.concat("shares", F.array("share")).alias("shares"), F.concat("slots", F.array("_slots")).alias("slots"))
        if not several:
            return now.select("source", "n", "shares", "slots")


def numbered(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` (source, n, id, mark, ...) with ``place``: each row's number in its source, from 0.

    A source is numbered part by part: a part takes the rows whose ``mark``, a hash of the whole row, falls to it; the
    parts' sizes, added up in runs, give each part its first number. So no task holds more of a source than a part.
    """
    dealt = rows.withColumn("part", F.pmod("mark", F.ceil(F.col("n") / part_rows)))
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("size")).withColumn("run", F.floor(F.col("part") / PART_RUN))
    runs = counts.groupBy("source", "run").agg(F.sum("size").alias("size"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("source", "run", F.coalesce(F.sum("size").over(before("source", "run")), F.lit(0)).alias("start"))
    inner = counts.withColumn("inner", F.coalesce(F.sum("size").over(before("source", "run", "part")), F.lit(0)))
    firsts = inner.join(starts, ["source", "run"]).select("source", "part", (F.col("start") + F.col("inner")).alias("first"))
    row = F.row_number().over(Window.partitionBy("source", "part").orderBy("mark", F.asc_nulls_first("id")))
    return dealt.withColumn("row", row - 1).join(firsts, ["source", "part"]).withColumn("place", F.col("first") + F.col("row"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", targets: dict[str, int] | None = None, temperature: float = 0.5, cycle: int = CYCLE, block_rows: int = BLOCK_ROWS, group: int = GROUP) -> DataFrame:
    """``docs`` with ``mix_block`` (its source's block number), ``mix_release``, ``mix_deadline``, ``mix_slot`` and
    ``mix_offset`` (place in the block): ordered by (mix_slot, mix_offset) the rows are the mixture.

    ``targets`` maps sources to whole shares that add up to ``cycle`` (sources that it leaves out are an error);
    without it, shares follow ``size ** temperature``. No row is dropped or repeated: while every source has rows left,
    the first t slots hold each source's t * w blocks to within one block (one for each level, see above); a source that
    has run out leaves its slots empty and the others keep their proportions. A null source is a source of its own. Rows with
    equal or null ids are placed in any order. An empty table gives no rows. Columns of ``docs`` named like the
    five are replaced; all others are kept, whatever their names.
    """
    new = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset"]
    docs = docs.drop(*new)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    # The caller's row travels as one value, so that no name of ours can clash with one of theirs. A null source is "-".
    named = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit("-"))
    rows = docs.select(named.alias("source"), F.col(id_col).alias("id"), F.xxhash64(F.lit("mix"), *[docs[c] for c in plain]).alias("mark"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    if targets is None:
        plan = levels(sizes, temperature, cycle, group)
    else:
        if sum(targets.values()) != cycle or min(targets.values()) < 1:
            raise ValueError(f"target shares are whole, at least 1, and add up to {cycle}")
        given = F.create_map(*[x for source, share in targets.items() for x in (F.lit(f"+{source}"), F.lit(share))])
        shown = F.when(F.col("source") == "-", "null").otherwise(F.expr("substring(source, 2)"))
        share = F.coalesce(F.try_element_at(given, F.col("source")), F.raise_error(F.concat(F.lit("no target for source "), shown)).cast("int"))
        weights = sizes.withColumn("share", share.cast("long"))
        plan = weights.join(cycle_slots(weights, cycle), "source").select("source", "n", F.array("share").alias("shares"), F.array("slots").alias("slots"))
    # Written out, so that Spark knows how small it is: a few sources are sent to every task, a million are joined.
    plan = Table(plan, "plan").df
    placed = numbered(rows.join(plan, "source"))
    block = F.expr(f"place div {block_rows}")

    def through(first: Column, body) -> Column:
        """A block's number taken through the levels."""
        return F.aggregate(F.arrays_zip("shares", "slots"), first, body)

    slot = through(block, lambda at, level: F.expr(f"{cycle}L") * F.floor(at / level["shares"]) + F.get(level["slots"], (at % level["shares"]).cast("int")))
    release = through(block, lambda at, level: F.floor(at * cycle / level["shares"]))
    deadline = through(block + 1, lambda at, level: F.ceil(at * cycle / level["shares"]))
    out = [block.alias("mix_block"), release.alias("mix_release"), deadline.alias("mix_deadline"), slot.alias("mix_slot"), (F.col("place") % block_rows).cast("int").alias("mix_offset")]
    return placed.select(*[F.col("doc")[c].alias(c) for c in docs.columns], *out)


def in_order(mixed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The mixture written out: rows range-partitioned and sorted by slot, the scheduling columns but ``keep`` dropped.

    A table that is read again has the order of its files at most: what must be in order later needs slot and offset.
    """
    ordered = mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
    return ordered.drop(*[c for c in ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset") if c not in keep])
