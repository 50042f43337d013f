"""Graph patterns as DataFrame plans.

A ``Match`` is a DataFrame with the columns ``<var>__<property>`` of its variables. Hops are equi-joins on native ids;
what a hop requires of its endpoint is filtered before the join, so an optional hop keeps its row with nulls and
Catalyst still pushes the filter to the scan. Nothing runs until the result is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph, link_key, vertex_key
from ..sources.tables import Written

#: The label of a variable that may be of any type.
ANY = "*"
#: Hops of an unbounded variable-length step at most.
MOST_HOPS = 10
#: Rows that a product of unrelated patterns may have before it is refused.
MOST_BINDINGS = 1_000_000


class PatternError(ValueError):
    """A pattern that has no meaning here: refused when it is built, never silently changed."""


class Match:
    def __init__(self, graph: Graph, df: DataFrame | None = None, labels: dict[str, str] | None = None):
        self.graph, self.df, self.labels = graph, df, dict(labels or {})

    def _with(self, df: DataFrame, **labels: str) -> Match:
        return Match(self.graph, df, self.labels | labels)

    def __getitem__(self, name: str) -> Column:
        """``m["c.c_name"]``: a property; ``c.key`` is the vertex key, ``c.id`` the native id."""
        var, _, prop = name.partition(".")
        if var not in self.labels:
            raise PatternError(f"{var} is not bound")
        if prop == "key":
            found = self.df[f"{var}__id"]
            if self.labels[var] == ANY:
                return F.when(found.isNotNull(), F.concat(F.lit("vtx."), self.df[f"{var}__label"], F.lit("."), found))
            return F.when(found.isNotNull(), vertex_key(self.labels[var], found))
        column = f"{var}__{prop or 'id'}"
        if self.labels[var] == ANY and prop == "label":
            return self.df[f"{var}__label"]
        # A property that no vertex of the type has is null, as for any missing field.
        return self.df[column] if column in self.df.columns else F.lit(None)

    def _vertices(self, var: str, label: str, where: Callable[[DataFrame], Column] | None, props: dict) -> DataFrame:
        kind = self.graph.vertices.get(label)
        if kind is None:
            raise PatternError(f"no vertices are labelled {label}")
        rows = kind.live()
        for name, value in props.items():
            rows = rows.where(F.col(name).eqNullSafe(value if isinstance(value, Column) else F.lit(value)))
        if where is not None:
            rows = rows.where(F.coalesce(where(rows), F.lit(False)))
        return rows.select(F.col(kind.id_col).alias(f"{var}__id"), *[F.col(c).alias(f"{var}__{c}") for c in rows.columns if c != "id"])

    def with_columns(self, **columns: Callable[[Match], Column]) -> Match:
        """Computed columns beside the variables; ``m.df.<name>`` refers to them."""
        return self._with(self.df.select("*", *[f(self).alias(name) for name, f in columns.items()]))

    def joined(self, rows: DataFrame, on: str | list[str], how: str = "left") -> Match:
        """Rows of another plan, joined by ``<var>__<property>`` columns that they have too."""
        return self._with(self.df.join(rows, on, how))

    def again(self, var: str, label: str, where: Callable[[DataFrame], Column] | None = None, **props) -> Match:
        """A pattern that begins with a variable that is bound already: rows are filtered by it, nothing is bound anew."""
        if self.labels.get(var) != label:
            raise PatternError(f"{var} is no {label}")
        ids = self._vertices(var, label, where, props).select(f"{var}__id")
        return self._with(self.df.join(ids, f"{var}__id", "left_semi"))

    def link_type(self, link: str) -> Column:
        """``type(r)``: the name of a bound relationship; null where an optional one is not there."""
        if f"{link}__link" not in self.df.columns:
            raise PatternError(f"{link} is no relationship")
        return self.df[f"{link}__link"]["name"]

    def link_key(self, link: str) -> Column:
        """``r.key``."""
        self.link_type(link)
        return self.df[f"{link}__link"]["key"]

    def node(self, var: str, label: str, where=None, **props) -> Match:
        """``(var:label {props})`` as a pattern of its own; beside other patterns it is a bounded product."""
        if var in self.labels:
            raise PatternError(f"{var} is bound already: a required pattern must bind something new")
        rows = self._vertices(var, label, where, props)
        if self.df is None:
            return self._with(rows, **{var: label})
        return self._with(bounded_product(self.df, rows), **{var: label})

    def keys(self, var: str, ids: DataFrame) -> Match:
        """Only the rows whose ``var`` is among ``ids(id)``: seeds of an evaluation, or a key seek."""
        return self._with(self.df.join(ids.select(F.col("id").alias(f"{var}__id")), f"{var}__id", "left_semi"))

    def aspect(self, var: str, name: str) -> Match:
        """Attaches an aspect's fields as ``<var>__<name>_<field>``; a vertex without it has nulls."""
        rows = self.graph.aspects[self.labels[var], name]
        named = rows.select(F.col("id").alias(f"{var}__id"), *[F.col(c).alias(f"{var}__{name}_{c}") for c in rows.columns if c != "id"])
        return self._with(self.df.join(named, f"{var}__id", "left"))

    def _end(self, start: str, name: str, direction: str) -> tuple[str, str]:
        link = self.graph.links.get(name)
        if link is None:
            raise PatternError(f"no links are named {name}")
        if direction not in ("out", "in", "both"):
            raise PatternError(f"no direction {direction}")
        ends = {"out": (link.src_label, link.dst_label), "in": (link.dst_label, link.src_label)}
        here, there = ends["in" if direction == "in" or (direction == "both" and self.labels[start] != link.src_label) else "out"]
        if self.labels.get(start) != here:
            raise PatternError(f"{start} is no {here}: {name} doesn't lead anywhere")
        return here, there

    def _pairs(self, start: str, name: str, direction: str, payload: bool = False, collapse: bool = True) -> DataFrame:
        link = self.graph.links[name]
        if direction == "both" and link.src_label != link.dst_label:  # ends of two types: only one way is possible
            direction = "out" if self.labels[start] == link.src_label else "in"
        return link.pairs(direction, payload, collapse)

    def hop(self, start: str, name: str, end: str, direction: str = "out", optional: bool = False, where=None, link: str | None = None, check: bool = True, **props) -> Match:
        """``(start)-[:name]->(end {props})``. ``where`` and ``props`` belong to the hop: with ``optional`` a row that
        nothing meets stays, with nulls. ``link`` names the relationship and keeps parallel links apart. An ``end``
        that is bound already is met, not bound anew. ``check=False`` takes links as they are, without looking
        whether their ends are live vertices (referential integrity saves the join)."""
        _, there = self._end(start, name, direction)
        pairs = self._pairs(start, name, direction, payload=link is not None)
        pairs = pairs.select(F.col("here").alias(f"{start}__id"), F.col("there").alias(f"{end}__id"), *([F.col("link").alias(f"{link}__link")] if link else []))
        if end in self.labels:
            if optional:
                raise PatternError("an optional hop must bind its end")
            return self._with(self.df.join(pairs, [f"{start}__id", f"{end}__id"]))
        if check or where is not None or props:
            pairs = pairs.join(self._vertices(end, there, where, props), f"{end}__id")
        return self._with(self.df.join(pairs, f"{start}__id", "left" if optional else "inner"), **{end: there})

    def hop_any(self, start: str, end: str, names: list[str], optional: bool = False, link: str | None = None) -> Match:
        """``(start)-[]-(end)`` over any of the links ``names`` (all that touch the start's type), in either direction.

        The end may be of several types: it has a key, an id (as text) and a ``label``, no properties. Parallel links
        collapse unless the relationship is named.
        """
        if end in self.labels:
            raise PatternError(f"{end} is bound already")
        here, rows = self.labels[start], None
        for name in names:
            kind = self.graph.links[name]
            for way in ("out", "in"):
                if (kind.src_label if way == "out" else kind.dst_label) != here:
                    continue
                there = kind.dst_label if way == "out" else kind.src_label
                target = self.graph.vertices[there]
                live = target.live().select(F.col(target.id_col).alias("there"))
                pairs = self._pairs(start, name, way, payload=False).join(live, "there", "left_semi")
                one = pairs.select(F.col("here").alias(f"{start}__id"), F.col("there").cast("string").alias(f"{end}__id"), F.lit(there).alias(f"{end}__label"), *([F.struct(F.lit(name).alias("name"), link_key(kind, *((F.col("here"), F.col("there")) if way == "out" else (F.col("there"), F.col("here")))).alias("key")).alias(f"{link}__link")] if link else []))
                rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            raise PatternError(f"no link of {names} touches {here}")
        rows = rows.distinct() if link is None else rows
        return self._with(self.df.join(rows, f"{start}__id", "left" if optional else "inner"), **{end: ANY})

    def reach(self, start: str, name: str, end: str, least: int = 0, most: int = MOST_HOPS, direction: str = "out", where=None, **props) -> Match:
        """``(start)-[:name*least..most]->(end)``: every vertex that some path without a repeated vertex reaches, once.

        Level by level, each written out before the next, until a level is empty. With ``least`` of 0 or 1 a level
        holds only what no level before it had (its distance is the smallest); longer minima keep the paths.
        """
        here, there = self._end(start, name, direction)
        if here != there:
            raise PatternError("a variable-length step stays within one type")
        if not 0 <= least <= most <= MOST_HOPS:
            raise PatternError(f"between 0 and {MOST_HOPS} hops")
        kind = self.graph.vertices[here]
        live = kind.live().select(F.col(kind.id_col).alias("there"))
        pairs = Written(self._pairs(start, name, direction).join(live, "there", "left_semi"), "pairs")
        starts = self.df.select(F.col(f"{start}__id").alias("start")).where("start IS NOT NULL").distinct()
        level = Written(starts.select("start", F.col("start").alias("at"), F.array("start").alias("path"), F.lit(0).alias("depth")), "level")
        levels, seen = [level], level
        for depth in range(1, most + 1):
            step = level.df.join(pairs.df, level.df["at"] == pairs.df["here"])
            if least <= 1:
                step = step.select("start", F.col("there").alias("at")).distinct().join(seen.df.select("start", "at"), ["start", "at"], "left_anti")
                step = step.select("start", "at", F.array("start").alias("path"), F.lit(depth).alias("depth"))
            else:
                step = step.where(~F.array_contains("path", F.col("there"))).select("start", F.col("there").alias("at"), F.concat("path", F.array("there")).alias("path"), F.lit(depth).alias("depth"))
            level = Written(step, "level")
            if level.df.isEmpty():
                level.drop()
                break
            levels.append(level)
            if least <= 1 and depth < most:  # one table of what was met, instead of every level on its own
                old, seen = seen, Written(seen.df.select("start", "at").unionByName(level.df.select("start", "at")), "seen")
                if old is not levels[0]:
                    old.drop()
        pairs.drop()
        if seen is not levels[0]:
            seen.drop()
        reached = levels[0].df.select("start", "at").limit(0) if least >= len(levels) else levels[least].df.select("start", "at")
        for more in levels[least + 1 :]:
            reached = reached.unionByName(more.df.select("start", "at"))
        reached = (reached if least <= 1 else reached.distinct()).select(F.col("start").alias(f"{start}__id"), F.col("at").alias(f"{end}__id"))
        ends = reached.join(self._vertices(end, there, where, props), f"{end}__id")
        return self._with(self.df.join(ends, f"{start}__id"), **{end: there})

    def exists(self, start: str, name: str, direction: str = "out", negated: bool = False, where=None, **props) -> Match:
        """``WHERE [NOT] (start)-[:name]->({props})`` as a semi or anti join."""
        _, there = self._end(start, name, direction)
        pairs = self._pairs(start, name, direction)
        if where is not None or props:
            ends = self._vertices("x", there, where, props).select(F.col("x__id").alias("there"))
            pairs = pairs.join(ends, "there", "left_semi")
        return self._with(self.df.join(pairs.select(F.col("here").alias(f"{start}__id")), f"{start}__id", "left_anti" if negated else "left_semi"))

    def gather(self, start: str, name: str, alias: str, value: Callable[[DataFrame], Column], direction: str = "out", where=None, **props) -> Match:
        """``[(start)-[:name]->(x {props}) | value]`` as a sorted list in ``alias``; empty where nothing is met."""
        _, there = self._end(start, name, direction)
        pairs = self._pairs(start, name, direction).withColumnRenamed("there", "x__id")
        ends = pairs.join(self._vertices("x", there, where, props), "x__id")
        lists = ends.groupBy(F.col("here").alias(f"{start}__id")).agg(F.sort_array(F.collect_list(value(ends))).alias("_list"))
        kind = lists.schema["_list"].dataType.simpleString()
        joined = self.df.join(lists, f"{start}__id", "left")
        return self._with(joined.withColumn(alias, F.coalesce("_list", F.array().cast(kind))).drop("_list"))

    def fold(self, start: str, name: str, direction: str = "out", where=None, link_where=None, **aggregates: Callable[[DataFrame], Column]) -> Match:
        """Independent optional branches, each folded on its own and joined to its start: ``(start)-[:name]->(x)`` with
        aggregates over the branch's distinct ends, instead of a product of branches and one grouping over it.
        ``link_where`` is a condition on the relationship: ``lambda r: r.link.<field>``."""
        _, there = self._end(start, name, direction)
        pairs = self._pairs(start, name, direction, payload=link_where is not None, collapse=False)
        if link_where is not None:  # parallel links: an end counts once if any of them meets the condition
            pairs = pairs.where(F.coalesce(link_where(pairs), F.lit(False))).select("here", "there")
        kind = self.graph.links[name]
        if link_where is not None or not kind.unique or direction == "both":
            # Dealt by the end once, for the collapse and for the join with the ends, into tasks that follow the table.
            pairs = pairs.repartition(kind.tasks(), "there").distinct()
        pairs = pairs.withColumnRenamed("there", "x__id")
        ends = pairs.join(self._vertices("x", there, where, {}), "x__id")
        folded = ends.groupBy(F.col("here").alias(f"{start}__id")).agg(*[f(ends).alias(alias) for alias, f in aggregates.items()])
        return self._with(self.df.join(folded, f"{start}__id", "left"))

    def where(self, condition: Callable[[Match], Column]) -> Match:
        return self._with(self.df.where(F.coalesce(condition(self), F.lit(False))))

    def select(self, distinct: bool = False, **items: Callable[[Match], Column] | str) -> DataFrame:
        """RETURN or WITH: named items only; ``"c.c_name"`` stands for that property."""
        if not items:
            raise PatternError("items are named one by one")
        rows = self.df.select(*[(self[i] if isinstance(i, str) else i(self)).alias(a) for a, i in items.items()])
        return rows.distinct() if distinct else rows


def bounded_product(left: DataFrame, right: DataFrame, most: int = MOST_BINDINGS) -> DataFrame:
    """All pairs of two small tables; refused, not cut, above ``most`` rows. Both sides are counted first."""
    a, b = left.limit(most + 1).count(), right.limit(most + 1).count()
    if a * b > most:
        raise PatternError(f"a product of {a} and {b} rows is above the bound of {most}")
    return left.crossJoin(right)


def nothing(aggregate: str) -> Column:
    """``count()`` or ``collect()`` without an argument: it folds nothing, so a group has 0 or an empty list."""
    if aggregate not in ("count", "collect"):
        raise PatternError(f"{aggregate}() needs an argument")
    none = F.lit(None).cast("string")
    return F.count(none) if aggregate == "count" else F.collect_list(none)


def group(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates grouped by ``keys``; without keys, no input rows give no row (not one of nulls)."""
    if keys:
        return rows.groupBy(*keys).agg(*[c.alias(a) for a, c in aggregates.items()])
    counted = rows.agg(*[c.alias(a) for a, c in aggregates.items()], F.count("*").alias("_rows"))
    return counted.where("_rows > 0").drop("_rows")


def label_scan(graph: Graph, label: str, closure: bool = False) -> DataFrame:
    """Keys of the live vertices of a label, with ``closure`` of its subtypes too; an unknown label gives none."""
    labels = graph.closure(label) if closure else [label] if label in graph.vertices else []
    return _keys_of(graph, labels)


def scan_all(graph: Graph, labels: list[str] | None = None) -> DataFrame:
    """``(key, label)`` of every live vertex, of all types or of those named."""
    return _keys_of(graph, list(graph.vertices.makers if labels is None and hasattr(graph.vertices, "makers") else labels or graph.vertices))


def _keys_of(graph: Graph, labels: list[str]) -> DataFrame:
    parts = [graph.vertices[x].live().select(vertex_key(x, graph.vertices[x].id_col).alias("key"), F.lit(x).alias("label")) for x in labels]
    if not parts:
        return graph.spark.createDataFrame([], "key string, label string")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def affected(graph: Graph, changed: DataFrame, label: str, steps: list[tuple[str, str]]) -> DataFrame:
    """Anchors whose rows a change may touch: from the changed ids of a pattern's far end back along its hops.

    ``steps`` are (link name, direction) from the changed end towards the anchor. One set-at-a-time walk.
    """
    here, at = changed.select("id").distinct(), label
    for name, direction in steps:
        link = graph.links[name]
        pairs = link.pairs(direction).withColumnRenamed("here", "id")
        here = here.join(pairs, "id").select(F.col("there").alias("id")).distinct()
        at = link.dst_label if direction == "out" else link.src_label
    return here
