"""Property graphs over DataFrames: a table for each vertex type, each aspect and each link name.

Vertices keep their native ids for joins; the text key ``vtx.<type>.<id>`` is an expression that costs nothing where a
query doesn't ask for it. Catalyst prunes columns and pushes filters to the files, as nothing is copied into one
wide table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that the links of one split of a table are dealt into.
TASKS_A_SPLIT = 8


@dataclass
class VertexType:
    label: str
    df: DataFrame
    id_col: str

    def live(self) -> DataFrame:
        return self.df.where(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in self.df.columns else self.df


@dataclass
class LinkType:
    """Links of one name: ``df`` has ``src``, ``dst`` and payload columns; ``unique``: no pair occurs twice."""

    name: str
    df: DataFrame
    src_label: str
    dst_label: str
    unique: bool = False

    def live(self) -> DataFrame:
        return self.df.where(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in self.df.columns else self.df

    def tasks(self) -> int:
        """Tasks to deal all links into: some for each split of the table, so that what one task holds doesn't grow with it.
        Only plans; a computed table with shuffles of its own would run them for it."""
        return max(TASKS_A_SPLIT * self.df.rdd.getNumPartitions(), int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pairs(self, direction: str, payload: bool = False, collapse: bool = True) -> DataFrame:
        """``(here, there)`` for an outward, inward or either-way hop; parallel links collapse unless the payload is
        asked for, or ``collapse`` is false. A hop never returns to where it starts."""
        out = self.live().select(F.col("src").alias("here"), F.col("dst").alias("there"), *([F.struct("*", F.lit(self.name).alias("name"), link_key(self, F.col("src"), F.col("dst")).alias("key")).alias("link")] if payload else []))
        back = out.select(F.col("there").alias("here"), F.col("here").alias("there"), *(["link"] if payload else []))
        rows = {"out": out, "in": back}[direction] if direction != "both" else out.unionByName(back)
        if self.src_label == self.dst_label:
            rows = rows.where("here <> there")
        return rows if payload or not collapse or (self.unique and direction != "both") else rows.distinct()


class OnDemand(dict):
    """A dict whose values are made when first asked for: a query opens only the tables that it names."""

    def __init__(self, makers: dict):
        super().__init__()
        self.makers = makers

    def __missing__(self, key):
        self[key] = found = self.makers[key]()
        return found

    def __contains__(self, key) -> bool:
        return super().__contains__(key) or key in self.makers

    def get(self, key, default=None):
        return self[key] if key in self else default


@dataclass
class Graph:
    spark: SparkSession
    vertices: dict[str, VertexType] = field(default_factory=dict)
    links: dict[str, LinkType] = field(default_factory=dict)
    aspects: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    #: parent type of each declared subtype
    parents: dict[str, str] = field(default_factory=dict)

    def add_vertices(self, label: str, df: DataFrame, id_col: str) -> Graph:
        self.vertices[label] = VertexType(label, df, id_col)
        return self

    def add_aspect(self, label: str, name: str, df: DataFrame) -> Graph:
        """``df`` has ``id`` and the aspect's fields, one live row a vertex."""
        self.aspects[label, name] = df
        return self

    def add_links(self, name: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], payload: tuple[str, ...] = (), unique: bool = False) -> Graph:
        """Links from columns of ``df``: (label, column) of either end. Rows with a null end are no links."""
        self.links[name] = link_type(name, df, src, dst, payload, unique)
        return self

    def closure(self, label: str, depth: int = 4) -> list[str]:
        """The label and its declared subtypes, ``depth`` levels down at most; a cycle is refused."""
        found, level = [label], [label]
        for _ in range(depth):
            level = [child for child, parent in self.parents.items() if parent in level]
            if set(level) & set(found):
                raise ValueError(f"subtypes of {label} form a cycle")
            found += level
        return [x for x in found if x in self.vertices]


def link_type(name: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], payload: tuple[str, ...] = (), unique: bool = False) -> LinkType:
    rows = df.where(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull())
    kept = [c for c in ("is_deleted", *payload) if c in df.columns]
    return LinkType(name, rows.select(F.col(src[1]).alias("src"), F.col(dst[1]).alias("dst"), *kept), src[0], dst[0], unique)


def vertex_key(label: str, id_col: Column | str) -> Column:
    return F.concat(F.lit(f"vtx.{label}."), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"))


def link_key(link: LinkType, src: Column, dst: Column) -> Column:
    return F.concat(F.lit(f"lnk.{link.src_label}."), src.cast("string"), F.lit(f".{link.name}.{link.dst_label}."), dst.cast("string"))


def class_authority(classes: DataFrame, most: int = 4) -> DataFrame:
    """``(id, type_id)``: for each vertex (id, instance_of, declared), the declared type that it or one of the up to
    ``most`` vertices above it by live ``instance_of`` links is; null where none is met. A declared type stands for itself."""
    up = classes.select(F.col("id").alias("_up"), F.col("instance_of").alias("_next"), F.col("declared").alias("_declared"))
    rows = classes.select("id", F.when(F.col("declared"), F.col("id")).alias("type_id"), F.when(~F.coalesce("declared", F.lit(False)), F.col("instance_of")).alias("_at"))
    for _ in range(most):
        met = rows.join(up, rows["_at"] == up["_up"], "left")
        found = F.coalesce("_declared", F.lit(False))
        rows = met.select("id", F.coalesce("type_id", F.when(found, F.col("_up"))).alias("type_id"), F.when(~found, F.col("_next")).alias("_at"))
    return rows.select("id", "type_id")


def adjacency(link: LinkType) -> DataFrame:
    """Two directed entries a link: ``(node, direction, name, other, lkey)``."""
    rows = link.live().withColumn("lkey", link_key(link, F.col("src"), F.col("dst")))
    entry = lambda here, there, way: rows.select(F.col(here).alias("node"), F.lit(way).alias("direction"), F.lit(link.name).alias("name"), F.col(there).alias("other"), "lkey")
    return entry("src", "dst", "outbound").unionByName(entry("dst", "src", "inbound"))


def warehouse_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The business tables as a graph: keys to other tables are links."""
    opened: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    def vertex(label: str, name: str, id_col: str):
        return label, lambda: VertexType(label, table(name), id_col)

    def link(name: str, of: str, src: tuple[str, str], dst: tuple[str, str], payload: tuple[str, ...] = (), unique: bool = True):
        return name, lambda: link_type(name, table(of), src, dst, payload, unique)

    vertices = dict(
        [
            vertex("region", "region", "r_regionkey"),
            vertex("nation", "nation", "n_nationkey"),
            vertex("customer", "customer", "c_custkey"),
            vertex("supplier", "supplier", "s_suppkey"),
            vertex("part", "part", "p_partkey"),
            vertex("order", "orders", "o_orderkey"),
            vertex("event", "events", "event_id"),
            vertex("document", "documents", "doc_id"),
            vertex("label", "labels", "doc_id"),
            ("user", lambda: VertexType("user", table("events").select("user_id").distinct(), "user_id")),
        ]
    )
    links = dict(
        [
            link("inRegion", "nation", ("nation", "n_nationkey"), ("region", "n_regionkey")),
            link("inNation", "customer", ("customer", "c_custkey"), ("nation", "c_nationkey")),
            link("locatedIn", "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
            link("placedBy", "orders", ("order", "o_orderkey"), ("customer", "o_custkey")),
            link("contains", "lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), ("l_quantity", "l_extendedprice", "l_linenumber"), unique=False),
            link("suppliedBy", "lineitem", ("part", "l_partkey"), ("supplier", "l_suppkey"), unique=False),
            link("didEvent", "events", ("user", "user_id"), ("event", "event_id")),
            link("labels", "labels", ("label", "doc_id"), ("document", "doc_id")),
        ]
    )
    return Graph(spark, OnDemand(vertices), OnDemand(links))
