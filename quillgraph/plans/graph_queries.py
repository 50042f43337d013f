"""Pattern queries over the business tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import match as M
from ..sources.graph import vertex_key, warehouse_graph
from .define import query


def start(spark, sf_dir):
    g = warehouse_graph(spark, sf_dir)
    return g, M.Match(g)


@query("""
SELECT 'vtx.customer.' || c_custkey AS customer_key, n_name AS nation, count(o_orderkey) AS open_orders, count(o_orderkey) = 0 AS idle
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON o_custkey = c_custkey GROUP BY c_custkey, n_name""")
def idle_customers(spark, sf_dir):
    """Customers, their nation and their open orders; the optional hop's condition belongs to the hop."""
    g, m = start(spark, sf_dir)
    m = m.node("c", "customer").hop("c", "inNation", "n")
    m = m.fold("c", "placedBy", "in", where=lambda o: o.o_orderstatus == "O", n_open=lambda o: F.count("*"))
    m = m.with_columns(open=lambda r: F.coalesce(r.df.n_open, F.lit(0)))
    return m.select(customer_key="c.key", nation="n.n_name", open_orders=lambda r: r.df.open, idle=lambda r: V.equal(r.df.open, F.lit(0), "bigint", "bigint"))


@query("SELECT 'vtx.nation.' || n_nationkey AS key, 'nation' AS label FROM nation")
def scan_label(spark, sf_dir):
    return M.label_scan(start(spark, sf_dir)[0], "nation")


@query("""SELECT 'vtx.customer.' || c_custkey AS key, 'customer' AS label FROM customer
UNION ALL SELECT 'vtx.supplier.' || s_suppkey, 'supplier' FROM supplier""")
def scan_taxonomy(spark, sf_dir):
    """A label with its subtypes: customers and suppliers are parties."""
    g, _ = start(spark, sf_dir)
    g.parents.update(customer="party", supplier="party")
    return M.label_scan(g, "party", closure=True)


@query("SELECT 'vtx.customer.' || c_custkey AS key, c_name AS name FROM customer WHERE c_custkey = 42")
def key_seek(spark, sf_dir):
    _, m = start(spark, sf_dir)
    return m.node("c", "customer", c_custkey=42).select(key="c.key", name="c.c_name")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AND c_acctbal > 0")
def inline_filter(spark, sf_dir):
    """Inline properties and a condition on the scan."""
    g, m = start(spark, sf_dir)
    low = g.vertices["customer"].df.agg(F.min("c_mktsegment").alias("s"))
    m = m.node("c", "customer", where=lambda c: c.c_acctbal > 0)
    return m.joined(low.withColumnRenamed("s", "c__c_mktsegment"), "c__c_mktsegment", "inner").select(id="c.id")


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def hop_out(spark, sf_dir):
    _, m = start(spark, sf_dir)
    return m.node("n", "nation").hop("n", "inRegion", "r").select(nation="n.n_name", region="r.r_name")


@query("SELECT r_name AS region, n_name AS nation, s_name AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def hop_in(spark, sf_dir):
    """A chain of two hops against the links' direction."""
    _, m = start(spark, sf_dir)
    m = m.node("r", "region").hop("r", "inRegion", "n", "in").hop("n", "locatedIn", "s", "in")
    return m.select(region="r.r_name", nation="n.n_name", supplier="s.s_name")


NEXT = "(SELECT n_nationkey AS src, n_nationkey + 5 AS dst FROM nation WHERE n_nationkey + 5 < 25)"


def neighbours(spark, sf_dir):
    """Nations linked to the nation five numbers on, for steps within one type."""
    g, m = start(spark, sf_dir)
    nations = g.vertices["nation"].df
    step = nations.select("n_nationkey", (F.col("n_nationkey") + 5).alias("next")).where("next < 25")
    g.add_links("next", step, ("nation", "n_nationkey"), ("nation", "next"), unique=True)
    return g, m


@query(f"""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN (SELECT src, dst FROM {NEXT} UNION SELECT dst, src FROM {NEXT}) e ON a.n_nationkey = e.src
JOIN nation b ON b.n_nationkey = e.dst""")
def hop_both(spark, sf_dir):
    _, m = neighbours(spark, sf_dir)
    return m.node("a", "nation").hop("a", "next", "b", "both").select(a="a.n_name", b="b.n_name")


@query(f"""WITH RECURSIVE w(src, dst, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation
UNION SELECT w.src, e.dst, hops + 1 FROM w JOIN {NEXT} e ON w.dst = e.src WHERE hops < 10)
SELECT DISTINCT src AS start, dst AS reached FROM w""")
def var_length_reach(spark, sf_dir):
    """Zero to ten hops: every vertex that is reached, once."""
    _, m = neighbours(spark, sf_dir)
    return m.node("a", "nation").reach("a", "next", "b").select(start="a.id", reached="b.id")


@query(f"""WITH RECURSIVE w(src, dst, hops) AS (SELECT src, dst, 1 FROM {NEXT} UNION SELECT w.src, e.dst, hops + 1 FROM w JOIN {NEXT} e ON w.dst = e.src WHERE hops < 3)
SELECT DISTINCT src AS start, dst AS reached FROM w WHERE hops BETWEEN 2 AND 3""")
def var_length_bounded(spark, sf_dir):
    _, m = neighbours(spark, sf_dir)
    return m.node("a", "nation").reach("a", "next", "b", 2, 3).select(start="a.id", reached="b.id")


@query("""SELECT c_custkey AS customer, o_orderkey AS "order" FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def optional_match(spark, sf_dir):
    _, m = start(spark, sf_dir)
    return m.node("c", "customer").hop("c", "placedBy", "o", "in", optional=True).select(customer="c.id", order="o.id")


@query("""SELECT c_custkey AS customer, o_orderkey AS "order" FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000""")
def optional_match_where(spark, sf_dir):
    _, m = start(spark, sf_dir)
    m = m.node("c", "customer").hop("c", "placedBy", "o", "in", optional=True, where=lambda o: o.o_totalprice > 400000)
    return m.select(customer="c.id", order="o.id")


@query("SELECT segment, count(*) AS statuses FROM (SELECT DISTINCT c_mktsegment AS segment, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey) WHERE o_orderstatus <> 'P' GROUP BY segment")
def with_distinct(spark, sf_dir):
    """A distinct WITH, filtered after it, feeding a count."""
    _, m = start(spark, sf_dir)
    rows = m.node("o", "order").hop("o", "placedBy", "c", check=True).select(distinct=True, segment="c.c_mktsegment", status="o.o_orderstatus")
    return M.group(rows.where("status <> 'P'"), ["segment"], statuses=F.count("*"))


@query("SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def group_count(spark, sf_dir):
    _, m = start(spark, sf_dir)
    return M.group(m.node("c", "customer").hop("c", "inNation", "n").select(nation="n.n_name"), ["nation"], customers=F.count("*"))


@query("SELECT c_mktsegment AS segment, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT CASE WHEN o_totalprice > 300000 THEN o_orderkey END) AS large FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def count_distinct(spark, sf_dir):
    """Distinct and conditional distinct counts."""
    _, m = start(spark, sf_dir)
    rows = m.node("o", "order").hop("o", "placedBy", "c").select(segment="c.c_mktsegment", status="o.o_orderstatus", price="o.o_totalprice", id="o.id")
    return M.group(rows, ["segment"], statuses=F.count_distinct("status"), large=F.count_distinct(F.when(F.col("price") > 300000, F.col("id"))))


@query("""SELECT n_name AS nation, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_mktsegment) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def collect_distinct(spark, sf_dir):
    _, m = start(spark, sf_dir)
    rows = m.node("c", "customer").hop("c", "inNation", "n").select(nation="n.n_name", segment="c.c_mktsegment")
    found = M.group(rows, ["nation"], s=F.sort_array(F.collect_set("segment")))
    return found.select("nation", F.array_join("s", ",").alias("segments"), F.size("s").cast("long").alias("n"))


@query("SELECT c_custkey AS customer, min(o_totalprice) AS least, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def min_max(spark, sf_dir):
    _, m = start(spark, sf_dir)
    m = m.node("c", "customer").fold("c", "placedBy", "in", least=lambda o: F.min("x__o_totalprice"), most=lambda o: F.max("x__o_totalprice"))
    return m.select(customer="c.id", least=lambda r: r.df.least, most=lambda r: r.df.most)


@query("SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS rest FROM orders")
def conditional_count(spark, sf_dir):
    _, m = start(spark, sf_dir)
    rows = m.node("o", "order").select(s="o.o_orderstatus")
    return M.group(rows, [], done=F.count(F.when(F.col("s") == "F", 1)), rest=F.count(F.when(F.col("s") != "F", 1)))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'none' HAVING count(*) > 0")
def zero_row_aggregate(spark, sf_dir):
    """An aggregate over no rows gives no row."""
    _, m = start(spark, sf_dir)
    return M.group(m.node("o", "order", o_orderstatus="none").select(s="o.o_orderstatus"), [], n=F.count("*"))


@query("SELECT c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark, sf_dir):
    _, m = start(spark, sf_dir)
    return m.node("c", "customer").exists("c", "placedBy", "in", o_orderstatus="P").select(customer="c.id")


@query("SELECT c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    _, m = start(spark, sf_dir)
    return m.node("c", "customer").exists("c", "placedBy", "in", negated=True).select(customer="c.id")


@query("""SELECT c_custkey AS customer, coalesce(n, 0) AS n, coalesce(prices, '') AS prices FROM customer LEFT JOIN (
SELECT o_custkey, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS prices FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def pattern_comprehension(spark, sf_dir):
    """A correlated list, empty where nothing is met."""
    _, m = start(spark, sf_dir)
    m = m.node("c", "customer").gather("c", "placedBy", "ids", lambda o: F.col("x__id"), "in", o_orderstatus="P")
    return m.select(customer="c.id", n=lambda r: F.size(r.df.ids).cast("long"), prices=lambda r: F.array_join(r.df.ids.cast("array<string>"), ","))


@query("""SELECT o_orderkey AS "order", count(*) AS parts FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def parallel_links(spark, sf_dir):
    """Parallel links to one vertex collapse."""
    _, m = start(spark, sf_dir)
    rows = m.node("o", "order", o_orderstatus="P").hop("o", "contains", "p", check=False).select(order="o.id", part="p.id")
    return M.group(rows, ["order"], parts=F.count("*"))


@query("""SELECT o_orderkey AS "order", count(*) AS links, sum(l_quantity) AS quantity, min(l_linenumber) AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def named_relationship(spark, sf_dir):
    """A named relationship keeps parallel links apart and gives their payload."""
    _, m = start(spark, sf_dir)
    rows = m.node("o", "order", o_orderstatus="P").hop("o", "contains", "p", link="r", check=False)
    rows = rows.select(order="o.id", q=lambda x: x.df["r__link.l_quantity"], n=lambda x: x.df["r__link.l_linenumber"])
    return M.group(rows, ["order"], links=F.count("*"), quantity=F.sum("q"), line=F.min("n"))


@query("""SELECT DISTINCT o_orderkey AS "order" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) ON l_partkey = p JOIN supplier ON s = s_suppkey
WHERE s_nationkey = n_nationkey AND o_orderstatus = 'P'""")
def bound_end(spark, sf_dir):
    """Two branches that must meet in the same nation: each part's nations are made distinct before they meet."""
    g, m = start(spark, sf_dir)
    nations = M.Match(g).node("s", "supplier").hop("s", "suppliedBy", "p", "in").hop("s", "locatedIn", "n").df.select("p__id", "n__id").distinct()
    m = m.node("o", "order", o_orderstatus="P").hop("o", "placedBy", "c").hop("c", "inNation", "n").hop("o", "contains", "p", check=False)
    return m.joined(nations, ["p__id", "n__id"], "left_semi").select(distinct=True, order="o.id")


@query("""SELECT s_suppkey AS supplier, max(cust) AS customers, max(ord) AS orders FROM (SELECT s_suppkey, c.n AS cust, 0 AS ord FROM supplier LEFT JOIN
(SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1) c ON c_nationkey = s_nationkey
UNION ALL SELECT s_suppkey, 0, p.n FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) p ON l_suppkey = s_suppkey) GROUP BY s_suppkey""")
def sibling_branches(spark, sf_dir):
    """Two optional branches folded apart instead of as a product."""
    g, m = start(spark, sf_dir)
    segments = M.Match(g).node("n", "nation").fold("n", "inNation", "in", customers=lambda c: F.count_distinct("x__c_mktsegment"))
    m = m.node("s", "supplier").hop("s", "locatedIn", "n").fold("s", "suppliedBy", "in", orders=lambda p: F.count_distinct("x__id"))
    m = m.joined(segments.df.select("n__id", "customers"), "n__id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return m.select(supplier="s.id", customers=lambda r: zero(r.df.customers), orders=lambda r: zero(r.df.orders))


@query("SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
def cross_product(spark, sf_dir):
    """Two unrelated patterns: a product within a bound that is checked first."""
    _, m = start(spark, sf_dir)
    return m.node("r", "region").node("n", "nation").select(region="r.r_name", nation="n.n_name")


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' END AS size FROM orders")
def case_flag(spark, sf_dir):
    _, m = start(spark, sf_dir)
    price = lambda r, n: V.compare(r["o.o_totalprice"], ">", F.lit(n))
    return m.node("o", "order").select(id="o.id", size=lambda r: F.when(price(r, 300000.0), "large").when(price(r, 100000.0), "medium"))


@query("""SELECT customer, o IS NULL AS no_order, o IS NOT NULL AS has_order, o IS NOT DISTINCT FROM NULL AS same FROM (SELECT c_custkey AS customer, min(o_orderkey) AS o
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def null_equality(spark, sf_dir):
    """Null equals null; <> null means not null; NOT null is true."""
    _, m = start(spark, sf_dir)
    rows = m.node("c", "customer").fold("c", "placedBy", "in", o=lambda x: F.min("x__id"))
    null = F.lit(None).cast("bigint")
    return rows.select(customer="c.id", no_order=lambda r: V.equal(r.df.o, null, "bigint", "bigint"), has_order=lambda r: V.not_equal(r.df.o, null, "bigint", "bigint"), same=lambda r: V.negate(r.df.o, "bigint"))


@query("SELECT o_orderkey AS id, o_totalprice * 2.0 - 1.0 AS a, CAST(CAST(trunc(o_totalprice) AS BIGINT) % 7 AS DOUBLE) AS m, 0 - o_totalprice AS neg FROM orders")
def arithmetic(spark, sf_dir):
    """Arithmetic in doubles. The remainder truncates its operands."""
    _, m = start(spark, sf_dir)
    p = lambda r: r["o.o_totalprice"]
    return m.node("o", "order").select(id="o.id", a=lambda r: V.arithmetic(V.arithmetic(p(r), "*", F.lit(2)), "-", F.lit(1)), m=lambda r: V.arithmetic(F.floor(p(r)), "%", F.lit(7)), neg=lambda r: V.minus(p(r)))


@query("""SELECT a.n_name AS a, b.n_name AS b, 1.0 - CAST(levenshtein(a.n_name, b.n_name) AS DOUBLE) / greatest(length(a.n_name), length(b.n_name)) AS ratio FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey""")
def levenshtein_ratio(spark, sf_dir):
    """Similar names among the nations of a region."""
    _, m = start(spark, sf_dir)
    m = m.node("a", "nation").hop("a", "inRegion", "r").hop("r", "inRegion", "b", "in").where(lambda r: r["a.id"] < r["b.id"])
    return m.select(a="a.n_name", b="b.n_name", ratio=lambda r: V.edit_ratio(r["a.n_name"], r["b.n_name"]))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'vtx.customer.' || c_custkey AS key FROM customer")
def id_from_key(spark, sf_dir):
    _, m = start(spark, sf_dir)
    return m.node("c", "customer").select(id=lambda r: V.id_from_key(r["c.key"]), key="c.key")


@query("""SELECT s_suppkey AS supplier, 'outbound' AS direction, 'vtx.nation.' || s_nationkey AS other, 'lnk.supplier.' || s_suppkey || '.locatedIn.nation.' || s_nationkey AS lkey FROM supplier
UNION ALL SELECT s_nationkey, 'inbound', 'vtx.supplier.' || s_suppkey, 'lnk.supplier.' || s_suppkey || '.locatedIn.nation.' || s_nationkey FROM supplier""")
def adjacency(spark, sf_dir):
    """Two directed entries a link."""
    from ..sources.graph import adjacency as entries

    g, _ = start(spark, sf_dir)
    rows = entries(g.links["locatedIn"])
    other = F.when(F.col("direction") == "outbound", vertex_key("nation", "other")).otherwise(vertex_key("supplier", "other"))
    return rows.select(F.col("node").cast("long").alias("supplier"), "direction", other.alias("other"), "lkey")


@query("""SELECT DISTINCT n_nationkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'""")
def affected_anchors(spark, sf_dir):
    """Nations whose rows a change of orders touches: the pattern walked back."""
    g, _ = start(spark, sf_dir)
    changed = g.vertices["order"].df.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return M.affected(g, changed, "order", [("placedBy", "out"), ("inNation", "out")])


@query("""SELECT u AS user, errors, purchases, errors > purchases AS troubled FROM (SELECT user_id AS u, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases FROM events GROUP BY user_id)""")
def user_activity(spark, sf_dir):
    _, m = start(spark, sf_dir)
    m = m.node("u", "user").fold("u", "didEvent", errors=lambda e: F.count(F.when(F.col("x__event_type") == "error", 1)), purchases=lambda e: F.count(F.when(F.col("x__event_type") == "purchase", 1)))
    return m.select(user="u.id", errors=lambda r: r.df.errors, purchases=lambda r: r.df.purchases, troubled=lambda r: V.compare(r.df.errors, ">", r.df.purchases))
