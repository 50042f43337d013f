"""Change dispatch, fan-out, output shapes and permissions over the business tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import authz, changes, convergence, history, mutations, output, views
from ..operators import match as M
from ..sources.graph import class_authority, vertex_key, warehouse_graph
from .define import query
from .view_queries import FLOW, history_events, table, targets


def change_log(spark, sf_dir):
    """Customers as vertices (overdrawn by 500 or more: deleted), order states as aspects, orders' owners as links, regions
    under keys of no kind."""
    c, o, r = (table(spark, sf_dir, t) for t in ("customer", "orders", "region"))
    text = lambda x: F.col(x).cast("string")
    rows = c.select(F.concat(F.lit("vtx.customer."), text("c_custkey")).alias("key"), F.col("c_custkey").alias("seq"), (F.col("c_acctbal") < -500).alias("is_deleted"))
    aspect = o.where("o_orderstatus = 'P'").select(F.concat(F.lit("vtx.order."), text("o_orderkey"), F.lit(".status")).alias("key"), F.col("o_orderkey").alias("seq"), F.lit(True).alias("is_deleted"))
    link = o.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("lnk.order."), text("o_orderkey"), F.lit(".placedBy.customer."), text("o_custkey")).alias("key"), F.col("o_orderkey").alias("seq"), F.lit(None).cast("boolean").alias("is_deleted"))
    odd = r.select(F.concat(F.lit("region/"), text("r_regionkey")).alias("key"), F.col("r_regionkey").cast("long").alias("seq"), F.lit(False).alias("is_deleted"))
    return rows.unionByName(aspect).unionByName(link).unionByName(odd)


@query("""SELECT 'vertex' AS kind, 'customer' AS label, CAST(c_custkey AS VARCHAR) AS id, c_custkey AS seq, c_acctbal < -500 AS is_deleted FROM customer
UNION ALL SELECT 'aspect', 'order', CAST(o_orderkey AS VARCHAR), o_orderkey, false FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'link', 'order', CAST(o_orderkey AS VARCHAR), o_orderkey, false FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'link', 'customer', CAST(o_custkey AS VARCHAR), o_orderkey, false FROM orders WHERE o_orderpriority = '1-URGENT'""")
def dispatch_changes(spark, sf_dir):
    """What each change touches, by its key's kind: itself, its owner, both ends."""
    return changes.touched(change_log(spark, sf_dir))


@query("""SELECT 'order' AS label, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'""")
def dispatch_filtered(spark, sf_dir):
    """Only changes that touch the types of a view."""
    return changes.touched(change_log(spark, sf_dir), ["order"]).select("label", "id").distinct()


@query("SELECT 'region/' || r_regionkey AS key FROM region")
def dispatch_unknown(spark, sf_dir):
    return changes.unknown_keys(change_log(spark, sf_dir)).select("key")


@query("SELECT 'idle.customer.' || c_custkey AS key, c_custkey AS projection_seq, true AS is_deleted FROM customer WHERE c_acctbal < -500")
def anchor_retraction(spark, sf_dir):
    """Deleted anchors' rows go without a read: their keys follow from the anchors'."""
    key = output.OutputKey("idle.{actorSuffix}", "customer").build(vertex_key("customer", "id"))
    return changes.anchor_tombstones(change_log(spark, sf_dir), "customer", key)


@query("SELECT DISTINCT n_nationkey AS seq, CAST(s_suppkey AS VARCHAR) AS actor_id FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def actor_fan_out(spark, sf_dir):
    """Suppliers that a change of a nation reaches; the walk also goes through regions, so by way of other nations."""
    g = warehouse_graph(spark, sf_dir)
    changed = g.vertices["nation"].df.select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("nation").alias("label"), F.col("n_nationkey").alias("id"))
    return changes.affected_actors(g, changed, ["locatedIn"], "supplier")


@query("""SELECT n1.n_nationkey AS seq, CAST(s_suppkey AS VARCHAR) AS actor_id FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey JOIN supplier ON s_nationkey = n2.n_nationkey""")
def actor_fan_out_by_region(spark, sf_dir):
    """The same over two kinds of links: nation, region, nation, supplier."""
    g = warehouse_graph(spark, sf_dir)
    changed = g.vertices["nation"].df.select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("nation").alias("label"), F.col("n_nationkey").alias("id"))
    return changes.affected_actors(g, changed, ["locatedIn", "inRegion"], "supplier", most=1_000_000)


def balances(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("source"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 AND c_mktsegment <> 'BUILDING' THEN 'content' WHEN c_custkey % 3 = 0 THEN 'provenance' ELSE 'converged' END AS verdict FROM customer
UNION ALL SELECT -c_custkey - 1, 'stale' FROM customer WHERE c_custkey % 100 = 0""")
def reproject_verdict(spark, sf_dir):
    """A stored view against a fresh evaluation, row by row (a sweep is the same over all anchors)."""
    fresh = balances(spark, sf_dir)
    stored = fresh.where("id % 5 <> 0").withColumn("segment", F.when(F.col("id") % 7 == 0, "BUILDING").otherwise(F.col("segment"))).withColumn("source", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("source")))
    old = fresh.where("id % 100 = 0").withColumn("id", -F.col("id") - 1)
    return changes.verdicts(stored.unionByName(old), fresh, ["id"], ["segment"], ["source"])


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 OR (c_custkey % 7 = 0 AND c_mktsegment <> 'BUILDING')")
def reproject_heal(spark, sf_dir):
    fresh = balances(spark, sf_dir)
    stored = fresh.where("id % 5 <> 0").withColumn("segment", F.when(F.col("id") % 7 == 0, "BUILDING").otherwise(F.col("segment")))
    return changes.heal(stored, fresh, ["id"], ["segment"], ["source"]).select("id")


@query("""SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS actor_id FROM supplier WHERE s_suppkey % 7 = 0 OR s_acctbal < 0""")
def grant_change_actors(spark, sf_dir):
    """Every seventh supplier lost a grant, overdrawn ones gained another: their personal rows are due."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("actor_id"), F.col("s_nationkey").cast("string").alias("anchor_id"), "s_suppkey", "s_acctbal")
    before = s.select("actor_id", "anchor_id", F.lit(False).alias("is_deleted"))
    after = s.select("actor_id", "anchor_id", (F.col("s_suppkey") % 7 == 0).alias("is_deleted")).unionByName(s.where("s_acctbal < 0").select("actor_id", F.lit("extra").alias("anchor_id"), F.lit(False).alias("is_deleted")))
    return changes.dirty_actors(before, after)


@query("SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS name, 9 AS projection_seq, false AS is_deleted FROM customer WHERE c_custkey % 4 = 0 AND c_acctbal >= 0")
def shred_nullification(spark, sf_dir):
    """Names of customers whose key was shredded are emptied; deleted rows stay as they are."""
    c = table(spark, sf_dir, "customer")
    view = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).cast("long").alias("projection_seq"), (F.col("c_acctbal") < 0).alias("is_deleted"))
    return changes.shred(view, c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("owner_id")), "id", ["name"], 9).withColumn("projection_seq", F.col("projection_seq").cast("int"))


def orders_of(spark, sf_dir):
    """Customers with their orders as lists; entries of orders in progress have no name, so they are not real."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("name"), F.col("o_orderkey").alias("id")).alias("e"))
    lists = o.groupBy("k").agg(F.collect_list("e").alias("orders"))
    c = table(spark, sf_dir, "customer").join(lists, F.col("c_custkey") == F.col("k"), "left")
    return c.select(vertex_key("customer", "c_custkey").alias("actorKey"), F.coalesce("orders", F.array().cast("array<struct<name:string,id:bigint>>")).alias("orders"), "c_mktsegment")


@query("""SELECT 'orders.customer.' || c_custkey AS key, 'vtx.customer.' || c_custkey AS actor, '1.0' AS version, '2024-01-01T00:00:00Z' AS "projectedAt", count(o_orderkey) AS n, c_mktsegment, CASE WHEN count(o_orderkey) > 0 THEN 'upsert' ELSE 'delete' END AS op
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def actor_envelope(spark, sf_dir):
    """One document a customer: its real orders; without any the document is deleted."""
    found = output.envelope(orders_of(spark, sf_dir), output.OutputKey("orders.{actorSuffix}", "customer"), ["orders", "c_mktsegment"], "2024-01-01T00:00:00Z", {"orders": "name"}, static=["links"])
    return found.select("key", "actor", "version", "projectedAt", F.size("orders").cast("long").alias("n"), "c_mktsegment", "op")


@query("""SELECT 'cap.' || c_custkey || '.read' AS key, 'vtx.customer.' || c_custkey AS back, CAST(NULL AS VARCHAR) AS other FROM customer""")
def key_template(spark, sf_dir):
    """Keys built from anchors, and anchors read back from keys; another pattern's keys have none."""
    key = output.OutputKey("cap.{actorSuffix}.read", "customer", bare=True)
    rows = table(spark, sf_dir, "customer").select(key.build(vertex_key("customer", "c_custkey")).alias("key"))
    return rows.select("key", key.anchor_of(F.col("key")).alias("back"), output.OutputKey("cap.{actorSuffix}", "supplier").anchor_of(F.col("key")).alias("other"))


@query("""SELECT o_orderkey AS id, 'vtx.customer.' || o_custkey AS source, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS revision FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'vtx.meta.lens', 7 FROM orders WHERE o_orderstatus = 'P'""")
def provenance_revisions(spark, sf_dir):
    """What a row came from, with revisions where they are known; the view itself is always among it."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), vertex_key("customer", "o_custkey").alias("customer"), F.lit("plain").alias("note"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(vertex_key("customer", "c_custkey").alias("key"), F.col("c_custkey").alias("seq"))
    current = c.unionByName(spark.createDataFrame([("vtx.meta.lens", 7)], "key string, seq long"))
    return output.revisions(rows, "id", ["customer", "note"], current, [F.lit("vtx.meta.lens")])


@query("""SELECT o_custkey || '.' || o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderkey AS VARCHAR) AS "order" FROM orders""")
def keyed_documents(spark, sf_dir):
    """Documents under composite keys, and the keys taken apart again."""
    docs = output.keyed_documents(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], ["o_orderstatus", "o_totalprice"])
    fields = output.key_fields(docs, ["customer", "order"])
    return fields.select(F.concat_ws(".", "customer", "order").alias("key"), "customer", "order")


@query("SELECT 'order.' || o_orderkey AS key FROM orders UNION ALL SELECT 'gone:part.' || p_partkey FROM part")
def truncate_prefix(spark, sf_dir):
    """One view's keys are emptied and returned; another's in the same table stay."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("order."), F.col("o_orderkey").cast("string")).alias("key"))
    stays, gone = output.truncate(rows.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("key"))), "part.")
    return stays.unionByName(gone.select(F.concat(F.lit("gone:"), F.col("key")).alias("key")))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS actor_id, 'other' AS grant_source, 5 AS projection_seq, false AS is_deleted FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'mine', CASE WHEN s_suppkey % 2 = 0 THEN 9 ELSE 5 END, s_suppkey % 2 = 0 FROM supplier""")
def grant_writer(spark, sf_dir):
    """A source's grants are upserted by revision; rows of another source, and late writes, change nothing."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("actor_id"), F.col("s_nationkey").cast("string").alias("anchor_id"), "s_suppkey")
    row = lambda source, seq, gone: s.select("actor_id", "anchor_id", F.lit(source).alias("grant_source"), seq.cast("int").alias("projection_seq"), gone.alias("is_deleted"))
    stored = row("mine", F.lit(5), F.lit(False)).unionByName(row("other", F.lit(5), F.lit(False)))
    incoming = row("claimed", F.when(F.col("s_suppkey") % 2 == 0, 9).otherwise(3), F.lit(True))
    return output.write_grants(stored, incoming, "mine").select("actor_id", "grant_source", "projection_seq", "is_deleted")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS n_anchors, c_custkey % 6 = 0 AS is_deleted, CASE WHEN c_custkey % 6 = 0 THEN 'now' END AS deleted_at FROM customer""")
def protected_table(spark, sf_dir):
    """A protected table after a write: deletions keep a stamped row, missing anchors become none."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    stored = c.select("id", F.lit("old").alias("v"), F.array(F.lit("a")).alias("authz_anchors"), F.lit(1).alias("projection_seq"), F.lit(False).alias("is_deleted"), F.lit(None).cast("string").alias("deleted_at"))
    incoming = c.where("id % 3 = 0").select("id", F.lit("new").alias("v"), F.lit(None).cast("array<string>").alias("authz_anchors"), F.lit(2).alias("projection_seq"), (F.col("id") % 6 == 0).alias("is_deleted"))
    return output.write_protected(stored, incoming, ["id"], "now").select("id", "v", F.size("authz_anchors").alias("n_anchors"), "is_deleted", "deleted_at")


def personal(spark, sf_dir):
    """Orders as personal rows of their customer; the anchor is the order's priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("actor_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("anchor"), F.col("o_orderkey").alias("id"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND (o_custkey % 3 = 0 OR o_custkey % 3 = 1 AND o_orderstatus = 'F' OR o_custkey % 3 = 2 AND o_orderpriority = '2-HIGH')""")
def personal_rows(spark, sf_dir):
    """Rows go to who may read their anchor and is interested: in all, in a kind, or in an anchor."""
    rows = personal(spark, sf_dir)
    actors = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("actor_id"), "c_custkey")
    grants = actors.select("actor_id", F.explode(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]))).alias("anchor_id")).withColumn("is_deleted", F.col("anchor_id") == "4-NOT SPECIFIED")
    none = F.array().cast("array<string>")
    interest = actors.where("c_custkey % 3 <> 0").select("actor_id", F.when(F.col("c_custkey") % 3 == 1, F.array(F.lit("F"))).otherwise(none).alias("types"), F.when(F.col("c_custkey") % 3 == 2, F.array(F.lit("2-HIGH"))).otherwise(none).alias("anchors"))
    return output.personal_rows(rows, grants, interest).select("id")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS actor_id, CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'upsert' END AS op, o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN '{"kind":"' || o_orderstatus || '","anchor":"new"}' END AS data
FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'""")
def actor_deltas(spark, sf_dir):
    """What every actor's copy has to change between two evaluations; rows that stay the same send nothing."""
    before = personal(spark, sf_dir)
    after = before.where("kind <> 'P'").withColumn("anchor", F.when(F.col("anchor") == "5-LOW", "new").otherwise(F.col("anchor")))
    return output.deltas(before, after, ["id"], ["kind", "anchor"])


@query("""SELECT 'upsert' AS op, o_orderkey AS revision FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'hydrated', coalesce(max(o_orderkey), 0) FROM orders WHERE o_custkey = 7""")
def cold_hydration(spark, sf_dir):
    """One recipient's rows, and a marker with the highest revision."""
    return output.hydration(personal(spark, sf_dir).withColumn("projection_seq", F.col("id")), "7").select("op", "revision")


@query("""SELECT 'balances' AS "view", CAST(c_custkey AS VARCHAR) AS key, sha256('{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS row_hash, '2024' AS at FROM customer WHERE c_custkey % 10 = 0""")
def write_audit(spark, sf_dir):
    """One record for each write that had an effect."""
    rows = balances(spark, sf_dir).select("id", "segment")
    stored = rows.withColumn("segment", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("segment")))
    return output.audit(views.changed_only(stored, rows, ["id"], ["segment"]), "balances", "2024", ["id"])


def roles(spark, sf_dir):
    """Suppliers belong to the role of their nation; parts' brands are operations, their sizes' parity the scope."""
    members = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("actor_id"), F.col("s_nationkey").alias("role_id"))
    p = table(spark, sf_dir, "part")
    return members, p.select((F.col("p_partkey") % 25).cast("int").alias("role_id"), F.col("p_brand").alias("operation"), (F.col("p_size") % 2).cast("string").alias("scope"))


@query("""SELECT actor_id, string_agg(p, ',' ORDER BY p) AS permissions FROM (SELECT DISTINCT s_suppkey AS actor_id, p_brand || ':' || p_size % 2 AS p FROM supplier JOIN part ON p_partkey % 25 = s_nationkey
UNION SELECT s_suppkey, 'own:*' FROM supplier WHERE s_acctbal > 0) GROUP BY actor_id""")
def permission_union(spark, sf_dir):
    """The permissions of an actor's roles and their own, each once."""
    members, permissions = roles(spark, sf_dir)
    direct = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("actor_id"), F.lit("own").alias("operation"), F.lit("*").alias("scope"))
    found = authz.permission_union(members, permissions, direct).where(F.size("permissions") > 0)
    texts = F.array_sort(F.transform("permissions", lambda p: F.concat_ws(":", p["operation"], p["scope"])))
    return found.select("actor_id", F.array_join(texts, ",").alias("permissions"))


@query("SELECT p_brand AS operation, string_agg(r, ',' ORDER BY r) AS roles FROM (SELECT DISTINCT p_brand, p_partkey % 25 AS r FROM part) GROUP BY p_brand")
def operation_roles(spark, sf_dir):
    found = authz.operation_roles(roles(spark, sf_dir)[1])
    return found.select("operation", F.array_join(F.col("roles").cast("array<string>"), ",").alias("roles"))


@query("""SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS n FROM nation""")
def concatenated_lists(spark, sf_dir):
    """Two collected lists, one after the other; a missing one counts as empty."""
    m = M.Match(warehouse_graph(spark, sf_dir)).node("n", "nation")
    m = m.fold("n", "inNation", "in", where=lambda c: c.c_acctbal < 0, customers=lambda c: F.collect_list("x__c_name"))
    m = m.fold("n", "locatedIn", "in", where=lambda s: s.s_acctbal < 0, suppliers=lambda s: F.collect_list("x__s_name"))
    return m.select(nation="n.n_name", n=lambda r: F.size(V.joined(r.df.customers, r.df.suppliers)).cast("long"))


@query("""SELECT 'vtx.nation.' || n_nationkey AS key, 'nation' AS label FROM nation UNION ALL SELECT 'vtx.region.' || r_regionkey, 'region' FROM region
UNION ALL SELECT 'vtx.supplier.' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'vtx.customer.' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'vtx.part.' || p_partkey, 'part' FROM part
UNION ALL SELECT 'vtx.order.' || o_orderkey, 'order' FROM orders UNION ALL SELECT 'vtx.event.' || event_id, 'event' FROM events UNION ALL SELECT 'vtx.document.' || doc_id, 'document' FROM documents
UNION ALL SELECT 'vtx.label.' || doc_id, 'label' FROM labels UNION ALL SELECT DISTINCT 'vtx.user.' || user_id, 'user' FROM events""")
def scan_all(spark, sf_dir):
    """Every vertex of every type."""
    return M.scan_all(warehouse_graph(spark, sf_dir))


@query("""SELECT 'vtx.nation.' || n_nationkey AS nation, 'customer' AS label, 'vtx.customer.' || c_custkey AS other FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'vtx.nation.' || n_nationkey, 'supplier', 'vtx.supplier.' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'vtx.nation.' || n_nationkey, 'region', 'vtx.region.' || r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey""")
def untyped_hop(spark, sf_dir):
    """A hop over any link, to ends of any type."""
    m = M.Match(warehouse_graph(spark, sf_dir)).node("n", "nation").hop_any("n", "x", ["inNation", "locatedIn", "inRegion"])
    return m.select(nation="n.key", label="x.label", other="x.key")


@query("""SELECT c_custkey AS customer, CASE WHEN o_orderkey IS NOT NULL THEN 'placedBy' END AS kind, 'lnk.order.' || o_orderkey || '.placedBy.customer.' || c_custkey AS key
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey""")
def relationship_identity(spark, sf_dir):
    """type(r) and r.key of an optional relationship; null where it is not there."""
    m = M.Match(warehouse_graph(spark, sf_dir)).node("c", "customer").hop("c", "placedBy", "o", "in", optional=True, where=lambda o: o.o_orderstatus == "P", link="r")
    return m.select(customer="c.id", kind=lambda x: x.link_type("r"), key=lambda x: x.link_key("r"))


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
def bound_head(spark, sf_dir):
    """A pattern that begins with a bound variable filters by it."""
    m = M.Match(warehouse_graph(spark, sf_dir)).node("o", "order").hop("o", "placedBy", "c")
    return m.again("c", "customer", where=lambda c: c.c_acctbal < 0, c_mktsegment="BUILDING").select(id="o.id")


@query("SELECT o_orderkey AS id, count(DISTINCT l_partkey) AS bulky FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY o_orderkey")
def link_condition(spark, sf_dir):
    """A branch's aggregate with a condition on the relationship itself."""
    m = M.Match(warehouse_graph(spark, sf_dir)).node("o", "order")
    m = m.fold("o", "contains", link_where=lambda r: r.link.l_quantity > 45, bulky=lambda p: F.count("*"))
    return m.select(id="o.id", bulky=lambda r: F.coalesce(r.df.bulky, F.lit(0)))


@query("""SELECT 'n' || n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN 'r' || n_regionkey END AS type_id FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey < 2 THEN 'r' || r_regionkey END FROM region
UNION ALL SELECT 's' || s_suppkey, CASE WHEN n_regionkey < 2 THEN 'r' || n_regionkey END FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def class_authority_walk(spark, sf_dir):
    """Suppliers are instances of nations, these of regions; two regions are declared types."""
    t = lambda name: table(spark, sf_dir, name)
    named = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    rows = t("region").select(named("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("instance_of"), (F.col("r_regionkey") < 2).alias("declared"))
    rows = rows.unionByName(t("nation").select(named("n", "n_nationkey").alias("id"), named("r", "n_regionkey").alias("instance_of"), F.lit(False).alias("declared")))
    rows = rows.unionByName(t("supplier").select(named("s", "s_suppkey").alias("id"), named("n", "s_nationkey").alias("instance_of"), F.lit(None).cast("boolean").alias("declared")))
    return class_authority(rows)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey || '-0' END AS event_id, 'orders' AS domain, 'orders.' || o_orderstatus AS event_type, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'vtx.customer.' || o_custkey END AS target_key FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, NULL, NULL, 'P', NULL FROM orders WHERE o_orderstatus = 'P'""")
def mutation_events(spark, sf_dir):
    """Events of operations; a class without a domain is a problem, not an event."""
    o = table(spark, sf_dir, "orders")
    cls = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("orders."), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    data = F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("targetKey"), F.lit("urgent"))).otherwise(F.create_map(F.lit("n"), F.lit("1")))
    specs = o.select(F.col("o_orderkey").alias("request_id"), F.lit(0).alias("position"), cls.alias("event_class"), data.alias("data"))
    batch = o.select(F.col("o_orderkey").alias("request_id"), F.lit(0).alias("position"), vertex_key("customer", "o_custkey").alias("key"))
    found = mutations.events_of(specs, batch, "now")
    good = F.col("problem").isNull()
    return found.select(F.col("request_id").alias("id"), *[F.when(good, F.col(c)).alias(c) for c in ("event_id", "domain", "target_key")], "event_type")


@query("""SELECT user_id AS token, CASE WHEN user_id % 2 = 0 THEN 'i' || user_id END AS instance_id, min(event_id) AS seq, arg_min(event_type, event_id) AS outcome FROM events GROUP BY user_id""")
def completion_correlation(spark, sf_dir):
    """The first completion of each token, with the instance that waits for it, if one does."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("token"), F.col("event_id").alias("seq"), F.col("event_type").alias("outcome"))
    waiting = e.select("token").distinct().where("token % 2 = 0").select("token", F.concat(F.lit("i"), F.col("token").cast("string")).alias("instance_id"))
    return convergence.correlate(e, waiting)


@query("""SELECT c_custkey AS id, c_acctbal AS amount, 'remind' AS operation, 'vtx.customer.' || c_custkey || '.contact' AS read_key, CASE WHEN c_custkey % 9 = 0 THEN 'nation' END AS data_error FROM customer""")
def row_templates(spark, sf_dir):
    """An action's parameters taken from target rows; a required one that is null is an error of the row."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", vertex_key("customer", "c_custkey").alias("entityKey"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")).alias("n"))
    return convergence.fill_template(c, {"amount": "row.c_acctbal", "operation": "remind", "read_key": "row.entityKey.contact", "nation": "row.n"}, ["amount", "nation"]).select("id", "amount", "operation", "read_key", "data_error")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5")
def seeded_keys(spark, sf_dir):
    """An evaluation for some anchors only."""
    seeds = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    return M.Match(warehouse_graph(spark, sf_dir)).node("c", "customer").keys("c", seeds).select(id="c.id")


@query("SELECT c_custkey AS id, c_custkey % 4 = 0 OR c_acctbal < 0 AS is_deleted, CASE WHEN c_acctbal < 0 THEN 'before' WHEN c_custkey % 4 = 0 THEN 'now' END AS deleted_at FROM customer")
def soft_delete(spark, sf_dir):
    """Rows are flagged, once: what is deleted already keeps its time."""
    c = table(spark, sf_dir, "customer")
    view = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("is_deleted"), F.when(F.col("c_acctbal") < 0, "before").alias("deleted_at"))
    return views.soft_delete(view, c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id")), ["id"], "now")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0")
def hard_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return views.hard_delete(c, c.where("id % 4 = 0"), ["id"])


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, event_type AS action FROM r WHERE n <= 3 GROUP BY ALL HAVING count(*) >= 3 AND count(CASE WHEN value > 80 THEN 1 END) = 0""")
def never_closes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return convergence.never_closes(e.select("user_id", F.col("event_type").alias("action"), F.col("event_id").alias("at"), F.coalesce(F.col("value") > 80, F.lit(False)).alias("closed")), 3, ["user_id"])


@query("""SELECT c_custkey AS entity_key, gap, CASE WHEN gap = 'funds' THEN 'call' END AS action FROM (SELECT c_custkey, unnest(['funds', 'survey']) AS gap FROM customer)
WHERE gap = 'survey' OR c_custkey % 4 < 2""")
def retry_budget(spark, sf_dir):
    """Gaps with their playbook's action; two tries are allowed for funds, any number for surveys."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_key"))
    playbook = spark.createDataFrame([("funds", "call", 2)], "gap string, action string, max_retries int")
    found = convergence.actions(c.select("entity_key", F.explode(F.array(F.lit("funds"), F.lit("survey"))).alias("gap")), playbook)
    spent = c.select("entity_key", F.lit("funds").alias("gap"), F.explode(F.sequence(F.lit(1), (F.col("entity_key") % 4).cast("int"))).alias("n")).where("n <= entity_key % 4 AND n > 0")
    return convergence.retry_budget(found, spent).select("entity_key", "gap", "action")


@query("SELECT s_suppkey AS pool, least(10.0, s_suppkey % 8 + 3.0) AS tokens FROM supplier")
def token_refill(spark, sf_dir):
    """Token buckets three seconds later."""
    level = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pool"), (F.col("s_suppkey") % 8).cast("double").alias("tokens"), F.lit(100.0).alias("at"))
    return convergence.refill(level, 103.0, 1.0, 10.0).select("pool", "tokens")


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AND c_acctbal > 0 AS both, c_custkey % 2 = 0 OR c_mktsegment = 'BUILDING' AS either FROM customer")
def truth_of_lists(spark, sf_dir):
    """AND and OR over truthiness; null is false."""
    c = table(spark, sf_dir, "customer")
    even = F.when(F.col("c_custkey") % 2 == 0, F.lit(True))
    return c.select(F.col("c_custkey").alias("id"), V.both(even, F.col("c_acctbal") > 0).alias("both"), V.either(even, F.col("c_mktsegment") == "BUILDING").alias("either"))


@query("""SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS last_type, upper(arg_max(event_type, event_id)) AS status,
arg_max(json_extract_string(props, '$.k'), event_id) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS k,
CASE WHEN max(CASE WHEN event_type = 'purchase' THEN event_id END) > coalesce(max(CASE WHEN event_type = 'error' THEN event_id END), -1) THEN 'yes' END AS buyer,
max(event_id) + 1 AS projection_seq FROM events GROUP BY user_id""")
def history_merge(spark, sf_dir):
    """History rows of an earlier part of the stream, taken further by all of it: what was folded isn't folded again."""
    e = history_events(spark, sf_dir)
    early = e.where("seq % 7 < 5").groupBy("target_key").agg(F.max("seq").alias("upto"))
    stored = history.fold(e.join(early, "target_key").where(F.col("seq") <= F.col("upto") / 2).select(*e.columns), FLOW)
    return history.fold_into(stored, e, FLOW)


@query("SELECT c_name AS name FROM customer WHERE c_name LIKE 'Customer#0000001%' AND c_name > 'Customer#000000104' ORDER BY c_name LIMIT 5")
def prefix_page(spark, sf_dir):
    """A page of five keys with a prefix, after a cursor (the limit is the feature)."""
    return views.page(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "name", "Customer#000000104", 5, "Customer#0000001")


@query("SELECT o_custkey AS id, c_name AS name FROM (SELECT DISTINCT o_custkey + 100 AS o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey")
def multi_get(spark, sf_dir):
    """Many keys at once; those that aren't there have a null row."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return views.at_keys(c, "id", table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("id"))).select("id", "row.name")


@query("""SELECT 'overdrawn.' || c_custkey AS key, 'vtx.customer.' || c_custkey AS entity_key, c_acctbal < 0 AS violating FROM customer""")
def target_contract(spark, sf_dir):
    """Target rows after the check of their contract, keyed by target and entity."""
    return convergence.target_rows(targets(spark, sf_dir), "overdrawn").select("key", "entity_key", "violating")


@query("""SELECT 'rich' AS lens, c_custkey AS id, 0 AS claims FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'building', c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'both', c_custkey, 2 FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'""")
def shared_target(spark, sf_dir):
    """Two views that write to one target, and the keys that both claim."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    rows, claims = views.union_views({"rich": c.where("balance > 5000").select("id", "balance"), "building": c.where("segment = 'BUILDING'").select("id", "segment")}, ["id"])
    return rows.select("lens", "id", F.lit(0).cast("long").alias("claims")).unionByName(claims.select(F.lit("both").alias("lens"), "id", "claims"))


@query("SELECT n_name AS nation, 0 AS n, 0 AS entries FROM nation")
def zero_argument_aggregates(spark, sf_dir):
    """count() and collect() without an argument fold nothing."""
    m = M.Match(warehouse_graph(spark, sf_dir)).node("n", "nation")
    found = M.group(m.select(nation="n.n_name"), ["nation"], n=M.nothing("count"), e=M.nothing("collect"))
    return found.select("nation", "n", F.size("e").alias("entries"))
