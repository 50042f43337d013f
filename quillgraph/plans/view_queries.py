"""Views, histories, authorization, convergence and the write path over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.guards import compile_guard
from ..operators import authz, convergence, history, mutations, views
from .define import query


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_changes(spark, sf_dir):
    """Orders as a change log of customers' last states: the order number is the sequence, 'P' a tombstone."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("projection_seq"), (F.col("o_orderstatus") == "P").alias("is_deleted"))


@query("""SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS projection_seq, arg_max(o_orderstatus, o_orderkey) = 'P' AS is_deleted FROM orders GROUP BY o_custkey""")
def latest_per_key(spark, sf_dir):
    return views.latest(order_changes(spark, sf_dir), ["id"])


@query("""SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS projection_seq, arg_max(o_orderstatus, o_orderkey) = 'P' AS is_deleted FROM orders GROUP BY o_custkey""")
def guarded_upsert(spark, sf_dir):
    """Two halves of the log merged in the wrong order: the guard keeps what is newer."""
    log = order_changes(spark, sf_dir)
    stored = views.latest(log.where("projection_seq % 2 = 1"), ["id"])
    return views.guarded_merge(stored, log.where("projection_seq % 2 = 0 OR projection_seq <= 0"), ["id"])


@query("SELECT id FROM (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey) WHERE s <> 'P'")
def tombstone_filter(spark, sf_dir):
    return views.live(views.latest(order_changes(spark, sf_dir), ["id"])).select("id")


@query("""SELECT DISTINCT o_custkey AS customer, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 <> 0
EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0""")
def diff_retraction(spark, sf_dir):
    """Composite keys that a view holds and a fresh evaluation doesn't give."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    stored = o.where("o_orderkey % 3 <> 0").select("customer", "priority").distinct().withColumn("is_deleted", F.lit(False))
    return views.retractions(stored, o.where("o_orderkey % 2 = 0").select("customer", "priority"), ["customer", "priority"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 10 = 0")
def no_op_suppression(spark, sf_dir):
    """Only rows that change are written: every tenth balance did."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    changed = c.withColumn("balance", F.when(F.col("id") % 10 == 0, F.col("balance") + 1).otherwise(F.col("balance")))
    return views.changed_only(c, changed, ["id"], ["name", "balance"]).select("id", "name")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'revoked' WHEN c_custkey % 2 <> 0 AND c_custkey % 3 = 0 THEN 'granted' ELSE 'none' END AS transition
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def transition_classify(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return views.transitions(c.where("id % 2 = 0").withColumn("is_deleted", F.lit(False)), c.where("id % 3 = 0").withColumn("is_deleted", F.lit(False)), ["id"])


@query("SELECT o_custkey AS id, count(*) AS claims FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) > 1")
def output_collisions(spark, sf_dir):
    return views.collisions(order_changes(spark, sf_dir), ["id"])


@query("SELECT n_name AS actor, string_agg(c_custkey, ',' ORDER BY c_custkey) AS keys FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def key_set_frame(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return views.key_sets(c.select(F.col("n_name").alias("actor"), "c_custkey"), "actor", "c_custkey").select("actor", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'whole' END AS note FROM customer")
def branch_merge(spark, sf_dir):
    """Two walks with one output shape; owned columns come from the smaller encoding."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    one = c.withColumn("note", F.lit("whole"))
    return views.merge_branches([one, c.where("id % 2 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit("even").alias("note")).join(c.select("id", F.col("name").alias("n")), "id").select("id", F.col("n").alias("name"), "note")], ["id"], ["name"], ["note"])


@query("""SELECT n_nationkey AS id, count(c_custkey) AS n, CASE WHEN count(c_custkey) > 0 THEN 'upsert' ELSE 'delete' END AS op FROM nation
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def realness_filter(spark, sf_dir):
    """List entries that are not real are dropped; what an empty list means follows."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.struct(F.when(F.col("c_acctbal") > 9000, F.col("c_name")).alias("name"), F.col("c_custkey").alias("k")).alias("e"))
    lists = c.groupBy("c_nationkey").agg(F.collect_list("e").alias("entries"))
    n = table(spark, sf_dir, "nation").join(lists, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    size = F.size(views.keep_real(F.coalesce("entries", F.array().cast("array<struct<name:string,k:bigint>>")), "name"))
    return n.select(F.col("n_nationkey").alias("id"), size.cast("long").alias("n"), views.empty_behaviour(size, "delete").alias("op"))


@query("""SELECT 'n' || c_nationkey || '.' || c_mktsegment AS key, max(c_custkey) AS last FROM customer GROUP BY c_nationkey, c_mktsegment""")
def entry_explode(spark, sf_dir):
    """One row an entry; of equal entry ids the last one wins."""
    c = table(spark, sf_dir, "customer")
    lists = c.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("base")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("entries"))
    return views.explode_entries(lists, "base", "entries", "c_mktsegment").select("key", F.col("entry.c_custkey").alias("last"))


@query("SELECT o_orderkey AS id, 'vtx.customer.' || o_custkey AS source FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'vtx.order.' || o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def provenance_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("vtx.order."), F.col("o_orderkey").cast("string")).alias("a"), F.concat(F.lit("vtx.customer."), F.col("o_custkey").cast("string")).alias("b"), F.lit("plain").alias("c"))
    return views.provenance(rows, "id", ["a", "b", "c"])


@query("SELECT c_name AS name FROM customer WHERE c_name > 'Customer#000000100' ORDER BY c_name LIMIT 20")
def keyset_page(spark, sf_dir):
    """A page of twenty in key order after a cursor (the limit is the feature)."""
    return views.page(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "name", "Customer#000000100", 20)


FLOW = history.HistoryDefinition(
    "targetKey",
    (
        history.ColumnRule("last_type", path="eventType"),
        history.ColumnRule("status", path="eventType", mapping=tuple((t, t.upper()) for t in ("view", "signup", "purchase", "error", "click"))),
        history.ColumnRule("k", path="payload.k"),
        history.ColumnRule("buyer", when=("purchase",), value="yes", clear_on=("error",)),
    ),
)


def history_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string"), F.col("event_id").cast("string").alias("request_id"), "event_type", F.lit("shop").alias("domain"),
        F.col("user_id").cast("string").alias("target_key"), F.from_json("props", "map<string,string>").alias("payload"), F.col("ts").cast("string").alias("timestamp"), (F.col("event_id") + 1).alias("seq"),
    )


@query("""SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS last_type, upper(arg_max(event_type, event_id)) AS status,
arg_max(json_extract_string(props, '$.k'), event_id) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS k,
CASE WHEN max(CASE WHEN event_type = 'purchase' THEN event_id END) > coalesce(max(CASE WHEN event_type = 'error' THEN event_id END), -1) THEN 'yes' END AS buyer,
max(event_id) + 1 AS projection_seq FROM events GROUP BY user_id""")
def event_fold_history(spark, sf_dir):
    """A user's history row: last type, mapped status, carried payload field, and a flag that errors clear."""
    return history.fold(history_events(spark, sf_dir), FLOW)


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, 'unknown value for status' AS reason FROM events WHERE event_type = 'click'")
def event_fold_rejects(spark, sf_dir):
    """Events with a value that a mapping doesn't know are set aside with the reason."""
    narrow = history.HistoryDefinition("targetKey", (history.ColumnRule("status", path="eventType", mapping=tuple((t, t) for t in ("view", "signup", "purchase", "error"))),))
    return history.rejected(history_events(spark, sf_dir), narrow).select("event_id", "reason")


def grants(spark, sf_dir):
    """Suppliers hold grants for their nation, but every seventh is revoked; supplier 1 reads everything."""
    s = table(spark, sf_dir, "supplier")
    own = s.select(F.col("s_suppkey").cast("string").alias("actor_id"), F.col("s_nationkey").cast("string").alias("anchor_id"), (F.col("s_suppkey") % 7 == 0).alias("is_deleted"))
    return own.unionByName(s.where("s_suppkey = 1").select(F.lit("1").alias("actor_id"), F.lit(authz.WILDCARD).alias("anchor_id"), F.lit(False).alias("is_deleted")))


def protected(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.array(F.col("c_nationkey").cast("string"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("authz_anchors"))


@query("""SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS actor_id, CAST(c_custkey AS VARCHAR) AS c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey OR s_nationkey = (c_nationkey + 1) % 25
WHERE s_suppkey % 7 <> 0 AND s_suppkey <> 1 UNION ALL SELECT '1', '*'""")
def rls_visible(spark, sf_dir):
    """What live grants let each actor read: pairs, and one row for the holder of the wildcard."""
    return authz.visible(protected(spark, sf_dir), grants(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey FROM customer JOIN supplier ON s_suppkey = 3 WHERE s_nationkey = c_nationkey OR s_nationkey = (c_nationkey + 1) % 25")
def rls_one_actor(spark, sf_dir):
    return authz.visible_to(protected(spark, sf_dir), grants(spark, sf_dir), "3").select("c_custkey")


@query("SELECT c_custkey FROM customer")
def wildcard_grant(spark, sf_dir):
    return authz.visible_to(protected(spark, sf_dir), grants(spark, sf_dir), "1").select("c_custkey")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'no capabilities' WHEN o_orderstatus = 'P' THEN 'no permission' WHEN o_custkey % 5 = 1 AND o_orderpriority <> '1-URGENT' THEN 'out of scope'
WHEN o_custkey % 5 = 2 THEN 'expired' ELSE 'allowed' END AS reason FROM orders""")
def authorize_operations(spark, sf_dir):
    """Orders as operations: their status is the operation, the priority its scope."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("actor_id"), F.col("o_orderstatus").alias("operation"), F.col("o_orderpriority").alias("scope"))
    actors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("actor_id")).where("actor_id % 5 <> 0")
    scope = F.when(F.col("actor_id") % 5 == 1, F.lit("1-URGENT")).otherwise(F.lit(authz.WILDCARD))
    until = F.when(F.col("actor_id") % 5 == 2, F.lit("2024-01-01T00:00:00Z"))
    permissions = actors.select("actor_id", F.explode(F.array(F.lit("O"), F.lit("F"))).alias("operation"), scope.alias("scope"), until.alias("expires_at"))
    return authz.authorize(o, permissions, "2024-06-01T00:00:00Z").select("id", "reason")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name FROM customer")
def secure_column(spark, sf_dir):
    """Encrypted names, read with their owners' keys; shredded keys give null."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("name"))
    key = F.lpad(F.hex(F.col("owner_id")), 32, "0")
    sealed = c.withColumn("name", authz.encrypt(F.col("name"), key))
    return authz.secure(sealed, c.where("id % 4 <> 0").select("owner_id", key.alias("key_hex")), "name").select("id", "name")


def targets(spark, sf_dir):
    """Customers as convergence targets: overdrawn ones violate, with gaps by segment and balance."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("vtx.customer."), F.col("c_custkey").cast("string")).alias("entity_key"), (F.col("c_acctbal") < 0).alias("violating"),
        (F.col("c_acctbal") < -500).alias("missing_funds"), (F.col("c_mktsegment") == "BUILDING").alias("missing_survey"),
        F.when(F.col("c_custkey") % 3 != 0, F.format_string("2024-%02d-01T00:00:00Z", (F.col("c_custkey") % 12 + 1).cast("int"))).alias("fresh_until"),
    )


@query("""SELECT 'vtx.customer.' || c_custkey AS entity_key, 'funds' AS gap FROM customer WHERE c_acctbal < -500
UNION ALL SELECT 'vtx.customer.' || c_custkey, 'survey' FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'""")
def gap_extraction(spark, sf_dir):
    return convergence.gaps(targets(spark, sf_dir))


@query("SELECT 'vtx.customer.' || c_custkey AS entity_key FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 12 + 1 <= 6")
def freshness_expired(spark, sf_dir):
    return convergence.expired(targets(spark, sf_dir), "2024-06-01T00:00:00Z").select("entity_key")


@query("""WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events),
g AS (SELECT user_id, event_type, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS close_rate, count(*) AS attempts FROM r WHERE n <= 10 GROUP BY ALL)
SELECT user_id, event_type AS action, close_rate, attempts, row_number() OVER (PARTITION BY user_id ORDER BY close_rate DESC, event_type) AS rank FROM g""")
def close_rate_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return convergence.rank_actions(e.select("user_id", F.col("event_type").alias("action"), F.col("event_id").alias("at"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("closed")), 10, ["user_id"])


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM d),
s AS (SELECT user_id, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS step FROM l WHERE k <= 5)
SELECT user_id, CASE WHEN max(step) <= 0 AND min(step) < 0 THEN 'shrinking' WHEN min(step) >= 0 AND max(step) > 0 THEN 'diverging' ELSE 'steady' END AS trend FROM s GROUP BY user_id""")
def trajectory(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return convergence.trajectory(e, "user_id", "day", "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, false AS hit, [event_type] AS ring FROM e WHERE n = 1
UNION ALL SELECT user_id, n, event_id, alt, CASE WHEN alt THEN [] WHEN len(x) > 8 THEN x[2:] ELSE x END FROM (SELECT *, len(x) >= 4 AND x[-1] = x[-3] AND x[-2] = x[-4] AND x[-1] <> x[-2] AS alt
FROM (SELECT e.user_id, e.n, e.event_id, list_append(r.ring, e.event_type) AS x FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT user_id, event_id FROM r WHERE hit""")
def oscillation(spark, sf_dir):
    """Users whose event types alternate, four in a row; a hit starts anew. The SQL goes through a ring of eight."""
    return convergence.oscillations(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""SELECT request_id FROM (SELECT event_id AS request_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id % 3 DESC, ts, event_id) AS p FROM events) WHERE p <= 12""")
def admission_topn(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pool"), (F.col("user_id") % 3).alias("priority"), F.col("ts").alias("since"), F.col("event_id").alias("request_id"))
    pools = e.select("pool").distinct().withColumn("tokens", F.lit(12.7))
    return convergence.admit(e, pools).select("request_id")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events WHERE value IS NOT NULL),
k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS p, count(*) OVER (PARTITION BY event_type) AS c FROM r WHERE n <= 128)
SELECT event_type, max(CASE WHEN p = ceil(c * 0.95) THEN value END) AS p95, max(CASE WHEN p = ceil(c * 0.99) THEN value END) AS p99 FROM k GROUP BY event_type""")
def percentile_nearest_rank(spark, sf_dir):
    """Nearest-rank percentiles of the last 128 values (the ring is the feature)."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return convergence.nearest_rank(e, ["event_type"], "value", {"p95": 0.95, "p99": 0.99}, ring=128, order="event_id").drop("mean")


@query("""SELECT c_custkey AS id, (c_acctbal IS NOT NULL AND c_mktsegment = 'BUILDING') OR NOT (trim(c_name) <> '') AS holds FROM customer""")
def guard_eval(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    guard = {"anyOf": [{"allOf": [{"present": "subject.data.c_acctbal"}, {"equals": {"path": "subject.data.c_mktsegment", "value": "BUILDING"}}]}, {"absent": "subject.data.c_name"}]}
    types = dict(c.dtypes)
    return c.select(F.col("c_custkey").alias("id"), compile_guard(guard, lambda a, f: c[f], lambda a, f: types[f]).alias("holds"))


@query("""WITH a AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e FROM events GROUP BY user_id)
SELECT user_id AS instance_id, CASE WHEN e = 1 THEN 'review' ELSE 'close' END AS step FROM a""")
def procedure_step(spark, sf_dir):
    """The next step of each user's procedure: a review where an error was seen, else straight on."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("instance_id")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("e"))
    steps = spark.createDataFrame([("case", 1, "open"), ("case", 2, "review"), ("case", 3, "close")], "pattern string, position int, step string")
    return convergence.next_step(e.select("instance_id", F.lit("case").alias("pattern"), F.lit(1).alias("cursor")), steps, e.select("instance_id", F.lit(2).alias("position"), (F.col("e") == 1).alias("holds"))).select("instance_id", "step")


def mutation_log(spark, sf_dir):
    """Orders as mutations of customers: 'F' updates, 'P' tombstones, 'O' creates another one under a new key."""
    o = table(spark, sf_dir, "orders")
    who = F.concat(F.lit("vtx.customer."), F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_custkey")).cast("string"))
    op = F.when(F.col("o_orderstatus") == "O", "create").when(F.col("o_orderstatus") == "F", "update").otherwise("tombstone")
    return o.select(F.col("o_orderkey").alias("batch_id"), who.alias("key"), op.alias("op"), F.lit("customer").alias("class"), F.col("o_orderpriority").alias("data"), F.when(F.col("o_orderkey") % 50 == 0, F.lit(2)).otherwise(F.lit(None)).cast("long").alias("expected_seq"))


def state(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("vtx.customer."), F.col("c_custkey").cast("string")).alias("key"), F.lit("customer").alias("class"), F.col("c_name").alias("data"), F.lit(False).alias("is_deleted"), F.lit(1).cast("long").alias("seq"))


@query("""SELECT o_orderkey AS batch_id, 'stale revision' AS violation FROM orders WHERE o_orderkey % 50 = 0""")
def mutation_violations(spark, sf_dir):
    return mutations.violations(mutation_log(spark, sf_dir), state(spark, sf_dir)).select("batch_id", "violation")


@query("""WITH m AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders WHERE o_orderstatus <> 'O'), g AS (SELECT * FROM m WHERE o_orderkey = f AND o_orderkey % 50 <> 0)
SELECT 'vtx.customer.' || c_custkey AS key, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE c_name END AS data, coalesce(o_orderstatus = 'P', false) AS is_deleted FROM customer LEFT JOIN g ON o_custkey = c_custkey
UNION ALL SELECT 'vtx.customer.' || (o_orderkey + 10000000), o_orderpriority, false FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 50 <> 0""")
def mutation_apply(spark, sf_dir):
    """The state after all sound batches; of batches that meet on a key only the first takes effect."""
    return mutations.apply_batches(mutation_log(spark, sf_dir), state(spark, sf_dir), 2).select("key", "data", "is_deleted")


@query("SELECT user_id AS request_id, min(event_id) AS seq FROM events GROUP BY user_id")
def request_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), "event_type")
    return mutations.dedupe_requests(e).select("request_id", "seq")
