"""Incremental views against rebuilds, and the stateful fold against the batch fold."""

from pyspark.sql import functions as F

from quillgraph.operators.views import live
from quillgraph.streaming.maintain import MaintainedView, SnapshotTable, change_stream, fold_stream

SCHEMA = "customer long, status string, n long, projection_seq long, is_deleted boolean"


def test_view_follows_its_changes(spark, tmp_path):
    orders = {"rows": []}
    state = lambda: spark.createDataFrame(orders["rows"] or [], "id long, customer long, status string")

    def evaluate(anchors):
        rows = state()
        rows = rows if anchors is None else rows.join(anchors, "customer", "left_semi")
        return rows.groupBy("customer", "status").agg(F.count("*").alias("n"))

    table = SnapshotTable(spark, f"file://{tmp_path}/view", SCHEMA, ["customer", "status"])
    view = MaintainedView(table, evaluate, lambda changes: changes.select(F.col("customer").alias("id")), "customer")
    steps = [
        ([(1, 1, "a"), (2, 1, "a"), (3, 2, "b")], [(1,), (2,)]),
        ([(1, 1, "a"), (2, 1, "c"), (3, 2, "b")], [(1,)]),
        ([(1, 1, "a"), (2, 1, "c")], [(2,)]),
        ([(1, 1, "a"), (2, 1, "c"), (4, 2, "b")], [(2,)]),
    ]
    for version, (rows, touched) in enumerate(steps):
        orders["rows"] = rows
        changes = spark.createDataFrame([(c, version + 1) for (c,) in touched], "customer long, seq long")
        view.apply(changes, version)
        view.apply(changes, version)  # a replayed batch changes nothing
        got = {tuple(r) for r in live(table.read()).select("customer", "status", "n").collect()}
        assert got == {tuple(r) for r in evaluate(None).collect()}
    assert table.version() == 3 and table.read(2).where("is_deleted").count() == 1
    view.rebuild(9, 4)
    assert live(table.read()).count() == 3


def test_a_merge_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    schema = "id long, v string, projection_seq long, is_deleted boolean"
    table = SnapshotTable(spark, f"file://{tmp_path}/t", schema, ["id"], buckets=4, keep=3)
    rows = lambda ids, v, seq: spark.createDataFrame([(k, v, seq, False) for k in ids], schema)
    table.merge(rows(range(40), "a", 1), 0)
    for version in range(1, 7):
        table.merge(rows([5], f"b{version}", version + 1), version)
        assert len([p for p in (tmp_path / "t" / f"v{version}").iterdir() if p.name.startswith("bucket=")]) == 1
        assert {(r.id, r.v) for r in table.read().collect()} == {(k, f"b{version}" if k == 5 else "a") for k in range(40)}
    assert {r.v for r in table.read(5).where("id = 5").collect()} == {"b5"}
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v")) == ["v0", "v4", "v5", "v6"]


def test_a_sink_probes_and_deletes(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/s", "id long, v string, projection_seq long, is_deleted boolean", ["id"], buckets=4)
    table.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, projection_seq long"), 0)
    table.delete(spark.createDataFrame([(2, 5)], "id long, projection_seq long"), 1)
    table.upsert(spark.createDataFrame([(2, "late", 3)], "id long, v string, projection_seq long"), 2)
    got = table.probe(spark.createDataFrame([(2,), (9,)], "id long")).collect()
    assert [(r.id, r.v, r.projection_seq, r.is_deleted) for r in got] == [(2, None, 5, True)]
    table.close()


def test_a_change_stream_is_filtered_by_type(spark, tmp_path):
    source = f"file://{tmp_path}/log"
    spark.createDataFrame([("vtx.a.1", "a", 1, False), ("vtx.b.1", "b", 2, False)], "key string, label string, seq long, is_deleted boolean").write.parquet(source)
    query = change_stream(spark, source, ["b"]).writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.key for r in spark.table("log").collect()] == ["vtx.b.1"]


def test_changes_arrive_as_a_stream(spark, tmp_path):
    source = f"file://{tmp_path}/changes"
    spark.createDataFrame([(1, 1), (2, 2)], "customer long, seq long").write.parquet(source)
    table = SnapshotTable(spark, f"file://{tmp_path}/view", "customer long, projection_seq long, is_deleted boolean", ["customer"])
    everyone = spark.range(1, 4).select(F.col("id").alias("customer"))
    view = MaintainedView(table, lambda a: everyone if a is None else everyone.join(a, "customer", "left_semi"), lambda c: c.select(F.col("customer").alias("id")), "customer")
    view.start(spark.readStream.schema("customer long, seq long").parquet(source), f"file://{tmp_path}/checkpoint").awaitTermination(120)
    assert {(r.customer, r.projection_seq) for r in table.read().collect()} == {(1, 2), (2, 2)}


def test_stateful_fold(spark, tmp_path):
    source = f"file://{tmp_path}/events"
    rows = [("k", "start", 1, {"a": "1", "b": "x"}), ("k", "stop", 2, {"a": None}), ("k", "late", 1, {"a": "9"}), ("m", "start", 1, {"b": "y"}), ("m", "restart", 3, {})]
    spark.createDataFrame(rows, "key string, event_type string, seq long, sets map<string,string>").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("key string, event_type string, seq long, sets map<string,string>").parquet(source)
    query = fold_stream(stream, {"b": ["restart"]}).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.key: (dict(r.columns), r.projection_seq) for r in spark.table("folded").collect()}
    assert got["m"] == ({}, 3) and got["k"][1] == 2 and got["k"][0]["b"] == "x"
