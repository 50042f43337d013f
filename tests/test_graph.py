"""Graph semantics on small graphs made by hand."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import values as V
from quillgraph.functions.guards import compile_guard
from quillgraph.operators import convergence, history, match, mutations, views
from quillgraph.sources.graph import TASKS_A_SPLIT, Graph


@pytest.fixture()
def graph(spark):
    g = Graph(spark)
    g.add_vertices("place", spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", False), (4, "gone", True), (5, "e", False)], "id long, name string, is_deleted boolean"), "id")
    rows = [(1, 2, "x", False), (1, 2, "y", False), (2, 3, "x", False), (3, 1, "x", False), (1, 1, "self", False), (2, 4, "x", False), (4, 5, "x", False), (3, 5, "x", True)]
    g.add_links("in", spark.createDataFrame(rows, "s long, d long, kind string, is_deleted boolean"), ("place", "s"), ("place", "d"), payload=("kind",))
    return g


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hops_collapse_parallel_links_and_skip_loops_and_the_deleted(graph):
    m = match.Match(graph).node("a", "place")
    assert pairs(m.hop("a", "in", "b").select(a="a.id", b="b.id")) == [(1, 2), (2, 3), (3, 1)]
    assert pairs(m.hop("a", "in", "b", link="r").select(a="a.id", b="b.id", k=lambda x: x.df["r__link.kind"])) == [(1, 2, "x"), (1, 2, "y"), (2, 3, "x"), (3, 1, "x")]
    assert pairs(m.hop("a", "in", "b", "both").where(lambda r: r["a.id"] == 1).select(b="b.id")) == [(2,), (3,)]


def test_folded_links_are_dealt_by_the_size_of_their_table(spark):
    links = spark.createDataFrame([(k % 6, k % 3) for k in range(60)] + [(1, None), (9, 1)], "a long, b long").repartition(5)
    g = Graph(spark).add_vertices("a", spark.range(6), "id").add_vertices("b", spark.range(4), "id").add_links("to", links, ("a", "a"), ("b", "b"))
    m = match.Match(g).node("b", "b").fold("b", "to", "in", n=lambda a: F.count("*"), distinct=lambda a: F.count_distinct("x__id"))
    assert pairs(m.df) == [(0, 2, 2), (1, 2, 2), (2, 2, 2), (3, None, None)]
    plan = m.df._jdf.queryExecution().optimizedPlan().toString()
    tasks = 5 * TASKS_A_SPLIT  # however many partitions shuffles have otherwise
    assert any("RepartitionByExpression" in line and line.endswith(f", {tasks}") for line in plan.split("\n"))


def test_optional_hops_keep_their_row(graph):
    m = match.Match(graph).node("a", "place")
    found = m.hop("a", "in", "b", optional=True, where=lambda b: b.name == "c").select(a="a.id", b="b.id", key="b.key")
    assert pairs(found) == [(1, None, None), (2, 3, "vtx.place.3"), (3, None, None), (5, None, None)]


def test_walks_stop_at_deleted_vertices_and_end_in_cycles(graph):
    m = match.Match(graph).node("a", "place", name="a")
    assert pairs(m.reach("a", "in", "b").select(b="b.id")) == [(1,), (2,), (3,)]
    assert pairs(m.reach("a", "in", "b", 2, 2).select(b="b.id")) == [(3,)]
    assert pairs(m.reach("a", "in", "b", 1).select(b="b.id")) == [(2,), (3,)]


def test_patterns_that_are_refused(graph):
    m = match.Match(graph).node("a", "place")
    for wrong in (
        lambda: m.node("a", "place"),
        lambda: m.node("b", "nothing"),
        lambda: m.hop("a", "nothing", "b"),
        lambda: m.select(),
        lambda: m["z.id"],
        lambda: m.reach("a", "in", "b", 0, 99),
        lambda: match.bounded_product(m.df, m.df, most=3),
    ):
        with pytest.raises(match.PatternError):
            wrong()
    graph.parents.update(place="thing", thing="place")
    with pytest.raises(ValueError):
        graph.closure("place")


def test_missing_properties_and_aspects(spark, graph):
    graph.add_aspect("place", "size", spark.createDataFrame([(1, 10)], "id long, value int"))
    m = match.Match(graph).node("a", "place", name="a").aspect("a", "size")
    assert pairs(m.select(v="a.size_value", n="a.nothing")) == [(10, None)]


@pytest.mark.parametrize("a, b, same, less", [(None, None, True, False), (None, 1, False, False), (1, 1, True, False), (1, 2, False, True)])
def test_null_truth_table(spark, a, b, same, less):
    row = spark.createDataFrame([(a, b)], "a int, b int")
    got = row.select(V.equal(F.col("a"), F.col("b"), "int", "int"), V.not_equal(F.col("a"), F.col("b"), "int", "int"), V.compare(F.col("a"), "<", F.col("b"), "int", "int")).first()
    assert tuple(got) == (same, not same, less)


def test_mixed_values(spark):
    row = spark.createDataFrame([(1, "1", 1.0, None, True, 0, "")], "i int, s string, d double, n boolean, t boolean, z int, e string")
    c = F.col
    got = row.select(
        V.equal(c("i"), c("s"), "int", "string"), V.equal(c("i"), c("d"), "int", "double"), V.equal(c("t"), F.lit("true"), "boolean", "string"),
        V.compare(c("i"), "<", c("s"), "int", "string"), V.truthy(c("z"), "int"), V.truthy(c("e"), "string"), V.truthy(c("n")), V.negate(c("n")),
        V.exactly_one(c("t"), c("n"), F.lit(True)), V.arithmetic(F.lit(-7), "%", F.lit(2)), V.arithmetic(F.lit(1), "/", F.lit(2)),
    ).first()
    assert tuple(got) == (True, True, True, False, True, True, False, True, False, -1.0, 0.5)
    for wrong in (V.arithmetic(c("i"), "/", c("z")), V.arithmetic(c("i"), "+", c("n")), V.id_from_key(c("s"))):
        with pytest.raises(Exception):
            row.select(wrong).collect()


def test_edit_ratio_counts_bytes_below(spark):
    got = spark.createDataFrame([("café", "cafe"), ("", ""), (None, "a")], "a string, b string").select(V.edit_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0.8, 1.0, None]


def test_guards(spark):
    row = spark.createDataFrame([(" ", 3, True, None)], "blank string, n int, t boolean, x string")
    types = dict(row.dtypes)
    holds = lambda g: row.select(compile_guard(g, lambda a, f: row[f], lambda a, f: types[f])).first()[0]
    assert holds({"absent": "subject.data.blank"}) and holds({"equals": {"path": "subject.data.n", "value": 3}}) and holds('{"not": {"present": "subject.data.x"}}')
    assert not holds({"equals": {"path": "subject.data.n", "value": "3"}}) and not holds({"equals": {"path": "subject.data.x", "value": "a"}})
    for wrong in ({}, {"absent": "x"}, {"allOf": []}, {"other": 1}, {"absent": "subject.data.n", "present": "subject.data.n"}):
        with pytest.raises(ValueError):
            holds(wrong)


def test_guarded_rows_ignore_what_is_late(spark):
    schema = "id long, v string, projection_seq long, is_deleted boolean"
    stored = spark.createDataFrame([(1, "old", 5, False), (2, "gone", 7, True)], schema)
    new = spark.createDataFrame([(1, "late", 4, False), (1, "same", 5, False), (2, "late", 6, False), (3, "new", 1, False), (4, "none", 0, False)], schema)
    assert pairs(views.guarded_merge(stored, new, ["id"])) == [(1, "old", 5, False), (2, "gone", 7, True), (3, "new", 1, False)]
    gone = views.soft_delete(stored, spark.createDataFrame([(1,), (9,)], "id long"), ["id"], "now")
    assert pairs(gone.select("id", "is_deleted", "deleted_at")) == [(1, True, "now"), (2, True, None)]


def test_history_keeps_unset_apart_from_null(spark):
    schema = "event_id string, request_id string, event_type string, domain string, target_key string, payload map<string,string>, timestamp string, seq long"
    event = lambda seq, kind, payload, key="k": (str(seq), str(seq), kind, "d", key, payload, "t", seq)
    rule = history.HistoryDefinition("targetKey", (history.ColumnRule("reason", path="payload.reason", clear_on=("restart",)), history.ColumnRule("state", path="eventType", mapping=(("start", "on"), ("stop", "off"), ("restart", "on")))))
    events = spark.createDataFrame([event(1, "start", {"reason": "first"}), event(2, "stop", {}), event(3, "stop", {"reason": None}, "l"), event(2, "start", {"reason": "x"}, "l"), event(1, "start", {"reason": "r"}, "m"), event(5, "restart", {"reason": "q"}, "m"), event(6, "odd", {}), event(7, "stop", {}, ""), event(0, "stop", {})], schema)
    assert pairs(history.fold(events, rule)) == [("k", "first", "off", 2), ("l", None, "off", 3), ("m", None, "on", 5)]
    assert sorted(r.reason for r in history.rejected(events, rule).collect()) == ["no key", "no sequence", "unknown value for state"]
    with pytest.raises(ValueError):
        history.HistoryDefinition("targetKey")


def test_oscillation_against_the_ring(spark):
    """A ring of the last eight values that a hit empties."""
    import random

    rng = random.Random(2)
    rows = [(p, k, rng.choice(["a", "b"] if p % 2 else ["a", "b", "c", None])) for p in range(8) for k in range(60)]
    rows += [(8, k, v) for k, v in enumerate("ABABCBCBCBAAABABABAB")] + [(9, k, "ab"[k % 2]) for k in range(50)]
    want = set()
    for p in range(10):
        ring = []
        for _, k, v in [r for r in rows if r[0] == p]:
            ring = [*ring, v][-8:]
            if len(ring) >= 4 and ring[-1] == ring[-3] and ring[-2] == ring[-4] and ring[-1] != ring[-2]:
                want.add((p, k))
                ring = []
    got = {tuple(r) for r in convergence.oscillations(spark.createDataFrame(rows, "p int, k int, v string"), "p", "k", "v").collect()}
    assert got == want


def test_batches_take_effect_as_a_whole(spark):
    state = spark.createDataFrame([("vtx.a.1", "A", "x", False, 1), ("vtx.a.2", "A", "y", True, 1)], "key string, class string, data string, is_deleted boolean, seq long")
    rows = [(1, "vtx.a.3", "create", "A", "n", None), (1, "vtx.a.1", "update", "A", "m", 1), (2, "vtx.a.4", "create", "A", "n", None), (2, "vtx.a.2", "create", "A", "n", None), (3, "bad", "create", "B", "n", None), (4, "vtx.a.2", "update", "A", "n", None)]
    log = spark.createDataFrame(rows, "batch_id long, key string, op string, class string, data string, expected_seq long")
    classes = spark.createDataFrame([("A", False)], "class string, abstract boolean")
    assert pairs(mutations.violations(log, state, classes)) == [(2, "vtx.a.2", "key exists"), (3, "bad", "malformed key"), (3, "bad", "unknown class"), (4, "vtx.a.2", "key is deleted")]
    assert pairs(mutations.apply_batches(log, state, 2, classes).select("key", "data", "is_deleted")) == [("vtx.a.1", "m", False), ("vtx.a.2", "y", True), ("vtx.a.3", "n", False)]
