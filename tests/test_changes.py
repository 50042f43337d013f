"""Change dispatch, fan-out, verdicts and output shapes on small tables made by hand."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.guards import apply_effects
from quillgraph.functions.values import joined
from quillgraph.operators import authz, changes, convergence, match, mutations, output, views
from quillgraph.sources.graph import Graph, class_authority


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_kind_of_key_touches_its_vertices(spark):
    log = spark.createDataFrame(
        [("vtx.a.1", 1, True), ("vtx.a.2.name", 2, True), ("lnk.a.1.in.b.9", 3, None), ("odd", 4, False), (None, 5, False), ("vtx.b.9", 6, None)],
        "key string, seq long, is_deleted boolean",
    )
    got = rows(changes.touched(log))
    assert got == [(1, "vertex", "a", "1", True), (2, "aspect", "a", "2", False), (3, "link", "a", "1", False), (3, "link", "b", "9", False), (6, "vertex", "b", "9", False)]
    assert rows(changes.touched(log, ["b"]).select("seq")) == [(3,), (6,)]
    assert sorted(r.seq for r in changes.unknown_keys(log.where("key IS NOT NULL")).collect()) == [4]


@pytest.fixture()
def company(spark):
    """People 1 to 4 (2 reports to 1, 3 to 2), teams 10 and 11, a site 20 with both teams."""
    g = Graph(spark)
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "id long")
    link = lambda *x: spark.createDataFrame(list(x), "s long, d long")
    for label, df in (("person", ids(1, 2, 3, 4)), ("team", ids(10, 11)), ("site", ids(20))):
        g.add_vertices(label, df, "id")
    g.add_links("memberOf", link((3, 10), (4, 11)), ("person", "s"), ("team", "d"))
    g.add_links("at", link((10, 20), (11, 20)), ("team", "s"), ("site", "d"))
    g.add_links("reportsTo", link((2, 1), (3, 2)), ("person", "s"), ("person", "d"))
    return g


def test_fan_out_stops_at_actors_and_refuses_wide_sets(spark, company):
    changed = spark.createDataFrame([(1, "site", "20"), (2, "team", "10"), (3, "person", "4"), (4, "team", "77")], "seq long, label string, id string")
    names = ["memberOf", "at"]
    reached = lambda **k: rows(changes.affected_actors(company, changed, names, "person", **k))
    # The team's walk goes on over the site to the other team; person 4 is the start of its own walk.
    assert reached() == [(1, "3"), (1, "4"), (2, "3"), (2, "4"), (3, "3"), (3, "4")]
    assert reached(depth=1) == [(2, "3"), (3, "4")]
    # One hop up from found actors: 3 reports to 2 (and 2's own superior is not added).
    assert reached(reports_to="reportsTo", depth=1) == [(2, "2"), (2, "3"), (3, "4")]
    with pytest.raises(changes.ActorSetTooWide):
        reached(most=1)


def test_verdicts_compare_nulls_as_values(spark):
    schema = "id long, v string, src long"
    stored = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, None, 1), (4, "d", 1), (5, "e", None)], schema)
    fresh = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1), (5, "e", 2), (6, "f", 1)], schema)
    got = dict(rows(changes.verdicts(stored, fresh, ["id"], ["v"], ["src"])))
    assert got == {1: "converged", 2: "content", 3: "converged", 4: "stale", 5: "provenance", 6: "missing"}
    assert rows(changes.heal(stored, fresh, ["id"], ["v"], ["src"]).select("id")) == [(2,), (5,), (6,)]


def test_writes_that_only_move_a_null_are_changes(spark):
    schema = "id long, a string, b string"
    stored = spark.createDataFrame([(1, "x", None), (2, None, None), (None, "n", "n")], schema)
    new = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, None, None), (None, "n", "n")], schema)
    assert rows(views.changed_only(stored, new, ["id"], ["a", "b"]).select("id")) == [(1,), (3,)]


def test_transitions_know_what_is_unknown(spark):
    schema = "id long, is_deleted boolean"
    before = spark.createDataFrame([(1, False), (2, True), (3, None)], schema)
    after = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], schema)
    assert rows(views.transitions(before, after, ["id"])) == [(1, "revoked"), (2, "granted"), (3, "unknown"), (4, "granted")]


def test_wildcard_holders_are_not_left_out(spark):
    data = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, [])], "k long, authz_anchors array<string>")
    grants = spark.createDataFrame([("p", "a", False), ("q", "*", False), ("q", "a", False), ("r", "b", True)], "actor_id string, anchor_id string, is_deleted boolean")
    assert rows(authz.visible(data, grants, "k")) == [("p", "1"), ("q", "*")]
    assert rows(authz.visible_to(data, grants, "q").select("k")) == [(1,), (2,), (3,)]


def test_visible_pairs_are_made_last(spark, monkeypatch):
    monkeypatch.setattr(authz, "BLOCK", 2)
    data = spark.createDataFrame([(k, [["a", "b"], ["b", "a", "a"], ["c", None], []][k % 4]) for k in range(40)] + [(0, ["d"]), (None, ["a"])], "k long, authz_anchors array<string>")
    held = [("p", "a"), ("p", "b"), ("q", "b"), ("q", "b"), ("r", "c"), (None, "a"), ("s", "d"), ("t", None)]
    grants = spark.createDataFrame([(*h, False) for h in held], "actor_id string, anchor_id string, is_deleted boolean")
    found = authz.visible_by_anchor(data, grants, "k")
    shares = [k for k in range(40) if k % 4 < 2]
    want = [(a, k) for a in ("p", "q", None) for k in shares] + [("r", k) for k in range(2, 40, 4)] + [("p", None), (None, None), ("s", 0)]
    assert sorted(map(str, rows(found))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Repartition")]  # no pair is shuffled or made distinct
    assert "Generate" in above and "Join" not in above and "Aggregate" not in above


@pytest.mark.parametrize("strip", [1, 3, 64])
def test_a_task_holds_the_pairs_of_a_strip(spark, monkeypatch, strip):
    """What is made of two blocks is not compiled into one step, which would hold all of their pairs at once."""
    monkeypatch.setattr(authz, "STRIP", strip)
    data = spark.createDataFrame([(k, ["a"]) for k in range(50)], "k long, authz_anchors array<string>")
    grants = spark.createDataFrame([(f"p{k}", "a", False) for k in range(7)], "actor_id string, anchor_id string, is_deleted boolean")
    found = authz.visible_by_anchor(data, grants, "k")
    assert rows(found) == sorted(((f"p{a}", k) for a in range(7) for k in range(50)), key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    pairs, strips = plan.split("Repartition 4, false")[0], plan.split("Repartition 4, false")[1].split("Repartition 4, true")[0]
    assert pairs.count("inline") == 2 and "explode" in strips and "inline" not in strips


def test_copies_of_permissions_and_memberships_dont_multiply(spark):
    members = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("q", 3)], "actor_id string, role_id int").repartition(2)
    permissions = spark.createDataFrame([(1, "read", "a")] * 500 + [(2, "read", "a"), (2, "write", None)], "role_id int, operation string, scope string")
    found = authz.permission_union(members, permissions)
    assert rows(found.select("actor_id", F.to_json("permissions"))) == [("p", '[{"operation":"read","scope":"a"},{"operation":"write"}]'), ("q", "[]")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate") == 2  # both sides come distinct to the join


def test_admission_does_not_hang_on_the_parts(spark):
    requests = spark.createDataFrame([("p" if k % 3 else "q", k % 5, k % 7, k) for k in range(200)], "pool string, priority int, since int, request_id long")
    tokens = spark.createDataFrame([("p", 9.9), ("q", 0.5)], "pool string, tokens double")
    one = rows(convergence.admit(requests, tokens, parts=1))
    assert one == rows(convergence.admit(requests, tokens, parts=64)) and len(one) == 9


def test_keys_are_read_back_and_shapes_are_checked(spark):
    key = output.OutputKey("cap.{actorSuffix}.x", "user")
    df = spark.createDataFrame([("vtx.user.1",), ("vtx.team.1",), ("bad",), (None,)], "k string")
    built = df.select("k", key.build(F.col("k")).alias("o"))
    assert rows(built.where("o IS NOT NULL")) == [("vtx.user.1", "cap.user.1.x")]
    back = spark.createDataFrame([("cap.user.1.x",), ("cap.user.1.2.x",), ("cap.team.1.x",), ("cap.user.1",)], "o string")
    assert rows(back.select(key.anchor_of(F.col("o")))) == [("vtx.user.1",), (None,), (None,), (None,)]
    assert rows(back.select(output.OutputKey("cap.{actorSuffix}.x", "user").anchor_of(F.col("o"), per_entry=True)).where("1 = 1"))[0] == ("vtx.user.1",)
    for wrong in (lambda: output.OutputKey("none", "user"), lambda: output.check_key_columns(["a"], ["b"]), lambda: output.check_key_columns(["a", "a"]), lambda: output.deltas(df, df, ["k"], ["k"], sealed=["k"])):
        with pytest.raises(output.ShapeError):
            wrong()
    assert output.check_key_columns(["a", "b"]) == ["a"]


def test_empty_documents_follow_the_declared_behaviour(spark):
    data = spark.createDataFrame([("vtx.user.1", [("x",), (None,)]), ("vtx.user.2", [("",)]), ("vtx.team.3", [("x",)]), (None, [])], "actorKey string, items array<struct<name:string>>")
    key = output.OutputKey("u.{actorSuffix}", "user", bare=True)
    ops = lambda empty: rows(output.envelope(data, key, ["items"], "t", {"items": "name"}, empty).select("key", F.size("items"), "op"))
    assert ops("delete") == [("u.1", 1, "upsert"), ("u.2", 0, "delete")]
    assert ops("emptyDoc") == [("u.1", 1, "upsert"), ("u.2", 0, "upsert")]
    assert ops("skip") == [("u.1", 1, "upsert")]


def test_classes_are_found_within_four_steps(spark):
    schema = "id string, instance_of string, declared boolean"
    chain = [("t", None, True)] + [(f"v{k}", f"v{k - 1}" if k else "t", False) for k in range(6)] + [("x", "gone", None), ("loop", "loop", False)]
    got = dict(rows(class_authority(spark.createDataFrame(chain, schema))))
    assert got == {"t": "t", "v0": "t", "v1": "t", "v2": "t", "v3": "t", "v4": None, "v5": None, "x": None, "loop": None}


def test_effects_and_lists(spark):
    state = {"subject.data.a": True, "subject.data.b": 1}
    effects = [{"absent": "subject.data.a"}, {"allOf": [{"present": "subject.data.c"}, {"equals": {"path": "subject.data.b", "value": 2}}]}]
    assert apply_effects(state, effects) == {"subject.data.b": 2, "subject.data.c": True} and state["subject.data.b"] == 1
    for wrong in ({"not": {"absent": "subject.data.a"}}, {"present": "elsewhere"}):
        with pytest.raises(ValueError):
            apply_effects({}, [wrong])
    df = spark.createDataFrame([([1, 2], None), (None, None), ([1], [3])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(joined(F.col("a"), F.col("b"))).collect()] == [[1, 2], [], [1, 3]]


def test_templates_and_events(spark):
    data = spark.createDataFrame([(1, "vtx.a.1"), (None, None)], "n long, k string")
    got = rows(convergence.fill_template(data, {"x": "row.n", "r": "row.k.listing", "t": "text"}, ["x"]).select("x", "r", "t", "data_error"))
    assert got == [(1, "vtx.a.1.listing", "text", None), (None, None, "text", "x")]
    for wrong in ({"x": "row.none"}, {"x": ""}):
        with pytest.raises(ValueError):
            convergence.fill_template(data, wrong)
    specs = spark.createDataFrame([("r", 0, "shop.sold", {"a": "1"}), ("r", 1, ".x", None), ("r", 2, "shop.", None), ("r", 3, None, None)], "request_id string, position int, event_class string, data map<string,string>")
    batch = spark.createDataFrame([("r", 0, "vtx.a.1")], "request_id string, position int, key string")
    found = mutations.events_of(specs, batch, "now").orderBy("event_id").collect()
    assert [(r.target_key, r.problem is None) for r in found] == [("vtx.a.1", True), (None, False), (None, False), (None, False)]


def test_patterns_over_any_link(spark, company):
    m = match.Match(company).node("t", "team").hop_any("t", "x", ["memberOf", "at"], link="r")
    got = rows(m.select(t="t.id", x="x.key", r=lambda y: y.link_type("r"), k=lambda y: y.link_key("r")))
    assert got == [(10, "vtx.person.3", "memberOf", "lnk.person.3.memberOf.team.10"), (10, "vtx.site.20", "at", "lnk.team.10.at.site.20"), (11, "vtx.person.4", "memberOf", "lnk.person.4.memberOf.team.11"), (11, "vtx.site.20", "at", "lnk.team.11.at.site.20")]
    for wrong in (lambda: match.Match(company).node("s", "site").hop_any("s", "x", ["memberOf"]), lambda: m.link_type("x"), lambda: m.again("t", "site")):
        with pytest.raises(match.PatternError):
            wrong()
    assert len(rows(match.scan_all(company))) == 7


def test_target_rows_have_their_contract(spark):
    good = spark.createDataFrame([("vtx.a.1", True, None), ("odd", True, False)], "entity_key string, violating boolean, missing_x boolean")
    assert rows(convergence.target_rows(good, "t").select("key", "missing_x")) == [("t.1", None)]
    for wrong in (good.drop("violating"), good.drop("missing_x"), good.withColumn("missing_y", F.lit(1)), good.withColumn("fresh_until", F.lit(1))):
        with pytest.raises(convergence.ContractError):
            convergence.target_rows(wrong, "t")
    with pytest.raises(match.PatternError):
        match.nothing("max")
