import math
import random
from collections import Counter

import pytest

from quillgraph.llm import mixing


def edf(shares: dict, cycle: int) -> list:
    """Earliest deadline first, slot by slot."""
    order, done = sorted(shares, key=lambda s: (shares[s], s is not None, s)), Counter()
    picked = []
    for slot in range(cycle):
        ready = [(math.ceil((done[s] + 1) * cycle / shares[s]), k, s) for k, s in enumerate(order) if done[s] < shares[s] and done[s] * cycle // shares[s] <= slot]
        picked.append(min(ready)[2])
        done[picked[-1]] += 1
    return picked


def test_cycle_is_earliest_deadline_first(spark):
    shares = {"a": 37, "b": 1, "c": 22, None: 40}
    got = mixing.cycle_slots(spark.createDataFrame(list(shares.items()), "source string, share long"), 100).collect()
    assert [s for _, s in sorted((slot, r.source) for r in got for slot in r.slots)] == edf(shares, 100)


def test_rows_are_whole_and_deviation_stays_below_one_block(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot"] * 6 + ["x", "y", None]), f"t{k}", -1) for k in range(4000)] + [(None, "x", None, 0), (5, "hot", "again", 0), (5, "hot", "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot int")
    mixed = mixing.mix(docs, cycle=100, block_rows=4)
    got = mixed.collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter(r[:3] for r in rows)
    assert [c for c in mixed.columns if not c.startswith("mix_")] == ["doc_id", "source", "text"]
    sizes = Counter(r[1] for r in rows)
    weights = {r.source: r.share for r in mixing.shares(spark.createDataFrame(list(sizes.items()), "source string, n long"), cycle=100).collect()}
    assert sum(weights.values()) == 100
    blocks = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        blocks.setdefault((r.source, r.mix_block), set()).add(r.mix_slot)
    assert all(len(s) == 1 for s in blocks.values())
    slots = {min(s): source for (source, _), s in blocks.items()}
    assert len(slots) == len(blocks)
    ends = {s: max(k for k, v in slots.items() if v == s) for s in sizes}
    seen = Counter()
    for t in range(min(ends.values()) + 1):
        seen[slots[t]] += 1
        assert all(abs(seen[s] - (t + 1) * w / 100) < 1 for s, w in weights.items())
    places = sorted((r.source or "", r.mix_block, r.mix_offset) for r in got)
    assert len(set(places)) == len(places)


def test_parts_number_a_hot_source_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_RUN", 3)
    docs = spark.range(1000).selectExpr("if(id % 10 = 0, 'b', 'a') AS source", "if(id % 10 = 0, 100L, 900L) AS n", "if(id % 3 = 0, null, id) AS id", "xxhash64(id) AS mark")
    got = mixing.numbered(docs, part_rows=50).collect()
    for source, n in (("a", 900), ("b", 100)):
        assert sorted(r.place for r in got if r.source == source) == list(range(n))


def test_more_sources_than_a_cycle_has_slots(spark):
    """1,300 sources in groups of 20, these in groups again: every row has a place, and no source is over two or three blocks off."""
    rng = random.Random(4)
    rows = [(k, f"host{rng.randrange(1300)}" if k % 3 else "hot") for k in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), cycle=60, block_rows=2, group=20).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        slots.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
    assert all(len(s) == 1 for s in slots.values())
    assert len({(r.source, r.mix_block, r.mix_offset) for r in got}) == 9000
    weights = mixing.levels(spark.createDataFrame(list(Counter(s for _, s in rows).items()), "source string, n long"), 0.5, 60, 20).collect()
    assert abs(sum(math.prod(x / 60 for x in r.shares) for r in weights) - 1) < 1e-9 and {len(r.shares) for r in weights} == {3}


def test_columns_may_have_any_names(spark):
    names = ["source", "id", "place", "part", "n", "doc", "Row", "mark", "_source", "shares", "slots"]
    docs = spark.createDataFrame([(k, *[f"{c}{k % 3}" for c in names], {"a": k}) for k in range(50)], "doc_id long, " + ", ".join(f"{c} string" for c in names) + ", extra map<string,int>")
    mixed = mixing.mix(docs)
    assert mixed.columns[:13] == docs.columns
    assert sorted(str(tuple(r)[:13]) for r in mixed.collect()) == sorted(str(tuple(r)) for r in docs.collect())


def test_targets_and_order(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(200)], "doc_id long, source string")
    mixed = mixing.mix(docs, targets={"a": 3, "b": 1}, cycle=4, block_rows=5)
    first = [r.source for r in mixed.where("mix_slot < 8").orderBy("mix_slot", "mix_offset").collect()]
    assert Counter(first) == {"a": 30, "b": 10}
    assert mixing.in_order(mixed).columns == ["doc_id", "source"]
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"a": 3}, cycle=4)
    with pytest.raises(Exception, match="no target"):
        mixing.mix(docs, targets={"a": 4}, cycle=4).collect()


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0
