import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import simhash


def brute(rows, max_bits=4):
    """Component of each (id, fp) by comparing everything with everything."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, fp in rows:
        if i is not None:
            low[find(fp)] = min(i, low.get(find(fp), i))
    return {(i, fp): low.get(find(fp)) for i, fp in rows}


def test_fingerprint_by_definition():
    words = "The Quick brown\tfox jumps  over the lazy dog".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.simhash("The Quick brown\tfox jumps  over the lazy dog") == want
    assert simhash.simhash("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.simhash(None) == simhash.simhash("") == simhash.simhash(" \n") == 0


def test_classes_match_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", "  ", texts[0], texts[0]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)] + [(None, texts[3], None, None)], "doc_id long, text string, fp string, component_id int")
    got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == brute([(i, simhash.simhash(t)) for i, t in zip(ids, texts)] + [(None, simhash.simhash(texts[3]))])


@pytest.mark.parametrize("block", [5, 2048])
def test_links_of_a_dense_group(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.connected_components(simhash.near_links(df)).collect()}
    want = brute([(k, f) for k, f in enumerate(signed_to_unsigned(signed))])
    mine = {}
    for k, f in enumerate(signed):
        mine.setdefault(roots.get(f, f), set()).add(k)
    theirs = {}
    for (k, _), low in want.items():
        theirs.setdefault(low, set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def signed_to_unsigned(values):
    return [v % (1 << 64) for v in values]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).select(F.count("*")).first()[0] == 0
