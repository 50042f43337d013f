import random

import pytest

from quillgraph.llm import licenses
from quillgraph.llm.registry import op10_license_scan


@pytest.fixture(scope="module")
def index():
    return licenses.Index(licenses.TEMPLATES)


def brute(text, least=0.8):
    """Templates of which some span of the allowed length contains enough distinct shingles."""
    words = licenses.words_of(text or "")
    found = set()
    for name, template in (licenses.TEMPLATES | licenses.SHORT_TEMPLATES).items():
        t = licenses.words_of(template)
        n = min(5, len(t))  # a template shorter than a shingle is one of its own length
        want = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        span = max(int(len(t) * licenses.STRETCH) + 1, len(t))
        for a in range(max(1, len(words) - span + 1)):
            part = words[a : a + span]
            if len({tuple(part[i : i + n]) for i in range(len(part) - n + 1)} & want) >= least * len(want):
                found.add(name)
                break
    return found


def noisy(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(["foo", "bar", "copy"])
    return " ".join(words)


def test_retrieval_against_brute_force(index):
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "license", "software", "of"]) for _ in range(n))
    texts = [f"{fill(rng.randrange(200))} {noisy(rng, t, rng.randrange(3))}\n{fill(rng.randrange(90))}" for t in licenses.TEMPLATES.values() for _ in range(12)]
    texts += [fill(500), "", None, "a b", licenses.TEMPLATES["MIT"], "İ" * 3 + " " + licenses.TEMPLATES["MIT-text"] * 2]
    got = licenses.scan_texts(texts, index)
    wanted = [brute(t) for t in texts]
    assert sum(map(len, wanted)) > 90
    missed = sum(len(w - {m[0] for m in g}) for w, g in zip(wanted, got))
    assert missed <= 0.01 * sum(map(len, wanted)) and all({m[0] for m in g} <= w for w, g in zip(wanted, got))
    for text, many in zip(texts, got):
        for name, share, start, stop in many:
            assert share >= 0.8 and brute(text[start:stop]) >= {name}
    assert len([m for m in got[-1] if m[0] == "MIT-text"]) == 2


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in op10_license_scan(spark, sf).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {k: v for k, t in texts.items() if (v := brute(t))}


def test_nulls_repeats_templates_and_empty_tables(spark):
    notice = "all rights to this text are reserved by nobody in particular"
    docs = spark.createDataFrame([(None, f"x {notice} y", 1), (1, None, 2), (2, notice, 3), (2, notice, 3)], "doc_id long, text string, license int")
    got = sorted((r.id or 0, r.license, r.containment, r.start, r.stop) for r in licenses.scan(docs, {"own": notice}).collect())
    assert got == [(0, "own", 1.0, 2, 2 + len(notice)), (2, "own", 1.0, 0, len(notice)), (2, "own", 1.0, 0, len(notice))]
    assert licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "too short"})


def test_short_texts_and_short_templates():
    notice = "This work is licensed under a Creative Commons Attribution 4.0 International License"
    index = licenses.Index({"by": notice, "arr": "All rights reserved", "long": " ".join(f"w{k}" for k in range(40))})
    texts = [
        notice.removeprefix("This "),  # 8 of the 9 shingles, and no window
        "This " + notice.removeprefix("This work is "),
        "Some text.\nALL RIGHTS RESERVED. all rights reserved",
        "all rights",
        "reserved all rights are reserved",
        "all rights reserved",
        " ".join(f"w{k}" for k in range(3, 36)),  # 29 of 36 shingles in 33 words
        " ".join(f"w{k}" for k in range(3, 35)),
    ]
    got = [[(name, start, stop) for name, _, start, stop in many] for many in licenses.scan_texts(texts, index)]
    assert got == [[("by", 0, len(texts[0]))], [], [("arr", 11, 30), ("arr", 32, 51)], [], [], [("arr", 0, 19)], [("long", 0, len(texts[6]))], []]


def test_query_finds_every_notice_planted_word_for_word(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id for r in rows if "all rights reserved" in " ".join(licenses.words_of(r.text or ""))}
    got = {r.doc_id for r in op10_license_scan(spark, sf).where("license = 'All-rights-reserved'").collect()}
    assert want and got == want
