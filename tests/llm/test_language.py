import random
import zlib
from itertools import product

import numpy as np
import pytest

from quillgraph.llm import language
from quillgraph.llm.registry import op5_crf_language_id


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    lens, k = np.array([1, 4, 3]), 3
    scores, moves = rng.normal(size=(3, 4, k)), rng.normal(size=(k, k))
    scores[np.arange(4) >= lens[:, None]] = 0
    posterior, pairs, logs = language.forward_backward(scores, lens, moves)
    want, want_pairs, total = np.zeros_like(posterior), np.zeros((k, k)), 0.0
    for c, n in enumerate(lens):
        paths = list(product(range(k), repeat=int(n)))
        weight = np.exp([sum(scores[c, t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        total += np.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            for t, y in enumerate(p):
                want[c, t, y] += w
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert np.allclose(posterior, want) and np.allclose(pairs, want_pairs) and np.isclose(logs, total)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    rows = []
    for lang, parts in (("aa", "kar lo mi tu".split()), ("bb", "sch en ung zu".split())):
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(150)]
        rows += [(" ".join(rng.choice(words) for _ in range(80)), lang) for _ in range(30)]
    return language.fit(rows), rows


def test_labels_switch_within_a_text(model):
    found, rows = model
    a, b = (next(t for t, lang in rows if lang == x).split()[:12] for x in ("aa", "bb"))
    posterior, text = language.Labeller(found).posteriors([" ".join(a + b + a), "-", "kar"])
    assert text.tolist() == [0] * 36 + [2]
    posterior = posterior[:36]
    assert [found.languages[k] for k in posterior.argmax(axis=1)] == ["aa"] * 12 + ["bb"] * 12 + ["aa"] * 12
    assert np.allclose(posterior.sum(axis=1), 1)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(5)
    chains = language.Chains([(["kar", "lo", "schung", "kar"], [0, 0, 1, 0]), (["x"], [2]), (["lo", "mi"], [2, 1])], {"kar".encode("utf-32-le"): 7})
    weights, moves = rng.normal(size=(language.WEIGHTS, 3)), rng.normal(size=(3, 3))
    value, weight, move = chains.gradient(range(3), weights, moves)
    assert value < 0
    for array, got in ((weights, weight), (moves, move)):
        places = np.argwhere(np.abs(got) > 1e-3)[:: max(1, len(np.argwhere(np.abs(got) > 1e-3)) // 12)]
        assert len(places) >= 9
        for i, k in places.tolist():
            array[i, k] += 1e-5
            up = chains.gradient(range(3), weights, moves)[0]
            array[i, k] -= 2e-5
            down = chains.gradient(range(3), weights, moves)[0]
            array[i, k] += 1e-5
            assert np.isclose((up - down) / 2e-5, got[i, k], rtol=1e-4, atol=1e-6)


def test_features_of_words_scored_together_are_those_of_each_alone(model):
    found, _ = model
    words = ["a", "kar", "lomitukar", "schungzu", "ß" * 70, "𝒜𝒷"]
    chars = lambda ws: np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32)
    key = lambda w: w.encode("utf-32-le")
    together = found.scores(chars(words), np.r_[0, np.cumsum([len(w) for w in words])], list(map(key, words)))
    for w, row in zip(words, together):
        assert np.allclose(found.scores(chars([w]), np.array([0, len(w)]), [key(w)])[0], row)
    # A run of letters is looked at whole: its middle counts.
    long = ["kar" * 20 + x + "kar" * 20 for x in ("", "schenung" * 9)]
    a, b = (found.scores(chars([w]), np.array([0, len(w)]), [key(w)])[0] for w in long)
    assert b[1] > a[1]


def test_many_labels_and_long_texts():
    rng = random.Random(8)
    rows = [(" ".join("".join(chr(0x4E00 + 20 * k + rng.randrange(20)) for _ in range(3)) for _ in range(30)), f"l{k:03}") for k in range(70) for _ in range(3)]
    found = language.fit(rows, rounds=3)
    assert len(found.languages) == 70
    assert sum(language.Labeller(found).texts([t])[0][0] == lang for t, lang in rows[::5]) >= 40
    text = "kar lo " * 200_000 + "x" * (language.STREAM + 5)
    assert "".join(language.parts_of(text)) == text and max(map(len, language.parts_of(text))) <= language.STREAM


def test_texts_do_not_hang_on_their_batch(model):
    found, rows = model
    texts = [None, "", "123 !?½ ² Ⅷ _", "kar", "schung " * 3000, "x" * 500, "\n\nkar lo\nmi\n", *(t for t, _ in rows[::7])]
    together = language.Labeller(found).texts(texts)
    assert together[:3] == [("und", 0.0)] * 3
    for text, (lang, score) in zip(texts, together):
        alone = language.Labeller(found).texts([text])[0]
        assert alone[0] == lang and abs(alone[1] - score) < 1e-9 and 0 <= score <= 1


def test_held_out_accuracy_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_crf_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_nulls_clashes_and_empty_tables(spark, model):
    docs = spark.createDataFrame([(None, "kar lo mi", None, "x"), (2, None, "aa", "y"), (2, "schung", "bb", "z")], "doc_id long, text string, lang string, score string")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.identify(docs, model[0]).collect())
    assert got == [(0, "aa"), (2, "bb"), (2, "und")]
    assert language.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
