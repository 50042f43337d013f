import base64
import hashlib
import random
import tempfile

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quillgraph.llm import bpe
from quillgraph.llm.registry import op4_byte_bpe

RANK_FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANK_FILE), special_tokens={})


TEXTS = [
    None, "", " ", "a", "\n\n  x", "Don't we'll 'tis  l’été — naïve 12345 ½ ！？", "the the the", "x" * 1000, "ab" * 3000,
    "日本語のテキスト 🎉🎉👩‍👩‍👧   end ", "<|endoftext|> tail\t\t", "Ünïcödé " * 50, "\x00\x01 \x7f", "é" * 5, "1" * 300 + " " * 300,
]


def test_ids_and_bytes_match_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 10)  # start the numbering again and again
    rows = [(k, t, "clash", 0) for k, t in enumerate(TEXTS * 2)] + [(None, "null id", None, None), (3, "same id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, ids int")
    got = bpe.encode(docs, RANK_FILE, P.PATTERN, with_bytes=True).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((str(r.id), list(r.ids), bytes(r.bytes)) for r in got) == want
    again = bpe.decode(bpe.encode(docs, RANK_FILE, P.PATTERN), RANK_FILE).collect()
    assert sorted((str(r.id), bytes(r.bytes)) for r in again) == sorted((i, b) for i, _, b in want)


def test_long_words_merge_alike(spark, library):
    """Words above a piece's length are folded piece by piece; repeated and random ones, of any alphabet."""
    rng = random.Random(6)
    ranks = bpe.read_ranks(RANK_FILE)
    words = ["thanedblethe" * 40, "a" * 777, "aab" * 100, "z", "x" * 40_000, "ab" * 5000, "日本語" * 200, "=" * 129, "-=" * 300, "1" * 2000]
    words += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (127, 128, 129, 191, 192, 193, 700) for alphabet in ("ab", "etaoinshr", "абвгдежз", "zqxj")]
    words += ["".join(rng.choice(["ing", "tion", "re", "pre", "ational", "s"]) for _ in range(300)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {r.id: list(r.ids) for r in bpe.encode(docs, RANK_FILE, P.PATTERN).collect()}
    for k, word in enumerate(words):
        assert got[k] == library.encode_ordinary(word), word[:30]
        assert len(word) > 2000 or bpe.merge_long(word.encode(), ranks) == got[k]


def test_pieces_without_a_common_token_are_merged_as_one(library):
    ranks = bpe.read_ranks(RANK_FILE)
    tokens = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    word = "thanedblethe" * 20
    single = lambda text: np.array([ranks[bytes([b])] for b in text.encode()])
    pieces = [single(word[: bpe.PIECE]), np.array(library.encode_ordinary(word[bpe.PIECE_STEP :]))]
    assert not {1} & set(np.diff(bpe.Pieces(tokens).starts)[pieces[1]].tolist())  # the second piece has no token of one byte
    assert bpe._joined(pieces, bpe.Pieces(tokens), ranks).tolist() == library.encode_ordinary(word)


def test_other_patterns_and_ranks(spark, library):
    """A pattern without a transducer, and ids beyond the first plane of characters."""
    ranks = {bytes([b]): b + 60_000 for b in range(256)} | {b"ab": 70_000, b"abc": 1_000_000, b"cd": 80_000, "é".encode(): 54_000}
    assert bpe.ids_of(np.array([ord(bpe.piece_char(r)) for r in ranks.values()])).tolist() == list(ranks.values())
    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken") as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        f.flush()
        other = tiktoken.Encoding("own", pat_str=r"\w+|\W", mergeable_ranks=ranks, special_tokens={})
        texts = ["abcd abc, cd", "éé ab\n", None, "x" * 300]
        got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f.name, r"\w+|\W", with_bytes=True).collect()
    for r in got:
        assert list(r.ids) == other.encode_ordinary(texts[r.id] or "") and bytes(r.bytes).decode() == (texts[r.id] or "")


def test_very_long_texts_are_cut_between_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "STREAM", 200)
    for text in ("one two  three\n four's " * 60, "x" * 900, "a  b " * 200):
        parts = bpe.segments(text, P.PATTERN)
        assert "".join(parts) == text
        assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_query_on_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), RANK_FILE, P.PATTERN).count() == 0
