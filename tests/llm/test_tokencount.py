import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import tokencount
from quillgraph.llm.registry import op6_transducer_token_counts

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def texts():
    rng = random.Random(1)
    odd = [None, "", "Don't we'll 'tis ''s 's're'r 've'v  'l 'll'lx it's'", "  a  \n b\t\tc \n", "'", "''", " 's", "<|endoftext|> a<|endoftext|>", " \x1c\x1f a\x85b\0c"]
    odd += ["é'é ½²", "日本 🎉🎉👩‍👩‍👧", "a" * 3000, "ab" * 400, "\n's", "' 's 　's", "'r", "x'v", "'l\n", " " * 700 + "x", "<|endoftext|"]
    return odd + ["".join(rng.choice("'' srtevmld\nA1é!") for _ in range(rng.randrange(60))) for _ in range(600)]


def test_counts_match_the_library(library, monkeypatch):
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts()]
    assert tokencount.count_tokens(texts(), FILE).tolist() == want
    monkeypatch.setattr(tokencount, "STREAM", 50)
    monkeypatch.setattr(tokencount, "CHUNK", 4)
    monkeypatch.setattr(tokencount, "MOST_STATES", 100)
    assert tokencount.count_tokens(texts(), FILE).tolist() == want


def test_prefix_scan_composes_in_order():
    maps = np.random.default_rng(0).integers(0, 11, (37, 11)).astype(np.uint8)
    got, now = tokencount.scan_maps(maps), np.arange(11)
    for k in range(37):
        now = maps[k][now]
        assert (got[k] == now).all()


def test_query_on_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op6_transducer_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        n = len(library.encode(d.text, add_special_tokens=False).ids)
        r = found[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 1024)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3)], "doc_id long, text string, n_tokens int")
    got = sorted((r.id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.counted(docs, FILE).collect())
    assert got == [(0, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False)]
    assert tokencount.counted(docs.limit(0), FILE).count() == 0
