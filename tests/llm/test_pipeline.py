import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import bpe, mixing, shared, simhash
from quillgraph.llm.shared import connected_components, materialize

from .test_lines import brute as brute_lines
from .test_simhash import brute as brute_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_in_order():
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources", "BPE encoding"]


def test_each_stage_against_its_definition(spark):
    """The stages on a table with nulls, copies, repeated ids and junk, each checked on what the one before it kept."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    extra = [(9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, "12 !!", "en", "a", 5), (None, "no id here but some words", None, "b", 25)]
    first = base.orderBy("doc_id").first()
    extra += [(9004, first.text, first.lang, first.source, first.n_chars), (first.doc_id, first.text, first.lang, first.source, first.n_chars)]
    docs = materialize(base.unionByName(spark.createDataFrame(extra, SCHEMA)), "docs")
    known = materialize(stage("language ID")(spark, docs, ""), "a")
    assert known.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {9001, 9002, 9003}
    lines = materialize(stage("line dedup")(spark, known, ""), "b")
    want = brute_lines([(r.doc_id, r.text) for r in known.collect()])
    assert sorted((str(r.doc_id), r.text) for r in lines.collect()) == sorted((str(i), t) for i, t in want)
    assert lines.where("n_chars <> char_length(text)").count() == 0 and lines.columns == docs.columns
    one = materialize(stage("SimHash near-dedup")(spark, lines, ""), "c")
    rows = [(r.doc_id, simhash.simhash(r.text)) for r in lines.collect()]
    classes = brute_classes(rows)
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted({str(low) for low in classes.values()})
    mixed = materialize(stage("mixing sources")(spark, one, ""), "d")
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, one.collect()))
    slots = {r.doc_id: (r.mix_slot, r.mix_offset) for r in mixing.mix(one).collect()}
    order = [slots[r.doc_id] for r in mixed.coalesce(1).collect()]
    assert order == sorted(order)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in stage("BPE encoding")(spark, mixed, "").collect():
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_every_class_keeps_one_document(spark):
    """Several null ids, and ids that stand on two different texts."""
    rng = random.Random(1)
    texts = sorted(" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(8))
    near = [(None, 0), (None, 1), (None, 1), (None, 2), (5, 4), (9, 4), (5, 3), (3, 3), (7, 5), (7, 6), (None, 6), (None, 7), (8, 7)]
    docs = spark.createDataFrame([(i, texts[t], None, "ab"[t % 2], 9) for i, t in near], SCHEMA)
    got = sorted((str(r.doc_id), texts.index(r.text)) for r in stage("SimHash near-dedup")(spark, docs, "").collect())
    assert got == [("3", 3), ("5", 4), ("7", 5), ("7", 6), ("8", 7), ("None", 0), ("None", 1), ("None", 2)]


def test_stages_keep_any_columns_and_whole_texts(spark):
    """Columns with the names that the operators use inside, maps, and a very long text."""
    names = ["root", "id", "key", "row_key", "source_", "place", "text_key", "lang_pred", "Score", "n_lines", "mix_slot", "order", "doc", "mark", "n"]
    long = "\n".join(f"zeile {k} und noch {k * k * 7919 % 100_003} {k ** 3} worte {k * 31 % 977} davon" for k in range(1500))
    rows = [(k, t, "de", "ab"[k % 2], len(t), *names, {"m": k}) for k, t in enumerate([long, "ein kurzer text mit worten", "noch ein anderer kurzer text hier", "ein kurzer text mit worten"])]
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{n} string" for n in names) + ", extra map<string,int>")
    for number, (_, f) in enumerate(corpus_pipeline.STAGES[:4]):
        more = docs.columns
        docs = materialize(f(spark, docs, ""), f"wide{number}")
        assert docs.columns == more
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {0, 1, 2, 3} and all(got[k].extra == {"m": k} and all(got[k][n] == n for n in names) for k in got)
    assert got[0].text.startswith("zeile 0 und") and got[3].text == ""
    encoded = {r.doc_id: r for r in stage("BPE encoding")(spark, docs, "").collect()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(list(encoded[k].ids) == library.encode_ordinary(got[k].text) for k in got)


def test_run_returns_places_that_outlive_rereading(spark, tmp_path, monkeypatch):
    """Several files of different sizes: read again, they are not in the order of the mixture."""
    docs = spark.createDataFrame([(k, f"text {k} " * (1 + k % 9), "en", "abc"[k % 7 % 3], 9) for k in range(700)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # each file is a task
    try:
        got = corpus_pipeline.run(spark, str(tmp_path))
        assert len(got.inputFiles()) > 1
        rows = got.orderBy("mix_slot", "mix_offset").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [r.doc_id for r in mixing.mix(docs).orderBy("mix_slot", "mix_offset").collect()]
    assert [r.doc_id for r in rows] == want and len({(r.mix_slot, r.mix_offset) for r in rows}) == 700
    assert all(r.n_tokens == len(r.ids) > 0 for r in rows)


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for number, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(f(spark, docs, ""), f"empty{number}")
    assert docs.columns == ["doc_id", "ids", "n_tokens"] and docs.count() == 0


@pytest.mark.parametrize("few", [0, 20_000])
@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(k % 7, k) for k in range(100)] + [(500, 501), (501, 502)]])
def test_components_against_a_loop(spark, monkeypatch, few, edges):
    monkeypatch.setattr(shared, "FEW_EDGES", few)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame(edges, "src long, dst long")).select(F.count("*")).first()[0] == len(linked)


def test_components_leave_little_on_the_driver(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(shared, "release", rounds.append)
    edges = spark.range(30_000).select((F.col("id") + 1).alias("src"), (F.col("id") - F.col("id") % 10).alias("dst"))
    few = connected_components(edges).select(F.count("*"), F.countDistinct("root"), F.min("root")).first()
    assert not rounds and few == (30_001, 1, 0)  # 30,000 edges are no reason for rounds of jobs
    monkeypatch.setattr(shared, "FEW_EDGES", 0)
    again = connected_components(edges.where("id < 300")).select(F.count("*"), F.countDistinct("root")).first()
    assert rounds and again == (301, 1)


def test_workers_get_small_batches(spark, monkeypatch):
    """Whatever the number of rows; a bound that the session has stays."""
    docs = spark.createDataFrame([(k, f"{k} " + "some words " * 1000) for k in range(3000)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 30_000_000 and max(got) < 2 * shared.BATCH_BYTES
        spark.conf.set(key, "1000000")
        shared.map_batches(docs, sizes, "n long")
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
