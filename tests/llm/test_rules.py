import random
import re

from pyspark.sql import functions as F

from quillgraph.llm import rules
from quillgraph.llm.registry import op9_decision_list


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_statistics_by_definition(spark):
    rng = random.Random(5)
    some = lambda n, k: " ".join(rng.choice(["a", "bb", "ç#", "d|d", "e"][:k]) for _ in range(n))
    texts = [None, "", " \t\n", "a", "a b c d", "x\n x\nx\n\n \nx", some(7, 5), some(8, 1), some(9, 1), some(300, 2), some(500, 5), "\r\n".join(["same line"] * 9)]
    texts += ["p q r s t u v w " * 2, "<b>&amp;</b> *$%", " ".join(f"w{k}" for k in range(5000)) + " " + " ".join(f"w{k}" for k in range(100, 200))]
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in rules.statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_query_matches_brute_force_and_learns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_decision_list(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.kept or r.base_failed for r in rows if labels.get(r.doc_id) == 1]
    low = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(low) <= 0.35 * len(low)  # few labels at this size


def test_precision_and_recall_on_labels_that_were_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    labelled = docs.join(labels.select("doc_id", "quality"), "doc_id")
    table = rules.Table(labelled, "labelled")
    found, learned = rules.quality(table.df.select("doc_id", "text"), table.df.select("doc_id", "quality").where("doc_id % 5 <> 0"))
    rows = found.join(table.df.select("doc_id", "quality"), "doc_id").where("doc_id % 5 = 0 AND NOT base_failed").select("kept", "quality").collect()
    rejected = [r.quality for r in rows if not r.kept]
    low = sum(r.quality == 0 for r in rows)
    assert len(rows) > 300 and low > 30
    assert rejected.count(0) >= 0.85 * len(rejected) and rejected.count(0) >= 0.5 * low, (str(learned), len(rejected), rejected.count(0), low)
    for rule in learned.rules:  # no condition that another one implies
        assert len({(c.feature, c.above) for c in rule}) == len(rule)


def test_counts_of_conditions_are_those_of_a_scan(spark):
    rng = random.Random(9)
    rows = [(*[rng.randrange(1, 60) for _ in range(8)], rng.randrange(2), k % 3) for k in range(400)]
    names = [*rules.COUNTS, "quality", "fold"]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n in ('quality', 'fold') else 'long'}" for n in names))
    counter = rules._Counter(frame)
    tried, low, good = counter.candidates(counter.table.df.where("n_words > 20"))
    some = frame.where("fold < 2 AND n_words > 20")
    assert (low, good) == rules._counts(some, [F.lit(True)])[0]
    assert [x[1:] for x in tried[::9]] == rules._counts(some, [c.column() for c, _, _ in tried[::9]])


def test_implied_conditions_are_merged():
    c = rules.Condition
    assert rules.tightened([c("a", True, 5.5), c("b", False, 2.0), c("a", True, 5.7), c("b", False, 3.0), c("a", False, 9.0)]) == [c("a", True, 5.7), c("b", False, 2.0), c("a", False, 9.0)]


def test_columns_may_have_any_names(spark):
    names = ["_text", "_words", "text_shown", "Words_Shown", "kept", "base_failed"]
    docs = spark.createDataFrame([(1, "a b\na b", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    (r,) = rules.statistics(docs).collect()
    assert [r[n] for n in names[:5]] == names[:5] and r.base_failed is True and r.n_dup_lines == 1


def test_list_covers_rule_by_rule(spark):
    rows = []
    for k in range(1200):
        noisy, short = k % 5 == 0, k % 7 == 0
        rows.append((100 if not short else 30, 500 if not short else 300, 60 if noisy else 1, 3, 1, 20, 0, 0, int(not (noisy or short)), k % 3))
    frame = spark.createDataFrame(rows, "n_words long, word_chars long, n_symbols long, n_upper long, n_marks long, n_distinct_words long, n_dup_lines long, n_repeat_words long, quality int, fold int")
    found = rules.learn(frame)
    assert found.rules and str(found).endswith("ELSE keep")
    wrong = frame.where(found.kept() != (F.col("quality") == 1)).count()
    assert wrong == 0


def test_without_labels_everything_passes_the_list(spark):
    docs = spark.createDataFrame([(1, "w " * 30 + " ".join(map(str, range(90)))), (None, None)], "doc_id long, text string")
    got, found = rules.quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert found.rules == () and {(r.doc_id, r.kept) for r in got.collect()} == {(1, True), (None, False)}
    assert rules.quality(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, quality int"))[0].count() == 0
