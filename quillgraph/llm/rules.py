"""Quality rules: text statistics in Spark SQL and a learned decision list over them.

Sequential covering (in the manner of the published rule inducers): a rule, a conjunction of threshold conditions,
is grown condition by condition on two thirds of the labelled rows for the gain in information about low quality. On
the last third any condition is pruned that the rule is no worse without, and the rule is kept if it is precise there;
the rows that it covers are set aside and the next rule is learned from the rest. A rule that is not kept makes way for
the next best beginning. The list is emitted as one ordered ``CASE WHEN`` expression. Everything on the main path is
DataFrame and SQL functions; only counts come to the driver, a histogram of every statistic by quality at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Table, free_name

GAP = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Labelled rows that a list is learned from at most: those of the smallest hashed ids.
FIT_ROWS = 20_000
#: Conditions a rule may have, rules a list may have, thresholds tried for each statistic.
MOST_CONDITIONS, MOST_RULES, THRESHOLDS = 3, 8, 24
#: Rules that may fail before learning ends.
MOST_FAILS = 6
#: Share of low quality rows among those that a rule covers on the pruning rows, at least; and rows covered.
LEAST_PRECISION, LEAST_COVER = 0.8, 10


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The matches of ``[^\\x20\\x09-\\x0D]+``."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, the first find included.

    Windows are compared by 64-bit hashes of their words' hashes. Only where two are equal are the hashes sorted, with
    their places; the places of repeated windows, in order, cover their union.
    """

    def count(hashes: Column) -> Column:
        def repeats(marks: Column) -> Column:
            def cover(pairs: Column) -> Column:
                same = lambda x, i: (x["h"] == F.get(pairs, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(pairs, i - 1)["h"]))
                hits = F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False)))
                places = F.sort_array(F.transform(hits, lambda x: x["i"]))
                return _bind(
                    places,
                    lambda p: F.aggregate(
                        F.transform(p, lambda at, i: F.least(F.coalesce(F.get(p, i + 1) - at, F.lit(window)), F.lit(window)).cast("long")),
                        F.lit(0).cast("long"),
                        lambda total, n: total + n,
                    ),
                )

            pairs = F.sort_array(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(marks)) == F.size(marks), F.lit(0).cast("long")).otherwise(_bind(pairs, cover))

        at = F.sequence(F.lit(0), F.size(hashes) - window)
        marks = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
        return F.when(F.size(hashes) <= window, F.lit(0).cast("long")).otherwise(_bind(marks, repeats))

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), count)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_upper, n_marks, n_distinct_words, n_dup_lines, n_repeat_words
    (all long) and base_failed.

    A null text counts as one without words. Columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop(*[c for c in [*COUNTS, "base_failed"] if c != text_col])
    kept_text, words = free_name(docs, "text_shown"), free_name(docs, "words_shown")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    kept = docs.withColumn(kept_text, text).withColumn(words, words_of(F.col(kept_text)))
    kept = kept.withColumn("n_words", F.size(words).cast("long"))
    kept = kept.withColumn("word_chars", F.char_length(F.array_join(words, "")).cast("long"))
    kept = kept.withColumn("n_symbols", F.regexp_count(kept_text, F.lit("[#*$%&|<>]")).cast("long"))
    kept = kept.withColumn("n_upper", F.regexp_count(kept_text, F.lit("\\p{Lu}")).cast("long"))
    kept = kept.withColumn("n_marks", F.regexp_count(kept_text, F.lit("[!?]")).cast("long"))
    kept = kept.withColumn("n_distinct_words", F.size(F.array_distinct(words)).cast("long"))
    kept = kept.withColumn("n_dup_lines", _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
    kept = kept.withColumn("n_repeat_words", repeated_words(F.col(words)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return kept.withColumn("base_failed", failed).drop(kept_text, words)


#: What rules may look at, as ratios that don't depend on a text's length, and the length itself.
FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "double(n_dup_lines)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "distinct_rate": "n_distinct_words / sqrt(greatest(n_words, 1))",
}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_distinct_words", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(conditions) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c.column()
    return found


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that meets one is rejected, any other kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        found = None
        for rule in self.rules:
            found = F.when(_all(rule), F.lit(False)) if found is None else found.when(_all(rule), F.lit(False))
        return F.lit(True) if found is None else found.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(["IF " + " AND ".join(map(str, r)) + " THEN reject" for r in self.rules] + ["ELSE keep"])


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """For each test, the low and the good rows that meet it, in one pass."""
    if not tests:
        return []
    low, good = F.col("quality") == 0, F.col("quality") == 1
    sums = [F.count_if(t & c) for t in tests for c in (low, good)]
    found = list(rows.agg(*[s.alias(f"c{k}") for k, s in enumerate(sums)]).first())
    return list(zip(found[::2], found[1::2]))


def _worth(low: int, good: int) -> float:
    """What a rule is worth on the pruning rows: how far low quality outweighs good among those it covers."""
    return (low - good) / (low + good) if low + good else -1.0


def tightened(rule: list[Condition]) -> list[Condition]:
    """The rule without conditions that another one implies."""
    best: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        old = best.get((c.feature, c.above))
        if old is None or (c.threshold > old.threshold if c.above else c.threshold < old.threshold):
            best[c.feature, c.above] = c
    return list(best.values())


class _Counter:
    """Labelled rows as bins of each statistic, between the thresholds that are tried."""

    def __init__(self, labelled: DataFrame):
        steps = [k / (THRESHOLDS + 1) for k in range(1, THRESHOLDS + 1)]
        grow = labelled.where("fold < 2")
        quantiles = lambda e, c: F.percentile_approx(F.when(c, F.expr(e)), steps, 10_000)
        low = F.col("quality") == 0
        marks = grow.agg(*[quantiles(e, c).alias(f"{f}_{k}") for f, e in FEATURES.items() for k, c in enumerate((low, ~low))]).first()
        self.thresholds = {f: sorted({float(t) for k in (0, 1) for t in marks[f"{f}_{k}"] or ()}) for f in FEATURES}
        # A bin's number: how many thresholds the value is above.
        bin_of = lambda f, value: F.size(F.filter(F.array(*map(F.lit, self.thresholds[f] or [0.0])), lambda t: t < value)).alias(f"bin_{f}")
        bins = [bin_of(f, F.expr(e)) for f, e in FEATURES.items()]
        self.table = Table(labelled.select("*", *bins), "bins")

    def histogram(self, rows: DataFrame) -> dict[str, dict[int, list[int]]]:
        """Low and good rows to grow on, by statistic and bin."""
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES])).alias("x")
        found: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
        for r in rows.where("fold < 2").select("quality", pairs).groupBy("x.f", "x.b", "quality").count().collect():
            found[r["f"]].setdefault(r["b"], [0, 0])[r["quality"]] += r["count"]
        return found

    def candidates(self, rows: DataFrame) -> tuple[list[tuple[Condition, int, int]], int, int]:
        """Every condition with the low and good rows that meet it; and the low and good rows."""
        found, total = [], [0, 0]
        for f, bins in self.histogram(rows).items():
            total = [sum(n[q] for n in bins.values()) for q in (0, 1)]
            below = [0, 0]
            for k, t in enumerate(self.thresholds[f]):
                below = [below[q] + bins.get(k, (0, 0))[q] for q in (0, 1)]  # values up to threshold k are in bins 0..k
                found.append((Condition(f, True, t), total[0] - below[0], total[1] - below[1]))
                found.append((Condition(f, False, t), below[0], below[1]))
        return found, total[0], total[1]


def learn(labelled: DataFrame) -> DecisionList:
    """A list from rows of the statistics with ``quality`` 0 or 1 and ``fold`` (0, 1 to grow on, 2 to prune on).

    No rows, or none of low quality: an empty list, which keeps everything.
    """
    counter = _Counter(labelled)
    rules: list[tuple[Condition, ...]] = []
    rest, fails, banned = counter.table.df, 0, set()
    bits = lambda p, n: math.log2(p / (p + n)) if p else 0.0
    while len(rules) < MOST_RULES and fails < MOST_FAILS:
        rule: list[Condition] = []
        first = None
        for _ in range(2 * MOST_CONDITIONS):
            tried, low, good = counter.candidates(rest.where(_all(rule)))
            if not (low and good):
                break
            gains = [(p * (bits(p, n) - bits(low, good)), k) for k, (c, p, n) in enumerate(tried) if p >= LEAST_COVER and (rule or c not in banned)]
            gain, k = max(gains, key=lambda g: (g[0], -g[1]), default=(0.0, 0))
            grown = tightened([*rule, tried[k][0]]) if gain > 0 else rule
            if gain <= 0 or len(grown) > MOST_CONDITIONS:
                break
            first = first or tried[k][0]
            rule = grown
        if not rule:
            break
        # Conditions that the rule is no worse without, one after the other.
        prune = rest.where("fold = 2")
        (now,) = _counts(prune, [_all(rule)])
        while len(rule) > 1:
            shorter = [[c for c in rule if c is not gone] for gone in rule]
            counts = _counts(prune, [_all(r) for r in shorter])
            best = max(range(len(shorter)), key=lambda k: _worth(*counts[k]))
            if _worth(*counts[best]) < _worth(*now):
                break
            rule, now = shorter[best], counts[best]
        low, good = now
        if low + good < LEAST_COVER // 2 or low < LEAST_PRECISION * (low + good):
            banned.add(first)
            fails += 1
            continue
        rules.append(tuple(rule))
        rest = rest.where(~_all(rule))
    counter.table.drop()
    return DecisionList(tuple(rules))


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics of the labelled texts that don't fail the base rules, at most ``fit_rows`` of them, with ``quality`` and ``fold``.

    The labels are a bounded sample (smallest hashed ids first), so their side of the join may be broadcast.
    """
    chosen = labels.where("quality in (0, 1)").groupBy(id_col).agg(F.min("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("fit"), id_col), id_col).limit(fit_rows).withColumnRenamed(id_col, "_id")
    # Two numbers a row and at most fit_rows of them.
    joined = docs.select(F.col(id_col).alias("_key"), F.col("text").alias("text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))
    stats = statistics(joined, "text").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(3)).cast("int"))
    return stats.where("NOT base_failed").select(*COUNTS, F.col("_quality").alias("quality"), "fold")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DecisionList]:
    """``docs`` with the statistics, ``base_failed`` and ``kept``; and the list that was learned.

    ``kept`` is false where ``base_failed``, else the list's verdict. Null texts have no words, so they fail.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fit = Table(labelled_statistics(texts, labels, "doc_id"), "labelled")
    rules = learn(fit.df)
    fit.drop()
    return statistics(docs, text_col).withColumn("kept", ~F.col("base_failed") & rules.kept()), rules
