"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language; a chain lets neighbours support each other, so that code-switched
text is labelled piece by piece. A word's features are its affixes, character n-grams and membership of learned
lexicons (hashed into one table of weights); transitions between languages are learned with them. Inference is
forward-backward; a text's language is the one with the largest sum of its words' posterior probabilities.

Training takes a bounded sample of labelled texts (``FIT_DOCS`` a language), whole, and deals them into sequences that
switch language at random, with the exact gradient of the conditional likelihood. Words are the runs of letters, in
lower case. Texts are labelled whole; chains restart at line ends and every ``CHAIN`` words. A batch's texts are one
stream of characters: its distinct words are hashed and scored together, and nothing is kept from batch to batch.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import give_back, map_batches

#: Labelled texts a language that the model is fitted on at most; longer texts than this many characters are taken
#: only where there are not enough others. Texts are never cut.
FIT_DOCS, FIT_CHARS = 120, 20_000
#: Languages at most (more distinct labels are an error, not a cut); weights a language; words of a chain.
MOST_LANGUAGES, WEIGHTS, CHAIN = 1000, 1 << 16, 64
#: Chains that inference goes through together.
TOGETHER = 512
#: Characters labelled together. A longer text is labelled in parts of about this length.
STREAM = 1 << 18

LETTERS = regex.compile(r"\p{L}+")
NO_LANGUAGE = "und"
BASE, MIX, EDGE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 0x110000

_tables: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _tables:
        table = np.zeros(0x110000, bool)
        points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32).tobytes().decode("utf-32-le")
        for m in LETTERS.finditer(points):
            table[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = True
        _tables.append(table)
    return _tables[0]


def _hashed(kind: int, columns: list[np.ndarray]) -> np.ndarray:
    key = np.full(len(columns[0]), kind + 1, np.uint64)
    for column in columns:
        key = (key ^ (key >> np.uint64(29))) * BASE + column
    return ((key * MIX) >> np.uint64(64 - (WEIGHTS.bit_length() - 1))).astype(np.int64)


def features(chars: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(feature, word)`` arrays, a pair for each kind, words in order: a bias, prefixes and suffixes of two to four
    letters, n-grams of one to three characters of the word with its ends marked, and membership of lexicons.

    ``chars`` are all words end to end, ``bounds`` where each begins (and the end), ``known`` a lexicon number each (0: none).
    """
    lens, words = np.diff(bounds), np.arange(len(bounds) - 1)
    chars = chars.astype(np.uint64)
    found = [(np.full(len(words), _hashed(0, [np.zeros(1, np.uint64)])[0]), words)]
    for n in (2, 3, 4):
        some = words[lens >= n]
        for kind, first in ((n, bounds[some]), (n + 4, bounds[some + 1] - n)):
            found.append((_hashed(kind, [chars[first + k] for k in range(n)]), some))
    edged = np.full(len(chars) + 2 * len(words), EDGE, np.uint64)
    edged[np.arange(len(chars)) + 2 * np.repeat(words, lens) + 1] = chars
    for n in (1, 2, 3):
        counts = lens + 3 - n
        first = bounds[:-1] + 2 * words
        at = np.arange(counts.sum()) + np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]][: len(counts)], counts)
        found.append((_hashed(8 + n, [edged[at + k] for k in range(n)]), np.repeat(words, counts)))
    some = words[known > 0]
    found.append((_hashed(12, [known[some].astype(np.uint64)]), some))
    return found


@dataclass
class Model:
    """``weights[feature, language]``, ``moves[from, to]`` (log scores) and the lexicon (a word's UTF-32 bytes: the number
    of the set of languages that have it)."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[bytes, int]

    def scores(self, chars: np.ndarray, bounds: np.ndarray, words: list[bytes]) -> np.ndarray:
        """``[word, language]`` of distinct words."""
        known = np.fromiter(map(self.lexicon.get, words, [0] * len(words)), np.int64, len(words))
        total = np.zeros((len(words), len(self.languages)))
        for feature, word in features(chars, bounds, known):
            if len(word):
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                total[word[first]] += np.add.reduceat(self.weights[feature], first, axis=0, dtype=np.float64)
        return total


def forward_backward(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray):
    """Posteriors ``[chain, word, language]`` of padded chains, pair counts ``[from, to]`` and the log-likelihood's
    normaliser; each step is scaled, so long chains don't underflow."""
    n, longest, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - top)
    step = np.exp(moves)
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    scale = np.ones((n, longest, 1))
    for t in range(longest):
        now = emit[:, t] if t == 0 else (alpha[:, t - 1] @ step) * emit[:, t]
        scale[:, t] = now.sum(axis=1, keepdims=True)
        alpha[:, t] = now / scale[:, t]
    for t in range(longest - 2, -1, -1):
        inside = (t + 1 < lens)[:, None]
        beta[:, t] = np.where(inside, ((beta[:, t + 1] * emit[:, t + 1]) @ step.T) / scale[:, t + 1], 1.0)
    posterior = alpha * beta
    posterior /= posterior.sum(axis=2, keepdims=True)
    real = np.arange(longest) < lens[:, None]
    pairs = np.zeros((k, k))
    for t in range(longest - 1):
        on = real[:, t + 1]
        if on.any():
            right = beta[on, t + 1] * emit[on, t + 1] / scale[on, t + 1]
            pairs += step * (alpha[on, t].T @ right)
    logs = ((np.log(scale) + top)[..., 0] * real).sum()
    return posterior * real[..., None], pairs, logs


class Chains:
    """Labelled chains of words, made ready for fitting: ``codes`` number distinct words, whose features lie end to end."""

    def __init__(self, chains: list[tuple[list[str], list[int]]], lexicon: dict[bytes, int]):
        names: dict[str, int] = {}
        self.codes = [np.array([names.setdefault(w, len(names)) for w in words]) for words, _ in chains]
        self.labels = [np.array(labels) for _, labels in chains]
        chars = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        known = np.array([lexicon.get(w.encode("utf-32-le"), 0) for w in names], np.int64)
        found = features(chars, np.r_[0, np.cumsum([len(w) for w in names])].astype(np.int64), known)
        owner = np.concatenate([w for _, w in found])
        order = np.argsort(owner, kind="stable")
        self.feature = np.concatenate([f for f, _ in found])[order]
        self.bounds = np.searchsorted(owner[order], np.arange(len(names) + 1))

    def gradient(self, some: range, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The conditional log-likelihood of some of the chains and its gradient by weights and by moves."""
        lens = np.array([len(self.codes[c]) for c in some])
        words, back = np.unique(np.concatenate([self.codes[c] for c in some]), return_inverse=True)
        truth = np.concatenate([self.labels[c] for c in some])
        counts = self.bounds[words + 1] - self.bounds[words]
        cuts = np.r_[0, np.cumsum(counts)[:-1]]
        flat = self.feature[np.arange(counts.sum()) + np.repeat(self.bounds[words] - cuts, counts)]
        score = np.add.reduceat(weights[flat], cuts, axis=0)[back]
        real = np.arange(lens.max()) < lens[:, None]
        padded = np.zeros((len(lens), lens.max(), weights.shape[1]))
        padded[real] = score
        posterior, pairs, logs = forward_backward(padded, lens, moves)
        error = -posterior[real]
        error[np.arange(len(truth)), truth] += 1
        move, gold = -pairs, score[np.arange(len(truth)), truth].sum()
        for c in some:
            before, after = self.labels[c][:-1], self.labels[c][1:]
            np.add.at(move, (before, after), 1)
            gold += moves[before, after].sum()
        weight = np.empty_like(weights)
        for k in range(weights.shape[1]):
            by_word = np.bincount(back, error[:, k], len(words))
            weight[:, k] = np.bincount(flat, np.repeat(by_word, counts), len(weights))
        return gold - logs, weight, move


def fit(rows: list[tuple[str, str]], seed: int = 7, rounds: int = 10, chain: int = 24, rate: float = 0.3) -> Model | None:
    """A model from (text, language) rows; None where no language has words."""
    rng = np.random.default_rng(seed)
    words: dict[str, list[list[str]]] = {}
    for text, lang in sorted(rows):
        if found := LETTERS.findall(text.lower()):
            words.setdefault(lang, []).append(found)
    if not words:
        return None
    languages = sorted(words)
    # Lexicon: words seen in two texts of a language at least, numbered by the set of languages that have them.
    seen: dict[str, dict[int, int]] = {}
    for at, lang in enumerate(languages):
        for text in words[lang]:
            for w in set(text):
                counts = seen.setdefault(w, {})
                counts[at] = counts.get(at, 0) + 1
    sets = {w: ",".join(str(at) for at, n in sorted(by.items()) if n > 1) for w, by in seen.items() if max(by.values()) > 1}
    lexicon = {w.encode("utf-32-le"): zlib.crc32(s.encode()) + 1 for w, s in sets.items()}
    # Code-switched sequences: spans of one language after another.
    spans = []
    for at, lang in enumerate(languages):
        for text in words[lang]:
            i = 0
            while i < len(text):
                n = int(rng.integers(3, chain))
                spans.append((text[i : i + n], at))
                i += n
    rng.shuffle(order := list(range(len(spans))))
    chains: list[tuple[list[str], list[int]]] = []
    for s in order:
        span, at = spans[s]
        if chains and len(chains[-1][0]) + len(span) <= 2 * chain:
            chains[-1][0].extend(span)
            chains[-1][1].extend([at] * len(span))
        else:
            chains.append((list(span), [at] * len(span)))
    ready = Chains(chains, lexicon)
    k = len(languages)
    model = Model(languages, np.zeros((WEIGHTS, k)), np.zeros((k, k)), lexicon)
    squares, move_squares = np.full((WEIGHTS, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(rounds):
        for start in range(0, len(chains), 96):
            _, weight, move = ready.gradient(range(start, min(start + 96, len(chains))), model.weights, model.moves)
            weight -= 1e-3 * model.weights
            move -= 1e-2 * model.moves
            squares += weight**2
            move_squares += move**2
            model.weights += rate * weight / np.sqrt(squares)
            model.moves += rate * move / np.sqrt(move_squares)
    return model


def stream_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(chars, first, stop, line, text)`` of the words of lower-cased texts: places in the stream of their characters,
    and the numbers of their line and text."""
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    letter = letter_table()[chars]
    edge = np.diff(np.r_[False, letter].astype(np.int8))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.cumsum(chars == 10)[first]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
    return chars, first, stop, line, text


def parts_of(text: str) -> list[str]:
    """A text in parts of about ``STREAM`` characters, cut where a word ends (in one only if it is as long as a part)."""
    found, at = [], 0
    while len(text) - at > STREAM:
        ends = [m.end() for m in regex.finditer(r"\P{L}(?=\p{L})", text, pos=at + STREAM // 2, endpos=at + STREAM)]
        cut = ends[-1] if ends else at + STREAM
        found.append(text[at:cut])
        at = cut
    return [*found, text[at:]]


class Labeller:
    """Applies a model to texts."""

    def __init__(self, model: Model):
        self.model = model

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each language at each word of lower-cased texts, and the number of each word's text."""
        chars, first, stop, line, text = stream_words(texts)
        if not len(first):
            return np.zeros((0, len(self.model.languages))), text
        # Words and what lies between them, as binary values over the stream itself: equal ones get one number.
        edges = np.empty(2 * len(first) + 1, np.int32)
        edges[0:-1:2], edges[1::2], edges[2:-1:2], edges[-1] = first, stop, first[1:], stop[-1]
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges * np.int32(4)), pa.py_buffer(chars)]).dictionary_encode()
        codes = np.asarray(coded.indices)[0::2]
        used, codes = np.unique(codes, return_inverse=True)
        some = coded.dictionary.take(pa.array(used))
        bounds = np.frombuffer(some.buffers()[1], np.int32)[: len(some) + 1].astype(np.int64) // 4
        table = self.model.scores(np.frombuffer(some.buffers()[2], np.uint32)[: bounds[-1]], bounds, some.to_pylist())
        new = np.r_[True, line[1:] != line[:-1]]
        place = np.arange(len(line))
        inline = place - np.maximum.accumulate(np.where(new, place, 0))
        starts = np.flatnonzero(inline % CHAIN == 0)
        lens = np.diff(np.r_[starts, len(place)])
        order = np.argsort(lens, kind="stable")
        found = np.zeros((len(place), table.shape[1]))
        for at in range(0, len(order), TOGETHER):
            chain = order[at : at + TOGETHER]
            real = np.arange(lens[chain].max()) < lens[chain][:, None]
            index = (starts[chain][:, None] + np.arange(real.shape[1]))[real]
            padded = np.zeros((*real.shape, table.shape[1]))
            padded[real] = table[codes[index]]
            found[index] = forward_backward(padded, lens[chain], self.model.moves)[0][real]
        return found, text

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; many short texts are labelled together, long ones part by part."""
        totals = np.zeros((len(texts), len(self.model.languages)))
        held: list[str] = []
        owner: list[int] = []

        def work() -> None:
            posterior, text = self.posteriors(held)
            rows = np.array(owner)[text]
            for k in range(totals.shape[1]):
                totals[:, k] += np.bincount(rows, posterior[:, k], len(texts))
            held.clear()
            owner.clear()

        size = 0
        for k, text in enumerate(texts):
            for part in parts_of(text.lower()) if text else ():
                held.append(part)
                owner.append(k)
                size += len(part)
                if size >= STREAM:
                    work()
                    size = 0
        if held:
            work()
        best, every = totals.argmax(axis=1), totals.sum(axis=1)
        share = np.round(totals[np.arange(len(texts)), best] / np.where(every > 0, every, 1), 9)
        return [(self.model.languages[b], float(s)) if e > 0 else (NO_LANGUAGE, 0.0) for b, s, e in zip(best.tolist(), share, every)]


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_docs: int = FIT_DOCS) -> list[tuple[str, str]]:
    """The rows that a model is fitted on: of each language the ``fit_docs`` texts with the smallest hashed ids, those of
    up to ``FIT_CHARS`` characters first. Texts come whole.

    A language's texts are ranked with a limit that Spark applies before the shuffle, so a common language is not gathered.
    """
    some = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    order = Window.partitionBy("lang").orderBy(F.char_length("text") > FIT_CHARS, F.xxhash64(F.lit("fit"), "id"), "id", F.xxhash64("text"))
    ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fit_docs)
    if (labels := some.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"{labels} labels or more: {lang_col} holds no languages")
    return [(r["text"], r["lang"]) for r in ranked.select("text", "lang").collect()]


def held_out(id_col: str = "doc_id"):
    """Rows that never train: crc32 of the id's text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    found = fit(sample(docs.where(~held_out(id_col)), id_col, text_col, lang_col))
    give_back()  # the driver lives on
    return found


def has_letter(text_col: str = "text"):
    """Whether a text has anything to label; false for a null text."""
    return F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (a language of the model, or ``und`` where the text is null or has no letter, or
    the model is None) and ``score``, the share of that language in the words' posteriors (0 for ``und``).

    Rows are kept as they are, columns of these names replaced. The model goes to the tasks with the function: a
    column of weights for each language and a lexicon from the bounded sample.
    """
    rows = docs.drop("lang_pred", "score")
    names = list(rows.columns)
    at = names.index(text_col)
    packed = None if model is None else Model(model.languages, model.weights.astype(np.float32), model.moves, model.lexicon)

    def run(batches):
        labeller = Labeller(packed) if packed else None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(at).to_pylist()
                found = labeller.texts(texts) if labeller else [(NO_LANGUAGE, 0.0)] * len(texts)
                columns = [*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
                yield pa.record_batch(columns, [*names, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_batches(rows, run, schema)
