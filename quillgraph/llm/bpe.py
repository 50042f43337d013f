"""Byte-level BPE encoding and decoding.

Encoding splits each text into the pattern's words and folds the ranked merges over the bytes of *distinct* words
with Spark's higher-order functions, looking ranks up in a literal map. Three narrow steps in one stage, nothing
shuffled or gathered:

1. ``_number_words`` (Arrow): the pattern's matches, numbered per task in order of first appearance. A row carries
   its word numbers; the first row of each group of rows also carries the words that the group is the first to show.
2. ``fold_merges`` (JVM): each new word's byte array, merged pair by pair, lowest rank first, into token ids.
3. ``_join_ids`` (Arrow): rows arrive in the same order, so every word's ids are known when a row needs them.

The fold's work grows with the square of a word's length, so a word above ``PIECE`` bytes is folded in overlapping
pieces. Two neighbouring pieces are joined at a token that both have at the same place: an encoding is right if and
only if each token stays unmerged next to the one after it, and all neighbours in the joined encoding are neighbours
in one of the pieces'. Pieces that agree on no token (not met so far) are merged once more as one, without the fold.

Words are dealt with once per task. After ``MOST_WORDS`` distinct words (or ``MOST_BYTES``) a task starts a new
numbering, so memory is bounded whatever the partition's size. A lost task is simply run again: steps depend on the
partition's rows alone. Decoding looks up each id's bytes and concatenates the binary pieces.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokencount
from .shared import map_batches

#: Distinct words, and bytes of them, after which a task's numbering starts again.
MOST_WORDS, MOST_BYTES = 500_000, 1 << 25
#: Bytes of a folded piece of a long word, and from the start of one piece to the next.
PIECE, PIECE_STEP = 128, 64
#: Rows, and characters of texts, that are worked on together, about.
ROWS, STREAM = 128, 1 << 19
#: Buckets of the literal rank map: Spark looks a key up in a map by walking it, so each holds about one entry.
BUCKETS = 1 << 16
#: A piece in the fold's state is one character, its id's; ids start above the control characters, and DONE marks that
#: nothing merges any more.
FIRST, DONE = 0x100, 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def piece_char(rank: int) -> str:
    """The character that stands for an id; the code points that are no characters are left out."""
    return chr(FIRST + rank if FIRST + rank < 0xD800 else FIRST + 0x800 + rank)


def ids_of(points: np.ndarray) -> np.ndarray:
    """The ids of code points."""
    points = points.astype(np.int32)
    return np.where(points < 0xD800, points, points - 0x800) - FIRST


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: in buckets by Spark's ``hash``, from a pair of pieces (two characters) to their union's
    piece with the pair behind it, so that the least of the found texts has the lowest rank.
    """
    merged: dict[str, str] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
            if first is not None and second is not None:
                merged[piece_char(first) + piece_char(second)] = piece_char(rank)
    # One small row per pair of the vocabulary: Spark says which bucket it looks in.
    rows = spark.createDataFrame(pa.table({"pair": list(merged)})).select("pair", bucket_of(F.col("pair")).alias("bucket")).toArrow()
    table: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for pair, bucket in zip(rows["pair"].to_pylist(), rows["bucket"].to_pylist()):
        table[bucket][pair] = merged[pair] + pair
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"), ensure_ascii=False)), "array<map<string,string>>")


def bucket_of(pair: Column) -> Column:
    return F.hash(pair).bitwiseAND(F.lit(BUCKETS - 1))


def _bind(value: Column, body) -> Column:
    """``body`` with ``value`` evaluated once (a lambda variable) instead of at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold_word(word: Column, ranks: Column) -> Column:
    """The word's pieces, merged: at each step the pair of lowest rank (the leftmost of equals) becomes one piece."""

    def step(state, _):
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(state) - 1), lambda i: F.substring(state, i, F.lit(2)))
        best = F.array_min(F.transform(pairs, lambda pair: F.try_element_at(F.get(ranks, bucket_of(pair)), pair)))
        merged = _bind(
            best,
            lambda b: F.when(b.isNull(), F.concat(state, F.lit(chr(DONE)))).otherwise(
                F.overlay(state, F.substring(b, 1, 1), F.instr(state, F.substring(b, 2, 2)), F.lit(2))
            ),
        )
        return F.when(F.endswith(state, F.lit(chr(DONE))) | (F.char_length(state) < 2), state).otherwise(merged)

    n = F.char_length(word)
    return F.when(n < 2, word).otherwise(F.aggregate(F.sequence(F.lit(2), n), word, step))


def fold_merges(words: Column, literal: Column) -> Column:
    """The merged pieces of each word of an array of words, each a character a byte (see ``piece_char``)."""
    return _bind(literal, lambda table: F.transform(words, lambda w: _fold_word(w, table)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over linked pieces, for words of any length: lowest rank first, then leftmost."""
    n = len(word)
    stop, prev, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(i: int) -> None:
        j = stop[i]
        if j < n and (rank := ranks.get(word[i : stop[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, stop[j]))

    alive = [True] * n
    for i in range(n):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not (alive[i] and stop[i] == j and j < n and alive[j] and stop[j] == end):
            continue
        alive[j], stop[i] = False, end
        if end < n:
            prev[end] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [ranks[word[i : stop[i]]] for i in range(n) if alive[i]]


def splitter(pattern: str) -> Callable:
    """A function from texts to ``(data, first, stop, text number)`` of their words, places in the UTF-8 ``data``.

    The usual pattern is read by its transducer, any other one by a regular expression.
    """
    if pattern == tokencount.PATTERN:
        classes = tokencount.char_classes()
        return lambda texts: tokencount.cut_words(texts, classes)
    find = regex.compile(pattern)

    def cut(texts: list[str]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        places = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        spans, at = [np.zeros((0, 3), np.int64)], 0
        for k, text in enumerate(texts):
            spans.append(np.array([(at + m.start(), at + m.end(), k) for m in find.finditer(text) if m.group()], np.int64).reshape(-1, 3))
            at += len(text)
        found = np.concatenate(spans)
        return data, places[found[:, 0]], places[found[:, 1]], found[:, 2]

    return cut


def segments(text: str, pattern: str) -> list[str]:
    """A very long text in several parts, cut where the usual pattern always starts a word: before a blank between two
    characters that are no white space."""
    if len(text) <= STREAM or pattern != tokencount.PATTERN:
        return [text]
    found, at, cut = [], 0, regex.compile(r"(?<=\S) (?=\S)")
    while (m := cut.search(text, at + STREAM)) is not None:
        found.append(text[at : m.start()])
        at = m.start()
    return [*found, text[at:]]


def _groups(sizes: list[int]):
    """Ranges of rows whose texts have about ``STREAM`` characters together."""
    first = held = 0
    for k, size in enumerate(sizes):
        held += size
        if held >= STREAM or k == len(sizes) - 1:
            yield first, k + 1
            first, held = k + 1, 0


def _distinct(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The number of each word among the distinct ones, these, and which of them are words (others lie in between)."""
    edges = np.empty(2 * len(first) + 1, np.int32)
    edges[0:-1:2], edges[1::2], edges[-1] = first, stop, stop[-1] if len(stop) else 0
    edges[2:-1:2] = first[1:]
    array = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    codes = np.asarray(coded.indices)[0::2]
    return codes, coded.dictionary.to_pylist(), np.bincount(codes, minlength=len(coded.dictionary)) > 0


class _Numbers(dict):
    """Numbers words in order of first appearance and gathers the new ones; long words are numbered with their pieces."""

    def __init__(self):
        self.size, self.new, self.long = 0, [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.size += len(word)
        if len(word) <= PIECE:
            self.new.append(word)
        else:
            self.new.append(b"")
            last = -(-(len(word) - PIECE) // PIECE_STEP)
            self.long.append({"word": number, "pieces": [self[word[k * PIECE_STEP : k * PIECE_STEP + PIECE]] for k in range(last + 1)]})
        return number


LONGS = pa.list_(pa.struct([("word", pa.int32()), ("pieces", pa.list_(pa.int32()))]))


def _number_words(pattern: str, ranks: dict[bytes, int]):
    def run(batches):
        cut, single = splitter(pattern), Pieces([piece_char(ranks[bytes([b])]).encode() for b in range(256)])
        numbers, fresh = _Numbers(), True
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(list(map(len, texts))):
                parts = [(k, s) for k in range(a, b) for s in segments(texts[k], pattern)]
                if len(numbers) > MOST_WORDS or numbers.size > MOST_BYTES:
                    numbers, fresh = _Numbers(), True
                places, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
                for at, stop in _groups([len(s) for _, s in parts]):
                    data, first, end, which = cut([s for _, s in parts[at:stop]])
                    codes, words, real = _distinct(data, first, end)
                    known = np.fromiter((numbers[w] if r else 0 for w, r in zip(words, real.tolist())), np.int32, len(words))
                    places.append(known[codes])
                    rows.append(np.array([k for k, _ in parts[at:stop]], np.int64)[which])
                lens = np.bincount(np.concatenate(rows) - a, minlength=b - a)
                none = [0] * (b - a - 1)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        _lists(pa.array(np.concatenate(places)), lens),
                        _lists(single.texts(numbers.new), [len(numbers.new), *none]),
                        pa.array([numbers.long, *[[] for _ in none]], LONGS),
                        pa.array([fresh, *map(bool, none)]),
                    ],
                    ["id", "place", "word", "long", "fresh"],
                )
                numbers.new, numbers.long, fresh = [], [], False

    return run


def _lists(values: pa.Array, lens) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), values)


def _join_ids(ranks: dict[bytes, int], with_bytes: bool):
    def run(batches):
        tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        book, words = Pieces(tokens), _Words()
        for batch in batches:
            place, word, long = batch.column(1), batch.column(2), batch.column(3)
            shown = np.flatnonzero(np.diff(np.asarray(word.offsets)) | np.asarray(batch.column(4).to_numpy(zero_copy_only=False), bool))
            edges = np.unique(np.r_[0, shown, batch.num_rows])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if batch.column(4)[a].as_py():
                    words.clear()
                words.add(word.slice(a, 1).flatten())
                for x in long[a].as_py() or ():
                    words.put(x["word"], _joined([words.ids(k) for k in x["pieces"]], book, ranks))
                some = place.slice(a, b - a)
                numbers = np.asarray(some.flatten())
                ids, lens = words.flat[spread(words.start[numbers], words.stop[numbers])], words.stop[numbers] - words.start[numbers]
                edge = np.asarray(some.offsets) - some.offsets[0].as_py()
                edge = np.r_[0, np.cumsum(lens)][edge]
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))]
                if with_bytes:
                    columns.append(book.rows(ids, edge))
                yield pa.record_batch(columns, ["id", "ids", "bytes"][: len(columns)])

    return run


class _Words:
    """The ids of every numbered word, end to end."""

    def __init__(self):
        self.flat, self.start, self.stop = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.clear()

    def clear(self) -> None:
        self.n_ids = self.n_words = 0

    def _append(self, ids: np.ndarray) -> int:
        while self.n_ids + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        at = self.n_ids
        self.flat[at : at + len(ids)] = ids
        self.n_ids += len(ids)
        return at

    def add(self, folded: pa.Array) -> None:
        """The next words, as the fold left them."""
        if not len(folded):
            return
        edges = np.frombuffer(folded.buffers()[1], np.int32)[folded.offset : folded.offset + len(folded) + 1]
        data = np.frombuffer(folded.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        real = points != DONE
        # Characters that begin before each byte, then those of them that are pieces.
        edges = np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum((data & 0xC0) != 0x80)][edges - edges[0]]]
        at = self._append(ids_of(points[real]))
        while self.n_words + len(folded) > len(self.start):
            self.start, self.stop = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.stop))
        self.start[self.n_words : self.n_words + len(folded)] = at + edges[:-1]
        self.stop[self.n_words : self.n_words + len(folded)] = at + edges[1:]
        self.n_words += len(folded)

    def put(self, number: int, ids: np.ndarray) -> None:
        self.start[number] = at = self._append(ids)
        self.stop[number] = at + len(ids)

    def ids(self, number: int) -> np.ndarray:
        return self.flat[self.start[number] : self.stop[number]]


def _joined(pieces: list[np.ndarray], book: Pieces, ranks: dict[bytes, int]) -> np.ndarray:
    """The ids of a long word from those of its overlapping pieces: each goes on after a token that it shares with what
    is there."""
    width = np.diff(book.starts)
    chosen, ends = pieces[0], np.cumsum(width[pieces[0]])
    kept, base = [], 0  # what later pieces can't change, and the place where ``chosen`` begins
    for k, ids in enumerate(pieces[1:], 1):
        stops = k * PIECE_STEP + np.cumsum(width[ids])
        # Tokens as pairs of places: the same start and the same end.
        here, there = ends << 32 | (ends - width[chosen]), stops << 32 | (stops - width[ids])
        shared, i, j = np.intersect1d(here, there, return_indices=True)
        if not len(shared):
            whole = b"".join([book.join(p)[: PIECE_STEP if n < len(pieces) - 1 else None] for n, p in enumerate(pieces)])
            return np.array(merge_long(whole, ranks), np.int32)
        kept.append(chosen[: i[0] + 1])
        chosen, ends = ids[j[0] + 1 :], stops[j[0] + 1 :]
    return np.concatenate([*kept, chosen])


def spread(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All the indexes of the ranges [first, stop), one range after the other."""
    lens = stop - first
    return np.arange(lens.sum()) + np.repeat(first - np.r_[0, np.cumsum(lens)[:-1]][: len(lens)], lens)


class Pieces:
    """The bytes of each id, to be concatenated."""

    def __init__(self, tokens: list[bytes | None]):
        self.starts = np.cumsum([0, *(len(t or b"") for t in tokens)])
        self.flat = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return self.flat[spread(self.starts[ids], self.starts[ids + 1])].tobytes() if len(ids) else b""

    def rows(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """A binary value for each range of ids between two edges."""
        places = np.r_[0, np.cumsum(np.diff(self.starts)[ids])][edges].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(places), pa.py_buffer(self.join(ids))])

    def texts(self, words: list[bytes]) -> pa.Array:
        """A text for each word, its bytes taken as ids."""
        found = self.rows(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum([0, *map(len, words)]))
        return found.cast(pa.string())


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, ids array<int>)`` per row, with ``with_bytes`` the ids decoded again, ``bytes``, and the columns ``keep``.

    Null and empty texts get no ids. Rows with a null or repeated id are encoded like any other; other columns of
    ``docs`` are ignored. Texts and words of any length are encoded whole. An empty table gives no rows.
    """
    ranks = read_ranks(rank_file)
    one = F.col(id_col).cast("long").alias("id")
    rows = docs.select((F.struct(one, *keep) if keep else one).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    numbered = map_batches(rows, _number_words(pattern, ranks), f"id {kind}, place array<int>, word array<string>, long array<struct<word:int,pieces:array<int>>>, fresh boolean")
    folded = numbered.select("id", "place", fold_merges(F.col("word"), rank_literal(docs.sparkSession, ranks)).alias("word"), "long", "fresh")
    found = map_batches(folded, _join_ids(ranks, with_bytes), f"id {kind}, ids array<int>" + ", bytes binary" * with_bytes)
    return found.select("id.id", *found.columns[1:], *[f"id.{c}" for c in keep]) if keep else found


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``(id, bytes)`` of rows ``(id, ids)``: each id's piece, concatenated. Null ids: null."""
    ranks = read_ranks(rank_file)

    def run(batches):
        tokens = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        book = Pieces(tokens)
        for batch in batches:
            found = [None if ids is None else book.join(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["id", "bytes"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, bytes binary")
