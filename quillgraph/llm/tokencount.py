"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic transducers, each run over many places of a batch at once (numpy, one step a character):

* ``SPLIT`` reads character classes and marks where pre-tokens start, with a delay of one character. A batch's texts
  form one stream, cut into chunks; each chunk's state map (end state for every start state) is computed, the maps
  are composed by a parallel prefix scan, and every chunk is then read again from its true start state.
* ``MergeTransducer`` reads a pre-token's bytes; each transition carries the number of tokens by which the count of
  the encoding changes. Its states are determinised when first met and kept for the worker's later tasks.

A state of the second holds, for each suffix of what was read that may still grow into a token, the last token of the
encoding before that suffix and the tokens counted since. The next byte's last token is the one token among the
suffixes that stays unmerged next to what precedes it; that is all that a merge order can depend on.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and about how many of a batch are worked on together.
CHUNK, STREAM = 256, 1 << 20
#: States after which the merge transducer is compiled anew, so that a worker's memory is bounded.
MOST_STATES = 150_000

# Character classes; the letters that can end a contraction have their own.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, SHORT, R, E, V, L, END = range(12)
# States: what the last character was part of. AFTER: a contraction has just ended.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANK, IN_SPACE, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, AFTER = range(11)
#: Bits that a transition emits: a pre-token starts at this character; at the one before.
HERE, BEFORE = 1, 2


def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    """``move[class, state]`` and ``mark[class, state]``, flat, of the pattern of byte-level BPE."""
    kind = {OTHER: IN_OTHERS, LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, BLANK: IN_BLANK, SPACE: IN_SPACE, QUOTE: AT_QUOTE}
    kind |= {c: IN_LETTERS for c in (SHORT, R, E, V, L)}
    move, mark = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    pending = {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}
    for c in range(12):
        for s in range(11):
            if c == END:
                move[c, s], mark[c, s] = START, HERE | (BEFORE if s in pending else 0)
                continue
            bits, now, was = 0, kind[c], s
            if s in pending:
                if c == pending[s]:
                    move[c, s] = AFTER
                    continue
                bits, was = BEFORE, IN_LETTERS  # no contraction: the quote stands alone, its letter starts a word
            if s == AT_QUOTE:
                if c in (SHORT, R, V, L):
                    move[c, s] = {SHORT: AFTER, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c]
                    continue
                was = IN_OTHERS
            if c in (BLANK, SPACE):
                starts = was not in (IN_BLANK, IN_SPACE)
            elif was == IN_BLANK:  # a single blank goes with the word after it
                bits, starts = bits | BEFORE, False
                now = IN_OTHERS if c == QUOTE else now
            elif was == IN_SPACE:
                bits, starts = bits | BEFORE, True
            elif c == QUOTE and was == IN_OTHERS:
                now, starts = IN_OTHERS, False
            else:
                starts = was != now
            move[c, s], mark[c, s] = now, bits | (HERE if starts else 0)
    return move.ravel(), mark.ravel()


MOVE, MARK = _split_tables()


def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32).tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, points):
            table[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = kind
    table[ord(" ")], table[ord("'")] = BLANK, QUOTE
    for letters, kind in (("stmd", SHORT), ("r", R), ("e", E), ("v", V), ("l", L)):
        for x in letters:
            table[ord(x)] = kind
    return table


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps ``maps[chunk, state]``, doubling the reach in each round."""
    reach = 1
    while reach < len(maps):
        joined = maps.copy()
        joined[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        maps, reach = joined, reach * 2
    return maps


def split_marks(classes: np.ndarray) -> np.ndarray:
    """For a stream of classes that ends with END: where pre-tokens (and END characters) start."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(11, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = MOVE[row[:, None].astype(np.int16) * 11 + maps]
    ends = scan_maps(maps)[:, START]
    state = np.r_[np.uint8(START), ends[:-1]].astype(np.int16)
    bits = np.empty((CHUNK, chunks), np.uint8)
    for k, row in enumerate(grid):
        at = row.astype(np.int16) * 11 + state
        bits[k], state = MARK[at], MOVE[at].astype(np.int16)
    bits = bits.T.reshape(-1)[:n]
    starts = (bits & HERE).astype(bool)
    starts[:-1] |= (bits[1:] & BEFORE).astype(bool)
    return starts


class Vocabulary:
    """Tokens and merge ranks of a tokenizer file, over bytes."""

    def __init__(self, file: str):
        with open(file) as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE with the standard pattern is compiled")
        # Byte-level files write each byte as a printable character: itself if it is one, else the next free one.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        raw = lambda token: bytes(byte[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {raw(t) for t in model["vocab"] if t not in self.special}


class MergeTransducer:
    """``step[state, column]`` and ``gain[state, column]``, filled where input leads; a column for each byte seen."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.begun = {t[:k] for t in words.tokens for k in range(1, len(t))}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.column = np.full(256, -1, np.int64)
        self.bytes: list[int] = []
        self.step = np.full((1024, 128), -1, np.int32)
        self.gain = np.zeros((1024, 128), np.int8)
        self.state_of((b"", ((0, None, 0),)))

    def encode(self, word: bytes) -> list[bytes]:
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, k = min((self.words.merges.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stays(self, before: bytes | None, token: bytes) -> bool:
        """Whether ``token`` is encoded as itself after ``before`` (None: at the start)."""
        found = self.apart.get((before, token))
        if found is None:
            found = self.encode((before or b"") + token) == ([token] if before is None else [before, token])
            self.apart[before, token] = found
        return found

    def state_of(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.known)
            self.known.append(key)
            if found == len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        return found

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte of ``data``."""
        for byte in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            self.column[byte] = len(self.bytes)
            self.bytes.append(byte)
        if len(self.bytes) > self.step.shape[1]:
            self.step = np.concatenate([self.step, np.full_like(self.step, -1)], axis=1)
            self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)], axis=1)
        return self.column[data]

    def fill(self, state: int, column: int) -> None:
        """The transition: key = (live suffix, for each live start: its place in it, last token before, tokens since)."""
        suffix, starts = self.known[state]
        grown = suffix + bytes([self.bytes[column]])
        for at, before, since in starts:  # one of them at most fits
            token = grown[at:]
            if token in self.words.tokens and self.stays(before, token):
                gain = 1 - since
                break
        else:
            raise AssertionError("a byte sequence without an encoding")
        live = [(at, before, since + gain) for at, before, since in starts if grown[at:] in self.begun]
        cut = live[0][0] if live else len(grown)
        key = (grown[cut:], (*((at - cut, before, since) for at, before, since in live), (len(grown) - cut, token, 0)))
        then = self.state_of(key)
        self.step[state, column], self.gain[state, column] = then, gain

    def counts(self, data: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tokens of each of the words ``data[first : first + len]``, all read in step."""
        if len(self.known) > MOST_STATES:
            self.reset()
        data = self.columns(data)
        width = self.step.shape[1]
        order = np.argsort(-lens, kind="stable")
        first, left = first[order], lens[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active = len(order)
        for k in range(int(left[0]) if len(left) else 0):
            active = int(np.searchsorted(-left[:active], -k, side="left"))
            at = state[:active] * width + data[first[:active] + k]
            then = self.step.ravel()[at]
            if (then < 0).any():
                for missing in np.unique(at[then < 0]).tolist():
                    self.fill(*divmod(missing, width))
                then = self.step.ravel()[at]
            total[:active] += self.gain.ravel()[at]
            state[:active] = then
        found = np.empty_like(total)
        found[order] = total
        return found


#: The pattern that ``SPLIT`` stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cut_words(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(data, first, stop, text)`` of the pattern's matches: places in the UTF-8 bytes, and the number of their text."""
    stream = "\0".join([*texts, ""])
    chars = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    kinds = classes[chars]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds[ends] = END
    starts = np.flatnonzero(split_marks(kinds)) if len(texts) else np.zeros(0, np.int64)
    width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
    offset = np.r_[0, np.cumsum(width)]
    first, stop = offset[starts], offset[np.r_[starts[1:], len(chars)]] if len(starts) else starts
    real = kinds[starts] != END
    return np.frombuffer(stream.encode(), np.uint8), first[real], stop[real], np.searchsorted(ends, starts[real])


_compiled: dict[str, tuple[Vocabulary, MergeTransducer, np.ndarray]] = {}


def compiled(file: str) -> tuple[Vocabulary, MergeTransducer, np.ndarray]:
    """A worker compiles a file once and keeps what it has determinised."""
    if file not in _compiled:
        words = Vocabulary(file)
        _compiled[file] = (words, MergeTransducer(words), char_classes())
    return _compiled[file]


def count_tokens(texts: list[str | None], file: str) -> np.ndarray:
    words, merge, classes = compiled(file)
    total = np.zeros(len(texts), np.int64)
    cut = regex.compile("|".join(map(regex.escape, sorted(words.special, key=len, reverse=True)))) if words.special else None
    parts, owner, size = [], [], 0

    def work() -> None:
        data, first, stop, part = cut_words(parts, classes)
        found = merge.counts(data, first, stop - first)
        np.add.at(total, np.array(owner)[part], found)

    for k, text in enumerate(texts):
        pieces = cut.split(text or "") if cut else [text or ""]
        total[k] += len(pieces) - 1
        for piece in pieces:
            if piece:
                parts.append(piece)
                owner.append(k)
                size += len(piece)
        if size >= STREAM:
            work()
            parts, owner, size = [], [], 0
    if parts:
        work()
    return total


def counted(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row: UTF-8 bytes, tokens as the tokenizer library counts them
    without added special tokens (special strings inside a text are one token), and whether there are over ``limit``.

    Null and empty texts have no tokens. Null or repeated ids are counted like any other; other columns are ignored.
    Texts of any length are counted whole. An empty table gives no rows. ``file`` must be readable on the executors.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.fromiter((len((t or "").encode()) for t in texts), np.int64, len(texts))
            tokens = count_tokens(texts, file)
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
