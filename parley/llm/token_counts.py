"""Token counts by rank-synchronous merging of many pre-tokens at once.

The pre-tokens of a stretch of texts that are not known yet are laid out as one
flat array of symbols with an array of row numbers (a ragged batch). In each round
every row finds the lowest rank among its neighbouring pairs, all rows join the
occurrences of their own lowest pair at the same time, and rows without a pair
leave the batch. The symbols that survive are counted.

Defined results: NULL texts count as empty (0 bytes, 0 tokens); special strings in
a text are one token each; texts of any length are read whole; repeated rows are
answered each; only id and text are read, so other columns may have any name; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parley.llm.bpe_files import NEWER_CLASS, SPACE, Vocabulary, byte_letters, file_text, has_newer, read_vocabulary
from parley.llm.common import keyed_texts, mapped

KEPT_WORDS = 300_000
KEPT_LENGTH = 64
BATCH_SYMBOLS = 1 << 20

_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_A = "\\t-\\r "
ASCII_CUT = re.compile(f"{_SUFFIXES}| ?[A-Za-z]+| ?[0-9]+| ?[^{_A}A-Za-z0-9]+|[{_A}]+(?![^{_A}])|[{_A}]+")
CUT = regex.compile(
    f"{_SUFFIXES}| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
CUT_NEWER = regex.compile(
    f"{_SUFFIXES}| ?[\\p{{L}}--[{NEWER_CLASS}]]+| ?[\\p{{N}}--[{NEWER_CLASS}]]+"
    f"| ?[[^{SPACE}\\p{{L}}\\p{{N}}]||[{NEWER_CLASS}]]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+",
    regex.V1,
)
NONE = np.int32(2**31 - 1)


class Merger:
    """Ranks of symbol pairs as sorted arrays, and the merging of ragged batches."""

    def __init__(self, vocabulary: Vocabulary):
        keys = np.fromiter(vocabulary.ranks, np.int64, len(vocabulary.ranks))
        ranks = np.fromiter(vocabulary.ranks.values(), np.int32, len(keys))
        self.made = np.array(vocabulary.made, np.int32)
        # A table of slots finds most pairs at the first look.
        self.bits = 18
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        rest = np.arange(len(keys))
        self.probes = 0
        home = self._home(keys)
        while len(rest):
            at = (home[rest] + self.probes) & ((1 << self.bits) - 1)
            open_ = self.slots[at] < 0
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(rest), bool)
            wins[first] = True
            wins &= open_
            self.slots[at[wins]], self.slot_rank[at[wins]] = keys[rest[wins]], ranks[rest[wins]]
            rest = rest[~wins]
            self.probes += 1
        byte = [vocabulary.tokens.get(x, -1) for x in byte_letters()]
        self.byte = np.array(byte, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is no merge."""
        keys = left.astype(np.int64) << 20 | right
        home = self._home(keys)
        found = np.full(len(keys), NONE, np.int32)
        open_ = np.arange(len(keys))
        for probe in range(self.probes):
            at = (home[open_] + probe) & ((1 << self.bits) - 1)
            held = self.slots[at]
            hit = held == keys[open_]
            found[open_[hit]] = self.slot_rank[at[hit]]
            open_ = open_[~hit & (held >= 0)]
            if not len(open_):
                break
        return found

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words)), size)
        known = symbols >= 0
        symbols, row = symbols[known], row[known]
        total = np.bincount(row, minlength=len(words))
        while len(symbols) > 1:
            rank = np.full(len(symbols), NONE, np.int32)
            near = np.flatnonzero(row[:-1] == row[1:])
            rank[near] = self.rank(symbols[near], symbols[near + 1])
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(row)])
            live = np.repeat(lowest != NONE, length)
            if not live.any():
                break
            hit = (rank == np.repeat(lowest, length)) & live
            at = np.flatnonzero(hit)
            # In a run of overlapping hits, as in "aaaa", every second one counts.
            new_run = np.r_[True, np.diff(at) > 1]
            place = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            np.subtract.at(total, row[at], 1)
            live[at + 1] = False
            symbols, row = symbols[live], row[live]
        return total


class Counter(dict):
    """Pre-token -> number of tokens; unknown ones are merged together, stretch by stretch."""

    def __init__(self, vocabulary: Vocabulary):
        self.merger = Merger(vocabulary)
        self.special = vocabulary.special_pattern
        self.old: dict[str, int] = {}

    def _cut(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_CUT.findall(text)
        return (CUT_NEWER if has_newer(text) else CUT).findall(text)

    def cut(self, text: str) -> tuple[int, list[str]]:
        """Number of special strings, and the pre-tokens between them."""
        if self.special is None or "<" not in text:
            return 0, self._cut(text)
        parts = self.special.split(text)
        return len(parts) - 1, [w for part in parts for w in self._cut(part)]

    def learn(self, words: set[str]) -> None:
        """Add the counts of unknown words."""
        open_, held = [], 0
        for word in words:
            open_.append(word)
            held += len(word)
            if held >= BATCH_SYMBOLS:
                self.update(zip(open_, self.merger.counts([w.encode() for w in open_]).tolist()))
                open_, held = [], 0
        if open_:
            self.update(zip(open_, self.merger.counts([w.encode() for w in open_]).tolist()))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. Words of earlier stretches are kept in two tables of bounded size."""
        cuts = [self.cut(t or "") for t in texts]
        words = set().union(*(w for _, w in cuts))
        if len(self) + len(words) > KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        fresh = words.difference(self)
        again = {w: self.old[w] for w in fresh.intersection(self.old)}
        self.update(again)
        self.learn(fresh.difference(again))
        found = [special + sum(map(self.__getitem__, w)) for special, w in cuts]
        for word in fresh:
            if len(word) > KEPT_LENGTH:
                del self[word]
        return found


_counters: dict[int, Counter] = {}


def _counter(text: str) -> Counter:
    key = hash(text)
    if key not in _counters:
        _counters[key] = Counter(read_vocabulary(text))
    return _counters[key]


def token_counts(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text."""
    texts = keyed_texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(file_text(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                rows = piece.column("text").to_pylist()
                size = [len((t or "").encode()) for t in rows]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(size, pa.int64()), pa.array(counter.counts(rows), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return mapped(texts, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
