"""BPE encoding and decoding with the merges of a tokenizer file.

A text is split at special strings, composed (NFC), lower-cased letter by letter
and cut into pre-tokens. The symbols of a pre-token form a doubly linked list; a
priority queue holds the ranks of its neighbouring pairs. The lowest rank is
taken, its pair joined, the two new neighbour pairs queued; an entry whose pair
no longer stands at its place is stale and skipped. Decoding looks each id up and
joins the vocabulary strings by blanks, as the file names no decoder.

The file is read by the driver (its size is that of a vocabulary) and broadcast;
each Python worker parses it once and keeps the answers for short pre-tokens in a
table of bounded size.

Defined results: NULL texts count as empty and give no ids and an empty decoded
text; texts of any length are read whole; repeated rows are answered each; only id
and text are read, so other columns may have any name; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parley.llm.bpe_files import (
    NEWER_CLASS, SPACE, Vocabulary, byte_letters, file_text, has_newer, lowered, read_vocabulary,
)
from parley.llm.common import keyed_texts, mapped

KEPT_WORDS = 200_000
KEPT_LENGTH = 48

_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: The same cuts; the first needs no Unicode tables.
ASCII_CUT = re.compile(f"{_SUFFIXES}|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")
CUT = regex.compile(f"{_SUFFIXES}|\\p{{L}}+|\\p{{N}}|[^{SPACE}\\p{{L}}\\p{{N}}]+")
CUT_NEWER = regex.compile(
    f"{_SUFFIXES}|[\\p{{L}}--[{NEWER_CLASS}]]+|[\\p{{N}}--[{NEWER_CLASS}]]|[[^{SPACE}\\p{{L}}\\p{{N}}]||[{NEWER_CLASS}]]+",
    regex.V1,
)


def join_symbols(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols after all merges, lowest rank first, leftmost first among equals.

    `ranks` maps a pair (left << 20 | right) to its rank, `made` a rank to the id of
    both together. Queue entries hold rank and place in one number.
    """
    n = len(symbols)
    ids = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    rank_of = ranks.get
    queue = []
    for i in range(n - 1):
        rank = rank_of(ids[i] << 20 | ids[i + 1])
        if rank is not None:
            queue.append(rank << 40 | i)
    heapify(queue)
    while queue:
        entry = heappop(queue)
        rank, i = entry >> 40, entry & 0xFFFFFFFFFF
        j = after[i]
        if j < 0 or ids[i] < 0 or rank_of(ids[i] << 20 | ids[j]) != rank:
            continue  # stale
        ids[i] = joined = made[rank]
        ids[j] = -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            right = rank_of(joined << 20 | ids[k])
            if right is not None:
                heappush(queue, right << 40 | i)
        h = before[i]
        if h >= 0:
            left = rank_of(ids[h] << 20 | joined)
            if left is not None:
                heappush(queue, left << 40 | h)
    return [x for x in ids if x >= 0]


class Encoder(dict):
    """Pre-token -> packed ids, worked out on first use.

    Two tables of bounded size: when this one is full it becomes the old one, from
    which words that are still in use come back.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.special = vocabulary.special_pattern
        self.old: dict[str, bytes] = {}
        letters = byte_letters()
        self.inner = [vocabulary.tokens.get(x) for x in letters]
        self.last = [vocabulary.tokens.get(x + vocabulary.word_end) for x in letters]

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            raw = word.encode()
            symbols = [*[self.inner[b] for b in raw[:-1]], self.last[raw[-1]]]
            ids = join_symbols([s for s in symbols if s is not None], self.vocabulary.ranks, self.vocabulary.made)
            packed = pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = ASCII_CUT.findall(text.lower())
        else:
            text = lowered(unicodedata.normalize("NFC", text))
            words = (CUT_NEWER if has_newer(text) else CUT).findall(text)
        return b"".join([self[w] for w in words])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts, at = [], 0
        for found in self.special.finditer(text):
            parts.append(self._plain(text[at:found.start()]))
            parts.append(pack("<I", self.vocabulary.special[found.group()]))
            at = found.end()
        return b"".join([*parts, self._plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        strings = self.vocabulary.strings
        return " ".join([strings[i] for i in np.frombuffer(packed, "<u4").tolist()])


_encoders: dict[int, Encoder] = {}


def _encoder(text: str) -> Encoder:
    """The worker's encoder for this file."""
    key = hash(text)
    if key not in _encoders:
        _encoders[key] = Encoder(read_vocabulary(text))
    return _encoders[key]


def _mapped(docs: DataFrame, file: str, work: Callable, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(file_text(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            yield from work(encoder, batch)

    return mapped(docs, run, schema)


def _pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in short stretches, so that results of one stretch only are held."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids packed as little-endian unsigned 32-bit numbers."""
    def work(encoder: Encoder, batch: pa.RecordBatch):
        for piece in _pieces(batch):
            ids = [encoder.encode(t) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    texts = keyed_texts(docs, id_col, text_col)
    return _mapped(texts, file, work, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """(doc_id, decoded) from the rows of `encode`; NULL ids decode to an empty text."""
    def work(encoder: Encoder, batch: pa.RecordBatch):
        for piece in _pieces(batch):
            texts = [encoder.decode(i or b"") for i in piece.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return _mapped(rows, file, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")


def encode_and_decode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) in one pass over the texts."""
    def work(encoder: Encoder, batch: pa.RecordBatch):
        for piece in _pieces(batch):
            ids = [encoder.encode(t) for t in piece.column("text").to_pylist()]
            decoded = [encoder.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    texts = keyed_texts(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return _mapped(texts, file, work, f"doc_id {kind}, ids binary, decoded string")
