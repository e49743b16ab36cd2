"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased; each becomes a 64-bit number.
A document and a benchmark item are compared when they share a seed, a run of
`SEED` equal words: the seeds of all items are looked up among the running hashes
of each document. For such a pair, running Karp-Rabin hashes of falling length find
the longest matching runs among unmarked words, these are marked as tiles, and so
on until no run of `SEED` words is left. Tiles do not overlap, but may lie in any
order, so a passage whose parts were moved about is still covered. A document is
contaminated by an item when its tiles cover `THRESHOLD` of the item's words, or one
tile has `LONG_TILE` words.

Seeds are looked up once each, however often they occur in a document or an item, and
a pair goes on only if the seeds it shares could cover enough: memory is linear in
the words of a document and of a block of items.

The items are a stated query set against all documents: they are read in blocks of
bounded size and sent to the tasks block by block. Documents are not moved.

Defined results: NULL or empty texts match nothing; an item of fewer than `SEED`
words contaminates the documents that hold all of it in a row and of whose words it
is at least `THRESHOLD`; repeated documents or items give a row each; texts of any
length are read whole; `contaminated` reads id and text only and `clean` keeps all
other columns whatever their names; empty tables give an empty result; runs of the
same length are marked from the front of the item, then of the document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.common import keyed_texts, mapped

SEED = 5
THRESHOLD = 0.5
LONG_TILE = 50
BLOCK_CHARS = 4_000_000
PIECE = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_B, _B_INV = np.uint64(_MULTIPLIER), np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
#: Letters and digits of ASCII, and every byte of a longer character.
_IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: Blanks and punctuation beyond ASCII.
_WIDE_BREAKS = re.compile("[\u00a0\u00a1-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")
_FILTER_BITS = 22


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_table = (_powers(_B, PIECE), _powers(_B_INV, PIECE))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _table
    if n > len(_table[0]):
        _table = (_powers(_B, n), _powers(_B_INV, n))
    return _table


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _folded(text: str | None) -> bytes:
    text = (text or "").lower()
    return (text if text.isascii() else _WIDE_BREAKS.sub(" ", text)).encode()


def _hash_words(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words, where each starts); long input is taken in pieces cut between words."""
    numbers, places = [], []
    letters = np.frombuffer(line, np.uint8)
    inside = _IN_WORD[letters]
    at = 0
    while at < len(letters):
        end = min(at + PIECE, len(letters))
        if end < len(letters) and inside[end - 1] and inside[end]:
            gaps = np.flatnonzero(~inside[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a piece
                rest = np.flatnonzero(~inside[end:])
                end = end + int(rest[0]) if len(rest) else len(letters)
        up, down = _power_tables(end - at)
        edge = np.diff(np.r_[np.int8(0), inside[at:end].view(np.int8), np.int8(0)])
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum((letters[at:end].astype(np.uint64) + np.uint64(1)) * up[:end - at], out=sums[1:])
        numbers.append(_mix((sums[ends] - sums[starts]) * down[starts]))
        places.append(starts + at)
        at = end
    if not numbers:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(numbers), np.concatenate(places)


class Running:
    """Karp-Rabin hashes of all runs of any length of a row of words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.up, self.down = _power_tables(len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[:len(words)], out=self.sums[1:])

    def runs(self, size: int) -> np.ndarray:
        """Hash of each `size` words in a row."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[:n])

    def free_runs(self, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs without a marked word."""
        hashes = self.runs(size)
        if not len(hashes):
            return np.empty(0, np.int64), hashes
        taken = np.r_[0, np.cumsum(marked)]
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return at, hashes[at]


def _known(sorted_hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted hashes are among the sorted ones."""
    if not len(sorted_hashes):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return sorted_hashes[at] == wanted


def _longest(p: Running, t: Running, p_marked: np.ndarray, t_marked: np.ndarray, least: int, most: int) -> int:
    """The greatest length from `least` to `most` of an unmarked run that both have, 0 without one."""
    def shared(size: int) -> bool:
        return bool(_known(np.sort(p.free_runs(p_marked, size)[1]), t.free_runs(t_marked, size)[1]).any())

    if most < least or not shared(least):
        return 0
    if shared(most):
        return most
    low, high = least, min(2 * least, most)  # a run of `low` words is shared; `high` is raised until none is
    while high < most and shared(high):
        low, high = high, min(2 * high, most)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if shared(middle) else (low, middle)
    return low


def _mark(p: Running, t: Running, p_marked: np.ndarray, t_marked: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Mark the runs of the given length that both have, from the front of p, then of t."""
    at_p, hash_p = p.free_runs(p_marked, size)
    at_t, hash_t = t.free_runs(t_marked, size)
    order = np.argsort(hash_t, kind="stable")
    at_t, hash_t = at_t[order], hash_t[order]
    low, high = np.searchsorted(hash_t, hash_p, "left"), np.searchsorted(hash_t, hash_p, "right")
    out, passed = [], {}
    for k in np.flatnonzero(low < high).tolist():
        i, begin, end = int(at_p[k]), int(low[k]), int(high[k])
        if p_marked[i:i + size].any():
            continue
        at = passed.get(begin, begin)  # places in t that are marked stay so
        while at < end:
            j = int(at_t[at])
            if not t_marked[j:j + size].any() and (p.words[i:i + size] == t.words[j:j + size]).all():
                p_marked[i:i + size] = t_marked[j:j + size] = True
                out.append((i, j, size))
                at += int(np.searchsorted(at_t[at:end], j + size))
                break
            at += 1
        passed[begin] = at
    return out


def tiles(p: np.ndarray, t: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (place in p, place in t, length), longest first."""
    p_marked, t_marked = np.zeros(len(p), bool), np.zeros(len(t), bool)
    running_p, running_t = Running(p), Running(t)
    out, size = [], min(len(p), len(t))
    while size := _longest(running_p, running_t, p_marked, t_marked, least, size):
        out += _mark(running_p, running_t, p_marked, t_marked, size)
        size -= 1
    return out


@dataclass
class Items:
    """A block of benchmark items as numbers, with their distinct seeds sorted by hash."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self):
        seeds = [Running(w).runs(SEED) for w in self.words]
        count = [len(s) for s in seeds]
        self.seeds, number = np.unique(np.concatenate([*seeds, np.empty(0, np.uint64)]), return_inverse=True)
        item = np.repeat(np.arange(len(seeds)), count)
        pairs = np.unique(np.stack([number.ravel(), item], axis=1), axis=0) if len(item) else np.empty((0, 2), np.int64)
        self.holders = pairs[:, 1]  # items of the first seed, of the second, ...
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.seeds) + 1))
        self.own = np.split(number.ravel(), np.cumsum(count)[:-1]) if count else []  # seed numbers of each item by place
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True
        self.short: dict[tuple[int, ...], list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < SEED:
                self.short.setdefault(tuple(w.tolist()), []).append(k)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the seed) of the seeds of any item in a row of words."""
        runs = Running(words).runs(SEED)
        at = np.flatnonzero(self.maybe[runs >> np.uint64(64 - _FILTER_BITS)])
        at = at[_known(self.seeds, runs[at])]
        return at, np.searchsorted(self.seeds, runs[at])

    def candidates(self, present: np.ndarray) -> list[int]:
        """Items that hold any of the distinct seeds."""
        count = self.first[present + 1] - self.first[present]
        place = np.repeat(self.first[present] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return np.unique(self.holders[place]).tolist()

    def matches(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(item, tiles) of the items that the words cover."""
        yield from self._short_matches(words, threshold)
        at, seed = self.hits(words)
        if not len(at):
            return
        present = np.unique(seed)
        held = np.zeros(len(self.seeds), bool)
        held[present] = True

        def enough(covered: int, longest: int, size: int) -> bool:
            return covered >= threshold * size or longest >= LONG_TILE

        for item in self.candidates(present):
            p = self.words[item]
            # Tiles consist of seeds: no more than their union can be covered, nor outside of it.
            reach = _spread(np.flatnonzero(held[self.own[item]]), len(p))
            if not enough(int(reach.sum()), _longest_true(reach), len(p)):
                continue
            inside = _spread(at[np.isin(seed, self.own[item])], len(words))
            places = np.flatnonzero(inside)
            gap = np.flatnonzero(np.diff(places) > 1) + 1
            t = np.insert(words[places], gap, _ABSENT)
            back = np.insert(places, gap, -1)
            found = [(a, int(back[b]), k) for a, b, k in tiles(p, t)]
            if found and enough(sum(k for _, _, k in found), max(k for _, _, k in found), len(p)):
                yield item, found

    def _short_matches(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Items too short for a seed, where they are a large part of the document."""
        if not self.short or not len(words) or len(words) * threshold > SEED - 1:
            return
        row = words.tolist()
        for size in range(1, min(SEED, len(row) + 1)):
            if size < threshold * len(row):
                continue
            met: set[int] = set()
            for j in range(len(row) - size + 1):
                for item in self.short.get(tuple(row[j:j + size]), ()):
                    if item not in met:
                        met.add(item)
                        yield item, [(0, j, size)]


def _longest_true(inside: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    return int((edge[1::2] - edge[::2]).max(initial=0))


_ABSENT = np.uint64(0)


def _spread(starts: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in the seeds that start at the places given."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + SEED, -1)
    return np.cumsum(change)[:size] > 0


_blocks: dict[str, Items] = {}


def _items(key: str, rows: list[tuple]) -> Items:
    """The worker's copy of a block; only the latest is kept."""
    if key not in _blocks:
        _blocks.clear()
        _blocks[key] = Items([i for i, _ in rows], [_hash_words(_folded(t))[0] for _, t in rows])
    return _blocks[key]


def _found(items: Items, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, list]]:
    """(row, item, tiles) of a list of texts; short texts are hashed together."""
    lines, held, first = [], 0, 0
    for row, text in enumerate([*texts, None]):
        if row == len(texts) or held > PIECE // 2:
            numbers, places = _hash_words(b"\n".join(lines))
            ends = np.cumsum([len(x) + 1 for x in lines])
            cut = np.searchsorted(places, ends)
            for k, (a, b) in enumerate(zip(np.r_[0, cut[:-1]], cut)):
                for item, tiled in items.matches(numbers[a:b], threshold):
                    yield first + k, item, tiled
            lines, held, first = [], 0, row
        if row < len(texts):
            lines.append(_folded(text))
            held += len(lines[-1])


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_CHARS))
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block)
        yield sorted((tuple(r) for r in part.collect()), key=repr)


def _mapped(docs: DataFrame, rows: list[tuple], work: Callable, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    key = f"{shared._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(key, shared.value)
        for batch in batches:
            yield work(items, batch)

    return mapped(docs, run, schema)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, tiles) of the contaminated documents.

    `tiles` lists place in the item, place in the document and length, in words.
    """
    texts = keyed_texts(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", texts.schema["doc_id"].dataType),
        T.StructField("item_id", benchmark.schema[item_col].dataType),
        T.StructField("item_words", T.LongType()), T.StructField("covered_words", T.LongType()),
        T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.StringType()),
    ])
    arrow_schema = to_arrow_schema(schema)

    def work(items: Items, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, item_ids, size, covered, shown = [], [], [], [], []
        for row, item, tiled in _found(items, batch.column("text").to_pylist(), threshold):
            rows.append(row)
            item_ids.append(items.ids[item])
            size.append(len(items.words[item]))
            covered.append(sum(k for _, _, k in tiled))
            shown.append(",".join(f"{a}:{b}:{k}" for a, b, k in sorted(tiled)))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
            "item_id": item_ids, "item_words": size, "covered_words": covered,
            "coverage": [c / s for c, s in zip(covered, size)], "tiles": shown,
        }, schema=arrow_schema)

    found = [
        _mapped(texts, rows, work, schema) for rows in _item_blocks(benchmark, item_col, item_text_col)
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows whose text no item contaminates, with all their columns; rows stay where they are."""
    def work(items: Items, batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, bool)
        for row, _, _ in _found(items, batch.column(text_col).to_pylist(), threshold):
            keep[row] = False
        return batch.filter(pa.array(keep))

    for rows in _item_blocks(benchmark, item_col, item_text_col):
        docs = _mapped(docs, rows, work, docs.schema)
    return docs
