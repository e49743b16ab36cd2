import random
import re

import numpy as np
import pytest
from llm_helpers import read

from parley.llm import decontaminate


def plain_tiles(p, t, least):
    """Greedy string tiling by looking at all pairs of places."""
    mp, mt, out = [False] * len(p), [False] * len(t), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if not best:
            return sorted(out)
        k, i, j = best
        mp[i:i + k] = mt[j:j + k] = [True] * k
        out.append((i, j, k))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_plain_tiling(seed):
    r = random.Random(seed)
    size = r.choice([2, 3, 6, 30])
    p = [r.randint(1, size) for _ in range(r.randint(1, 40))]
    t = [r.randint(1, size) for _ in range(r.randint(1, 60))]
    s = r.randint(0, len(p))
    t = t + p[s:] + [99] + p[:s]
    least = r.choice([2, 3, 5])
    assert sorted(decontaminate.tiles(np.array(p, np.uint64), np.array(t, np.uint64), least)) == plain_tiles(p, t, least)


def words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub(decontaminate._WIDE_BREAKS, " ", (text or "").lower()))


def plain_pairs(docs, items):
    out = {}
    for d, text in docs:
        w = words(text)
        grams = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        for i, item in items:
            p = words(item)
            if len(p) >= 5 and any(tuple(p[k:k + 5]) in grams for k in range(len(p) - 4)):
                covered = sum(k for _, _, k in plain_tiles(p, w, 5))
                if covered >= 0.5 * len(p):
                    out[d, i] = (len(p), covered)
    return out


def test_equals_plain_search_on_edited_passages(shared):
    items = [tuple(r) for r in read(shared, "benchmark").select("item_id", "text").limit(8).collect()]
    items += [(900, None), (901, ""), (902, "too short"), (903, items[0][1])]
    r = random.Random(4)
    docs = [(1, None), (2, ""), (3, "nothing of the kind"), (4, "x" * 200_000)]
    for k, (_, text) in enumerate(items[:8]):
        parts = re.split(r"(?<=\.)\s+", text)
        r.shuffle(parts)
        docs.append((10 + k, "before it " + " -- ".join(parts).upper() + " after it"))
        w = text.split()
        docs.append((30 + k, " ".join(x if n % 9 else "changed" for n, x in enumerate(w))))
        docs.append((50 + k, " ".join(w[:len(w) // 3])))
    docs += [(None, items[1][1]), (77, items[2][1]), (77, items[2][1])]
    found = decontaminate.contaminated(
        shared.createDataFrame(docs, "doc_id long, text string"), shared.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = plain_pairs(docs, items)
    assert {(r.doc_id, r.item_id): (r.item_words, r.covered_words) for r in found} == want
    assert {10 + k for k in range(8)} <= {d for d, _ in want}
    assert sum(r.doc_id == 77 and r.item_id == items[2][0] for r in found) == 2


def test_blocks_of_items_change_nothing(shared, monkeypatch):
    docs, items = read(shared, "documents"), read(shared, "benchmark")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(decontaminate, "PIECE", 1 << 10)
    assert whole and sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == whole


def test_clean_keeps_the_others_with_all_columns(shared, odd_documents):
    items = shared.createDataFrame([(1, "The cat is on the mat and it was the best of all days")], "item_id long, text string")
    kept = decontaminate.clean(odd_documents, items)
    assert kept.columns == odd_documents.columns
    want = [r for r in odd_documents.collect() if r.doc_id not in (5, 6)]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want))


def test_empty_tables(shared, odd_documents):
    items = shared.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd_documents, items).count() == 0
    assert decontaminate.contaminated(odd_documents.limit(0), read(shared, "benchmark")).count() == 0


def test_long_repetitive_texts_take_bounded_memory_and_time():
    """80,000 equal words against 16 items of 60 equal words, and repeated phrases: no list of pairs of places."""
    import tracemalloc

    items = [np.full(60, 7, np.uint64)] * 16 + [np.tile(np.array([1, 2, 3, 4, 5, 6, 90 + k], np.uint64), 60) for k in range(4)]
    held = decontaminate.Items(list(range(len(items))), items)
    text = np.r_[np.full(80_000, 7, np.uint64), np.tile(np.array([1, 2, 3, 4, 5, 6, 8], np.uint64), 10_000)]
    tracemalloc.start()
    found = {item: sum(k for _, _, k in tiled) for item, tiled in held.matches(text, 0.5)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {**{k: 60 for k in range(16)}, **{16 + k: 360 for k in range(4)}}
    assert peak < 60_000_000


def test_short_items_and_long_tiles(shared):
    long = " ".join(f"w{k}" for k in range(300))
    items = [(1, "all is well"), (2, "yes"), (3, long), (4, "all is well")]
    docs = [
        (1, "All is well!"), (2, "so all is well now then"), (3, "we know that all is well here and there and so on"), (4, "yes"),
        (5, "yes no"), (6, "yes we said no"), (7, "before " + " ".join(f"w{k}" for k in range(100, 160)) + " after it"),
        (8, " ".join(f"w{k}" for k in range(100, 140)) + " and something else"), (9, None), (10, "well is all"),
    ]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(
        shared.createDataFrame(docs, "doc_id long, text string"), shared.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(1, 1), (1, 4), (2, 1), (2, 4), (4, 2), (5, 2), (7, 3)}


def test_extra_columns_with_clashing_names(shared):
    docs = shared.createDataFrame([(1, "a", "all is well")], "doc_id long, item_id string, text string")
    items = shared.createDataFrame([(1, "all is well", "x")], "item_id long, text string, doc_id string")
    assert decontaminate.contaminated(docs, items).count() == 1 and decontaminate.clean(docs, items).count() == 0
