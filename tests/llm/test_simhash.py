import random

import numpy as np
import pytest
import xxhash
from llm_helpers import read
from pyspark.sql import functions as F

from parley.llm import simhash


def plain_runs(text, size=4):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def plain_fingerprint(text, size=4):
    runs = plain_runs(text, size)
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(prints, most):
    prints = np.array(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= most
    label = np.arange(len(prints))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def plain_similar_of_each(rows, words=5, most=6, least=0.8, sketch=2):
    """(id, text) rows that stay: each text of a component compared with every smaller one."""
    label = plain_labels([plain_fingerprint(t, sketch) for _, t in rows], most) if rows else []
    texts = {}
    for (i, t), k in zip(rows, label):
        had = texts.get((k, t))
        texts[k, t] = i if had is None else had if i is None else min(i, had)
    kept, sets = [], {t: set(plain_runs(t, words)) for _, t in rows}
    for (k, t), i in texts.items():
        def smaller(other):
            return (texts[other] is None, texts[other] or 0, other[1] or "") < (i is None, i or 0, t or "")

        def alike(a, b):
            return len(a & b) >= least * len(a | b)

        if not any(o[0] == k and o[1] != t and smaller(o) and alike(sets[t], sets[o[1]]) for o in texts):
            kept.append((i, t))
    return kept


def plain_components(rows):
    """doc ids and fingerprints -> smallest id reachable, by comparing all pairs."""
    label = plain_labels([p for _, p in rows], simhash.MAX_DIFF)
    out = []
    for k in label:
        ids = [i for (i, _), other in zip(rows, label) if other == k and i is not None]
        out.append(min(ids, default=None))
    return out


def assert_plain(df):
    found = simhash.near_duplicates(df).collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
    want = sorted((str(i), format(p, "016x"), c) for (i, p), c in zip(prints, plain_components(prints)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == want
    return want


def test_equals_all_pairs(shared):
    want = assert_plain(read(shared, "documents"))
    assert any(i != str(c) for i, _, c in want)


def test_odd_rows(odd_documents):
    want = assert_plain(odd_documents)
    assert ("1", "0" * 16, 1) in want and ("2", "0" * 16, 1) in want


def test_empty_table(odd_documents):
    assert simhash.near_duplicates(odd_documents.limit(0)).count() == 0


def gray(value):
    for step in (1, 2, 4, 8, 16, 32):
        value ^= value >> step
    return value


@pytest.mark.parametrize("seed", range(8))
def test_tree_links_equal_all_pairs(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(rng.choice([1, 5, 60]))]
    near = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(300 // len(base))}
    fps = np.array(sorted(near, key=gray), np.uint64)
    left, right = (fps, fps) if seed % 2 else (fps[:len(fps) // 3], fps[len(fps) // 3:])
    label = simhash.links(left, right)
    members = [int(x) for x in np.concatenate([right, left])]

    def groups(pairs):
        top = {m: m for m in members}

        def find(m):
            while top[m] != m:
                m = top[m]
            return m

        for a, b in pairs:
            top[find(a)] = find(b)
        out = {}
        for m in top:
            out.setdefault(find(m), set()).add(m)
        return sorted(map(sorted, out.values()))

    pairs = [(int(a), int(b)) for a in left for b in right if (int(a) ^ int(b)).bit_count() <= simhash.MAX_DIFF]
    assert groups(zip(members, (members[k] for k in label))) == groups(pairs)


def test_gray_rank_of_neighbours_differs_in_one_bit(shared):
    rows = shared.range(64).selectExpr("id as fp").withColumn("place", simhash.gray_rank(F.col("fp")))
    order = [r.fp for r in rows.orderBy("place").collect()]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("nodes,keys", [(1000, 5), (10 ** 9, 15), (10 ** 12, 35)])
def test_any_two_near_fingerprints_share_a_key(nodes, keys):
    masks = simhash.band_masks(nodes)
    assert len(masks) == keys
    rng = random.Random(nodes)
    for _ in range(2000):
        flips = sum(1 << k for k in rng.sample(range(64), rng.randint(0, simhash.MAX_DIFF)))
        assert any(not flips & mask for mask in masks)


def test_more_bands_give_the_same(shared, monkeypatch):
    docs = read(shared, "documents")
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "BUCKET", 0)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.getrandbits(20)}" for w in words]


def similar_rows():
    """Groups of edited copies, exact copies, short, empty and missing texts."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.getrandbits(16)}" for _ in range(rng.randint(30, 300))]
        rows += [(len(rows) + k, " ".join(edited(rng, base, share))) for k, share in enumerate((0, 0, 0.005, 0.01, 0.02, 0.03, 0.2))]
    rows += [(900, None), (901, ""), (902, " "), (903, "one"), (904, "one"), (None, "one"), (None, rows[0][1]), (905, rows[0][1])]
    return rows


@pytest.mark.parametrize("slice_chars", [16_000_000, 2_000])
def test_one_similar_of_each(shared, monkeypatch, slice_chars):
    monkeypatch.setattr(simhash, "SLICE_CHARS", slice_chars)
    rows = similar_rows()
    kept = simhash.one_similar_of_each(shared.createDataFrame(rows, "doc_id long, text string"))
    found = [(r.doc_id, r.text) for r in kept.collect()]
    want = plain_similar_of_each(rows)
    if slice_chars > 10_000:
        assert sorted(found, key=repr) == sorted(want, key=repr)
    # Whatever the slices: nothing that stays is similar to another that stays, nothing goes without a similar smaller one.
    sets = {t: set(plain_runs(t, 5)) for _, t in rows}
    label = dict(zip([t for _, t in rows], plain_labels([plain_fingerprint(t, 2) for _, t in rows], simhash.WIDE_DIFF)))
    alike = lambda a, b: label[a] == label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    texts = [t for _, t in found]
    assert len(set(texts)) == len(texts)
    assert not any(alike(a, b) for k, a in enumerate(texts) for b in texts[:k])
    for i, t in rows:
        assert t in texts or any(o is not None and (i is None or o < i) and alike(t, u) for o, u in rows if u != t)


def test_one_similar_of_each_odd_rows(odd_documents):
    kept = simhash.one_similar_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(plain_similar_of_each(rows), key=repr)
    assert simhash.one_similar_of_each(odd_documents.limit(0)).count() == 0


def test_long_chains_and_stars(shared):
    chain = [(i + 1, i) for i in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    edges = shared.createDataFrame(chain + star + [(5000, 5001), (5001, 5000)], "a long, b long")
    found = dict(tuple(r) for r in simhash.components(edges).collect())
    assert all(found[i] == 0 for i in range(1, 201)) and all(found[1000 + k] == 1000 for k in range(1, 300))
    assert found[5001] == 5000


def test_buckets_beyond_a_block_keep_all_links(shared, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = random.Random(5)
    core = rng.getrandbits(64)
    prints = {core ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for _ in range(250)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = shared.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.block_pairs(simhash.blocks(nodes)).mapInArrow(simhash._linked, "a long, b long")
    found = dict(tuple(r) for r in simhash.components(edges).collect())
    want = plain_components([(p, p & (1 << 64) - 1) for p in signed])
    assert [found.get(p, p) for p in signed] == want


def test_one_of_each_group_stays(odd_documents):
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 6 not in ids and ids.count(8) == 1 and ids.count(5) == 1


def test_rows_are_kept_by_id_and_text(shared):
    """One id on two texts (one of them a copy of a smaller id), and NULL ids in components with and without an id."""
    rng = random.Random(3)
    alone, copied, nameless, near_id = (" ".join(f"w{rng.getrandbits(30)}" for _ in range(80)) for _ in range(4))
    for extra in range(3):  # whichever of the two texts a hash puts first
        rows = [(1, copied, extra), (7, alone, extra), (7, copied, extra), (None, nameless, extra), (None, nameless, extra + 1),
                (None, near_id, extra), (9, near_id, extra), (None, copied, extra)]
        kept = simhash.one_of_each(shared.createDataFrame(rows, "doc_id long, text string, extra long"))
        found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert found == sorted([(1, copied), (7, alone), (9, near_id), (None, nameless)], key=str)
