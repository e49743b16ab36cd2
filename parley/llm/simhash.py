"""SimHash near-duplicates through a hierarchical index over Gray-ordered fingerprints.

1. Each document gets a 64-bit fingerprint: the majority of the XXH64 bits of its
   word shingles. Equal fingerprints are reduced to one node, so a group of exact
   copies costs one row from here on, however large it is.
2. Fingerprints within `MAX_DIFF` bits agree on at least one of MAX_DIFF + 1 bands
   of bits, on two of MAX_DIFF + 2, on three of MAX_DIFF + 3. By the number of nodes
   one, two or three bands make a key, so that about `BUCKET` nodes share one. Each
   node is sent to its keys; rows of one key form a bucket.
3. Range partitioning by (band, value, Gray rank) sorts the buckets, and a task
   cuts its rows into blocks of at most `BLOCK` neighbours. A bucket of any size
   thus spreads over many tasks. Two blocks of a bucket meet only if the bits that
   each of them shares throughout differ in at most MAX_DIFF places.
4. Inside two blocks the index works: neighbours in Gray order form groups, groups
   form groups, and each upper node keeps the mask and pattern of the bits its
   members share beyond those of its parent. A search adds up differences on the
   way down and leaves a whole group as soon as they exceed MAX_DIFF, or links a
   whole group at once when they cannot exceed it any more.
5. Blocks give spanning links, not pairs. Connected components of these links are
   found by alternating star operations over written tables.

`one_similar_of_each` keeps one document of each group of similar ones. Its candidates
are the components of wider links between fingerprints of word pairs (`SKETCH` words:
a changed word costs two of them, but five shingles of five words, so similar texts
lie closer); a document goes when a smaller one of its component has at least
`SIMILAR` of the `WORDS`-word shingles in common (Jaccard). A component is compared in slices of bounded size, then
what is left of it slice against slice, so no task holds a component. Only texts of
components with different texts are moved.

Defined results: NULL or empty texts have fingerprint 0 and link like any other;
texts below one shingle use their whole word sequence; texts of any length are read
whole; a NULL id is never the id of a component (NULL when no member has one);
repeated rows are answered each; texts without a word are similar to each other; only
id and text are looked at, and the functions that return documents keep all columns
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.llm.common import free_name, keyed_texts, mapped
from parley.operators.keyed import broadcast_if_small
from parley.session import written

SHINGLE = 4
SEED = 42
MAX_DIFF = 4
BLOCK = 1024
FANOUT = 8
#: Nodes that may share a key before keys of more bands are used.
BUCKET = 8 * BLOCK
#: For keeping one of each group of similar documents: shingles and similarity, and words of a
#: fingerprint's shingles and differing bits of its candidates.
WORDS = 5
SIMILAR = 0.8
SKETCH = 2
WIDE_DIFF = 6
#: Characters of the texts that a task compares with each other.
SLICE_CHARS = 16_000_000


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `size` words, A-Z lower-cased; of the whole sequence when shorter."""
    # bytes.lower and bytes.split know ASCII letters and the six ASCII blanks only.
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        whole = [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
        return np.array(whole, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    found = [digest(line[s:e - 1], SEED) for s, e in zip(starts, ends[size - 1:])]
    return np.array(found, np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bits set in over half the shingle hashes, as a signed 64-bit number."""
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE
) -> DataFrame:
    """One row (doc_id, fp, text_hash, chars) per input row."""
    texts = keyed_texts(docs, id_col, text_col).withColumns({
        "text_hash": F.xxhash64("text"), "chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint"),
    })
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(found, pa.int64()), batch.column("text_hash"), batch.column("chars")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "text_hash", "chars"])

    return mapped(texts, run, f"doc_id {kind}, fp bigint, text_hash bigint, chars bigint")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the Gray sequence, unsigned order kept by flipping the top bit."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def band_masks(nodes: int, most: int = MAX_DIFF) -> list[int]:
    """Masks of bits, one of which any two fingerprints within `most` bits agree under.

    `most` differing bits touch at most that many of `most` + k pieces, so k pieces are
    equal. More pieces give keys that fewer nodes share, but more of them.
    """
    for agree in (1, 2, 3):
        pieces = most + agree
        cuts = [64 * k // pieces for k in range(pieces + 1)]
        parts = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
        masks = [sum(chosen) for chosen in combinations(parts, agree)]
        if nodes <= BUCKET << min(mask.bit_count() for mask in masks):
            break
    return masks


def _band_keys(fp: Column, masks: list[int]) -> Column:
    keys = [
        F.struct(F.lit(b).alias("band"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")).alias("value"))
        for b, mask in enumerate(masks)
    ]
    return F.explode(F.array(*keys))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbours with one band value, from rows sorted by band, value and Gray rank."""
    open_key, open_rows, done = None, [], []

    def block():
        ranks, fps = zip(*open_rows)
        f = np.array(fps, np.int64).view(np.uint64)
        both = np.bitwise_and.reduce(f)
        shared = both | ~np.bitwise_or.reduce(f)
        done.append((*open_key, ranks[0], list(fps), int(both.view(np.int64)), int(shared.view(np.int64))))

    def out():
        names = ("band", "value", "place", "fps", "pattern", "mask")
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        columns = list(zip(*done)) or [()] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("band", "value", "place", "fp"))
        for band, value, place, fp in zip(*columns):
            if (band, value) != open_key or len(open_rows) >= BLOCK:
                if open_rows:
                    block()
                    open_rows.clear()
                open_key = (band, value)
            open_rows.append((place, fp))
        if len(done) >= 512:
            yield out()
    if open_rows:
        block()
    yield out()


def blocks(nodes: DataFrame, most: int = MAX_DIFF) -> DataFrame:
    """Blocks of the distinct fingerprints `nodes.fp`, per band value, in Gray order."""
    masks = band_masks(nodes.count(), most)
    rows = nodes.select("fp", gray_rank(F.col("fp")).alias("place"), _band_keys(F.col("fp"), masks).alias("k"))
    rows = rows.select("k.band", "k.value", "place", "fp")
    ordered = rows.repartitionByRange("band", "value", "place").sortWithinPartitions("band", "value", "place")
    return mapped(
        ordered,
        _cut, "band int, value bigint, place bigint, fps array<bigint>, pattern bigint, mask bigint"
    )


class GrayTree:
    """Groups of FANOUT neighbours in Gray order, level on level up to a few top nodes."""

    def __init__(self, fps: np.ndarray):
        self.size = len(fps)
        both, either, spans = fps, fps, np.arange(len(fps) + 1)
        levels = [(both, ~np.zeros_like(fps), spans)]
        while len(both) > FANOUT:
            cuts = np.arange(0, len(both), FANOUT)
            both, either = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(either, cuts)
            spans = np.append(spans[:-1][cuts], len(fps))
            levels.append((both, both | ~either, spans))
        self.levels = levels[::-1]  # from the top down: pattern, mask of shared bits, spans of members
        # What a node shares beyond its parent; the parent's bits are already accounted for.
        self.own = [self.levels[0][1]]
        for (_, above, _), (_, mask, _) in zip(self.levels, self.levels[1:]):
            self.own.append(mask & ~np.repeat(above, FANOUT)[:len(mask)])

    def search(self, queries: np.ndarray, most: int = MAX_DIFF) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, first member, end of members) for groups that lie within `most` bits as a whole."""
        top = len(self.levels[0][0])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        spent = np.zeros(len(q), np.int64)
        for depth, (pattern, mask, spans) in enumerate(self.levels):
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & self.own[depth][node])
            near = spent <= most
            q, node, spent = q[near], node[near], spent[near]
            whole = spent + np.bitwise_count(~mask[node]) <= most
            if whole.any():
                yield q[whole], spans[node[whole]], spans[node[whole] + 1]
            q, node, spent = q[~whole], node[~whole], spent[~whole]
            if depth + 1 == len(self.levels) or not len(q):
                return
            below = len(self.levels[depth + 1][0])
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            real = child < below
            q, node, spent = (np.repeat(x, FANOUT)[real] for x in (q, node, spent))
            node = child[real]


def links(left: np.ndarray, right: np.ndarray, most: int = MAX_DIFF) -> np.ndarray:
    """Spanning links between fingerprints of two blocks that lie within `most` bits.

    Members are numbered through, those of `right` first. Returns for each member
    the smallest member it is connected with.
    """
    label = np.arange(len(right) + len(left))
    ends = []
    covered = np.zeros(len(right) + 1, np.int64)  # members k and k + 1 belong to one linked group
    tree = GrayTree(right)
    for at in range(0, len(left), 256):
        for q, first, end in tree.search(left[at:at + 256], most):
            ends.append(np.stack([q + at + len(right), first]))
            np.add.at(covered, first, 1)
            np.add.at(covered, end - 1, -1)
    inside = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
    ends.append(np.stack([inside + 1, inside]))
    a, b = np.concatenate(ends, axis=1)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def _linked_within(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column("left_fps"), batch.column("right_fps")):
                own = not right.is_valid
                x = np.asarray(left.values, np.int64)
                y = x if own else np.asarray(right.values, np.int64)
                label = links(x.view(np.uint64), y.view(np.uint64), most)
                members = np.concatenate([y, x])
                moved = np.flatnonzero(members != members[label])
                a.append(members[moved])
                b.append(members[label[moved]])
            columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in (a, b)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return run


_linked = _linked_within(MAX_DIFF)


def block_pairs(cut: DataFrame, most: int = MAX_DIFF) -> DataFrame:
    """Each block by itself (`right_fps` NULL), and the pairs of blocks of one bucket that can hold a link."""
    alone = cut.select(F.col("fps").alias("left_fps"), F.lit(None).cast("array<bigint>").alias("right_fps"))
    heads = cut.select("band", "value", "place", "pattern", "mask")
    left, right = heads.alias("l"), heads.alias("r")
    differ = F.col("l.pattern").bitwiseXOR(F.col("r.pattern")).bitwiseAND(F.col("l.mask")).bitwiseAND(F.col("r.mask"))
    near = left.join(
        right,
        (F.col("l.band") == F.col("r.band")) & (F.col("l.value") == F.col("r.value"))
        & (F.col("l.place") < F.col("r.place")) & (F.bit_count(differ) <= most),
    ).select("l.band", "l.value", F.col("l.place").alias("lp"), F.col("r.place").alias("rp"))
    key = ["band", "value"]
    first = cut.select(*key, F.col("place").alias("lp"), F.col("fps").alias("left_fps"))
    second = cut.select(*key, F.col("place").alias("rp"), F.col("fps").alias("right_fps"))
    met = near.join(first, [*key, "lp"]).join(second, [*key, "rp"]).select("left_fps", "right_fps")
    return alone.unionByName(met)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of the component, for nodes of undirected `edges`.

    Large-star and small-star steps in turn: each hangs neighbours onto the smallest
    node nearby, until only stars are left. Every step is written, so a lost
    executor costs no more than one step.
    """
    def least(rows: DataFrame) -> DataFrame:
        """For each u the least of u and its neighbours v."""
        return rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def step(now: DataFrame, large: bool) -> DataFrame:
        if large:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            moved = both.join(least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            joined = now.join(least(now), "u")
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                joined.select("u", F.col("m").alias("v"))
            )
        return written(moved.where("u <> v").distinct(), "star")

    def state(rows: DataFrame):
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "star"
    )
    seen = None
    while (found := state(now)) != seen:
        seen = found
        now = step(step(now, True), False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _in_components(
    docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, most: int = MAX_DIFF
) -> DataFrame:
    """One row per document: doc_id, fp, text_hash, chars, root (smallest fp of the component), component_id."""
    prints = written(fingerprints(docs, id_col, text_col, size), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    cut = written(blocks(nodes, most), "blocks")
    edges = mapped(block_pairs(cut, most), _linked_within(most), "a bigint, b bigint")
    rooted = nodes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed), fingerprint (16 hex digits), component_id."""
    return _in_components(docs, id_col, text_col).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id, or of a hash where none has an id.

    A row is known by its id and the hash of its text, since ids may repeat with
    other texts or be missing; among rows equal in both any one stays.
    """
    found = _in_components(docs, id_col, text_col)
    names = [free_name(docs.columns, n) for n in ("_keep", "_hash", "_root", "_rank")]
    keep_id, text_hash, root, rank = names
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias(keep_id), F.col("text_hash").alias(text_hash), F.col("root").alias(root)
    ).distinct()
    same = F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.xxhash64(F.col(text_col)) == F.col(text_hash))
    order = W.partitionBy(root).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = docs.join(kept, same).withColumn(rank, F.row_number().over(order))
    return rows.where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two sets, sorted and without repeats, share at least that part of their union."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both)


_COMPARED = "root bigint, text_hash bigint, dropped boolean"


def _compared(words: int, least: float, across: bool):
    """Which texts of a sorted run of rows with one `part` are similar to an earlier one of it (of another slice)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, held = None, None, []
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("root", "part", "slice", "text_hash", "text"))
            for root, part, slice_, text_hash, text in zip(*columns):
                if (root, part) != now:
                    now, last = (root, part), None
                    held.clear()
                if text_hash == last:  # the same row again
                    continue
                last = text_hash
                own = np.unique(shingle_hashes(text, words))
                dropped = any(similar(own, other, least) for at, other in held if not across or at != slice_)
                held.append((slice_, own))
                out.append((root, text_hash, dropped))
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["root", "text_hash", "dropped"])

    return run


def _dropped_texts(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """(root, text_hash) of the texts that a smaller one of their component is similar to."""
    groups = texts.groupBy("root").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).where("n > 1")
    slices = F.ceil(F.col("chars") / F.lit(SLICE_CHARS)).cast("int")
    groups = groups.select("root", F.greatest(slices, F.lit(1)).alias("slices"))
    wanted = texts.drop("chars").join(groups, "root").withColumn("slice", F.pmod(F.xxhash64("text_hash"), F.col("slices")).cast("int"))
    wanted = written(wanted, "compared-texts")
    said = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))

    def placed(rows: DataFrame, across: bool) -> DataFrame:
        met = said.join(broadcast_if_small(rows), F.col("id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("text_hash")))
        ordered = met.select("root", "part", "slice", "first", "text_hash", "text").repartition("root", "part")
        ordered = ordered.sortWithinPartitions("root", "part", F.asc_nulls_last("first"), "text_hash")
        return written(mapped(ordered, _compared(words, least, across), _COMPARED), "compared")

    alone = placed(wanted.withColumn("part", F.col("slice").cast("string")), False)
    gone = alone.where("dropped").select("root", "text_hash")
    left = wanted.where("slices > 1").join(gone, ["root", "text_hash"], "left_anti")
    if not left.isEmpty():
        # Slice against slice: each text goes to the pairs of slices that hold its own.
        others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: k != F.col("slice"))
        pair = F.transform(others, lambda k: F.concat_ws(
            "-", F.least(k, F.col("slice")).cast("string"), F.greatest(k, F.col("slice")).cast("string")
        ))
        crossed = placed(left.withColumn("part", F.explode(pair)), True)
        gone = gone.unionByName(crossed.where("dropped").select("root", "text_hash").distinct())
    return gone


def one_similar_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILAR,
    sketch: int = SKETCH, most: int = WIDE_DIFF,
) -> DataFrame:
    """Documents without those that a smaller document (by id) of their component is similar to.

    Rows of one text are one document, known by the smallest id and the hash of the
    text; of rows equal in both any one stays. Documents are joined once with the
    narrow list of what is kept; only rows that repeat are ranked.
    """
    found = _in_components(docs, id_col, text_col, sketch, most)
    texts = written(
        found.groupBy("root", "text_hash").agg(F.min("doc_id").alias("first"), F.max("chars").alias("chars")), "texts"
    )
    gone = _dropped_texts(docs, texts, id_col, text_col, words, least)
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("text_hash") == F.col("kept_hash"))
    kept = texts.join(gone, ["root", "text_hash"], "left_anti").select("first", F.col("text_hash").alias("kept_hash"))
    kept = written(rows.join(kept, same).select("first", "kept_hash", "rows"), "kept")
    first, kept_hash, rank = (free_name(docs.columns, name) for name in ("_first", "_hash", "_rank"))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def joined(side: DataFrame) -> DataFrame:
        side = side.select(F.col("first").alias(first), F.col("kept_hash").alias(kept_hash))
        return docs.join(side, F.col(id_col).eqNullSafe(F.col(first)) & (F.xxhash64(F.col(text_col)) == F.col(kept_hash)))

    order = W.partitionBy(first, kept_hash).orderBy(F.xxhash64(*columns))
    repeated = joined(broadcast_if_small(kept.where("rows > 1"))).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return joined(kept.where("rows = 1")).select(*columns).unionByName(repeated.select(*columns))
