"""Conversation prefix trie: double arrays per prefix shard, shared upper nodes merged globally.

A node is a distinct sequence of first turns (role and text) of a conversation. Its
number is the exclusive or of 64-bit hashes of (turn, place), twice with different
seeds; so the numbers of a conversation's nodes are running sums, which a range sort
over (conversation, turn) and carried totals give without holding a conversation, and
a node's parent is found by taking its last turn out again.

Conversations that are equal as a whole go on as one, with their count. A node with
more than `SHARD_ROWS` turns at and below it is an upper node; the first node of a
conversation that is none starts a prefix, and prefixes are dealt to shards of about
that many turns. A shard numbers its turns densely, packs its sequences into BASE and
CHECK arrays, walks them for members and sums its subtrees; all that lies below a
prefix lies in one shard. Upper nodes are shared by shards: their members are counted
by grouped aggregation, what shards hand up is added to the upper node above them,
and sums over the upper tree double their reach in each round, so the number of
rounds is the logarithm of its depth.

A turn, a first turn or a conversation that most rows share is counted before it is
sent, and dealt over many tasks where rows meet it. The list of conversations that
end at a node is hashed in order of their ids: a digest needs all of them one after
the other, so the ids of one node pass through one task, which holds none of them.

Defined results: a NULL role or text is empty; rows are ordered by turn, NULL first,
then by a hash of role and text; repeated rows are turns of their own; rows without
conversation id form one conversation that borrows no turns, counts as a member and
is neither a node's smallest member (NULL if it is the only one) nor in its list of
ends; texts of any length are reduced to a hash and a word count; extra columns are
not read; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.common import mapped, salted_left_join
from parley.session import written

SHARD_ROWS = 20_000
#: A key with more than one row in so many is dealt over many tasks.
HOT = 1000
#: Conversations borrow their first turns from the first one of their group.
GROUP, HEADS = 20, 4
#: Stands for a missing conversation id inside: the greatest, so it is never the smallest member.
NOBODY = 2**63 - 1

NODE = ["z1", "z2"]


def _mark(key: Column, place: Column, seed: int) -> Column:
    return F.xxhash64(key, place.cast("bigint"), F.lit(seed))


def _turn_mark(seed: int) -> Callable[[Column], Column]:
    return lambda turn: _mark(turn["key"], turn["pos"], seed)


def _joined(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0).cast("bigint"))


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(turns with their place in the conversation, turns per conversation and range partition)."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = turns.select(
        F.coalesce(F.col(conv).cast("bigint"), F.lit(NOBODY)).alias("c"), F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(said[0]).cast("string"), F.lit(":"), *said))).alias("key"),
        F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    ).withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc("c"), F.asc_nulls_first("turn"), F.asc("key"), F.asc("tie")]
    rows = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "c", "key", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")
        ),
        "trie-lines",
    )
    earlier = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("c", "part").agg(F.count("*").alias("n"))
    parts = written(parts.withColumn("n0", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-parts")
    here = W.partitionBy("c", "part").orderBy("line")
    rows = rows.withColumn("k", F.row_number().over(here) - 1).join(parts.drop("n"), ["c", "part"])
    return written(rows.select("c", "part", "line", "key", "words", (F.col("n0") + F.col("k")).alias("pos")), "trie-placed"), parts


def _borrowed(c: Column, heads: int) -> Column:
    """How many first turns a conversation takes from its group's first one."""
    drawn = F.crc32(c.cast("string").cast("binary")) % heads
    return F.when(c == NOBODY, F.lit(0)).otherwise(drawn).cast("int")


def rebuilt(
    turns: DataFrame, group: int = GROUP, heads: int = HEADS, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations as nodes, conversations).

    A conversation c takes the first h turns of c - c % group, h = crc32(c) % heads,
    and goes on with its own turns after its first h; `heads=1` leaves all as they are.
    """
    placed, parts = _placed(turns, conv, turn, role, text)
    first = placed.where((F.col("c") % group == 0) & (F.col("pos") < heads - 1) & (F.col("c") != NOBODY))
    first = first.groupBy(F.col("c").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("given")
    )
    convs = parts.groupBy("c").agg(F.sum("n").alias("own")).withColumns({
        "h": _borrowed(F.col("c"), heads), "base": F.col("c") - F.col("c") % group,
    })
    head = F.slice("given", F.lit(1), F.col("h"))
    convs = convs.join(first, "base", "left").withColumn(
        "head", F.when(F.col("given").isNull(), F.array().cast(first.schema["given"].dataType)).otherwise(head)
    )
    zero = F.lit(0).cast("bigint")
    convs = written(
        convs.select(
            "c", "h", "head", F.size("head").alias("m"),
            *[F.aggregate(F.transform("head", _turn_mark(s)), zero, lambda a, x: a.bitwiseXOR(x)).alias(f"h{s}") for s in (1, 2)],
        ),
        "trie-conversations",
    )
    so_far = W.partitionBy("c").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)  # at most heads - 1 rows
    heads_in = convs.select("c", F.inline("head")).select(
        "c", "pos", "key", "words", *[F.bit_xor(_mark(F.col("key"), F.col("pos"), s)).over(so_far).alias(f"z{s}") for s in (1, 2)]
    )
    per_part = parts.select("c", "part").join(convs.drop("head"), "c")
    own = placed.join(per_part, ["c", "part"]).where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    own = own.withColumns({f"x{s}": _mark(F.col("key"), F.col("pos"), s) for s in (1, 2)})
    sums = own.groupBy("c", "part").agg(*[F.bit_xor(f"x{s}").alias(f"t{s}") for s in (1, 2)])
    earlier = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # Only a conversation that reaches over from the range partition before has a carry: at most one row a partition.
    carry = sums.select("c", "part", *[F.bit_xor(f"t{s}").over(earlier).alias(f"c{s}") for s in (1, 2)]).where("c1 IS NOT NULL")
    here = W.partitionBy("c", "part").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumns({f"x{s}": F.bit_xor(f"x{s}").over(here) for s in (1, 2)})
    own = own.join(F.broadcast(carry), ["c", "part"], "left").select(
        "c", "pos", "key", "words",
        *[F.col(f"h{s}").bitwiseXOR(_joined(f"c{s}")).bitwiseXOR(F.col(f"x{s}")).alias(f"z{s}") for s in (1, 2)],
    )
    rows = heads_in.unionByName(own).select("c", (F.col("pos") + 1).cast("bigint").alias("depth"), "key", "words", *NODE)
    return written(rows, "trie-turns"), convs.select("c")


class DoubleArray:
    """BASE and CHECK over dense symbols: the child of s by x lies at BASE[s] + x, where CHECK names s."""

    def __init__(self, paths: list[list[int]]):
        self.base, self.check = [0], [-2]  # slot 0 is the root; -1 marks a free slot
        self.free = 1
        order = sorted(range(len(paths)), key=paths.__getitem__)
        open_ = [(0, 0, len(order), 0)]
        while open_:
            slot, low, high, at = open_.pop()
            while low < high and len(paths[order[low]]) == at:
                low += 1
            if low == high:
                continue
            runs = [low]
            for k in range(low + 1, high):
                if paths[order[k]][at] != paths[order[k - 1]][at]:
                    runs.append(k)
            symbols = [paths[order[k]][at] for k in runs]
            base = self._room(symbols)
            self.base[slot] = base
            for x in symbols:
                self.check[base + x] = slot
            for x, begin, end in zip(symbols, runs, [*runs[1:], high]):
                open_.append((base + x, begin, end, at + 1))

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.check += [-1] * more
            self.base += [0] * more

    def _room(self, symbols: list[int]) -> int:
        """The first base at which the slots of all symbols are free."""
        while self.free < len(self.check) and self.check[self.free] != -1:
            self.free += 1
        at = self.free
        while True:
            base = at - symbols[0]
            self._grow(base + symbols[-1] + 1)
            if all(self.check[base + x] == -1 for x in symbols):
                return base
            at += 1

    def step(self, slot: int, symbol: int) -> int:
        to = self.base[slot] + symbol
        if not 0 <= to < len(self.check) or self.check[to] != slot:
            raise KeyError(symbol)
        return to


_SHARD = T.StructType([
    *[T.StructField(name, T.LongType()) for name in (
        *NODE, "p1", "p2", "depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved",
    )],
    T.StructField("top", T.BooleanType()),
])


def shard_nodes(rows: list[tuple]) -> dict[str, np.ndarray]:
    """The nodes of one shard, from rows (c, copies, depth, key, words, z1, z2, p1, p2) in order of c and depth.

    The first row of each c is the node its prefix starts with; its parent is an upper node.
    """
    ids: dict = {}
    paths: list[list[int]] = []
    last = None
    for c, _, _, key, _, z1, z2, _, _ in rows:
        symbol = key if c == last else (z1, z2)
        if c != last:
            paths.append([])
            last = c
        paths[-1].append(ids.setdefault(symbol, len(ids)))
    trie = DoubleArray(paths)
    size = len(trie.check)
    about = np.zeros((5, size), np.int64)  # z1, z2, p1, p2, depth
    conv, copies, words = np.full(size, NOBODY, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    path, at, slot, last = -1, 0, 0, None
    for c, n, depth, _, w, z1, z2, p1, p2 in rows:
        if c != last:
            path, at, slot, last = path + 1, 0, 0, c
        slot = trie.step(slot, paths[path][at])
        at += 1
        conv[slot] = min(conv[slot], c)
        copies[slot] += n
        words[slot] = w
        about[:, slot] = z1, z2, p1, p2, depth
    check = np.array(trie.check)
    slots = np.flatnonzero(check >= 0)
    parents = check[slots]
    children = np.bincount(parents, minlength=size)
    leaves = np.zeros(size, np.int64)
    leaves[slots] = children[slots] == 0
    saved = (copies - 1) * words
    # Depth by depth from below: a prefix may start at any depth, a child always lies one below its parent.
    deep = about[4][slots]
    for level in np.unique(deep)[::-1]:
        there = (deep == level) & (parents > 0)
        np.add.at(leaves, parents[there], leaves[slots[there]])
        np.add.at(saved, parents[there], saved[slots[there]])
    top = parents == 0
    return {
        "z1": about[0][slots], "z2": about[1][slots], "p1": about[2][slots], "p2": about[3][slots], "depth": deep,
        "conv": conv[slots], "parent_conv": np.where(top, NOBODY, conv[parents]), "n_convs": copies[slots],
        "n_children": children[slots], "n_leaves": leaves[slots], "saved": saved[slots], "top": top,
    }


def _shards(lower: DataFrame) -> DataFrame:
    """Nodes below the upper ones, shard by shard; a task holds one shard at a time."""
    arrow = to_arrow_schema(_SHARD)
    names = ["shard", "c", "n", "depth", "key", "words", "z1", "z2", "p1", "p2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            nodes = shard_nodes(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in names]
            for shard, *row in zip(*columns):
                if shard != now and held:
                    yield out()
                now = shard
                held.append(tuple(row))
        if held:
            yield out()

    sent = lower.select(*names).repartition("shard").sortWithinPartitions("shard", "c", "depth")
    return mapped(sent, run, _SHARD)


def _paths(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Turns of one conversation of each set of equal ones, with the size of the set."""
    once = ends.groupBy("len", *NODE).agg(F.min("c").alias("c"), F.count("*").alias("n")).where("len > 0")
    hot = ends.where(F.col("len") * HOT > rows.count())
    found = salted_left_join(rows, once.select("c", "n", "len"), ["c"], hot).where("n IS NOT NULL")
    return found.withColumns({
        f"p{s}": F.col(f"z{s}").bitwiseXOR(_mark(F.col("key"), F.col("depth") - 1, s)) for s in (1, 2)
    })


def _split(paths: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(turns at upper nodes, turns below them with their shard)."""
    sizes = paths.groupBy(*NODE).agg(F.sum(F.col("len") - F.col("depth") + 1).alias("w"), F.count("*").alias("k"))
    big = written(sizes.where(F.col("w") > shard_rows).select(*NODE, "k"), "trie-upper")
    total = paths.count()
    told = written(
        salted_left_join(paths, big.select(*NODE, F.lit(True).alias("upper")), NODE, big.where(F.col("k") * HOT > total)), "trie-split"
    )
    lower = told.where("upper IS NULL").drop("upper")
    cuts = lower.groupBy("c").agg(F.min(F.struct("depth", *NODE)).alias("cut"), F.count("*").alias("k"))
    n = lower.count()
    cuts = cuts.withColumn("shard", F.pmod(F.xxhash64("cut.z1", "cut.z2"), F.lit(n // shard_rows + 1)))
    lower = salted_left_join(lower, cuts.select("c", "shard"), ["c"], cuts.where(F.col("k") * HOT > n))
    return told.where("upper"), lower


def _upper_tree(upper: DataFrame, ends: DataFrame, shards: DataFrame) -> DataFrame:
    """Upper nodes and the root, with sums over all that lies below them."""
    nodes = upper.groupBy(*NODE).agg(
        F.min("depth").alias("depth"), F.min("c").alias("conv"), F.sum("n").alias("n_convs"), F.min("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    root = ends.agg(F.min("c").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("z1"), zero.alias("z2"), zero.alias("depth"), "conv", "n_convs", zero.alias("words"),
        none.alias("p1"), none.alias("p2"),
    )
    nodes = written(nodes.unionByName(root), "trie-upper-nodes")
    from_shards = shards.where("top").groupBy(F.col("p1").alias("z1"), F.col("p2").alias("z2")).agg(
        F.count("*").alias("below"), F.sum("n_leaves").alias("leaves_in"), F.sum("saved").alias("saved_in")
    )
    inside = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("z1"), F.col("p2").alias("z2")).agg(F.count("*").alias("beside"))
    rows = nodes.join(from_shards, NODE, "left").join(inside, NODE, "left")
    rows = rows.withColumn("n_children", _joined("below") + _joined("beside"))
    rows = written(
        rows.select(
            *NODE, "p1", "p2", "depth", "conv", "n_convs", "n_children", F.col("p1").alias("a1"), F.col("p2").alias("a2"),
            (_joined("leaves_in") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
            (_joined("saved_in") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ),
        "trie-sums",
    )
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        # Each node hands the sum of its last 2^k levels to the ancestor 2^k above, then looks twice as far.
        given = rows.where("a1 IS NOT NULL").groupBy("a1", "a2").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        given = given.select(F.col("a1").alias("z1"), F.col("a2").alias("z2"), "l", "s")
        above = rows.select(F.col("z1").alias("a1"), F.col("z2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        rows = written(
            rows.join(given, NODE, "left").join(above, ["a1", "a2"], "left").select(
                *NODE, "p1", "p2", "depth", "conv", "n_convs", "n_children", F.col("b1").alias("a1"), F.col("b2").alias("a2"),
                (F.col("n_leaves") + _joined("l")).alias("n_leaves"), (F.col("saved") + _joined("s")).alias("saved"),
            ),
            "trie-sums",
        )
    return rows.drop("a1", "a2")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(z1, z2, ends_sha256): the ids that end at a node, in order, through a running hash."""
    schema = T.StructType([*[T.StructField(name, T.LongType()) for name in NODE], T.StructField("ends_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, any_yet, done = None, None, False, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(arrow)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for z1, z2, c in zip(*(batch.column(name).to_pylist() for name in (*NODE, "c"))):
                if (z1, z2) != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state, any_yet = (z1, z2), hashlib.sha256(), False
                if c != NOBODY:
                    state.update(f",{c}".encode() if any_yet else str(c).encode())
                    any_yet = True
            yield out()
        if state is not None:
            done.append((*now, state.hexdigest()))
        yield out()

    return mapped(ends.select(*NODE, "c").repartition(*NODE).sortWithinPartitions(*NODE, "c"), run, schema)


def prefix_trie(rows: DataFrame, convs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie over the node rows and conversations that `rebuilt` gives."""
    last = rows.groupBy("c").agg(F.max(F.struct("depth", *NODE)).alias("end"))
    ends = written(
        convs.join(last, "c", "left").select(
            "c", *[F.coalesce(F.col(f"end.{name}"), F.lit(0).cast("bigint")).alias(to) for name, to in (("depth", "len"), ("z1", "z1"), ("z2", "z2"))]
        ),
        "trie-ends",
    )
    upper, lower = _split(written(_paths(rows, ends), "trie-paths"), shard_rows)
    shards = written(_shards(lower), "trie-shards")
    tree = written(_upper_tree(upper, ends, shards), "trie-tree")
    names = tree.select(F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("conv").alias("above"))
    every = shards.where("top").count() + tree.count()  # all children of upper nodes, so that fewer than HOT have many
    children = tree.where(F.col("n_children") * HOT > every).select(F.col("z1").alias("p1"), F.col("z2").alias("p2"))
    fields = [*NODE, "depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved"]
    tops = salted_left_join(shards.where("top").drop("parent_conv"), names, ["p1", "p2"], children)
    own = tree.join(names, ["p1", "p2"], "left")
    nodes = shards.where("NOT top").select(*fields)
    for part in (tops, own):
        nodes = nodes.unionByName(part.withColumnRenamed("above", "parent_conv").select(*fields))
    rows = nodes.join(_end_digests(ends), NODE, "left")
    nobody = F.lit(NOBODY)
    return rows.select(
        F.nullif("conv", nobody).alias("conv_id"), "depth", F.nullif("parent_conv", nobody).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
