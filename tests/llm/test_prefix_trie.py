import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from llm_helpers import SMALL, plan_of, read

import __spark_entry__ as entry_points
import oracle
from parley.llm import prefix_trie

KEY = "op11_prefix_trie"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def _key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows, group=20, heads=4):
    """Conversations rebuilt and laid into a dictionary of prefixes, one by one."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        turns[c].append((turn is not None, turn or 0, _key(role, text), role, text))
    for said in turns.values():
        said.sort()
    rebuilt = {}
    for c, said in turns.items():
        h = zlib.crc32(str(c).encode()) % heads if c is not None else 0
        base = None if c is None else c - (c % group if c >= 0 else -(-c % group))
        head = turns.get(base, [])[:h] if c is not None else []
        rebuilt[c] = [(role, text) for *_, role, text in [*head, *said[h:]]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    smallest = {n: min((c for c in m if c is not None), default=None) for n, m in members.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        own = (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in children
    out = []
    for node, m in members.items():
        ids = ",".join(str(c) for c in sorted(c for c in ends.get(node, []) if c is not None))
        out.append((
            smallest[node], len(node), smallest[node[:-1]] if node else None, len(m), children[node], leaves[node], saved[node],
            hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(turns, **sizes):
    nodes = prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns), **sizes)
    assert nodes.columns == COLUMNS
    return sorted(map(tuple, nodes.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_small_table_equals_sql(shared):
    assert oracle.compare(entry_points.queries()[KEY](shared, SMALL), oracle.connect(SMALL), entry_points.oracle_sql()[KEY]) is None


@pytest.mark.parametrize("shard_rows", [1, 60])
def test_random_conversations_at_any_shard_size(shared, shard_rows):
    draw = random.Random(shard_rows)
    rows = [
        (c, turn, draw.choice(["user", "assistant"]), draw.choice(["yes", "no  way", "", "a b c"]))
        for c in range(-45, 90) if c % 20 != 7 for turn in range(draw.randrange(0, 7))
    ]
    assert found(shared.createDataFrame(rows, SCHEMA), shard_rows=shard_rows) == plain(rows)


def test_common_and_long_conversations(shared, monkeypatch):
    rows = [(c, t, "user", f"same turn {t}") for c in range(60) for t in range(5)]
    rows += [(1000, t, "user", f"long {t % 3}") for t in range(300)] + [(1001, t, "user", f"long {t % 3}") for t in range(290)]
    for hot, size in ((3, 40), (1000, 10_000)):
        monkeypatch.setattr(prefix_trie, "HOT", hot)
        assert found(shared.createDataFrame(rows, SCHEMA).repartition(7), shard_rows=size) == plain(rows)


def test_odd_rows(shared):
    rows = [
        (None, 1, "user", "nobody"), (None, None, None, None), (40, None, "user", "first"), (40, 0, None, "second"), (40, 0, "user", None),
        (41, 5, "user", "x " * 50_000), (41, 5, "user", "x " * 50_000), (42, 1, "", ""), (43, 0, "user", "short"), (63, 0, "user", "alone"),
        (62, 0, "user", "a"), (62, 1, "user", "b"), (62, 2, "user", "c"), (62, 3, "user", "d"),
    ]
    turns = shared.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "2 AS depth", "'k' AS key", "3 AS z1")
    assert found(turns) == plain(rows)
    assert found(turns.limit(0)) == []


def test_double_array_holds_each_path_and_no_other():
    draw = random.Random(4)
    paths = [[draw.randrange(9) for _ in range(draw.randrange(6))] for _ in range(300)]
    trie = prefix_trie.DoubleArray(paths)
    slots = {(): 0}
    for path in paths:
        slot = 0
        for k, x in enumerate(path):
            slot = trie.step(slot, x)
            assert slots.setdefault(tuple(path[:k + 1]), slot) == slot
    assert len(set(slots.values())) == len(slots) == 1 + sum(p >= 0 for p in trie.check)
    for prefix, slot in slots.items():
        for x in range(9):
            if (*prefix, x) not in slots:
                with pytest.raises(KeyError):
                    trie.step(slot, x)


def test_texts_are_not_moved(shared):
    turns = read(shared, "conversations")
    placed, _ = prefix_trie._placed(turns, "conv_id", "turn", "role", "text")
    assert "text" not in placed.columns
    assert "CartesianProduct" not in plan_of(placed)
