import random

import pytest
from test_lookup import messages

from parley.operators import corpus as co


def greedy(texts, limit):
    chunks, cur = [], ""
    for t in texts:
        if cur and len(cur) + len(t) + 1 > limit:
            chunks.append(cur)
            cur = ""
        cur += t + "\n"
    return chunks + ([cur] if cur else [])


def corpus_frame(spark, rows):
    return spark.createDataFrame(rows, "user_name string, conversation_name string, last_ts_us long, ts_us long, id string, text string")


@pytest.mark.parametrize("seed,limit,block", [(1, 50, 40), (2, 50, 7), (3, 50, 10_000), (4, 200, 130), (5, 30, 1), (6, 64, 64), (7, 40, 25)])
def test_chunks_equal_one_pass(spark, monkeypatch, seed, limit, block):
    monkeypatch.setattr(co, "BLOCK_CHARS", block)
    # Small batches, so that blocks run across them.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(seed)
    rows, want = [], {}
    for user in ("hot", "u1", "u2"):
        texts = []
        for c in range(6 if user == "hot" else 2):
            for i in range(rng.randrange(1, 30)):
                size = rng.choice([1, 2, 5, 9, 20, limit - 1, limit, limit + 30]) if rng.random() < 0.3 else rng.randrange(1, 15)
                text = "".join(rng.choice("ab é😀") for _ in range(size)) or "x"
                rows.append((user, f"c{c}", 100 - c, i, f"{c}:{i:03d}", text))
                texts.append(text)
        want[user] = greedy(texts, limit)
    rng.shuffle(rows)
    try:
        got = co.chunk_corpus(corpus_frame(spark, rows), limit).orderBy("user_name", "chunk_no").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for user, chunks in want.items():
        mine = [r for r in got if r["user_name"] == user]
        assert [r["chunk"] for r in mine] == chunks
        assert [r["chunk_no"] for r in mine] == list(range(len(chunks)))


def test_long_first_message_makes_no_empty_chunk(spark):
    rows = [("u", "c", 1, 0, "a", "x" * 90), ("u", "c", 1, 1, "b", "y"), ("u", "c", 1, 2, "c", "z" * 90), ("u", "c", 1, 3, "d", "w")]
    got = [r["chunk"] for r in co.chunk_corpus(corpus_frame(spark, rows), 20).orderBy("chunk_no").collect()]
    assert got == ["x" * 90 + "\n", "y\n", "z" * 90 + "\n", "w\n"]


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(f"a{i:02d}", "DM: D1", i, "U1" if i % 2 else "U2", "" if i == 3 else f"t{i}") for i in range(12)]
    rows += [("b", "dev", 50, None, "y" * 300), ("c", "DM: D2", 99, "U1", "last"), ("e", "mute", 70, "U1", "")]
    conv = spark.createDataFrame(
        [("D1", "DM: D1", "dm", ["Ann", "Bob"]), ("C1", "dev", "channel", None), ("D2", "DM: D2", "dm", None),
         ("D3", "DM: D3", "dm", None), ("C2", "mute", "channel", None)],
        "id string, name string, type string, participants array<string>")
    return messages(spark, rows), conv


def test_corpus_counts_all_authors_before_the_cut(talk):
    m, conv = talk
    got = co.user_corpus(m, conv, "U1", per_conversation=6).orderBy("last_ts_us", "ts_us").collect()
    assert [r["text"] for r in got] == ["t1", "t5", "last"]
    newest = co.user_corpus(m, conv, "U1", per_conversation=2, order="newest").collect()
    assert sorted(r["text"] for r in newest) == ["last", "t11"]


def test_transcripts(talk):
    m, conv = talk
    got = {r["id"]: r["transcript"] for r in co.transcripts(m, conv, per_conversation=4, line_chars=200).collect()}
    assert got["D1"] == "\n=== DM: Ann & Bob ===\nU2: t0\nU1: t1\nU2: t2"
    assert got["C1"] == "\n=== CHANNEL: dev ===\nNone: " + "y" * 200
    assert got["D2"] == "\n=== DM:  ===\nU1: last" and got["C2"] == "\n=== CHANNEL: mute ==="
    assert "D3" not in got
    whole = {r["id"]: r["transcript"] for r in co.transcripts(m, conv).collect()}
    assert len(whole["C1"]) > len(got["C1"]) and whole["D1"].startswith(got["D1"]) and len(whole["D1"]) > len(got["D1"])


@pytest.mark.parametrize("budget", [5, 30, 60, 200, 270, 5000])
def test_budget_is_a_prefix_of_the_joined_text(talk, budget):
    m, conv = talk
    whole = {r["id"]: r["transcript"] for r in co.transcripts(m, conv).collect()}
    want = "\n".join(whole[i] for i in ("D2", "C2", "C1", "D1"))[:budget]
    parts = co.transcript_budget(m, conv, budget)
    assert co.joined_transcript(parts, budget).first()["transcript"] == want


@pytest.mark.parametrize("block_chars", [1, 7, 40, 10_000])
def test_blocks_joined_are_the_transcripts(talk, block_chars):
    m, conv = talk
    whole = {r["id"]: r["transcript"] for r in co.transcripts(m, conv).collect()}
    longest = max(len(line) for t in whole.values() for line in t.split("\n"))
    blocks = {}
    for r in co.transcript_blocks(m, conv, block_chars=block_chars).orderBy("block").collect():
        blocks.setdefault(r["id"], []).append(r["text"])
    assert {i: "\n".join(t) for i, t in blocks.items()} == whole
    assert all(len(t) <= block_chars + longest for parts in blocks.values() for t in parts[1:])


def test_budget_joins_only_lines_inside_it(talk, monkeypatch):
    """No whole transcript is built on the way to the budgeted part."""
    m, conv = talk
    want = co.transcripts(m, conv).where("id = 'D1'").first()["transcript"][:30]

    def whole(*args, **options):
        raise AssertionError("a whole transcript was built")

    monkeypatch.setattr(co, "transcripts", whole)
    part = co.transcript_budget(m, conv.where("id = 'D1'"), 30).first()["part"]
    assert part == want and len(part) == 30
