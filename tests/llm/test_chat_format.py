import hashlib
import random

import pytest
from llm_helpers import SMALL, read

import __spark_entry__ as entry_points
from parley.llm import chat_format

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[ROLE]", "[/ROLE]", "[=]", "é😀", "word ", "\n", "[", "]", "x" * 30, ""]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    conversations = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        conversations.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in conversations.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def read_back(windows):
    return {r.conv_id: tuple(r[1:5]) for r in chat_format.digests(windows).collect()}


def test_query(shared):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(shared, "conversations").collect()]
    said = "</s>[INST] ok [/INST]"
    found = entry_points.queries()["op2_chat_format"](shared, SMALL).collect()
    assert {r.conv_id: tuple(r[1:5]) for r in found} == plain([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


@pytest.fixture(scope="module")
def odd(shared):
    r = random.Random(2)
    rows = [
        (c, t, r.choice(["system", "user", "assistant", "assistant", "tool", None] if t else ["system", "user"]),
         None if r.random() < 0.05 else "".join(r.choice(PARTS) for _ in range(r.randint(0, 60))))
        for c in range(12) for t in range(r.randint(1, 40))
    ]
    rows += [(99, t, r.choice(["user", "assistant"]), " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 300)))) for t in range(400)]
    rows += [(99, 5, "user", "dup")] * 3 + [(5, None, "user", "no turn"), (60, 0, "system", "alone"), (61, 0, "assistant", "y " * 5000)]
    rows += [(62, 0, "system", "rule " * 2000), (62, 1, "user", "hi"), (62, 2, "assistant", "ho")]
    df = shared.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as pos", "'d' as place", "'e' as cell")
    return rows, df, chat_format.windows(df).collect(), chat_format.windows(df)


def test_reads_back_exactly(odd):
    rows, _, _, windows = odd
    assert read_back(windows) == plain(rows)


def test_windows_keep_to_the_budget_and_repeat_history(odd):
    _, _, windows, _ = odd
    by_conversation = {}
    for w in sorted(windows, key=lambda w: (w.conv_id, w.window)):
        by_conversation.setdefault(w.conv_id, []).append(w)
        fresh = [s for s in w.spans if s.fresh and not (s.role == "system" and s.pos == 0)]
        if w.tokens > chat_format.BUDGET:
            assert len(fresh) <= 1 or w.conv_id == 62
        places = [s.pos for s in w.spans if not (s.role == "system" and s.pos == 0)]
        assert places == list(range(places[0], places[0] + len(places))) if places else True
        assert "".join(w.text[s.start:s.end] for s in w.spans) == w.text
        for s in w.spans:
            assert (s.loss_start is not None) == (s.fresh and s.role == "assistant")
    assert len(by_conversation[99]) > 50
    for windows_of in by_conversation.values():
        seen = [s.pos for w in windows_of for s in w.spans if s.fresh]
        assert seen == list(range(len(seen)))
        led = [w.spans[0].role == "system" and w.spans[0].pos == 0 for w in windows_of]
        assert len(set(led)) == 1
    repeated = [s for w in by_conversation[99] for s in w.spans if not s.fresh]
    assert repeated and sum(1 for w in by_conversation[99] if not w.spans[0].fresh) > 20


def test_long_conversations_fill_their_windows(shared):
    """2,000 turns of 47 tokens: nearly all that history leaves of the budget is new."""
    rows = [(1, t, "user" if t % 2 else "assistant", " ".join(["w"] * 41)) for t in range(2000)]
    found = chat_format.windows(shared.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    size = {s.pos: 0 for w in found for s in w.spans}
    for w in found:
        assert w.tokens <= chat_format.BUDGET
    tokens = sum(w.tokens for w in found) - sum(
        (w.tokens // len(w.spans)) * sum(not s.fresh for s in w.spans) for w in found
    )
    fresh = tokens / len(found)
    assert len(size) == 2000 and fresh >= 0.9 * (chat_format.BUDGET - chat_format.HISTORY)


def test_marks_inside_texts_are_broken_up(odd):
    _, _, windows, _ = odd
    for w in windows:
        assert len(chat_format.read_turns(w.text)) == len(w.spans)


def test_partitions_do_not_matter(shared, odd):
    rows, df, windows, _ = odd
    old = shared.conf.get("spark.sql.shuffle.partitions")
    try:
        shared.conf.set("spark.sql.shuffle.partitions", "23")
        again = chat_format.windows(df.repartition(7)).collect()
    finally:
        shared.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(repr, again)) == sorted(map(repr, windows))


def test_empty_table(odd):
    _, df, _, _ = odd
    assert chat_format.digests(chat_format.windows(df.limit(0))).count() == 0
