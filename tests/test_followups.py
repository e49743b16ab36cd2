"""Follow-ups against a plain Python search over all messages."""

import random

import pytest
from test_lookup import messages

from parley.functions.times import HOUR_US
from parley.operators import followups as fu, people as pe

AS_OF = 1_000 * HOUR_US
CUTOFF = AS_OF - 72 * HOUR_US
NAMES = {"U1": "Ann", "U2": "Bob", "U3": "Cy Real"}


@pytest.fixture(scope="module")
def chat(spark):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        conv = "hot" if i % 3 == 0 else rng.choice(["a", "b", "DM: D1", "DM: D2", "DM: D3", "DM: D4"])
        ts = AS_OF - rng.randrange(500) * HOUR_US // 2 + rng.randrange(3)
        user = rng.choice(["U1", "U2", "U3", "U4", "Ann", "U9", None] + ["U2"] * 6)
        rows.append((f"m{i:04d}", conv, ts, user, rng.choice(["hi", "ask Ann now", "ann?", "x" * 99 + "Ann"])))
    rows.append(("tie1", "DM: D5", AS_OF - 30 * HOUR_US, "U2", "one"))
    rows.append(("tie2", "DM: D5", AS_OF - 30 * HOUR_US, "U3", "two"))
    rows.append(("fresh", "DM: D6", AS_OF - 2 * HOUR_US, "U2", "too new"))
    rows.append(("stale", "DM: D6", AS_OF - 40 * HOUR_US, "U2", "not the latest"))
    conv = spark.createDataFrame(
        [(f"D{i}", f"DM: D{i}", "dm", None) for i in range(1, 7)] + [("D99", "DM: D1", "dm", ["x"])] + [(c, c, "channel", ["p"]) for c in "ab"],
        "id string, name string, type string, participants array<string>")
    return rows, messages(spark, rows).cache(), conv


def show(user):
    return NAMES.get(user, user)


def brute_items(rows):
    found = []
    for id_, conv, ts, user, text in rows:
        if user is None or show(user) == "Ann" or ts <= CUTOFF:
            continue
        same = [r for r in rows if r[1] == conv]
        if conv.startswith("DM"):
            if ts == max(r[2] for r in same) and AS_OF - ts > 24 * HOUR_US:
                found.append((id_, "dm"))
        elif "Ann" in text and not any(r[2] > ts and show(r[3]) == "Ann" for r in same):
            found.append((id_, "mention"))
    return sorted(found)


def test_items_match_a_full_search(chat, people):
    rows, m, conv = chat
    got = fu.followups(m, conv, people[0], fu.Owner("Ann"), AS_OF).collect()
    assert sorted((r["id"], r["type"]) for r in got) == brute_items(rows)
    assert {"tie1", "tie2"} <= {r["id"] for r in got} and "fresh" not in {r["id"] for r in got}
    assert [r["age_hours"] for r in got] == sorted((r["age_hours"] for r in got), reverse=True)
    long = [r for r in got if r["snippet"].startswith("xxx")]
    assert all(r["snippet"].endswith("...") and len(r["snippet"]) == 103 for r in long)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_context_is_every_earlier_message(chat, people, monkeypatch, limit):
    from parley.operators import resolve as rs
    plain = fu.broadcast_if_small
    for module in (rs, fu):
        monkeypatch.setattr(module, "broadcast_if_small", lambda side: plain(side, limit))
    rows, m, conv = chat
    items = fu.followups(m, conv, people[0], fu.Owner("Ann"), AS_OF)
    start = CUTOFF - 14 * 24 * HOUR_US
    context = fu.followup_context(m, items, people[0], start).cache()
    for item in items.collect()[:12]:
        want = sorted((r[2], r[0]) for r in rows if r[1] == item["conversation_name"] and start <= r[2] < item["ts_us"])
        got = [(r["ts_us"], r["id"]) for r in fu.context_of(context, item["conversation_name"], item["ts_us"]).collect()]
        assert got == want
    assert context.groupBy("id").count().where("count > 1").isEmpty()
    assert fu.context_of(context, "nope", AS_OF).isEmpty()


def test_whole_answer(chat, people):
    _, m, conv = chat
    full = fu.list_followups(m, conv, people[0], fu.Owner("Ann"), AS_OF, ignored=["hot"])
    total = full.summary.first()
    assert full.status == "pending" and total["total_before_filter"] == total["mentions_before_filter"] + total["dms_before_filter"]
    assert fu.list_followups(m, conv, people[0], fu.Owner(None), AS_OF).status == "error"
    assert fu.list_followups(m, conv, people[0], fu.Owner("Ann"), AS_OF * 9).status == "all_clear"


def test_owner_from_metadata():
    assert fu.Owner.from_metadata({"user_id": "U1", "owner_name": "Ann"}) == fu.Owner("Ann", "U1")
    assert fu.Owner.from_metadata({"owner_id": "U2", "user_name": "B"}, "x") == fu.Owner("B", "U2")
    assert fu.Owner.from_metadata({}, "x") == fu.Owner("x", None)


@pytest.mark.parametrize("mentions_only", [True, False])
def test_interactions_match_a_full_search(chat, people, mentions_only):
    rows, m, conv = chat
    got = pe.user_interactions(m, people[0], conv, "cy", AS_OF, days_back=8, mentions_only=mentions_only)
    cut = AS_OF - 8 * 24 * HOUR_US
    wrote = lambda r: r[3] is not None and "cy" in show(r[3]).lower()
    if mentions_only:
        want = [r for r in rows if r[2] > cut and (wrote(r) or "cy" in r[4].lower())]
    else:
        theirs = {r[1] for r in rows if wrote(r)}
        want = [r for r in rows if r[2] > cut and r[1] in theirs]
    hits = want
    want = sorted(want, key=lambda r: (-r[2], r[0]))[: 200 if mentions_only else 500]
    assert got.status == "ok" and sorted(r["id"] for r in got.messages.collect()) == sorted(r[0] for r in want)
    s = got.summary.first()
    assert s["interactions_before_filter"] == len(hits) and s["conversations_before_filter"] == len({r[1] for r in hits})
    assert {(r["name"], r["interaction_count"]) for r in got.conversations.collect()} == {
        (c, sum(r[1] == c for r in hits)) for c in {r[1] for r in hits}
    }
    # Two conversations share a name: rows are not doubled, the known participants are kept.
    d1 = [r for r in got.messages.collect() if r["conversation_name"] == "DM: D1"]
    assert all(r["participants"] == ["x"] for r in d1)


def test_person_gate(chat, people):
    _, m, conv = chat
    assert pe.user_interactions(m, people[0], conv, "zz", AS_OF).status == "not_found"
    assert pe.user_interactions(m, people[0], conv, "cy", AS_OF * 9).status == "no_interactions"
