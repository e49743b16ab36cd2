import pytest
from pyspark.sql import functions as F

from parley.functions.bots import is_bot
from parley.operators import activity as ac, lookup as lk
from parley.operators.bots import filter_bots

MESSAGE = ("id string, conversation_name string, conversation_type string, ts_us long, datetime string, user_name string, "
           "text string, clean_text string, search_text string, thread_ts_us long, is_thread_parent boolean, reply_count long")


def messages(spark, rows):
    full = []
    for id_, conv, ts, user, text, *thread in rows:
        root, parent, replies = (thread + [None, None, 0])[:3] if thread else (None, None, 0)
        kind = "dm" if conv.startswith("DM") else "channel"
        low = " ".join(p for p in (text.lower(), (user or "").lower(), conv.lower()) if p)
        full.append((id_, conv, kind, ts, f"d{ts}", user, text, text, low, root, parent, replies))
    return spark.createDataFrame(full, MESSAGE)


@pytest.fixture
def dims(spark):
    conv = spark.createDataFrame(
        [("C2", "dev", "channel", None), ("C3", "C3", "channel", None), ("D1", "Ann & Bob", "dm", ["Ann", "Slackbot"])],
        "id string, name string, type string, participants array<string>")
    return conv


def test_conversation_by_name_id_or_channel(spark, people, dims):
    _, channels = people
    assert lk.get_conversation(dims, channels, "Ann & Bob").first()["id"] == "D1"
    assert lk.get_conversation(dims, channels, "D1").first()["name"] == "Ann & Bob"
    assert lk.get_conversation(dims, channels, "dev-ops").first()["id"] == "C3"
    assert lk.get_conversation(dims, channels, "nope").isEmpty()


def test_messages_page(spark, people):
    _, channels = people
    m = messages(spark, [(f"m{i}", "dev", i, "U1", "t") for i in range(10)] + [("x", "C3", 5, "U1", "t")])
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(lk.get_messages(m, channels, "dev", limit=3, offset=2)) == ["m2", "m3", "m4"]
    assert ids(lk.get_messages(m, channels, "dev", since_us=8, until_us=9)) == ["m8", "m9"]
    assert ids(lk.get_messages(m, channels, "dev", until_us=0)) == ["m0"]
    assert ids(lk.get_messages(m, channels, "dev-ops")) == ["x"]
    assert ids(lk.get_messages(m, channels, "unknown")) == []


def test_search_takes_signs_literally(spark):
    m = messages(spark, [("a", "dev", 1, "U1", "100% sure_thing"), ("b", "dev", 2, "U2", "100 sureXthing"),
                         ("c", "ops", 3, "U1", "É\\x 100%"), ("d", "dev", 3, "U1", "100%")])
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(lk.search_messages(m, "100%")) == ["c", "d", "a"]
    assert ids(lk.search_messages(m, "SURE_THING")) == ["a"]
    assert ids(lk.search_messages(m, "é\\X")) == ["c"]
    # Filters hold for both text columns.
    assert ids(lk.search_messages(m, "100%", conversation="dev", user="U1")) == ["d", "a"]
    assert ids(lk.search_messages(m, "100%", limit=1)) == ["c"]


def test_channel_ids(spark):
    ch = spark.createDataFrame([("C5", "dev"), ("C1", "dev-ops"), ("C2", "web-dev"), ("C3", "a_b")], "slack_id string, name string")
    one = lambda w: lk.channel_to_id(ch, w).first()[0]
    assert one("dev") == "C5" and one("##dev") == "C5" and one("dev-") == "C1" and one("eb-d") == "C2"
    assert one("a%b") is None and one("DEV") is None


def test_matches_and_gate(spark):
    u = spark.createDataFrame(
        [("U1", "Ann", None), ("U2", "ann Lee", None), ("U3", None, "Joann"), ("U4", None, None)],
        "slack_id string, name string, real_name string")
    rows = [tuple(r) for r in lk.match_users(u, "ANN").collect()]
    assert rows == [("Ann", "U1", 100), ("ann Lee", "U2", 90), ("Joann", "U3", 80)]
    gate = lambda t: lk.user_ambiguity(u, t).first()
    assert gate("ann")["status"] == "ok"  # several, but exactly one exact
    assert gate("an")["status"] == "ambiguous" and gate("an")["suggestions"] == ["Ann", "ann Lee", "Joann"]
    assert gate("zz")["status"] == "not_found" and gate("lee")["status"] == "ok"


def test_resolution_chain(spark, people, dims):
    _, channels = people
    one = lambda w: lk.resolve_conversation(dims, channels, w).first()["resolved_name"]
    assert one("D1") == "D1" and one("dev-ops") == "dev-ops" and one("ev-op") == "C3" and one("zzz") == "zzz"


def test_activity_answers(spark, people, dims):
    users, channels = people
    day = 86_400_000_000
    m = messages(spark, [
        ("p", "dev", 20 * day, "U1", "root", 20 * day, True, 2), ("r1", "dev", 20 * day + 5, "U3", "re", 20 * day, False, 0),
        ("r2", "dev", 30 * day, None, "re2", 20 * day, False, 0), ("q", "dev", 20 * day + 1, "U9", "solo"),
        ("p0", "dev", 20 * day + 2, "U1", "no replies", 20 * day + 2, True, 0), ("old", "dev", day, "U1", "old"),
        ("z", "C3", day, "U1", "old"), ("g", "orphans", 20 * day, "U1", "x")])
    ask = lambda name: ac.channel_activity(dims, channels, users, m, name, 31 * day)
    ok = ask("dev")
    assert ok.status == "ok" and ok.summary.first()["total_messages"] == 5 and ok.summary.first()["unique_participants"] == 3
    assert [(r["id"], r["type"], r["user"]) for r in ok.flow.collect()] == [
        ("p", "thread_parent", "Ann"), ("r1", "thread_reply", "Cy Real"), ("r2", "thread_reply", None),
        ("q", "message", "U9"), ("p0", "thread_parent", "Ann")]
    assert [r["display_name"] for r in ok.participants.collect()] == ["Ann", "Cy Real", "U9"]
    by_id = ask("C2")
    assert by_id.status == "ok" and by_id.resolved_name == "dev" and by_id.summary.first()["total_messages"] == 5
    assert ask("dev-ops").status == "no_activity"
    assert ask("rphan").resolved_name == "orphans"
    assert ask("evv").status == "not_found" and ask("ops-dev").suggestions == []


def test_bot_words(spark):
    names = spark.createDataFrame([("SlackBot",), ("My GitHub app",), ("Ann",), (None,), ("",)], "n string")
    assert [r[0] for r in names.select(is_bot(F.col("n"), ["github"])).collect()] == [True, True, False, False, False]


def test_filter_reaches_nested_lists(spark):
    df = spark.createDataFrame(
        [("dm", "DM: slackbot, (Slackbot)", "Ann", ["Ann", "slackbot"], [("Ann",), ("slackbot",)], (1, [("Bob",), ("slackbot",)])),
         ("dm", "Ann, slackbot", "Ann", ["slackbot"], [], (1, [])), ("mention", "#slackbot", "Ann", None, None, None),
         ("mention", "#x", "slackbot", [], [], (1, []))],
        "type string, location string, user string, participants array<string>, context_messages array<struct<user:string>>, "
        "thread struct<n:int,replies:array<struct<user_name:string>>>")
    rows = filter_bots(df).collect()
    assert [r["location"] for r in rows] == ["Ann, slackbot", "#slackbot"] and rows[0]["participants"] == []
    nested = filter_bots(df.withColumn("type", F.lit("x"))).first()
    assert nested["participants"] == ["Ann"] and [c["user"] for c in nested["context_messages"]] == ["Ann"]
    assert [r["user_name"] for r in nested["thread"]["replies"]] == ["Bob"]
