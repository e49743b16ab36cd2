"""Hand-made raw messages through the normaliser."""

import json

import pytest

from parley.functions.times import epoch_us
from parley.operators import normalize as nz, resolve as rs
from parley.schemas import MESSAGES
from parley.sources import landing
from pyspark.sql import functions as F

RICH = [
    {"type": "rich_text", "elements": [{"type": "rich_text_section", "elements": [
        {"type": "text", "text": "hi "}, {"type": "emoji", "name": "wave"}, {"type": "user", "user_id": "U1"},
        {"type": "user", "user_id": "U9"}, {"type": "link", "url": "x"}]}]},
    {"type": "divider"},
]

RAW = {
    "plain": {"ts": "1234567890.000100", "user": "U1", "text": "hello big  world"},
    "rich": {"ts": "2.000001", "user": "U9", "text": "", "blocks": RICH},
    "file": {"ts": "3.0", "user": "U2", "files": [{"name": "a.pdf", "title": "Plan"}]},
    "bare_file": {"ts": "4.0", "user": "U2", "files": [{"size": 3}]},
    "mentions": {"ts": "5.0", "user": "U2", "text": "<@U1> <@U9> <@U1|x> <#C1|lab> <#C2> <!here> https://x"},
    "many": {"ts": "5.5", "user": "U2", "text": "<@U1><@U2><@U9><@U8><@W7><#C2><#C3><@U1>"},
    "share": {"ts": "6.0", "subtype": "file_comment"},
    "leave": {"ts": "7.0", "subtype": "channel_leave"},
    "bot": {"ts": "8.0", "subtype": "bot_message"},
    "other": {"ts": "9.0", "subtype": "odd", "bot_id": "B1"},
    "bot_id": {"ts": "10.0", "bot_id": "B1", "files": [{"name": "x"}]},
    "parent": {"ts": "11.0", "thread_ts": "11.0", "reply_count": 2, "reactions": [{"name": "x", "users": []}]},
    "reply": {"ts": "12.0", "thread_ts": "11.0", "reply_count": 5},
    "near_parent": {"ts": "13.0", "thread_ts": "13.00"},
    "edited": {"ts": "14.0", "edited": {"ts": "15.5"}},
    "edited_no_ts": {"ts": "16.0", "edited": {"user": "U1"}},
    "not_edited": {"ts": "17.0", "edited": {}},
    "one_s": {"ts": "1700000000.0", "text": "a"},
    "next_s": {"ts": "1700000001.0", "text": "b"},
}


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def raw_frame(spark, rows):
    text = [json.dumps({"conversation_id": "C2", "conversation_type": "channel", **r}) for r in rows]
    return landing.parse_messages(lines(spark, text)).withColumn("conversation_name", F.lit("dev"))


@pytest.fixture(scope="module")
def done(spark):
    users = spark.createDataFrame([("U1", "Ann"), ("U2", "Bob"), ("U5", "")], "slack_id string, name string")
    channels = spark.createDataFrame([("C2", "dev"), ("C3", "ops")], "slack_id string, name string")
    good, _ = nz.split_bad_rows(raw_frame(spark, RAW.values()))
    rows = nz.normalize(good, rs.name_book(users, channels)).collect()
    by_ts = {r["ts_us"]: r for r in rows}
    return {k: by_ts[round(float(v["ts"]) * 1_000_000)] for k, v in RAW.items()}


def test_schema(spark, done):
    assert list(done["plain"].asDict()) == MESSAGES.names


def test_id_is_raw_text(done):
    assert done["plain"]["id"] == "dev:1234567890.000100"
    assert done["plain"]["ts_us"] == 1234567890000100
    assert done["plain"]["datetime"] == "2009-02-13 23:31:30"


def test_seconds_stay_apart(done):
    assert done["next_s"]["ts_us"] - done["one_s"]["ts_us"] == 1_000_000


def test_text_sources(done):
    assert done["rich"]["text"] == "hi :wave:@Ann@U9"
    assert done["file"]["text"] == "[File: a.pdf] Plan"
    assert done["bare_file"]["text"] == "[File: Unknown]"
    assert done["share"]["text"] == ""


def test_mentions(done):
    assert done["mentions"]["clean_text"] == "@Ann @U9 <@U1|x> #lab #dev @here https://x"
    assert done["mentions"]["mentions_users"] == ["Ann"]
    assert done["mentions"]["contains_links"] and not done["plain"]["contains_links"]
    assert done["many"]["clean_text"] == "@Ann@Bob@U9@U8@W7#dev#ops@Ann"
    assert done["many"]["mentions_users"] == ["Ann", "Bob"]
    assert done["plain"]["mentions_users"] is None


def test_types(done):
    kinds = {k: done[k]["message_type"] for k in RAW}
    assert kinds["plain"] == "message" and kinds["file"] == "file_share" and kinds["share"] == "file_share"
    assert kinds["leave"] == "system" and kinds["bot"] == "bot" and kinds["other"] == "system" and kinds["bot_id"] == "bot"


def test_threads(done):
    assert done["plain"]["is_thread_parent"] is None
    assert done["parent"]["is_thread_parent"] and done["parent"]["reply_count"] == 2
    assert done["reply"]["is_thread_parent"] is False and done["reply"]["reply_count"] == 0
    assert done["near_parent"]["is_thread_parent"] is False


def test_flags(done):
    assert done["edited"]["is_edited"] and done["edited"]["edited_ts_us"] == 15_500_000
    assert done["edited_no_ts"]["is_edited"] and done["edited_no_ts"]["edited_ts_us"] is None
    assert not done["not_edited"]["is_edited"] and not done["plain"]["is_edited"]
    assert done["parent"]["has_reactions"] and done["file"]["has_attachments"]


def test_words_and_search(done):
    assert done["plain"]["word_count"] == 3
    assert done["plain"]["search_text"] == "hello big  world ann dev"
    assert done["share"]["word_count"] == 0 and done["share"]["search_text"] == "dev"


def test_large_book_gives_the_same(spark, done, monkeypatch):
    monkeypatch.setattr(rs, "is_small", lambda side: False)
    users = spark.createDataFrame([("U1", "Ann"), ("U2", "Bob")], "slack_id string, name string")
    channels = spark.createDataFrame([("C2", "dev"), ("C3", "ops")], "slack_id string, name string")
    good, _ = nz.split_bad_rows(raw_frame(spark, RAW.values()))
    rows = {r["id"]: r for r in nz.normalize(good, rs.name_book(users, channels)).collect()}
    assert rows == {r["id"]: r for r in done.values()}


def test_bad_rows(spark):
    rows = [
        '{"conversation_id":"C2","ts":"1.0","text":"ok"}', '{"conversation_id":"C2","text":"no ts"}',
        '{"conversation_id":"C2","ts":"x"}', '{"ts":', '{"conversation_id":"C2","ts":""}',
        '{"ts":"2.0"}', '{"conversation_id":"","ts":"3.0"}',
    ]
    good, bad = nz.split_bad_rows(landing.parse_messages(lines(spark, rows)))
    assert [r["text"] for r in good.collect()] == ["ok"]
    assert sorted(r["reason"] for r in bad.collect()) == [
        "broken json", "missing conversation_id", "missing conversation_id", "missing ts", "missing ts", "ts is not a number"]


def test_reading_files_equals_parsing_lines(spark, tmp_path):
    tight = (",", ":")  # nested JSON comes back with or without the blanks of the file
    text = [json.dumps({"conversation_id": "C2", **r}, separators=tight) for r in RAW.values()] + ['{"ts":']
    path = str(tmp_path / "in")
    lines(spark, text).write.text(path)
    read = landing.read_messages(spark, path)
    parsed = landing.parse_messages(lines(spark, text))
    assert sorted(read.collect(), key=repr) == sorted(parsed.collect(), key=repr)


def test_attachments_keep_their_index(spark):
    raw = raw_frame(spark, [{"ts": "1.0", "files": [
        {"name": "a.PNG", "filetype": "png", "size": 5_000_000_000, "mimetype": "image/png"}, 7,
        {"name": "v", "mimetype": "video/mp4"}, {"name": "d", "filetype": "docx"}],
        "attachments": ["x", {"title": "T", "title_link": "L"}]}])
    rows = {r["id"]: r for r in nz.attachments(raw).collect()}
    assert sorted(rows) == ["dev:1.0:attachment:1", "dev:1.0:file:0", "dev:1.0:file:2", "dev:1.0:file:3"]
    assert rows["dev:1.0:file:0"]["file_size"] == 5_000_000_000 and rows["dev:1.0:file:0"]["is_image"]
    assert rows["dev:1.0:file:2"]["is_video"] and rows["dev:1.0:file:3"]["is_document"]
    assert rows["dev:1.0:attachment:1"]["file_type"] == "link" and rows["dev:1.0:attachment:1"]["url_private"] == "L"


def test_reactions_once_per_person(spark):
    users = spark.createDataFrame([("U1", "Ann")], "slack_id string, name string")
    raw = raw_frame(spark, [{"ts": "1.0", "reactions": [
        {"name": "tada", "users": ["U1", "U1", "U7", ""]}, 3, {"name": "eyes", "users": ["U1"]}]}])
    rows = nz.reactions(raw, rs.name_book(users), 99).collect()
    assert sorted((r["emoji"], r["user_name"]) for r in rows) == [(":eyes:", "Ann"), (":tada:", "Ann"), (":tada:", "U7")]
    assert {r["ts_us"] for r in rows} == {99}


def test_records_payload_wins(spark):
    recs = spark.createDataFrame(
        [("1.5", "D1", "U1", "typed", "1.5", None, '{"text":"raw","ts":"1.500000","subtype":"x"}'),
         ("2.5", "C1", "U2", "only", "2.5", "2.5", None)],
        "message_id string, conversation_id string, user_id string, text string, timestamp string, thread_ts string, raw string",
    )
    rows = landing.records_to_raw(recs).orderBy("ts").collect()
    assert [(r["ts"], r["text"], r["user"], r["subtype"]) for r in rows] == [
        ("1.500000", "raw", "U1", "x"), ("2.5", "only", "U2", None)]


def test_time_needs_no_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        from parley.functions.times import datetime_text
        one = spark.range(1).select(datetime_text(epoch_us(F.lit("0.5"))).alias("d"), datetime_text(epoch_us(F.lit("x"))).alias("e")).first()
        assert tuple(one) == ("1970-01-01 00:00:00", "Invalid Timestamp")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_unicode_words(spark):
    from parley.functions.text import word_count
    one = spark.createDataFrame([("a b c\n d ",), ("",), ("  ",)], "t string").select(word_count(F.col("t"))).collect()
    assert [r[0] for r in one] == [4, 0, 0]


def test_fields_of_odd_types_lose_no_message(spark):
    base = {"conversation_id": "C2", "ts": "1.0"}
    odd = [
        {**base, "reply_count": "3", "thread_ts": "1.0"}, {**base, "files": {}}, {**base, "ts": 2.5}, {**base, "text": ["a", 1]},
        {**base, "edited": 7, "reactions": "x", "blocks": {"a": 1}}, {**base, "user": 12, "subtype": None},
    ]
    landed = landing.parse_messages(lines(spark, [json.dumps(r) for r in odd] + ["{", "[1]", "7"]))
    good, bad = nz.split_bad_rows(landed)
    rows = good.collect()
    assert len(rows) == len(odd) and sorted(r["reason"] for r in bad.collect())[0] == "broken json" and bad.count() == 3
    assert {r["reply_count"] for r in rows} == {3, None} and {r["ts"] for r in rows} == {"1.0", "2.5"}
    assert {r["text"] for r in rows} == {None, '["a",1]'} and {r["user"] for r in rows} == {None, "12"}
    assert all(not r["files"] for r in rows)


def test_mentions_in_file_titles_and_rich_text_are_resolved(spark):
    rich = [{"type": "rich_text", "elements": [{"type": "rich_text_section", "elements": [
        {"type": "text", "text": "see <@U2> and "}, {"type": "user", "user_id": "U1"}, {"type": "text", "text": " in <#C2>"}]}]}]
    raw = raw_frame(spark, [
        {"ts": "1.0", "text": "", "files": [{"name": "f", "title": "for <@U1> in <#C3>"}]}, {"ts": "2.0", "text": "", "blocks": rich},
        {"ts": "3.0", "text": "<@U1><@U2><@U1> <@U9> <#C2> <#C3|x> <@U2>"},
    ])
    users = spark.createDataFrame([("U1", "Ann"), ("U2", "Bob")], "slack_id string, name string")
    channels = spark.createDataFrame([("C2", "dev"), ("C3", "ops")], "slack_id string, name string")
    good, _ = nz.split_bad_rows(raw)
    rows = {r["ts_us"]: r for r in nz.normalize(good, rs.name_book(users, channels)).collect()}
    first, second, third = (rows[k * 1_000_000] for k in (1, 2, 3))
    assert first["clean_text"] == "[File: f] for @Ann in #ops" and first["mentions_users"] == ["Ann"]
    assert second["text"] == "see <@U2> and @Ann in <#C2>" and second["clean_text"] == "see @Bob and @Ann in #dev"
    assert second["mentions_users"] == ["Bob"]
    assert third["clean_text"] == "@Ann@Bob@Ann @U9 #dev #x @Bob" and third["mentions_users"] == ["Ann", "Bob"]


@pytest.mark.parametrize("small", [True, False])
def test_repeated_ids_in_the_book_and_missing_keys(spark, monkeypatch, small):
    monkeypatch.setattr(rs, "is_small", lambda side: small)
    users = spark.createDataFrame([("U1", "Zed"), ("U1", "Ann"), ("U2", "Bob")], "slack_id string, name string")
    rows = [(None, "<@U1>"), (None, "<@U2>"), ("a", "<@U1> <@U2>"), ("a", "<@U1>"), (None, None), ("b", "<@U1><@U2><@U3><@U4><@U1>")]
    m = spark.createDataFrame(rows, "id string, text string")
    got = sorted(((r["id"], r["clean_text"], r["mentions_users"]) for r in rs.rewrite_mentions(m, rs.name_book(users)).collect()), key=repr)
    assert got == sorted([
        (None, "@Ann", ["Ann"]), (None, "@Bob", ["Bob"]), ("a", "@Ann @Bob", ["Ann", "Bob"]), ("a", "@Ann", ["Ann"]), (None, None, None),
        ("b", "@Ann@Bob@U3@U4@Ann", ["Ann", "Bob"])], key=repr)


def test_raw_lines_are_scanned_once(spark, tmp_path):
    lines(spark, [json.dumps({"conversation_id": "C2", "conversation_name": "dev", **r}) for r in RAW.values()]).write.text(str(tmp_path / "in"))
    users = spark.createDataFrame([("U1", "Ann")], "slack_id string, name string")
    raw = landing.read_messages(spark, str(tmp_path / "in")).withColumn("conversation_name", F.lit("dev"))
    plan = nz.normalize(raw, rs.name_book(users))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan json" not in plan and "Scan json" not in plan  # the drafts were written from one reading
