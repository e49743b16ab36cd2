import pytest
from test_lookup import messages

from parley.operators import repair as rp

CONV = "id string, name string, type string, participants array<string>"


@pytest.fixture
def chat(spark):
    return messages(spark, [("1", "D1", 1, "U1", "a"), ("2", "D1", 2, "U2", "b"), ("3", "C2", 3, "U1", "c"),
                            ("4", "x D10 y", 4, "U3", "d"), ("5", "DM: D5", 5, "None", "e"), ("6", "DM: D5", 5, "U9", "e")])


def names(df):
    return {r["id"]: r["name"] for r in df.collect()}


def test_names_from_participants(spark, people, chat):
    conv = spark.createDataFrame([
        ("D1", "D1", "dm", ["Bob", "ann1"]), ("D2", "DM: D2", "dm", ["Cy Real", "who?"]), ("D3", "D3", "dm", ["who?"]),
        ("D4", "pals", "dm", ["Ann"]), ("C2", "C2", "channel", ["Ann"]), ("D6", "D6", "dm", None)], CONV)
    fixed, renames = rp.repair_dm_names(conv, people[0])
    assert names(fixed) == {"D1": "Ann & Bob", "D2": "U3", "D3": "D3", "D4": "pals", "C2": "C2", "D6": "D6"}
    moved = rp.rename_conversations(chat, renames)
    assert moved.where("conversation_name = 'Ann & Bob'").count() == 2 and moved.count() == chat.count()


def test_channel_messages_filed_under_the_id(spark, chat):
    conv = spark.createDataFrame([("C2", "dev", "channel", None), ("D1", "z", "dm", None)], CONV)
    got = {r["id"]: r["conversation_name"] for r in rp.repair_message_names(conv, chat).collect()}
    assert got["3"] == "dev" and got["1"] == "D1"
    assert rp.message_name_fixes(conv, chat).count() == 1


def test_format_finds_the_id_anywhere_in_the_name(spark, chat):
    conv = spark.createDataFrame([
        ("D1", "U1", "dm", ["x"]), ("D10", "D10", "dm", None), ("D5", "DM: D5", "dm", ["k"]), ("D7", "Dora", "dm", ["x"]),
        ("C9", "U9", "channel", None)], CONV)
    got = {r["id"]: (r["name"], r["participants"]) for r in rp.repair_dm_format(conv, chat).collect()}
    assert got["D1"] == ("DM: D1", ["U1", "U2", "U3"])  # D10 holds D1
    assert got["D10"] == ("DM: D10", ["U3"]) and got["D7"] == ("DM: D7", None)
    assert got["D5"] == ("DM: D5", ["k"]) and got["C9"] == ("U9", None)


def test_readable_names_keep_the_stored_order(spark, people):
    conv = spark.createDataFrame([
        ("D1", "D1", "dm", ["U2", "USLACKBOT", "U1"]), ("D2", "D2", "dm", ["U9", "U1", "U2"]), ("D3", "D3", "dm", ["USLACKBOT"]),
        ("D4", "Ann", "dm", ["U1"]), ("D5", "x", "dm", [])], CONV)
    fixed, renames = rp.repair_dm_readable(conv, people[0])
    assert names(fixed) == {"D1": "Bob & Ann", "D2": "U9, Ann + 1 others", "D3": "D3", "D4": "Ann", "D5": "x"}
    assert {r["old_name"] for r in renames.collect()} == {"D1", "D2"}


def test_shared_old_name_moves_messages_once(spark, people, chat):
    conv = spark.createDataFrame([("D1", "D1", "dm", ["U1"]), ("D2", "D1", "dm", ["U2"])], CONV)
    fixed, renames = rp.repair_dm_readable(conv, people[0])
    assert renames.count() == 1 and rp.rename_conversations(chat, renames).count() == chat.count()
