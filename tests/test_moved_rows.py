"""Wide rows stay where they are: lookups go by the few ids or keys in question, also beside large tables."""

import random

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import kept, keyed, normalize as nz, resolve as rs
from parley.plans import views as v
from parley.sources import tables
from parley.streaming import load


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_size_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def small_is(monkeypatch):
    """Tables count as small up to so many rows."""

    def to(rows):
        monkeypatch.setattr(rs, "is_small", lambda side: side.count() <= rows)
        monkeypatch.setattr(v, "is_small", lambda side: side.count() <= rows, raising=False)

    return to


def test_texts_of_events_are_built_after_the_lookups(spark, no_size_broadcast, small_is):
    want = sorted(map(tuple, v.messages(spark, SMALL).collect()), key=repr)
    small_is(10)
    found = v.messages(spark, SMALL)
    plan = plan_of(found)
    assert "Exchange" in plan and plan.rindex(" saw ") < plan.index("Exchange")
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_lines_are_dealt_out_before_they_are_built(spark):
    plan = plan_of(v.landed_lines(spark, SMALL, spread=3))
    assert plan.rindex(" saw ") < plan.index("REPARTITION_BY_NUM")


def test_grams_need_no_array_per_character(spark):
    texts = ["", "ab", "abcabc", "é😀x\ny", None, "Abc"]
    rows = spark.createDataFrame([("dm", "2024-01-01", f"c{k % 2}", t, t and t.lower()) for k, t in enumerate(texts)],
                                 "conversation_type string, dt string, conversation_name string, clean_text string, search_text string")
    found = kept.grams(rows)
    want = {(f"c{k % 2}", x[i:i + 3]) for k, t in enumerate(texts) if t for x in (t, t.lower()) for i in range(len(x) - 2)}
    got = [(r.conversation_name, r.gram) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "lambda" not in plan_of(found) and "split(" not in plan_of(found)


def test_conversation_names_move_no_messages(spark, no_size_broadcast, small_is):
    raw = spark.createDataFrame([("C1", None, "a"), ("C2", "channel", "b"), ("D1", None, "c"), (None, None, "d"), ("C9", None, "e")],
                                "conversation_id string, conversation_type string, text string")
    book = spark.createDataFrame([("C1", "one"), ("C2", "two"), ("U1", "Ann")], "ref_id string, ref_name string")
    known = spark.createDataFrame([("C2", "stored"), ("D1", "")], "id string, name string")
    small_is(0)
    named = nz.with_conversation_name(raw, known, book)
    assert {r.text: r.conversation_name for r in named.collect()} == {"a": "one", "b": "stored", "c": "DM: D1", "d": None, "e": "C9"}
    assert "SortMergeJoin" not in plan_of(named)


def test_few_ids_of_a_large_book_are_broadcast(spark, no_size_broadcast, small_is):
    rows = spark.createDataFrame([(k, [f"U{k % 3}", "U1"]) for k in range(20)], "k long, ids array<string>")
    book = spark.range(50).selectExpr("concat('U', id) as ref_id", "concat('name ', id) as ref_name")
    small_is(10)
    named = rs.attach_names(rows, F.col("ids"), book)
    assert {r.k: r.names for r in named.collect()} == {k: {f"U{k % 3}": f"name {k % 3}", "U1": "name 1"} for k in range(20)}
    direct = plan_of(named).split("Union", 1)[1].split("many-ids")[0]
    assert direct.count("BroadcastHashJoin") >= rs.DIRECT_IDS


@pytest.mark.parametrize("limit", [100_000, 3])
def test_only_repeated_keys_are_ranked(spark, monkeypatch, limit):
    monkeypatch.setattr(keyed, "is_small", lambda side: side.count() <= limit)
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(40)]), draw.choice(["a", None]), k) for k in range(60)]
    df = spark.createDataFrame(rows, "a long, b string, seq long")
    want = {}
    for a, b, k in rows:
        want[a, b] = max(k, want.get((a, b), -1))
    got = [tuple(r) for r in keyed.latest_of_stored(df, ["a", "b"], [F.desc("seq")]).collect()]
    assert sorted(got, key=repr) == sorted([(*key, k) for key, k in want.items()], key=repr)
    single = df.dropDuplicates(["seq"])
    assert "Window" not in plan_of(keyed.latest_of_stored(single, ["seq"], [F.desc("seq")]))


def test_first_rows_of_a_date_move_once(spark, tmp_path):
    schema = schemas.T.StructType([schemas.T.StructField("id", schemas.L), schemas.T.StructField("dt", schemas.S)])
    new = spark.range(30).selectExpr("id", "concat('2024-01-0', id % 3 + 1) as dt")
    latest, _ = tables.upsert_into(spark, str(tmp_path / "m"), new, schema, ["id"], [F.desc("id")], ["dt"])
    plan = plan_of(latest)
    assert "Window" not in plan and "Exchange" not in plan and "PartitionFilters" in plan and "dt=" in str(latest.inputFiles())
    tables.upsert_into(spark, str(tmp_path / "m"), new.where("id < 9"), schema, ["id"], [F.desc("id")], ["dt"])
    assert tables.read_table(spark, str(tmp_path / "m"), schema).count() == 30
