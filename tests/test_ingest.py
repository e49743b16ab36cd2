import json
import os

import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import ingest, resolve as rs
from parley.sources import landing, tables
from parley.streaming import load


def conversations(spark, rows):
    return spark.createDataFrame(rows, schemas.CONVERSATIONS)


def incoming(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, type string, participants array<string>, seq long")


def test_conversation_upsert_keeps_what_a_later_row_lacks(spark, people):
    book = rs.name_book(*people)
    old = conversations(spark, [])
    at = F.expr("timestamp_micros(0)")
    first = ingest.upsert_conversations(old, incoming(spark, [
        ("D1", None, "dm", ["U2", "U1", "U9"], 1), ("C2", None, "channel", None, 1), ("D2", "Pals", "dm", ["U1"], 1),
        ("D3", None, "dm", None, 1)]), book, at)
    got = {r["id"]: r for r in first.collect()}
    assert got["D1"]["name"] == "Ann, Bob + 1 others" and got["D1"]["participants"] == ["Bob", "Ann", "U9"]
    assert got["C2"]["name"] == "dev" and got["D2"]["name"] == "Pals" and got["D3"]["name"] == "DM: D3"
    later = ingest.upsert_conversations(first, incoming(spark, [
        ("D1", None, "dm", None, 2), ("D2", None, "dm", [], 2), ("D3", None, "dm", ["U1"], 2)]), book, F.expr("timestamp_micros(5)"))
    got = {r["id"]: r for r in later.collect()}
    assert got["D1"]["name"] == "Ann, Bob + 1 others" and got["D2"]["participants"] == ["Ann"]
    assert got["D3"]["name"] == "Ann" and got["C2"]["updated_at"] != got["D3"]["updated_at"]


def test_marks_never_go_back(spark):
    state = spark.createDataFrame([("C1", 50), ("C2", 5)], schemas.SYNC_STATE)
    rows = spark.createDataFrame([("C1", 40), ("C2", 9), ("C3", 1)], "conversation_id string, ts_us long")
    assert {tuple(r) for r in ingest.update_marks(state, rows).collect()} == {("C1", 50), ("C2", 9), ("C3", 1)}
    again = ingest.update_marks(ingest.update_marks(state, rows), rows)
    assert {tuple(r) for r in again.collect()} == {("C1", 50), ("C2", 9), ("C3", 1)}


def test_window_is_strict_and_uses_the_later_bound(spark):
    day = 86_400_000_000
    state = spark.createDataFrame([("C1", 9 * day)], schemas.SYNC_STATE)
    rows = spark.createDataFrame([("C1", 9 * day), ("C1", 9 * day + 1), ("C2", 5 * day), ("C2", 5 * day + 1)], "conversation_id string, ts_us long")
    got = {tuple(r) for r in ingest.newer_than_marks(rows, state, 10 * day, sync_days=5).collect()}
    assert got == {("C1", 9 * day + 1), ("C2", 5 * day + 1)}
    assert ingest.newer_than_marks(rows, ingest.cleared_marks(state), 10 * day, sync_days=0).count() == 4


def test_threads_drop_the_parent_only(spark):
    cols = "id string, conversation_id string, conversation_type string, ts_us long, thread_ts_us long"
    hist = spark.createDataFrame([("p", "C1", "channel", 1, 1), ("q", "C1", "channel", 5, None), ("d", "D1", "dm", 1, 1)], cols)
    threads = spark.createDataFrame([
        ("p", "C1", "channel", 1, 1), ("r1", "C1", "channel", 2, 1), ("r2", "C1", "channel", 3, 1),
        ("x", "C1", "channel", 9, 8), ("d", "D1", "dm", 1, 1), ("d2", "D1", "dm", 2, 1)], cols)
    assert sorted(r["id"] for r in ingest.expand_threads(hist, threads).collect()) == ["d", "p", "q", "r1", "r2"]


def test_config_channels(spark, people):
    _, channels = people
    listed = spark.createDataFrame([("dev", "C99")], "name string, id string")
    got = dict(tuple(r) for r in ingest.resolve_config_channels(["dev", "#dev-ops", "ops", "zzz"], listed, channels).collect())
    assert got == {"dev": "C99", "#dev-ops": "C3", "ops": "C3", "zzz": None}
    assert ingest.merge_names(["b", "a"], ["a"]) == ["a", "b"]


def test_dims_guard(spark, people):
    users, channels = people
    assert not ingest.dims_missing(users, channels) and ingest.dims_missing(users.limit(0), channels)


# --- streaming -----------------------------------------------------------------------


def message(i, text, conv="C2", **more):
    return {"conversation_id": conv, "conversation_type": "channel" if conv[0] == "C" else "dm",
            "ts": f"{1700000000 + i * 3600}.000000", "user": "U1", "text": text, **more}


BATCHES = [
    [message(i, f"m{i}", files=[{"name": "f"}], reactions=[{"name": "x", "users": ["U1"]}]) for i in range(30)] + [{"text": "no ts"}],
    [message(3, "edited", edited={"ts": "1800000000.0"}), message(40, "late dm", conv="D7")],
    [message(2, "again"), message(41, "new <@U2>")],
]


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def run(spark, people, landing_dir, store):
    users, channels = people
    dims = conversations(spark, [("C2", "dev", "channel", None, None, None, 0, None)])
    load.stream_load(spark, str(landing_dir), store, dims, users, channels, 5).awaitTermination()


def test_plain_and_bad_batches_keep_the_load_going(spark, people, tmp_path):
    """A batch without files, links or reactions, and one of bad rows only, with a restart after each."""
    store = load.Store(str(tmp_path / "t"))
    steps = [
        ([message(1, "plain")], 1, 0), ([{"conversation_id": "C2", "ts": "abc"}, {"ts": "1.0", "text": "lost?"}], 1, 2),
        ([message(100, "other day")], 2, 2), ([message(1, "with file", files=[{"name": "f"}])], 2, 2),
        ([message(1, "plain again")], 2, 2),
    ]
    for i, (rows, stored, bad) in enumerate(steps):
        land(tmp_path / "in", f"{i}.json", rows)
        run(spark, people, tmp_path / "in", store)
        assert load.read_messages_table(spark, store).count() == stored
        assert bad == 0 or spark.read.json(store.path("quarantine")).count() == bad
    texts = {r["clean_text"] for r in load.read_messages_table(spark, store).collect()}
    assert texts == {"plain again", "other day"}
    reasons = {r["reason"] for r in spark.read.json(store.path("quarantine")).collect()}
    assert reasons == {"ts is not a number", "missing conversation_id"}
    marks = dict(tuple(r) for r in spark.read.parquet(store.path("sync_state")).collect())
    assert marks == {"C2": 1700360000000000}
    assert not [n for n in os.listdir(store.root) if n.endswith("__staged") or n.startswith("_batch")]


def test_upsert_ranks_new_rows_only(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id int, v string, seq int")
    got = tables.upsert(old, new, ["id"], [F.desc("seq")])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    part = tables.upsert(old, new.drop("v"), ["id"], [F.desc("seq")])
    assert sorted(map(tuple, part.collect())) == [(1, "a", 1), (2, None, 3), (3, None, 1)]


def tables_of(spark, store):
    frames = [load.read_messages_table(spark, store)] + [
        spark.read.parquet(store.path(t)) for t in ("attachments", "reactions", "sync_state", "conversations")]
    return [sorted(map(repr, (r.asDict() for r in f.select(*sorted(f.columns)).collect()))) for f in frames]


def test_stream_in_steps_equals_one_go_and_replays_cleanly(spark, people, tmp_path):
    stepwise = load.Store(str(tmp_path / "a"))
    for i, rows in enumerate(BATCHES):
        land(tmp_path / "in_a", f"{i}.json", rows)
        run(spark, people, tmp_path / "in_a", stepwise)
    got = tables_of(spark, stepwise)
    texts = {r["id"]: r["clean_text"] for r in load.read_messages_table(spark, stepwise).collect()}
    assert len(texts) == 32
    assert texts["dev:1700010800.000000"] == "edited" and texts["dev:1700007200.000000"] == "again"
    assert texts["DM: D7:1700144000.000000"] == "late dm" and texts["dev:1700147600.000000"] == "new @Bob"
    assert dict(tuple(r) for r in spark.read.parquet(stepwise.path("sync_state")).collect()) == {
        "C2": 1700147600000000, "D7": 1700144000000000}
    assert spark.read.json(stepwise.path("quarantine")).count() == 1
    rooms = {r["id"]: (r["name"], r["type"], r["latest_message_ts_us"]) for r in spark.read.parquet(stepwise.path("conversations")).collect()}
    assert rooms == {"C2": ("dev", "channel", 1700147600000000), "D7": ("DM: D7", "dm", 1700144000000000)}
    assert not [n for n in os.listdir(stepwise.root) if n.startswith("_batch")]

    # Nothing new: nothing changes.
    run(spark, people, tmp_path / "in_a", stepwise)
    assert tables_of(spark, stepwise) == got

    # The same batch loaded again changes nothing.
    users, channels = people
    raw = landing.read_messages(spark, str(tmp_path / "in_a" / "2.json"))
    dims = conversations(spark, [("C2", "dev", "channel", None, None, None, 0, None)])
    load.load_batch(spark, raw, stepwise, dims, users, channels, 2, 5)
    assert tables_of(spark, stepwise) == got


def test_lost_swap_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "id string, dt string")
    old.write.partitionBy("dt").parquet(path)
    new = spark.createDataFrame([("a2", "2024-01-01")], "id string, dt string")
    new.write.partitionBy("dt").parquet(f"{path}__staged")
    assert tables.finish_pending_swap(spark, path, ["dt"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["a2", "b"]
    assert not tables.finish_pending_swap(spark, path, ["dt"])


def test_small_table_survives_a_lost_driver(spark, tmp_path):
    path = str(tmp_path / "s")
    state = lambda n: spark.createDataFrame([("C1", n)], schemas.SYNC_STATE)
    tables.replace_small(spark, path, state(1))
    tables.replace_small(spark, path, tables.read_small(spark, path, schemas.SYNC_STATE).withColumn("last_ts_us", F.lit(2).cast("long")))
    assert tables.read_small(spark, path, schemas.SYNC_STATE).first()["last_ts_us"] == 2
    state(3).write.parquet(f"{path}__aside")
    assert tables.read_small(spark, path, schemas.SYNC_STATE).first()["last_ts_us"] == 3
    assert tables.read_small(spark, str(tmp_path / "none"), schemas.SYNC_STATE).isEmpty()


def test_half_written_stage_is_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "x")], "id string, dt string").write.partitionBy("dt").parquet(path)
    (tmp_path / "t__staged").mkdir()
    (tmp_path / "t__staged" / "part-0.parquet").write_text("broken")
    assert not tables.finish_pending_swap(spark, path, ["dt"])
    assert spark.read.parquet(path).count() == 1 and not (tmp_path / "t__staged").exists()


@pytest.mark.parametrize("strict,expected", [(True, [3]), (False, [2, 3])])
def test_since_prunes_dates(spark, tmp_path, strict, expected):
    day = 86_400_000_000
    rows = tables.with_date(spark.createDataFrame([(1, 0), (2, day), (3, day + 1)], "n int, ts_us long"))
    path = str(tmp_path / "m")
    rows.write.partitionBy("dt").parquet(path)
    late = tables.since(spark.read.parquet(path), day, strict)
    assert sorted(r["n"] for r in late.collect()) == expected
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("a\nb",)], "t string")
    tables.write_text(df, "t", str(tmp_path / "txt"))
    tables.write_json(df, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).first()["t"] == "a\nb"
    assert spark.read.text(str(tmp_path / "txt"), wholetext=True).first()[0] == "a\nb\n"


def test_backfill_names_all_threads_unless_a_number_is_given(spark):
    rows = [(f"m{k}", "hot" if k < 40 else "other", k, True, int(k != 3)) for k in range(45)]
    m = spark.createDataFrame(rows, "id string, conversation_name string, ts_us long, is_thread_parent boolean, reply_count int")
    assert {r["id"] for r in ingest.threads_to_backfill(m).collect()} == {f"m{k}" for k in range(45) if k != 3}
    newest = {r["id"] for r in ingest.threads_to_backfill(m, 2).collect()}
    assert newest == {"m39", "m38", "m44", "m43"}


# --- a store that readers cannot harm, one evaluation a batch ------------------------------


def test_reading_leaves_a_running_write_alone(spark, people, tmp_path):
    store = load.Store(str(tmp_path / "t"))
    land(tmp_path / "in", "0.json", BATCHES[0])
    run(spark, people, tmp_path / "in", store)
    for stage in ("messages__staged", "conversations__next", "sync_state__next"):
        (tmp_path / "t" / stage).mkdir()
        (tmp_path / "t" / stage / "part-0.parquet").write_text("half written")
    done = tmp_path / "t" / "attachments__staged"
    done.mkdir()
    (done / "_SUCCESS").write_text("")
    before = sorted(str(p) for p in (tmp_path / "t").rglob("*"))
    assert load.read_messages_table(spark, store).count() == 30
    assert load.read_conversations(spark, store).count() == 1 and load.read_daily(spark, store).count() > 0
    assert load.known_conversations(spark, store, None).count() == 1
    assert sorted(str(p) for p in (tmp_path / "t").rglob("*")) == before
    land(tmp_path / "in", "1.json", BATCHES[1])
    run(spark, people, tmp_path / "in", store)
    assert load.read_messages_table(spark, store).count() == 31
    assert not [n for n in os.listdir(store.root) if "__" in n]


def test_new_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    noted = F.udf(note, "long")
    new = spark.range(1000).withColumn("v", noted("id")).withColumn("dt", F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")))
    old = spark.range(500).selectExpr("id", "-1L as v", "'2024-01-01' as dt")
    assert tables.upsert(old, new, ["id"], [F.desc("v")]).count() == 1000 and seen.value == 1000
    schema = schemas.T.StructType([schemas.T.StructField("id", schemas.L), schemas.T.StructField("v", schemas.L), schemas.T.StructField("dt", schemas.S)])
    for k in (2, 3):
        _, touched = tables.upsert_into(spark, str(tmp_path / "m"), new, schema, ["id"], [F.desc("v")], ["dt"])
        assert seen.value == k * 1000 and touched == [{"dt": f"2024-01-0{d}"} for d in (1, 2, 3)]
    assert tables.read_table(spark, str(tmp_path / "m"), schema).count() == 1000


def counts(spark, store):
    return {r["id"]: (r["message_count"], r["latest_message_ts_us"]) for r in load.read_conversations(spark, store).collect()}


def test_counts_are_right_after_every_batch(spark, people, tmp_path):
    """An edit counts no message twice, a batch loaded again changes nothing."""
    store = load.Store(str(tmp_path / "t"))
    users, channels = people
    dims = conversations(spark, [("C2", "dev", "channel", None, None, None, 0, None)])
    at = lambda i: (1700000000 + i * 3600) * 1_000_000
    steps = [(0, {"C2": (30, at(29))}), (1, {"C2": (30, at(29)), "D7": (1, at(40))}), (2, {"C2": (31, at(41)), "D7": (1, at(40))}),
             (2, {"C2": (31, at(41)), "D7": (1, at(40))}), (0, {"C2": (31, at(41)), "D7": (1, at(40))})]
    for n, (k, want) in enumerate(steps):
        land(tmp_path / "in", f"{n}.json", BATCHES[k])
        load.load_batch(spark, landing.read_messages(spark, str(tmp_path / "in" / f"{n}.json")), store, dims, users, channels, n, 5)
        assert counts(spark, store) == want
        m = load.read_messages_table(spark, store)
        by_author = {tuple(r) for r in m.groupBy("conversation_name", "user_name").count().collect()}
        days = load.read_daily(spark, store).groupBy("conversation_name", "user_name").agg(F.sum("messages"))
        assert {tuple(r) for r in days.collect()} == by_author


def test_kept_search_finds_streamed_messages(spark, people, tmp_path):
    from parley.operators import search

    store = load.Store(str(tmp_path / "t"))
    for i, rows in enumerate(BATCHES):
        land(tmp_path / "in", f"{i}.json", rows)
        run(spark, people, tmp_path / "in", store)
    found = search.search_kept(load.read_messages_table(spark, store), load.read_grams(spark, store), "New @Bob")
    assert [r["clean_text"] for r in found.collect()] == ["new @Bob"]
    assert search.search_kept(load.read_messages_table(spark, store), load.read_grams(spark, store), "m3 ann").isEmpty()  # edited away


def test_replies_are_filed_by_root_date(spark, people, tmp_path):
    store = load.Store(str(tmp_path / "t"))
    root = "1700000000.000000"
    rows = [message(0, "root", thread_ts=root, reply_count=2), message(30, "late reply", thread_ts=root), message(1, "plain")]
    land(tmp_path / "in", "0.json", rows)
    run(spark, people, tmp_path / "in", store)
    assert [(r["text"], r["root_dt"]) for r in load.read_replies(spark, store).collect()] == [("late reply", "2023-11-14")]


def dim(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dimensions_are_merged_and_times_move_on_change_only(spark, tmp_path):
    store = load.Store(str(tmp_path / "t"))

    def users(second):
        return dim(spark, [("U1", "ann", "Ann A", False, ("Ann" if not second else "Anna", None)), ("U2", "bob", "", False, ("", ""))], schemas.RAW_USER)

    rooms = dim(spark, [("C2", "dev", None, None, False, 3), (None, "lost", None, None, False, 3)], schemas.RAW_CHANNEL)
    dms = dim(spark, [("D1", True, False, "U1", None), ("D2", False, True, None, ["U1", "U2", "U9"]), ("D3", True, False, None, None)], schemas.RAW_DM)
    assert load.load_dimensions(spark, store, users(False), rooms, dms, 1_000_000, only_if_missing=True)
    assert not load.load_dimensions(spark, store, users(True), rooms, dms, 2_000_000, only_if_missing=True)
    assert load.load_dimensions(spark, store, users(True), rooms, dms, 3_000_000)
    people, channels = load.read_dims(spark, store)
    us = F.unix_micros
    got = {r[0]: tuple(r[1:]) for r in people.select("slack_id", "name", us("created_at"), us("updated_at")).collect()}
    assert got == {"U1": ("Anna", 1_000_000, 3_000_000), "U2": ("bob", 1_000_000, 1_000_000)}
    assert [r["updated_at"].timestamp() for r in channels.where("slack_id is not null").collect()] == [1.0]
    names = {r["id"]: (r["name"], r["type"], r["participants"]) for r in load.read_conversations(spark, store).collect()}
    assert names == {
        "C2": ("dev", "channel", None), "D1": ("Anna", "dm", ["Anna"]), "D2": ("Anna, U9 + 1 others", "dm", ["Anna", "bob", "U9"]),
        "D3": ("DM: D3", "dm", None)}


def test_dimensions_are_read_again_before_each_batch(spark, tmp_path):
    store, root = load.Store(str(tmp_path / "t")), tmp_path / "dims"
    landed = load.LandedDims(*[str(root / n) for n in ("users", "channels", "dms")])
    nobody = spark.createDataFrame([], "slack_id string, name string")
    none = conversations(spark, [])
    for step, name in enumerate(("Ann", "Anna")):
        for kind, row in (("users", {"id": "U1", "name": "ann", "profile": {"display_name": name}}), ("channels", {"id": "C2", "name": "dev"}), ("dms", {"id": "D7", "is_im": True, "user": "U1"})):
            (root / kind).mkdir(parents=True, exist_ok=True)
            (root / kind / f"{step}.json").write_text(json.dumps(row) + "\n")
        land(tmp_path / "in", f"{step}.json", [message(step, "hi <@U1>"), message(step, "direct", conv="D7")])
        load.stream_load(spark, str(tmp_path / "in"), store, none, nobody, nobody, lambda batch: 10 + batch, landed_dims=landed).awaitTermination()
    texts = {r["id"]: (r["clean_text"], r["user_name"]) for r in load.read_messages_table(spark, store).collect()}
    assert texts["dev:1700000000.000000"] == ("hi @Ann", "Ann") and texts["dev:1700003600.000000"] == ("hi @Anna", "Anna")
    assert texts["Anna:1700003600.000000"] == ("direct", "Anna")
    assert {r["name"] for r in load.read_conversations(spark, store).collect()} == {"dev", "Anna"}
    assert load.read_dims(spark, store)[0].select(F.unix_micros("updated_at")).first()[0] == 11


def test_newest_landed_record_counts(spark, tmp_path):
    for k, name in enumerate(("old", "new")):
        (tmp_path / f"{k}.json").write_text(json.dumps({"id": "U1", "name": name}) + "\n")
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))
    assert [r["name"] for r in landing.read_users(spark, str(tmp_path)).collect()] == ["new"]
