"""Tables kept beside the messages: counts, pages, searches, replies by root date, links of context."""

import random

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from parley.operators import activity, followups as fu, kept, keyed, lookup as lk, people, search
from parley.plans import views as v


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return v.kept_tables(spark, SMALL)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_daily_counts_add_up(spark, tables):
    whole = v.messages(spark, SMALL).groupBy("conversation_name").agg(
        F.count(F.lit(1)), F.min("ts_us"), F.max("ts_us"))
    assert rows_of(kept.totals(tables["daily"])) == rows_of(whole)


def test_grams_of_a_text(spark):
    texts = ["", "ab", "abc", "abcabc", "é😀x y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [sorted(r[0]) for r in df.select(kept.text_grams(F.col("t"))).collect()]
    assert found == [sorted({t[k:k + 3] for k in range(len(t) - 2)}) if t else [] for t in texts]


@pytest.mark.parametrize("term,conversation,user,limit", [
    ("purchase", None, None, 50), ("SAW VIEW in", None, "U1", 7), ("no such words", None, None, 50), ("#g", "nation_3", None, 5),
    ("", None, None, 3), ("http", "nation_4", "U", 1000), ("%", None, None, 5),
])
def test_search_equals_the_full_read(tables, term, conversation, user, limit):
    m = tables["messages"]
    cols = ["id", "ts_us", "conversation_name", "clean_text"]
    want = lk.search_messages(m, term, conversation, user, limit).select(*cols)
    got = search.search_kept(m, tables["grams"], term, conversation, user, limit).select(*cols)
    assert rows_of(got) == rows_of(want)


def test_search_reads_candidate_dates_only(spark, tables):
    m = tables["messages"]
    newest = m.agg(F.max(F.col("dt").cast("string"))).first()[0]
    plan = plan_of(search.search_kept(m, tables["grams"], "saw", limit=1))
    filters = [line for line in plan.splitlines() if "FileScan parquet" in line and "/messages" in line]
    assert filters and all(newest in line.split("PartitionFilters")[1] for line in filters)
    dates = m.select("dt").distinct().count()
    assert dates > 5 and all(line.count("20") < 3 * dates for line in filters)


@pytest.mark.parametrize("offset,limit", [(0, 5), (3, 4), (11, 100), (10_000, 5), (0, 0), (24, 1)])
def test_page_equals_the_full_read(tables, offset, limit):
    m = tables["messages"]
    want = m.where("conversation_name = 'nation_7'").orderBy("ts_us", "id").offset(offset).limit(limit).select("id")
    got = lk.deep_page(m, tables["daily"], "nation_7", limit, offset).select("id")
    assert [r.id for r in got.collect()] == [r.id for r in want.collect()]


def test_page_reads_few_dates(tables):
    plan = plan_of(lk.deep_page(tables["messages"], tables["daily"], "nation_7", 2, 12))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all(" IN (" in line or "= 20" in line for line in (s.split("PartitionFilters")[1] for s in scans))


def test_replies_are_read_by_the_date_of_their_root(spark, tables):
    window = activity.channel_window(tables["messages"], v.CUTOFF_14D)
    plan = plan_of(activity.channel_threads(window, tables["replies"], v.users(spark, SMALL), v.CUTOFF_14D))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "/replies" in line)
    assert "GreaterThan(thread_ts_us," in scan and "root_dt" in scan.split("PartitionFilters")[1]


def test_who_wrote_where_needs_no_history(spark, tables):
    found = people.interactions_all(
        tables["messages"], v.users(spark, SMALL), v.conversations_dim(spark, SMALL), v.PERSON, v.CUTOFF_30D, authors=tables["daily"])
    scans = [line for line in plan_of(found).splitlines() if "FileScan parquet" in line and "/messages" in line]
    assert scans and all("dt#" in s.split("PartitionFilters")[1] for s in scans)


def test_context_names_the_next_item(spark):
    draw = random.Random(5)
    hour = 3_600_000_000
    messages = [(f"c{k % 3}", f"m{k}", draw.randrange(0, 60) * hour // 4) for k in range(200)]
    items = [(c, i, t) for c, i, t in messages if draw.random() < 0.1] + [("c9", "alone", 5)]
    schema = "conversation_name string, id string, ts_us long"
    context = spark.createDataFrame(messages, schema).withColumn("text", F.lit("x"))
    got = {(r.conversation_name, r.id): (r.next_item_id, r.next_item_ts_us) for r in fu.link_context(context, spark.createDataFrame(items, schema)).collect()}
    want = {
        (c, i): (lambda later: (later[1], later[0]) if later else (None, None))(min(((t2, j) for d, j, t2 in items if d == c and t2 > t), default=None))
        for c, i, t in messages
    }
    assert got == want and len(got) == 200
    assert fu.link_context(context, spark.createDataFrame([], schema)).where("next_item_id is not null").isEmpty()


def test_running_start_of_hot_and_missing_groups(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["hot", "hot", "hot", "b", None]), draw.randrange(50), k, draw.randrange(1, 9)) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, t long, row long, size long").repartition(5)
    got = {r.row: r.start for r in keyed.running_start(df, ["g"], ["t"], "size", "row").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        at = 0
        for _, t, k, size in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            want[k] = at
            at += size
    assert got == want
