"""Balanced building blocks against the plain window, with one hot key."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from parley.operators import keyed


def hot_rows_frame(spark, n=3000):
    """A third of the rows belong to one group; many times collide."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"g{rng.randrange(50)}", rng.randrange(400), f"i{i:05d}") for i in range(n)]
    return spark.createDataFrame(rows, "g string, ts long, id string")


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("fan_out", [1, 7, 64])
def test_first_n_equals_plain_rank(spark, fan_out):
    df = hot_rows_frame(spark)
    w = W.partitionBy("g").orderBy("ts", "id")
    plain = df.withColumn("rn", F.row_number().over(w)).where("rn <= 7")
    order = [F.asc("ts"), F.asc("id")]
    fast = keyed.first_n_per_group(df, ["g"], order, ["id"], 7, fan_out, keep_rank="rn")
    assert same(plain, fast)
    newest = keyed.first_n_per_group(df, ["g"], [F.desc("ts"), F.asc("id")], ["id"], 3, fan_out)
    assert newest.where("g = 'hot'").count() == 3 and newest.columns == df.columns


def test_first_n_prunes_before_the_shuffle(spark):
    order = [F.asc("ts"), F.asc("id")]
    found = keyed.first_n_per_group(hot_rows_frame(spark), ["g"], order, ["id"], 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Scan") == 1


def test_latest_ignores_input_order(spark):
    df = hot_rows_frame(spark)
    one = keyed.latest_per_key(df, ["g"], [F.desc("ts"), F.desc("id")])
    two = keyed.latest_per_key(df.orderBy(F.rand(3)), ["g"], [F.desc("ts"), F.desc("id")])
    assert same(one, two) and one.count() == df.select("g").distinct().count()


def test_broadcast_only_below_the_limit(spark):
    side = spark.range(50)
    assert "broadcast" in keyed.broadcast_if_small(side, 50)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in keyed.broadcast_if_small(side, 49)._jdf.queryExecution().logical().toString().lower()
