"""Per-key building blocks that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.session import written

BROADCAST_ROWS = 100_000


def is_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Row count that stops at the limit."""
    return side.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a checked row count.

    Above the limit no hint is set: Spark then plans a shuffle join, where
    adaptive execution splits partitions swollen by a hot key.
    """
    return F.broadcast(side) if is_small(side, max_rows) else side


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in `order`.

    `row_number() = 1` lets Spark keep one row per key on the map side already
    (WindowGroupLimit), so a key sent again and again does not pile up.
    """
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_of_stored(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`latest_per_key` of rows that are written aside: only those whose key comes again are ranked and moved.

    Keys are counted by their hash; a chance collision ranks two rows that keep their own keys.
    """
    hashed = rows.withColumn("_key", F.xxhash64(*key))
    again = written(hashed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "repeated")
    if again.isEmpty():
        return rows
    if not is_small(again):
        return written(latest_per_key(rows, key, order), "latest")
    alone = hashed.join(F.broadcast(again), "_key", "left_anti").drop("_key")
    copies = hashed.join(F.broadcast(again), "_key", "left_semi").drop("_key")
    return alone.unionByName(written(latest_per_key(copies, key, order), "latest"))


def _ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """`row_number() <= n`; Spark keeps at most n rows per group on the map side (WindowGroupLimit)."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], spread_by: Sequence[str], n: int,
    fan_out: int = 16, keep_rank: str | None = None,
) -> DataFrame:
    """First `n` rows of each group.

    Ranked inside `fan_out` hash slices of each group first, so that at most
    `n * fan_out` rows of a group meet in the final ranking, however large it is.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.lit(fan_out)))
    short = _ranked(sliced, [*group, "_slice"], order, n, "_rn").drop("_rn", "_slice")
    final = _ranked(short, group, order, n, keep_rank or "_rn")
    return final if keep_rank else final.drop("_rn")


def running_start(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: str, row: str) -> DataFrame:
    """(row, start): the sum of `size` over the earlier rows of the same group, in order.

    `rows` should be narrow; `row` is unique. A range sort over (group, order) spreads
    a group of any size over many tasks, of which only the sums are combined.
    """
    keys = [F.col(c) for c in (*group, *order, row)]
    ordered = rows.select(*group, *order, size, row).repartitionByRange(*keys).sortWithinPartitions(*keys)
    lines = written(
        ordered.select(*group, size, row, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_line")),
        "ordered",
    )
    sums = lines.groupBy(*group, "_part").agg(F.sum(size).alias("_sum"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    named = [F.col(c).alias(f"_of_{c}") for c in group]
    carried = sums.select(*named, F.col("_part").alias("_in"), F.sum("_sum").over(earlier).alias("_carried")).where("_carried is not null")
    # At most one group reaches into a partition from the one before: no more rows than partitions.
    same = F.col("_part") == F.col("_in")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    here = W.partitionBy(*group, "_part").orderBy("_line").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce("_carried", F.lit(0)) + F.coalesce(F.sum(size).over(here), F.lit(0))
    return lines.join(F.broadcast(carried), same, "left").select(row, start.cast("bigint").alias("start"))
