"""Parquet tables with insert-or-replace by key.

Messages are partitioned by type and date. A message's key fixes its date, so a
batch can only change the partitions its own rows fall into: those are read,
merged, staged in full and swapped in; all others stay untouched. Small tables are
written whole beside the old one and moved into place.

There is one writer at a time. It alone finishes or drops what a lost driver left
behind; readers never change anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from parley.functions.times import date_text
from parley.operators.keyed import broadcast_if_small, latest_of_stored, latest_per_key
from parley.session import written

MESSAGE_PARTITIONS = ("conversation_type", "dt")


def with_date(messages: DataFrame) -> DataFrame:
    return messages.withColumn("dt", date_text(F.col("ts_us")))


def since(messages: DataFrame, cutoff_us: int, strict: bool = True) -> DataFrame:
    """Rows after the cutoff; prunes date partitions when the table has them."""
    late = F.col("ts_us") > cutoff_us if strict else F.col("ts_us") >= cutoff_us
    rows = messages.where(late)
    if "dt" in messages.columns:
        rows = rows.where(F.col("dt").cast("string") >= date_text(F.lit(cutoff_us).cast("bigint")))
    return rows


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one with its schema when nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old and new rows together, last write per key.

    `order` ranks the new rows among themselves (latest first); any new row beats
    an old one. The new rows are computed once and written aside. Old rows are
    neither ranked nor, when the new keys are few, moved. Columns missing from
    `new` become NULL, as only the listed columns are replaced by a fresh row.
    """
    return replaced(old, written(latest_per_key(new, key, order), "fresh"), key)


def replaced(old: DataFrame, latest: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows without those that have a row of the same key in `latest`, which is unique by key, and that."""
    keys = broadcast_if_small(latest.select(*key))
    return old.join(keys, list(key), "left_anti").unionByName(latest, allowMissingColumns=True).select(
        *old.columns, *[c for c in latest.columns if c not in old.columns]
    )


def _swap_in(spark: SparkSession, staged: str, path: str, partitions: Sequence[str]) -> None:
    """Move the staged partition folders into place. Safe to repeat while the stage exists.

    A folder leaves the stage only by the rename that puts it in place, so whatever
    a lost driver left undone is still there. An empty stage moves nothing.
    """
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, path)
    new_path = spark._jvm.org.apache.hadoop.fs.Path

    def move(here, there, depth: int) -> None:
        for child in fs.listStatus(here):
            name = child.getPath().getName()
            if not child.isDirectory() or "=" not in name:
                continue
            to = new_path(there, name)
            if depth > 1:
                move(child.getPath(), to, depth - 1)
            else:
                fs.mkdirs(there)
                fs.delete(to, True)
                if not fs.rename(child.getPath(), to):
                    raise OSError(f"could not move {child.getPath()} to {to}")

    move(source, target, len(partitions))
    drop_path(spark, staged)


def finish_pending_swap(spark: SparkSession, path: str, partitions: Sequence[str]) -> bool:
    """Complete a swap that a lost driver left behind; a half-written stage is discarded. For the writer only."""
    staged = f"{path}__staged"
    if not path_exists(spark, staged):
        return False
    if path_exists(spark, f"{staged}/_SUCCESS"):
        _swap_in(spark, staged, path, partitions)
        return True
    drop_path(spark, staged)
    return False


def _place(partitions: Sequence[str]) -> Column:
    """The partition a row lies in, as one text."""
    return F.concat_ws("/", *[F.col(name).cast("string") for name in partitions])


def touched_partitions(batch: DataFrame, partitions: Sequence[str]) -> list[dict[str, str]]:
    """The partitions that the rows of a batch fall into: a short list of dates and types."""
    rows = batch.select(*partitions).distinct().collect()
    return sorted(({name: row[name] for name in partitions} for row in rows), key=lambda p: [str(x) for x in p.values()])


def in_partitions(rows: DataFrame, touched: Sequence[dict[str, str]]) -> DataFrame:
    """The rows of these partitions; a filter on partition columns, so no others are read."""
    if not touched:
        return rows.limit(0)
    return rows.where(_place(list(touched[0])).isin(["/".join(p.values()) for p in touched]))


def _stored_schema(schema: T.StructType, partitions: Sequence[str]) -> T.StructType:
    return T.StructType(
        [f for f in schema.fields if f.name not in partitions]
        + [T.StructField(p, T.StringType()) for p in partitions]
    )


def _replace_partitions(
    spark: SparkSession, path: str, rows: DataFrame, partitions: Sequence[str], dealt: bool = False
) -> None:
    """Put `rows` in place of all rows of the partitions they fall into; `dealt` rows lie by partition already."""
    staged = f"{path}__staged"
    # Rebalancing gives few files per partition and still splits a swollen one.
    rows = rows if dealt else rows.hint("rebalance", *partitions)
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(staged)
    _swap_in(spark, staged, path, partitions)


def upsert_into(
    spark: SparkSession, path: str, new: DataFrame, schema: T.StructType, key: Sequence[str],
    order: Sequence[Column], partitions: Sequence[str],
) -> tuple[DataFrame, list[dict[str, str]]]:
    """Insert or replace `new` by key in the partitioned parquet table at `path`.

    The new rows are computed once and written aside by partition, so that they move once
    where the table has nothing there yet. Only the partitions they fall into are read
    and rewritten. Returns the new rows as they were written, and these partitions.
    """
    finish_pending_swap(spark, path, partitions)
    stored = _stored_schema(schema, partitions)
    fresh = written(new.hint("rebalance", *partitions), "fresh", partitions)
    latest = latest_of_stored(fresh, key, order).select(*stored.names)
    touched = touched_partitions(fresh, partitions)
    if touched:
        old = in_partitions(read_table(spark, path, stored), touched)
        if old.isEmpty():
            _replace_partitions(spark, path, latest, partitions, dealt=True)
        else:
            _replace_partitions(spark, path, replaced(old, latest, key), partitions)
    return latest, touched


def replace_in(
    spark: SparkSession, path: str, rows: DataFrame, schema: T.StructType, partitions: Sequence[str],
) -> None:
    """Put `rows`, which hold all there is for the partitions they fall into, in place of those partitions."""
    finish_pending_swap(spark, path, partitions)
    _replace_partitions(spark, path, rows.select(*_stored_schema(schema, partitions).names), partitions)


def _put_aside_in_place(spark: SparkSession, path: str) -> None:
    """The complete copy beside a small table becomes the table. Safe to repeat."""
    fs, old = _fs(spark, f"{path}__old")
    _, aside = _fs(spark, f"{path}__aside")
    _, target = _fs(spark, path)
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old) or not fs.rename(aside, target):
        raise OSError(f"could not move {aside} to {path}")
    fs.delete(old, True)


def replace_small(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Replace a small table that `rows` may itself read: written in full beside it, then moved into place.

    From the move to `__aside` on the new rows count, also if the driver is lost before they are in place.
    """
    following, aside = f"{path}__next", f"{path}__aside"
    rows.write.mode("overwrite").parquet(following)
    if path_exists(spark, f"{aside}/_SUCCESS"):
        _put_aside_in_place(spark, path)
    fs, source = _fs(spark, following)
    _, to = _fs(spark, aside)
    fs.delete(to, True)
    if not fs.rename(source, to):
        raise OSError(f"could not move {following} to {aside}")
    _put_aside_in_place(spark, path)


def _small_path(spark: SparkSession, path: str) -> str:
    return f"{path}__aside" if path_exists(spark, f"{path}__aside/_SUCCESS") else path


def read_small(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of `replace_small`, from the copy beside it where that is complete; nothing is moved."""
    return read_table(spark, _small_path(spark, path), schema)


def small_exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, _small_path(spark, path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
