"""Readers for landed JSON: messages, users, channels, direct messages.

Files hold one JSON object per line and are read with fixed schemas, never
inferred ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from parley.functions.names import first_non_empty
from parley.functions.text import blank_to_null
from parley.operators.keyed import latest_per_key
from parley.schemas import CORRUPT, RAW_CHANNEL, RAW_DM, RAW_MESSAGE, RAW_USER


READ_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
LANDED = T.StructType(
    [*[T.StructField(f.name, T.VariantType()) for f in RAW_MESSAGE.fields], T.StructField(CORRUPT, T.StringType())]
)


def _typed(landed: DataFrame) -> DataFrame:
    """Variants -> raw message columns. A number counts as text and the other way round; a list field that
    is no list, or a text that cannot be what its field wants, is NULL."""
    fields = {
        f.name: F.try_variant_get(F.col(f.name), "$", f.dataType.simpleString()).alias(f.name) for f in RAW_MESSAGE.fields
    }
    return landed.select(*[fields.get(c, F.col(c)) for c in landed.columns])


def parse_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text -> raw message columns; `_corrupt` keeps lines that are not JSON objects.

    `inline` turns the parsed record into plain columns once per row; selecting
    its fields would let the optimizer repeat the parse in every expression and
    filter above.
    """
    kept = [c for c in lines.columns if c != column]
    return _typed(lines.select(*kept, F.inline(F.array(F.from_json(column, LANDED, READ_OPTIONS)))))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.schema(LANDED).options(**READ_OPTIONS).json(path))


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDED).options(**READ_OPTIONS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _typed(reader.json(path))


def records_to_raw(records: DataFrame) -> DataFrame:
    """Application message records -> raw rows; a field of the original payload wins over the record's."""
    r = records.withColumn("_raw", F.from_json("raw", RAW_MESSAGE))
    first = {
        "conversation_id": F.col("conversation_id"),
        "ts": F.coalesce("_raw.ts", "timestamp"),
        "user": F.coalesce("_raw.user", "user_id"),
        "text": F.coalesce("_raw.text", F.col("text")),
        "thread_ts": F.coalesce("_raw.thread_ts", F.col("thread_ts")),
    }
    return r.select(
        *[first.get(f.name, F.col(f"_raw.{f.name}")).alias(f.name) for f in RAW_MESSAGE.fields]
    )


def _newest_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Of records landed several times, the one in the newest file; records without id are left out."""
    landed = spark.read.schema(schema).json(path).select(
        "*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file")
    )
    order = [F.desc("_at"), F.desc("_file"), F.desc(F.xxhash64(*schema.names))]
    return latest_per_key(landed.where("id is not null"), ["id"], order).drop("_at", "_file")


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return _newest_records(spark, path, RAW_USER)


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    return _newest_records(spark, path, RAW_CHANNEL)


def read_dms(spark: SparkSession, path: str) -> DataFrame:
    return _newest_records(spark, path, RAW_DM)


def user_dim(raw: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Name is the profile's display name, else the real name, else the handle; blanks become NULL."""
    at = F.lit(None).cast("timestamp") if loaded_at is None else loaded_at
    return raw.select(
        F.col("id").alias("slack_id"),
        first_non_empty(F.col("profile.display_name"), F.col("real_name"), F.col("name")).alias("name"),
        blank_to_null(F.col("name")).alias("display_name"),
        blank_to_null(F.col("real_name")).alias("real_name"),
        blank_to_null(F.col("profile.email")).alias("email"),
        F.coalesce("is_bot", F.lit(False)).alias("is_bot"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def channel_dim(raw: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    at = F.lit(None).cast("timestamp") if loaded_at is None else loaded_at
    return raw.select(
        F.col("id").alias("slack_id"),
        blank_to_null(F.col("name")).alias("name"),
        F.concat(F.lit("#"), F.coalesce("name", F.lit(""))).alias("display_name"),
        blank_to_null(F.col("purpose.value")).alias("purpose"),
        blank_to_null(F.col("topic.value")).alias("topic"),
        F.coalesce("is_private", F.lit(False)).alias("is_private"),
        F.coalesce("num_members", F.lit(0)).cast("bigint").alias("member_count"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def dm_participants(raw: DataFrame) -> DataFrame:
    """(id, participants): the one partner, or the members of a group, or nobody."""
    nobody = F.array().cast("array<string>")
    single = F.when(blank_to_null(F.col("user")).isNotNull(), F.array("user"))
    return raw.where("id is not null").select(
        "id",
        F.coalesce(
            F.when(F.col("is_im"), F.coalesce(single, nobody)).when(F.col("is_mpim"), F.col("members")),
            nobody,
        ).alias("participants"),
    )
