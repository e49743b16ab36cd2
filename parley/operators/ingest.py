"""Dimension and conversation upserts, high-water marks, incremental reads, threads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.functions.message import conversation_type
from parley.functions.text import blank_to_null
from parley.functions.times import DAY_US
from parley.operators.keyed import first_n_per_group
from parley.operators.lookup import channel_ids_for_names
from parley.operators.resolve import name_conversations
from parley.session import written


def upsert_conversations(
    old: DataFrame, new: DataFrame, book: DataFrame, written_at: Column
) -> DataFrame:
    """Insert or replace by id: given name or a derived one, participants as names.

    `new` carries id, name, type, participants (ids) and seq. A later row without
    name or participants keeps the ones already known.
    """
    has_name, has_people = blank_to_null(F.col("name")).isNotNull(), F.size("participants") > 0
    newest = new.groupBy("id").agg(
        F.max_by("type", "seq").alias("type"),
        F.max_by("name", F.when(has_name, F.col("seq"))).alias("_given"),
        F.max_by("participants", F.when(has_people, F.col("seq"))).alias("participants"),
    )
    named = name_conversations(newest, book, out="_built").select(
        "id",
        F.coalesce(blank_to_null(F.col("_given")), F.col("_built")).alias("name"),
        blank_to_null(F.col("_given")).isNull().alias("_derived"),
        "type",
        "participants",
    )
    kept = old.select(
        "id", F.col("name").alias("_old_name"), F.col("type").alias("_old_type"),
        F.col("participants").alias("_old_people"), F.col("created_at").alias("_old_created"),
        F.col("updated_at").alias("_old_updated"), "message_count", "latest_message_ts_us",
    )
    is_new = F.col("type").isNotNull()
    no_people = F.col("participants").isNull()
    return kept.join(named, "id", "full").select(
        "id",
        F.when(F.col("_derived") & no_people, F.coalesce("_old_name", "name"))
        .otherwise(F.coalesce("name", "_old_name")).alias("name"),
        F.coalesce("type", "_old_type").alias("type"),
        F.coalesce("participants", "_old_people").alias("participants"),
        F.coalesce("_old_created", written_at).alias("created_at"),
        F.when(is_new, written_at).otherwise(F.col("_old_updated")).alias("updated_at"),
        F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"),
        "latest_message_ts_us",
    )


def upsert_dimension(old: DataFrame, new: DataFrame, at: Column, key: str = "slack_id") -> DataFrame:
    """Insert or replace by id; `updated_at` moves only where something changed, `created_at` never.

    `new` is unique by id. Rows that are not in `new` stay as they are.
    """
    payload = [c for c in old.columns if c not in (key, "created_at", "updated_at")]
    before = old.select(
        key, F.struct(*payload).alias("_old"), F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated")
    )
    after = new.select(key, F.struct(*payload).alias("_new"))
    same = F.col("_new").isNull() | F.col("_new").eqNullSafe(F.col("_old"))
    shown = F.coalesce("_new", "_old")
    return before.join(after, key, "full").select(
        key, *[shown[c].alias(c) for c in payload],
        F.when(F.col("_old").isNull(), at).otherwise(F.col("_created")).alias("created_at"),
        F.when(same, F.col("_updated")).otherwise(at).alias("updated_at"),
    ).select(*old.columns)


def conversation_stats(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Message count and newest message time of each conversation, by name."""
    counted = messages.groupBy(F.col("conversation_name").alias("name")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("ts_us").alias("_last")
    )
    base = conversations.drop("message_count", "latest_message_ts_us")
    return base.join(counted, "name", "left").select(
        *base.columns,
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("message_count"),
        F.col("_last").alias("latest_message_ts_us"),
    )


def infer_conversation_type(df: DataFrame, id_col: str = "conversation_id") -> DataFrame:
    landed = F.col("conversation_type") if "conversation_type" in df.columns else None
    return df.withColumn("conversation_type", conversation_type(F.col(id_col), landed))


def read_marks(conversations: DataFrame, sync_state: DataFrame) -> DataFrame:
    """High-water mark of every conversation, 0 when it was never loaded."""
    return (
        conversations.select(F.col("id").alias("conversation_id")).distinct()
        .join(sync_state, "conversation_id", "left")
        .select("conversation_id", F.coalesce("last_ts_us", F.lit(0)).cast("bigint").alias("last_ts_us"))
    )


def update_marks(sync_state: DataFrame, loaded: DataFrame) -> DataFrame:
    """Highest time per conversation over the old marks and the rows just loaded."""
    fresh = loaded.groupBy("conversation_id").agg(F.max("ts_us").alias("last_ts_us"))
    return (
        sync_state.select("conversation_id", "last_ts_us").unionByName(fresh)
        .groupBy("conversation_id").agg(F.max("last_ts_us").alias("last_ts_us"))
    )


def newer_than_marks(
    rows: DataFrame, sync_state: DataFrame, as_of_us: int, sync_days: int = 30
) -> DataFrame:
    """Rows strictly newer than max(as_of - sync_days, mark); 0 days means no floor."""
    floor = as_of_us - sync_days * DAY_US if sync_days else 0
    late = rows.where(F.col("ts_us") > floor)
    return (
        late.join(sync_state.select("conversation_id", "last_ts_us"), "conversation_id", "left")
        .where(F.col("last_ts_us").isNull() | (F.col("ts_us") > F.col("last_ts_us")))
        .drop("last_ts_us")
    )


def cleared_marks(sync_state: DataFrame) -> DataFrame:
    """Full refresh: no marks left."""
    return sync_state.limit(0)


def dims_missing(users: DataFrame, channels: DataFrame) -> bool:
    """Dimensions are loaded unless both already hold rows."""
    return users.isEmpty() or channels.isEmpty()


def expand_threads(history: DataFrame, thread_rows: DataFrame) -> DataFrame:
    """Add to the history the replies of each channel thread it starts.

    `thread_rows` holds whole threads; the first message of each is the parent,
    already in the history, and is left out. Both tables carry id,
    conversation_id, conversation_type, ts_us and thread_ts_us. The rows of the wanted
    threads are written aside, so the inputs are read for them once.
    """
    thread = ["conversation_id", "thread_ts_us"]
    started = history.where(
        (F.col("conversation_type") == "channel") & (F.col("thread_ts_us") == F.col("ts_us"))
    ).select(*thread).distinct()
    wanted = written(thread_rows.join(started, thread, "left_semi").select(*history.columns), "threads")
    first = wanted.groupBy(*thread).agg(F.min("ts_us").alias("_first"))
    marked = wanted.join(first, thread)
    later = marked.where(F.col("ts_us") > F.col("_first"))
    # Of messages at the time of the first one the smallest id is the head; these are few.
    among = W.partitionBy(*thread).orderBy("id")
    tied = marked.where(F.col("ts_us") == F.col("_first")).withColumn("_rn", F.row_number().over(among)).where("_rn > 1")
    return history.unionByName(later.select(*history.columns)).unionByName(tied.select(*history.columns))


def threads_to_backfill(messages: DataFrame, per_conversation: int | None = None) -> DataFrame:
    """Threads with replies; only the newest of each conversation when a number is given."""
    parents = messages.where(F.col("is_thread_parent") & (F.col("reply_count") > 0))
    if per_conversation is None:
        return parents
    return first_n_per_group(
        parents, ["conversation_name"], [F.desc("ts_us"), F.asc("id")], ["id"], per_conversation
    )


def resolve_config_channels(names: Sequence[str], listed: DataFrame, channels: DataFrame) -> DataFrame:
    """(name, id) of each channel named in a configuration; id NULL means unknown, to be reported.

    `listed` (name, id) is what the service lists and wins; the stored dimension
    is asked next.
    """
    asked = channels.sparkSession.createDataFrame([(n,) for n in merge_names(names)], "name string")
    by_list = listed.select("name", F.col("id").alias("_listed"))
    stored = channel_ids_for_names(names, channels).withColumnRenamed("asked", "name")
    return (
        asked.join(by_list, "name", "left").join(stored, "name", "left")
        .select("name", F.coalesce("_listed", "channel_id").alias("id"))
    )


def merge_names(*lists: Sequence[str]) -> list[str]:
    return sorted({name for names in lists for name in names})
