"""Landed message files -> tables, batch by batch.

Every write is keyed, so a batch that runs again after a lost executor or driver
gives the same tables. Each batch is parsed once and its rows are computed once per
table; only the dates it touches are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from parley import schemas
from parley.functions.message import edited_ts_us
from parley.functions.times import epoch_us
from parley.operators import kept
from parley.operators.ingest import dims_missing, update_marks, upsert_conversations, upsert_dimension
from parley.operators.normalize import (
    attachments, last_sent, mark_bad_rows, normalize_drafts, reactions, with_conversation_name, with_draft,
)
from parley.operators.resolve import name_book
from parley.session import scratch, written
from parley.sources import landing
from parley.sources.tables import (
    MESSAGE_PARTITIONS, in_partitions, read_small, read_table, replace_in, replace_small, small_exists,
    upsert_into, with_date,
)


@dataclass(frozen=True)
class Store:
    """Where the tables live."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"


@dataclass(frozen=True)
class LandedDims:
    """Folders of landed users, channels and direct messages."""

    users: str
    channels: str
    dms: str


def _with_dt(schema: schemas.T.StructType) -> schemas.T.StructType:
    return schemas.T.StructType([*schema.fields, schemas.T.StructField("dt", schemas.S)])


MESSAGE_TABLE = _with_dt(schemas.MESSAGES)
ATTACHMENT_TABLE = _with_dt(schemas.ATTACHMENTS)
REACTION_TABLE = _with_dt(schemas.REACTIONS)
REPLY_PARTITIONS = ("conversation_type", "root_dt")


def read_messages_table(spark: SparkSession, store: Store) -> DataFrame:
    return read_table(spark, store.path("messages"), MESSAGE_TABLE)


def read_daily(spark: SparkSession, store: Store) -> DataFrame:
    """Counts per date, conversation and author (`kept.daily`)."""
    return read_table(spark, store.path("daily"), schemas.DAILY)


def read_grams(spark: SparkSession, store: Store) -> DataFrame:
    return read_table(spark, store.path("grams"), schemas.GRAMS)


def read_replies(spark: SparkSession, store: Store) -> DataFrame:
    return read_table(spark, store.path("replies"), schemas.REPLIES)


def read_conversations(spark: SparkSession, store: Store) -> DataFrame:
    return read_small(spark, store.path("conversations"), schemas.CONVERSATIONS)


def read_dims(spark: SparkSession, store: Store) -> tuple[DataFrame, DataFrame]:
    """Stored users and channels."""
    return (
        read_small(spark, store.path("users"), schemas.USERS),
        read_small(spark, store.path("channels"), schemas.CHANNELS),
    )


def load_dimensions(
    spark: SparkSession, store: Store, users: DataFrame, channels: DataFrame, dms: DataFrame, at_us: int,
    only_if_missing: bool = False,
) -> bool:
    """Merge landed users, channels and direct messages into the store; false when there was nothing to do.

    The landed frames are unique by id, as `landing.read_users` and its like give
    them. Channels become conversations under their names, direct messages under
    those of their participants.
    """
    old_users, old_channels = read_dims(spark, store)
    if only_if_missing and not dims_missing(old_users, old_channels):
        return False
    at = F.timestamp_micros(F.lit(at_us))
    replace_small(spark, store.path("users"), upsert_dimension(old_users, landing.user_dim(users), at))
    replace_small(spark, store.path("channels"), upsert_dimension(old_channels, landing.channel_dim(channels), at))
    rooms = channels.where("id is not null").select(
        "id", "name", F.lit("channel").alias("type"), F.lit(None).cast("array<string>").alias("participants")
    )
    direct = landing.dm_participants(dms).select(
        "id", F.lit(None).cast("string").alias("name"), F.lit("dm").alias("type"), "participants"
    )
    fresh = rooms.unionByName(direct).withColumn("seq", F.lit(1))
    merged = upsert_conversations(read_conversations(spark, store), fresh, name_book(*read_dims(spark, store)), at)
    replace_small(spark, store.path("conversations"), merged.select(*schemas.CONVERSATIONS.names))
    return True


def load_batch(
    spark: SparkSession, raw: DataFrame, store: Store, conversations: DataFrame, users: DataFrame,
    channels: DataFrame, batch_id: int, as_of_us: int,
) -> None:
    """Normalise one batch of raw rows and merge it into the tables.

    `conversations`, `users` and `channels` count until the store holds its own.
    """
    with scratch(spark):
        _load_batch(spark, raw, store, conversations, users, channels, batch_id, as_of_us)


def load_records(
    spark: SparkSession, records: DataFrame, store: Store, conversations: DataFrame, users: DataFrame,
    channels: DataFrame, batch_id: int, as_of_us: int,
) -> None:
    """Load message records handed over by an application; what their raw payload says wins."""
    raw = landing.records_to_raw(records)
    load_batch(spark, raw, store, conversations, users, channels, batch_id, as_of_us)


def _load_batch(spark, raw, store, conversations, users, channels, batch_id, as_of_us) -> None:
    marked = written(mark_bad_rows(raw), "batch")
    marked.where("reason is not null").select("conversation_id", "ts", "reason", schemas.CORRUPT).write.mode(
        "overwrite"
    ).json(f"{store.path('quarantine')}/batch={batch_id}")
    good = marked.where("reason is null").drop("reason", schemas.CORRUPT)

    own_users, own_channels = read_dims(spark, store)
    if small_exists(spark, store.path("users")):
        users, channels = own_users, own_channels
    book = written(name_book(users, channels), "book")
    # Of copies of one message the last edit wins, then any fixed order.
    order = [F.desc_nulls_last(edited_ts_us(F.col("edited"))), F.desc(F.xxhash64(*good.columns))]
    latest = last_sent(good, order)
    known = known_conversations(spark, store, conversations)
    named = with_date(with_conversation_name(latest, known, book, ids=good).withColumn("ts_us", epoch_us(F.col("ts"))))
    drafts = written(with_draft(named), "drafts")

    fresh, touched = upsert_into(
        spark, store.path("messages"), with_date(normalize_drafts(drafts, book)), MESSAGE_TABLE, ["id"],
        [F.desc("ts_us")], MESSAGE_PARTITIONS,
    )
    # The other tables do not depend on each other: their small jobs run side by side.
    _side_by_side(
        # Attachments and reactions lie in the date partition of their message.
        lambda: upsert_into(
            spark, store.path("attachments"), attachments(drafts, ["dt"]), ATTACHMENT_TABLE, ["id"],
            [F.desc("message_id")], ["dt"],
        ),
        lambda: upsert_into(
            spark, store.path("reactions"), reactions(drafts, book, as_of_us, ["dt"]), REACTION_TABLE,
            ["message_id", "emoji", "user_name"], [F.desc("ts_us")], ["dt"],
        ),
        lambda: _keep_days(spark, store, touched),
        lambda: _keep_grams(spark, store, fresh, touched),
        lambda: upsert_into(
            spark, store.path("replies"), kept.replies(fresh.drop("dt")), schemas.REPLIES, ["id"], [F.desc("ts_us")],
            REPLY_PARTITIONS,
        ),
    )
    _side_by_side(
        lambda: _write_conversations(spark, store, known, drafts, book, as_of_us),
        lambda: _write_marks(spark, store, drafts),
    )


def _side_by_side(*steps: Callable[[], object]) -> None:
    with ThreadPoolExecutor(len(steps)) as pool:
        for done in [pool.submit(step) for step in steps]:
            done.result()


def _keep_days(spark: SparkSession, store: Store, touched: list[dict[str, str]]) -> None:
    """Counts of the touched dates anew."""
    if touched:
        rows = in_partitions(read_messages_table(spark, store), touched)
        replace_in(spark, store.path("daily"), kept.daily(rows), schemas.DAILY, MESSAGE_PARTITIONS)


def _keep_grams(spark: SparkSession, store: Store, fresh: DataFrame, touched: list[dict[str, str]]) -> None:
    """Runs of characters of the fresh messages added to those of the touched dates."""
    if touched:
        old = in_partitions(read_grams(spark, store), touched)
        rows = old.unionByName(kept.grams(fresh)).distinct()
        replace_in(spark, store.path("grams"), rows, schemas.GRAMS, MESSAGE_PARTITIONS)


def _write_marks(spark: SparkSession, store: Store, drafts: DataFrame) -> None:
    old = read_small(spark, store.path("sync_state"), schemas.SYNC_STATE)
    replace_small(spark, store.path("sync_state"), update_marks(old, drafts.select("conversation_id", "ts_us")))


def known_conversations(spark: SparkSession, store: Store, given: DataFrame) -> DataFrame:
    """The stored conversations; before the first load the given ones."""
    stored = read_conversations(spark, store)
    if small_exists(spark, store.path("conversations")):
        return stored
    return stored.unionByName(given, allowMissingColumns=True)


def _write_conversations(
    spark: SparkSession, store: Store, known: DataFrame, drafts: DataFrame, book: DataFrame, as_of_us: int
) -> None:
    """Add the conversations of a batch; counts and newest times come from the kept counts."""
    seen = drafts.groupBy(F.col("conversation_id").alias("id")).agg(F.max("conversation_type").alias("type"))
    nobody = F.lit(None).cast("array<string>")
    fresh = seen.select(
        "id", F.lit(None).cast("string").alias("name"), "type", nobody.alias("participants"), F.lit(1).alias("seq")
    )
    merged = upsert_conversations(known, fresh, book, F.timestamp_micros(F.lit(as_of_us)))
    counted = kept.with_totals(merged.select(*schemas.CONVERSATIONS.names), read_daily(spark, store))
    replace_small(spark, store.path("conversations"), counted)


def stream_load(
    spark: SparkSession, landing_dir: str, store: Store, conversations: DataFrame, users: DataFrame,
    channels: DataFrame, as_of_us: int | Callable[[int], int], files_per_trigger: int | None = None,
    every: str | None = None, landed_dims: LandedDims | None = None,
) -> StreamingQuery:
    """Load landed files as they come: all there is now, or again at each interval.

    With `landed_dims` users, channels and direct messages are read again before each
    batch. `as_of_us` may be a function of the batch number, for streams that run long.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        now = as_of_us(batch_id) if callable(as_of_us) else as_of_us
        if landed_dims is not None:
            load_dimensions(
                session, store, landing.read_users(session, landed_dims.users),
                landing.read_channels(session, landed_dims.channels), landing.read_dms(session, landed_dims.dms), now,
            )
        load_batch(session, batch, store, conversations, users, channels, batch_id, now)

    writer = (
        landing.stream_messages(spark, landing_dir, files_per_trigger)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", store.path("_checkpoint"))
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
