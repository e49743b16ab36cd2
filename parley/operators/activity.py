"""Catalogues of channels and DMs, and what happened in one channel.

A thread or a channel may hold a large share of all messages, so messages come
as flat rows with their place in the flow, never as one row with a list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from parley.functions.text import blank_to_null
from parley.functions.times import DAY_US, date_text
from parley.operators.bots import filter_bots
from parley.operators.lookup import (
    channel_suggestions, conversation_containing, get_conversation, list_conversations, resolve_conversation,
)
from parley.operators.resolve import with_display_name
from parley.sources.tables import since


def _written_times(conversations: DataFrame) -> list[str]:
    """When a conversation was stored and last changed, where the table says so."""
    return [c for c in ("created_at", "updated_at") if c in conversations.columns]


def list_channels(
    conversations: DataFrame, channels: DataFrame, messages: DataFrame, ignored: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Channels with activity; the name comes from the channel whose id is the stored name, else the id.

    `messages` are the messages or the kept counts, as in `list_conversations`.
    """
    listed = list_conversations(conversations, messages, "channel", ordered=False)
    known = channels.where(F.col("slack_id").startswith("C")).select("slack_id", F.col("name").alias("_title"))
    by_name = known.select(F.col("slack_id").alias("_n"), F.col("_title").alias("_by_name"))
    by_id = known.select(F.col("slack_id").alias("_i"), F.col("_title").alias("_by_id"))
    titled = listed.join(by_name, F.col("name") == F.col("_n"), "left").join(
        by_id, F.col("id") == F.col("_i"), "left"
    )
    shown = titled.select(
        "id",
        F.coalesce("_by_name", "_by_id", "name").alias("name"),
        *_written_times(conversations),
        F.col("actual_message_count").alias("message_count"),
        "start_date", "end_date",
        F.col("last_message_ts_us").alias("last_activity_us"),
    )
    kept = filter_bots(shown, ignored)
    return kept.orderBy(F.desc_nulls_last("last_activity_us"), "id") if ordered else kept


def list_dms(
    conversations: DataFrame, messages: DataFrame, ignored: Sequence[str] = (), ordered: bool = True
) -> DataFrame:
    listed = list_conversations(conversations, messages, "dm", ordered=False)
    shown = listed.select(
        "id", "name", "participants",
        *_written_times(conversations),
        F.col("actual_message_count").alias("message_count"),
        "start_date", "end_date",
        F.col("last_message_ts_us").alias("last_activity_us"),
    )
    kept = filter_bots(shown, ignored)
    return kept.orderBy(F.desc_nulls_last("last_activity_us"), "id") if ordered else kept


def channel_window(messages: DataFrame, cutoff_us: int, conversation: str | None = None) -> DataFrame:
    """Messages of one conversation, or of all channels, after the cutoff."""
    if conversation is None:
        return since(messages.where(F.col("conversation_type") == "channel"), cutoff_us)
    return since(messages.where(F.col("conversation_name") == conversation), cutoff_us)


def channel_summary(window: DataFrame) -> DataFrame:
    """Counts per conversation; authors are counted first, so no task sees all rows of a busy channel."""
    per_author = window.groupBy("conversation_name", "user_name").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("ts_us").alias("_first"),
        F.max("ts_us").alias("_last"),
        F.count_if(F.col("is_thread_parent")).alias("_parents"),
        F.count_if(F.col("thread_ts_us").isNotNull() & ~F.col("is_thread_parent")).alias("_replies"),
    )
    return per_author.groupBy("conversation_name").agg(
        F.sum("_n").alias("total_messages"),
        F.count("user_name").alias("unique_participants"),
        F.min("_first").alias("first_message_ts_us"),
        F.max("_last").alias("last_message_ts_us"),
        F.sum("_parents").alias("thread_count"),
        F.sum("_replies").alias("thread_reply_count"),
    )


def channel_participants(window: DataFrame, users: DataFrame, ordered: bool = True) -> DataFrame:
    """Messages and last time per author, busiest first; names are looked up after counting."""
    counted = window.groupBy("conversation_name", "user_name").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("ts_us").alias("last_activity_us")
    )
    named = with_display_name(counted, users, "display_name").where(
        blank_to_null(F.col("display_name")).isNotNull()
    )
    people = named.select("conversation_name", "user_name", "display_name", "message_count", "last_activity_us")
    return people.orderBy("conversation_name", F.desc("message_count"), "user_name") if ordered else people


def _main(window: DataFrame) -> DataFrame:
    return window.where(F.col("thread_ts_us").isNull() | F.col("is_thread_parent"))


def channel_main(window: DataFrame, users: DataFrame, ordered: bool = True) -> DataFrame:
    """Messages outside threads and thread parents, oldest first."""
    rows = with_display_name(_main(window), users).select(
        "conversation_name", "id", "ts_us", "datetime", "user_name", "clean_text", "is_thread_parent",
        "reply_count", "thread_ts_us", "display_user_name",
    )
    return rows.orderBy("conversation_name", "ts_us", "id") if ordered else rows


def _thread_replies(window: DataFrame, all_messages: DataFrame, cutoff_us: int | None) -> DataFrame:
    """Replies, of any age, to the window's parents that have replies: one semi-join for all threads.

    A parent in the window has the time of its thread, so replies of threads that
    began before it are left out in the scan; where replies are filed by the date of
    their root (`kept.replies`), older dates are not read at all.
    """
    parents = window.where(F.col("is_thread_parent") & (F.col("reply_count") > 0))
    replies = all_messages.where(~F.col("is_thread_parent"))
    if cutoff_us is not None:
        replies = replies.where(F.col("thread_ts_us") > cutoff_us)
        if "root_dt" in replies.columns:
            replies = replies.where(F.col("root_dt").cast("string") >= date_text(F.lit(cutoff_us).cast("bigint")))
    thread = ["conversation_name", "thread_ts_us"]
    return replies.join(parents.select(*thread).distinct(), thread, "left_semi")


def channel_threads(
    window: DataFrame, all_messages: DataFrame, users: DataFrame, cutoff_us: int | None = None
) -> DataFrame:
    """Replies with the time of their parent.

    `all_messages`: the same conversations, not cut by time, or their replies filed by
    root date; `cutoff_us` is that of the window.
    """
    return with_display_name(_thread_replies(window, all_messages, cutoff_us), users).select(
        "conversation_name", F.col("thread_ts_us").alias("parent_ts_us"), "id", "ts_us", "datetime",
        "user_name", "clean_text", "display_user_name",
    )


def conversation_flow(
    window: DataFrame, all_messages: DataFrame, users: DataFrame, ordered: bool = True, cutoff_us: int | None = None
) -> DataFrame:
    """Main messages and their replies as one flat list.

    `root_ts_us` places a reply under its parent; inside a conversation the order
    (root_ts_us, is_reply, ts_us, id) is the nested reading order.
    """
    cols = ["conversation_name", "id", "ts_us", "datetime", "user_name", "clean_text", "reply_count"]
    main = _main(window).select(
        *cols,
        F.col("ts_us").alias("root_ts_us"),
        F.lit(False).alias("is_reply"),
        F.when(F.col("is_thread_parent"), "thread_parent").otherwise("message").alias("type"),
    )
    replies = _thread_replies(window, all_messages, cutoff_us).select(
        *cols,
        F.col("thread_ts_us").alias("root_ts_us"),
        F.lit(True).alias("is_reply"),
        F.lit("thread_reply").alias("type"),
    )
    flow = with_display_name(main.unionByName(replies), users, "user").select(
        "conversation_name", "root_ts_us", "is_reply", "ts_us", "id", "datetime", "user",
        F.col("clean_text").alias("text"), "type", "reply_count",
    )
    return flow.orderBy("conversation_name", "root_ts_us", "is_reply", "ts_us", "id") if ordered else flow


@dataclass
class ChannelActivity:
    """Answer of `channel_activity`: a status and, when it is 'ok', the frames."""

    status: str
    channel: str
    resolved_name: str | None = None
    suggestions: list[str] = field(default_factory=list)
    summary: DataFrame | None = None
    participants: DataFrame | None = None
    flow: DataFrame | None = None


def channel_activity(
    conversations: DataFrame, channels: DataFrame, users: DataFrame, messages: DataFrame,
    channel: str, as_of_us: int, days_back: int = 14, filed_replies: DataFrame | None = None,
) -> ChannelActivity:
    """Resolve a channel name and report on its last days.

    The name is settled first, on the small tables, so that every scan of the
    messages carries a literal conversation and time filter. `filed_replies` are
    replies filed by root date (`kept.replies`), where there are such.
    """
    resolved = resolve_conversation(conversations, channels, channel).first()["resolved_name"]
    known = get_conversation(conversations, channels, resolved).first()
    if known is not None:
        resolved = known["name"]  # messages are filed by name, also when asked by id
    else:
        resolved = conversation_containing(messages, channel).first()["conversation_name"]
        if resolved is None:
            close = [r["name"] for r in channel_suggestions(channels, channel).collect()]
            return ChannelActivity("not_found", channel, suggestions=close)
    cutoff = as_of_us - days_back * DAY_US
    window = channel_window(messages, cutoff, resolved)
    if window.isEmpty():
        return ChannelActivity("no_activity", channel, resolved)
    replies = messages if filed_replies is None else filed_replies
    whole = replies.where(F.col("conversation_name") == resolved)
    return ChannelActivity(
        "ok", channel, resolved,
        summary=channel_summary(window),
        participants=channel_participants(window, users),
        flow=conversation_flow(window, whole, users, cutoff_us=cutoff),
    )
