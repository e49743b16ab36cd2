"""Interactions with one person."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.times import DAY_US
from parley.operators.bots import filter_bots
from parley.operators.keyed import broadcast_if_small, latest_per_key
from parley.operators.lookup import user_ambiguity
from parley.operators.resolve import with_author_test, with_display_name
from parley.session import written
from parley.sources.tables import since

MENTIONS_SHOWN = 200
ALL_SHOWN = 500


def _is_person(person: str, exact: bool):
    wanted = person.lower()

    def test(name: Column) -> Column:
        lowered = F.lower(name)
        return lowered == wanted if exact else F.contains(lowered, F.lit(wanted))

    return test


def mention_hits(
    messages: DataFrame, users: DataFrame, person: str, cutoff_us: int, exact: bool = False
) -> DataFrame:
    """All messages after the cutoff that the person wrote or is named in, ignoring case."""
    flagged = with_author_test(since(messages, cutoff_us), users, _is_person(person, exact), "_wrote")
    named = F.contains(F.lower("clean_text"), F.lit(person.lower()))
    return flagged.where(F.coalesce("_wrote", F.lit(False)) | named).drop("_wrote")


def conversation_hits(
    messages: DataFrame, users: DataFrame, person: str, cutoff_us: int, exact: bool = False,
    authors: DataFrame | None = None,
) -> DataFrame:
    """All messages after the cutoff in conversations the person ever wrote in.

    The conversations are found first and written out: the list is usually short
    enough to be broadcast, and then the messages are not shuffled. `authors` are the
    kept counts (`kept.daily`); with them the history is not read.
    """
    wrote = messages if authors is None else authors
    theirs = broadcast_if_small(written(conversations_of(wrote, users, person, exact), "conversations"))
    return since(messages, cutoff_us).join(theirs, "conversation_name", "left_semi")


def _shown(rows: DataFrame, conversations: DataFrame, users: DataFrame, limit: int) -> DataFrame:
    """The newest rows, then author and participants for just those."""
    newest = rows.orderBy(F.desc("ts_us"), "id").limit(limit).select(
        "id", "ts_us", "datetime", "user_name", "clean_text", "conversation_name", "conversation_type",
        "thread_ts_us", "is_thread_parent",
    )
    return with_display_name(newest, users).join(_participants(conversations), "conversation_name", "left")


def _participants(conversations: DataFrame) -> DataFrame:
    """One row per conversation name, the one with participants first."""
    return latest_per_key(
        conversations.select(F.col("name").alias("conversation_name"), "participants", F.col("id").alias("_cid")),
        ["conversation_name"],
        [F.asc(F.col("participants").isNull()), F.asc("_cid")],
    ).drop("_cid")


def interactions_mentions(
    messages: DataFrame, users: DataFrame, conversations: DataFrame, person: str, cutoff_us: int,
    limit: int = MENTIONS_SHOWN, exact: bool = False,
) -> DataFrame:
    """Newest messages the person wrote or is named in, ignoring case."""
    return _shown(mention_hits(messages, users, person, cutoff_us, exact), conversations, users, limit)


def conversations_of(messages: DataFrame, users: DataFrame, person: str, exact: bool = False) -> DataFrame:
    """Names of the conversations the person ever wrote in, from two columns of the history or the kept counts."""
    authors = messages.select("conversation_name", "user_name")
    flagged = with_author_test(authors, users, _is_person(person, exact), "_wrote")
    return flagged.where("_wrote").select("conversation_name").distinct()


def interactions_all(
    messages: DataFrame, users: DataFrame, conversations: DataFrame, person: str, cutoff_us: int,
    limit: int = ALL_SHOWN, exact: bool = False, authors: DataFrame | None = None,
) -> DataFrame:
    """Newest messages of every conversation the person ever wrote in."""
    return _shown(conversation_hits(messages, users, person, cutoff_us, exact, authors), conversations, users, limit)


def label_thread(df: DataFrame) -> DataFrame:
    label = (
        F.when(F.col("thread_ts_us").isNull(), "")
        .when(F.col("is_thread_parent"), "thread_parent")
        .otherwise("thread_reply")
    )
    return df.withColumn("thread_info", label)


def interactions_by_conversation(hits: DataFrame) -> DataFrame:
    """Per conversation over all hits: type, count, newest time, thread messages."""
    labelled = label_thread(hits)
    return labelled.groupBy("conversation_name").agg(
        F.min("conversation_type").alias("type"),
        F.count(F.lit(1)).alias("interaction_count"),
        F.max("ts_us").alias("latest_ts_us"),
        F.count_if(F.col("thread_info") == "thread_parent").alias("thread_parents"),
        F.count_if(F.col("thread_info") == "thread_reply").alias("thread_replies"),
    )


def interactions_summary(by_conversation: DataFrame) -> DataFrame:
    """One row of totals, before the bot filter."""
    return by_conversation.agg(
        F.coalesce(F.sum("interaction_count"), F.lit(0)).alias("interactions_before_filter"),
        F.count(F.lit(1)).alias("conversations_before_filter"),
        F.count_if(F.col("type") == "dm").alias("dms_before_filter"),
        F.count_if(F.col("type") == "channel").alias("channels_before_filter"),
    )


@dataclass
class Interactions:
    status: str
    person: str
    suggestions: list[str] = field(default_factory=list)
    messages: DataFrame | None = None
    conversations: DataFrame | None = None
    summary: DataFrame | None = None


def user_interactions(
    messages: DataFrame, users: DataFrame, conversations: DataFrame, person: str, as_of_us: int,
    days_back: int = 30, mentions_only: bool = False, exact: bool = False, ignored: Sequence[str] = (),
    authors: DataFrame | None = None,
) -> Interactions:
    """Name gate, then the interactions, grouped and summed up."""
    gate = user_ambiguity(users, person).first()
    if gate["status"] != "ok":
        return Interactions(gate["status"], person, list(gate["suggestions"]))
    cutoff = as_of_us - days_back * DAY_US
    if mentions_only:
        hits = mention_hits(messages, users, person, cutoff, exact)
    else:
        hits = conversation_hits(messages, users, person, cutoff, exact, authors)
    grouped = written(interactions_by_conversation(hits), "by-conversation")
    if grouped.isEmpty():
        return Interactions("no_interactions", person)
    named = grouped.withColumnRenamed("conversation_name", "name").join(
        _participants(conversations).withColumnRenamed("conversation_name", "name"), "name", "left"
    )
    kept = written(filter_bots(named, ignored), "kept-conversations")
    theirs = broadcast_if_small(kept.select(F.col("name").alias("conversation_name")))
    shown = _shown(
        hits.join(theirs, "conversation_name", "left_semi"), conversations, users,
        MENTIONS_SHOWN if mentions_only else ALL_SHOWN,
    )
    return Interactions(
        "ok", person,
        messages=label_thread(shown),
        conversations=kept.orderBy(F.desc("latest_ts_us"), "name"),
        summary=interactions_summary(grouped),
    )
