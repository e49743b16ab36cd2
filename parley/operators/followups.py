"""What still waits for an answer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from parley.functions import text as tx
from parley.functions.times import DAY_US, HOUR_US, age_hours, ts_text
from parley.operators.bots import filter_bots
from parley.operators.keyed import broadcast_if_small
from parley.operators.resolve import with_author_test, with_display_name
from parley.session import written
from parley.sources.tables import since

CONTEXT_DAYS = 14


@dataclass(frozen=True)
class Owner:
    """Whose follow-ups are wanted."""

    name: str | None
    id: str | None = None

    @staticmethod
    def from_metadata(meta: dict, fallback: str | None = None) -> "Owner":
        """Owner id or user id; user name, else owner name, else the fallback."""
        name = meta.get("user_name") or meta.get("owner_name") or fallback
        return Owner(name, meta.get("owner_id") or meta.get("user_id"))


def _flag_mine(messages: DataFrame, users: DataFrame, owner: str, cutoff_us: int) -> DataFrame:
    return with_author_test(since(messages, cutoff_us), users, lambda name: name == owner, "_mine")


def unanswered_mentions(messages: DataFrame, users: DataFrame, owner: str, cutoff_us: int) -> DataFrame:
    """Channel messages naming the owner with no later message by the owner in that channel.

    "No later message" is a comparison with the owner's last time per
    conversation, one number each, instead of a pairwise anti-join. A later
    message is newer than the cutoff too, so both sides read only the window.
    """
    flagged = _flag_mine(messages, users, owner, cutoff_us)
    mine = flagged.where("_mine").groupBy("conversation_name").agg(F.max("ts_us").alias("_last_mine"))
    naming = flagged.where(
        (F.col("conversation_type") == "channel") & ~F.col("_mine") & F.col("clean_text").contains(owner)
    ).drop("_mine")
    return (
        naming.join(mine, "conversation_name", "left")
        .where(F.col("_last_mine").isNull() | (F.col("_last_mine") <= F.col("ts_us")))
        .drop("_last_mine")
    )


def unanswered_dms(
    messages: DataFrame, conversations: DataFrame, users: DataFrame, owner: str, cutoff_us: int, as_of_us: int
) -> DataFrame:
    """Latest message of each DM (all of them on a tie) not by the owner, in the window, over a day old.

    The latest message counts only inside the window, so older ones are never
    read; the newest time per conversation is joined back on (name, time).
    """
    names = conversations.where(F.col("type") == "dm").select(F.col("name").alias("conversation_name")).distinct()
    window = since(messages, cutoff_us)
    newest = (
        window.groupBy("conversation_name").agg(F.max("ts_us").alias("ts_us"))
        .where(F.lit(as_of_us) - F.col("ts_us") > DAY_US)
        .join(names, "conversation_name", "left_semi")
    )
    newest = broadcast_if_small(written(newest, "latest-dms"))
    last = window.join(newest, ["conversation_name", "ts_us"], "left_semi")
    flagged = with_author_test(last, users, lambda name: name == owner, "_mine")
    return flagged.where(~F.col("_mine")).drop("_mine")


def _items(
    messages: DataFrame, conversations: DataFrame, users: DataFrame, owner: str, as_of_us: int, max_age_hours: int
) -> DataFrame:
    cutoff = as_of_us - max_age_hours * HOUR_US
    cols = ["conversation_name", "id", "ts_us", "user_name", "clean_text"]
    mentions = unanswered_mentions(messages, users, owner, cutoff).select(*cols, F.lit("mention").alias("type"))
    dms = unanswered_dms(messages, conversations, users, owner, cutoff, as_of_us)
    return mentions.unionByName(dms.select(*cols, F.lit("dm").alias("type")))


def followups(
    messages: DataFrame, conversations: DataFrame, users: DataFrame, owner: Owner, as_of_us: int,
    max_age_hours: int = 72, ordered: bool = True,
) -> DataFrame:
    """Open mentions and DMs with place, snippet and age, oldest first. Not bot-filtered."""
    items = _items(messages, conversations, users, owner.name, as_of_us, max_age_hours)
    location = F.when(F.col("type") == "mention", F.concat(F.lit("#"), "conversation_name")).otherwise(
        F.col("conversation_name")
    )
    open_items = with_display_name(items, users, "user").select(
        "id",
        "conversation_name",
        "type",
        location.alias("location"),
        "ts_us",
        ts_text(F.col("ts_us")).alias("ts"),
        tx.snippet(F.col("clean_text")).alias("snippet"),
        age_hours(as_of_us, F.col("ts_us")).alias("age_hours"),
        "user",
    ).where(F.col("age_hours") <= max_age_hours)
    return open_items.orderBy(F.desc("age_hours"), "id") if ordered else open_items


def followups_summary(items: DataFrame) -> DataFrame:
    """One row of totals, before the bot filter; 'all_clear' when nothing is open."""
    counted = items.agg(
        F.count(F.lit(1)).alias("total_before_filter"),
        F.count_if(F.col("type") == "mention").alias("mentions_before_filter"),
        F.count_if(F.col("type") == "dm").alias("dms_before_filter"),
    )
    return counted.withColumn(
        "status", F.when(F.col("total_before_filter") == 0, "all_clear").otherwise("pending")
    )


def followup_context(
    messages: DataFrame, items: DataFrame, users: DataFrame, context_from_us: int
) -> DataFrame:
    """Earlier messages for all items, each message once.

    The context of an item is everything earlier in its conversation from
    `context_from_us` on, so the contexts of one conversation are prefixes of one
    list by time, and the time of an item says where its prefix ends. The result
    is a filtered read, no longer than the history; one list per item would grow
    with items times messages.
    """
    ends = items.groupBy("conversation_name").agg(F.max("ts_us").alias("_end"))
    ends = broadcast_if_small(written(ends, "followup-ends"))
    earlier = (
        since(messages, context_from_us, strict=False)
        .join(ends, "conversation_name").where(F.col("ts_us") < F.col("_end"))
    )
    return with_display_name(earlier, users, "user").select(
        "conversation_name", "id", "ts_us", "datetime", "user", F.col("clean_text").alias("text")
    )


def link_context(context: DataFrame, items: DataFrame) -> DataFrame:
    """Add to each context message the next open item of its conversation: `next_item_id`, `next_item_ts_us`.

    A message is context of that item and of all later ones. An as-of join by union:
    messages and items lie in hour slices of their conversation, ordered from the
    newest back, and take the last item met; where a slice has no later item, the first
    item of the next slice that has one is carried in. No task orders a whole conversation.
    """
    item = F.struct(F.col("ts_us").alias("at"), F.col("id").alias("item"))
    nothing = F.lit(None).cast("struct<at:bigint,item:string>")
    marks = items.select("conversation_name", "ts_us", F.lit(True).alias("_is_item"), item.alias("_item"))
    rows = context.withColumns({"_is_item": F.lit(False), "_item": nothing}).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("_hour", F.floor(F.col("ts_us") / F.lit(HOUR_US)).cast("bigint"))
    place = ["conversation_name", "_hour"]
    # Items of one moment come after its messages, the smallest id last.
    back = W.partitionBy(*place).orderBy(F.desc("ts_us"), "_is_item", F.desc("_item")).rowsBetween(W.unboundedPreceding, 0)
    here = rows.withColumn("_next", F.last("_item", ignorenulls=True).over(back)).where("not _is_item")
    slices = rows.groupBy(*place).agg(F.min("_item").alias("_first"))
    later = W.partitionBy("conversation_name").orderBy(F.desc("_hour")).rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select(*place, F.last("_first", ignorenulls=True).over(later).alias("_carried"))
    found = F.coalesce("_next", "_carried")
    return here.join(carried, place).select(
        *context.columns, found["item"].alias("next_item_id"), found["at"].alias("next_item_ts_us")
    )


def context_of(context: DataFrame, conversation: str, item_ts_us: int) -> DataFrame:
    """The context list of one item, oldest first."""
    mine = (F.col("conversation_name") == conversation) & (F.col("ts_us") < item_ts_us)
    return context.where(mine).orderBy("ts_us", "id")


@dataclass
class Followups:
    status: str
    summary: DataFrame | None = None
    items: DataFrame | None = None
    context: DataFrame | None = None


def list_followups(
    messages: DataFrame, conversations: DataFrame, users: DataFrame, owner: Owner, as_of_us: int,
    max_age_hours: int = 72, ignored: Sequence[str] = (), context_days: int = CONTEXT_DAYS,
) -> Followups:
    """Status, totals, bot-filtered items and the bot-filtered context of those items."""
    if not owner.name:
        return Followups("error")
    found = written(
        followups(messages, conversations, users, owner, as_of_us, max_age_hours, ordered=False), "followups"
    )
    summary = followups_summary(found)
    context_from = as_of_us - max_age_hours * HOUR_US - context_days * DAY_US
    kept = filter_bots(found, ignored)
    return Followups(
        summary.first()["status"],
        summary,
        kept.orderBy(F.desc("age_hours"), "id"),
        filter_bots(link_context(followup_context(messages, kept, users, context_from), kept), ignored),
    )
