"""Raw message -> flat readable row, plus its attachments and reactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from parley.functions import message as ms, text as tx, times as tm
from parley.operators.keyed import broadcast_if_small, latest_of_stored
from parley.operators.resolve import DIRECT_IDS, attach_names, book_for, mention_ids, resolve_ids, with_clean_text
from parley.schemas import CORRUPT, FILE_ITEM, LINK_ITEM, MESSAGES, REACTION_ITEM
from parley.session import written

RAW_KEY = ("conversation_id", "ts")


def mark_bad_rows(raw: DataFrame) -> DataFrame:
    """Adds `reason`, NULL for good rows. A row needs a conversation and a numeric ts to have an id."""
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    return raw.withColumn(
        "reason",
        F.when(broken, "broken json")
        .when(tx.blank_to_null(F.col("conversation_id")).isNull(), "missing conversation_id")
        .when(tx.blank_to_null(F.col("ts")).isNull(), "missing ts")
        .when(tm.epoch_us(F.col("ts")).isNull(), "ts is not a number"),
    )


def split_bad_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with a reason)."""
    marked = mark_bad_rows(raw)
    good = marked.where("reason is null").drop("reason", CORRUPT)
    return good, marked.where("reason is not null")


def with_conversation_name(
    raw: DataFrame, conversations: DataFrame, book: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """Stored conversation name, else channel name, else `DM: id` / the id; type from the landed field.

    Conversations are fewer than messages: of a large book only their entries are looked
    at. `ids` holds `conversation_id` where it is read more cheaply than from `raw`.
    """
    known = conversations.select(
        F.col("id").alias("conversation_id"), tx.blank_to_null(F.col("name")).alias("_stored")
    )
    kind = ms.conversation_type(F.col("conversation_id"), F.col("conversation_type"))
    typed = raw.withColumn("conversation_type", kind).join(broadcast_if_small(known), "conversation_id", "left")
    asked = (raw if ids is None else ids).select("conversation_id")
    named = resolve_ids(typed, book_for(book, asked), "conversation_id", "_channel")
    fallback = F.when(F.col("conversation_type") == "dm", F.concat(F.lit("DM: "), "conversation_id")).otherwise(
        F.col("_channel")
    )
    return (
        named.withColumn("conversation_name", F.coalesce("_stored", fallback))
        .drop("_stored", "_channel")
    )


def with_draft(raw: DataFrame) -> DataFrame:
    """The text of each message with people still shown by their ids, and all ids whose names it needs.

    Both come from one reading of text, blocks and files, so file titles and the text
    parts of rich text are searched for mentions like plain text.
    """
    nobody = F.lit(None).cast("map<string,string>")
    rich = tx.rich_text_if_needed(F.col("text"), F.col("blocks"), nobody)
    drafted = raw.withColumn("_rich_ids", F.when(rich.isNotNull(), tx.rich_text_user_ids(F.col("blocks"))))
    drafted = drafted.withColumn("_draft", tx.message_text(F.col("text"), rich, F.col("files")))
    no_ids = F.array().cast("array<string>")
    author = F.when(tx.blank_to_null(F.col("user")).isNotNull(), F.array("user")).otherwise(no_ids)
    return drafted.withColumn(
        "_ids", F.array_distinct(F.concat(author, F.coalesce("_rich_ids", no_ids), mention_ids(F.col("_draft"))))
    )


def normalize(raw: DataFrame, book: DataFrame) -> DataFrame:
    """The 22 message columns. `raw` carries conversation_name and conversation_type.

    Texts and the ids in them are read out once and written aside.
    """
    return normalize_drafts(written(with_draft(raw), "drafts"), book)


def normalize_drafts(drafted: DataFrame, book: DataFrame) -> DataFrame:
    """`normalize` for rows that have their draft: one lookup for author and mentions, then plain projections."""
    named = attach_names(drafted, F.col("_ids"), book, most=DIRECT_IDS + 1)
    names = F.col("names")
    who = tx.blank_to_null(F.col("user"))
    named = named.withColumn("user_name", F.coalesce(F.try_element_at(names, who), who))
    # Shared parts are columns of their own, so that each is computed once per row.
    rich = F.when(F.size("_rich_ids") > 0, tx.rich_text(F.col("blocks"), names))
    step = named.withColumn("_text", F.coalesce(tx.blank_to_null(rich), F.col("_draft")))
    step = with_clean_text(step, "_text", "_clean")
    step = step.withColumn("_us", tm.epoch_us(F.col("ts"))).withColumn(
        "_parent", ms.is_thread_parent(F.col("thread_ts"), F.col("ts"))
    )
    cols = {
        "id": ms.message_id(F.col("conversation_name"), F.col("ts")),
        "conversation_name": F.col("conversation_name"),
        "conversation_type": F.col("conversation_type"),
        "ts_us": F.col("_us"),
        "datetime": tm.datetime_text(F.col("_us")),
        "user_name": F.col("user_name"),
        "author_name": F.col("user_name"),
        "text": F.col("_text"),
        "clean_text": F.col("_clean"),
        "message_type": ms.message_type(*[F.col(c) for c in ("subtype", "bot_id", "app_id", "files", "attachments")]),
        "subtype": F.col("subtype"),
        "thread_ts_us": tm.epoch_us(F.col("thread_ts")),
        "is_thread_parent": F.col("_parent"),
        "reply_count": ms.reply_count(F.col("_parent"), F.col("reply_count")),
        "has_attachments": ms.has_attachments(F.col("files"), F.col("attachments")),
        "has_reactions": ms.any_items(F.col("reactions")),
        "is_edited": ms.is_edited(F.col("edited")),
        "edited_ts_us": ms.edited_ts_us(F.col("edited")),
        "mentions_users": tx.mentioned_users(F.col("_text"), names),
        "contains_links": tx.contains_links(F.col("_clean")),
        "word_count": tx.word_count(F.col("_clean")),
        "search_text": tx.search_text(F.col("_clean"), F.col("user_name"), F.col("conversation_name")),
    }
    return step.select(*[c.cast(MESSAGES[n].dataType).alias(n) for n, c in cols.items()])


def _raw_message_id(raw: DataFrame) -> DataFrame:
    return raw.withColumn("message_id", ms.message_id(F.col("conversation_name"), F.col("ts")))


def attachments_from_files(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per file; items that are not objects are skipped but keep their index.

    `keep` names raw columns to carry along.
    """
    items = _raw_message_id(raw).select("message_id", *keep, F.posexplode("files").alias("_i", "_json"))
    parsed = items.withColumn("f", F.when(F.ltrim("_json").startswith("{"), F.from_json("_json", FILE_ITEM)))
    mime = F.coalesce("f.mimetype", F.lit(""))
    return parsed.where("f is not null").select(
        F.concat_ws(":", "message_id", F.lit("file"), F.col("_i").cast("string")).alias("id"),
        "message_id",
        F.col("f.name").alias("file_name"),
        F.col("f.filetype").alias("file_type"),
        F.col("f.size").alias("file_size"),
        F.col("f.url_private").alias("url_private"),
        F.col("f.title").alias("title"),
        mime.startswith("image/").alias("is_image"),
        mime.startswith("video/").alias("is_video"),
        F.coalesce(F.col("f.filetype").isin(*ms.DOCUMENT_TYPES), F.lit(False)).alias("is_document"),
        *keep,
    )


def attachments_from_links(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    items = _raw_message_id(raw).select("message_id", *keep, F.posexplode("attachments").alias("_i", "_json"))
    parsed = items.withColumn("a", F.when(F.ltrim("_json").startswith("{"), F.from_json("_json", LINK_ITEM)))
    return parsed.where("a is not null").select(
        F.concat_ws(":", "message_id", F.lit("attachment"), F.col("_i").cast("string")).alias("id"),
        "message_id",
        F.col("a.title").alias("file_name"),
        F.lit("link").alias("file_type"),
        F.lit(None).cast("bigint").alias("file_size"),
        F.col("a.title_link").alias("url_private"),
        F.col("a.title").alias("title"),
        F.lit(False).alias("is_image"),
        F.lit(False).alias("is_video"),
        F.lit(False).alias("is_document"),
        *keep,
    )


def attachments(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return attachments_from_files(raw, keep).unionByName(attachments_from_links(raw, keep))


def reactions(raw: DataFrame, book: DataFrame, ingested_us: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (message, emoji, person); the time is that of the load."""
    each = _raw_message_id(raw).select("message_id", *keep, F.explode("reactions").alias("_json"))
    each = each.withColumn("r", F.when(F.ltrim("_json").startswith("{"), F.from_json("_json", REACTION_ITEM)))
    each = each.where("r is not null").select(
        "message_id", *keep, F.col("r.name").alias("emoji_name"), F.explode("r.users").alias("_who")
    )
    named = resolve_ids(each, book_for(book, each.select("_who")), "_who", "user_name").where("user_name is not null")
    emoji = F.concat(F.lit(":"), F.coalesce("emoji_name", F.lit("None")), F.lit(":"))
    return (
        named.select("message_id", emoji.alias("emoji"), "emoji_name", "user_name", *keep)
        .distinct()
        .withColumn("ts_us", F.lit(ingested_us).cast("bigint"))
    )


def last_sent(raw: DataFrame, sent_order: list) -> DataFrame:
    """Of several copies of one raw message, the one sent last; `raw` is read more than once."""
    return latest_of_stored(raw, RAW_KEY, sent_order)
