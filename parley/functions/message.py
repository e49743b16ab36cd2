"""Expressions over the fields of one raw message."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parley.functions.text import blank_to_null
from parley.functions.times import epoch_us

# Message subtypes with a type of their own.
FILE_SUBTYPES = ("file_share", "file_comment")
BOT_SUBTYPES = ("bot_message",)
# File types that count as documents.
DOCUMENT_TYPES = ("pdf", "doc", "docx", "txt")


def any_items(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def message_type(
    subtype: Column, bot_id: Column, app_id: Column, files: Column, attachments: Column
) -> Column:
    sub = blank_to_null(subtype)
    by_bot = blank_to_null(bot_id).isNotNull() | blank_to_null(app_id).isNotNull()
    return (
        F.when(sub.isin(*FILE_SUBTYPES), "file_share")
        .when(sub.isin(*BOT_SUBTYPES), "bot")
        .when(sub.isNotNull(), "system")
        .when(by_bot, "bot")
        .when(any_items(files) | any_items(attachments), "file_share")
        .otherwise("message")
    )


def has_attachments(files: Column, attachments: Column) -> Column:
    return any_items(files) | any_items(attachments)


def is_edited(edited: Column) -> Column:
    """`edited` is the raw JSON text of the field; empty values do not count."""
    return F.coalesce(
        ~F.regexp_replace(edited, r"\s", "").isin("", "{}", "[]", "false", "0", "null"), F.lit(False)
    )


def edited_ts_us(edited: Column) -> Column:
    return epoch_us(F.get_json_object(edited, "$.ts"))


def is_thread_parent(thread_ts: Column, ts: Column) -> Column:
    """Compared as text; NULL for messages outside a thread."""
    return F.when(blank_to_null(thread_ts).isNotNull(), thread_ts == ts)


def reply_count(parent: Column, count: Column) -> Column:
    return F.when(parent, F.coalesce(count, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def message_id(conversation_name: Column, ts: Column) -> Column:
    """Built from the raw ts text, never from a double."""
    return F.concat(conversation_name, F.lit(":"), ts)


def conversation_type(conversation_id: Column, landed: Column | None = None) -> Column:
    """The landed type wins; the id prefix is only a fallback."""
    guessed = F.when(conversation_id.startswith("D"), "dm").otherwise("channel")
    return guessed if landed is None else F.coalesce(blank_to_null(landed), guessed)
