"""Small tables kept beside the messages, so that lists, pages and searches need not read the history.

Each is a function of the messages of one type and date. A load recomputes them for
the dates it touched, so they stay right under edits and repeated batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.times import date_text
from parley.schemas import DAILY, GRAMS

GRAM = 3


def daily(messages: DataFrame) -> DataFrame:
    """Messages, first and last time per date, conversation and author."""
    rows = messages.groupBy("conversation_type", "dt", "conversation_name", "user_name").agg(
        F.count(F.lit(1)).alias("messages"), F.min("ts_us").alias("first_ts_us"), F.max("ts_us").alias("last_ts_us")
    )
    return rows.withColumn("dt", F.col("dt").cast("string")).select(*DAILY.names)


def totals(days: DataFrame) -> DataFrame:
    """(name, message_count, first_message_ts_us, last_message_ts_us) per conversation, summed from `daily`."""
    return days.groupBy(F.col("conversation_name").alias("name")).agg(
        F.sum("messages").alias("message_count"),
        F.min("first_ts_us").alias("first_message_ts_us"),
        F.max("last_ts_us").alias("last_message_ts_us"),
    )


def with_totals(conversations: DataFrame, days: DataFrame) -> DataFrame:
    """Conversations with the count and newest time of their messages, by name."""
    counted = totals(days).select(
        "name", F.col("message_count").alias("_n"), F.col("last_message_ts_us").alias("_last")
    )
    return conversations.join(counted, "name", "left").withColumns({
        "message_count": F.coalesce("_n", F.lit(0)).cast("bigint"), "latest_message_ts_us": F.col("_last"),
    }).select(*conversations.columns)


def text_grams(text: Column) -> Column:
    """The distinct runs of three characters of a text; linear in its length."""
    return F.array_distinct(_runs(text))


def _runs(text: Column) -> Column:
    """The run that begins at each character, as far as there is one: read ahead, then one character on."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(?=({'.' * GRAM}))."), F.lit(1))


def grams(messages: DataFrame) -> DataFrame:
    """Which runs of three characters occur in the messages of a date and conversation.

    Taken from both texts that a search looks at. Runs of replaced messages may stay
    in a kept table: it only names candidates, the texts themselves decide.
    """
    found = F.concat(_runs(F.col("search_text")), _runs(F.col("clean_text")))  # distinct below, not per text
    rows = messages.select("conversation_type", "dt", "conversation_name", F.explode(found).alias("gram"))
    return rows.withColumn("dt", F.col("dt").cast("string")).select(*GRAMS.names).distinct()


def replies(messages: DataFrame) -> DataFrame:
    """Replies with the date of their thread's root, by which they are filed."""
    rows = messages.where(F.col("thread_ts_us").isNotNull() & ~F.col("is_thread_parent"))
    return rows.withColumn("root_dt", date_text(F.col("thread_ts_us")))
