"""Reads and name lookups. Every limit follows a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.functions.names import match_score
from parley.functions.times import DAY_US, datetime_text
from parley.operators.kept import totals
from parley.sources.tables import since


def _date(ts_us: Column) -> Column:
    """Readable time of a smallest or largest time, NULL where there are no messages."""
    return F.when(ts_us.isNotNull(), datetime_text(ts_us))


def _first_channel_id(channels: DataFrame, name: str) -> str | None:
    found = channels.where(F.col("name") == name).agg(F.min("slack_id").alias("slack_id")).first()
    return found["slack_id"]


def get_conversation(conversations: DataFrame, channels: DataFrame, wanted: str) -> DataFrame:
    """The conversation of that name or id; else that of the channel with that name."""

    def called(name: str, rank: int) -> DataFrame:
        hit = (F.col("name") == name) | (F.col("id") == name)
        return conversations.where(hit).withColumn("_rank", F.lit(rank))

    found = called(wanted, 0)
    channel_id = _first_channel_id(channels, wanted)
    if channel_id is not None:
        found = found.unionByName(called(channel_id, 1))
    return found.orderBy("_rank", "id").limit(1).drop("_rank")


def _page(messages, name, limit, offset, since_us, until_us) -> DataFrame:
    rows = messages.where(F.col("conversation_name") == name)
    if since_us is not None:
        rows = since(rows, since_us, strict=False)
    if until_us is not None:
        rows = rows.where(F.col("ts_us") <= until_us)
    return rows.orderBy("ts_us", "id").offset(offset).limit(limit)


def deep_page(
    messages: DataFrame, days: DataFrame, conversation: str, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """A page of a conversation, oldest first, that reads only the dates it lies in.

    `days` are the kept counts (`kept.daily`): their running sum says in which dates
    the messages from `offset` on lie. At most `limit` dates hold a page.
    """
    per_day = days.where(F.col("conversation_name") == conversation).groupBy("dt").agg(F.sum("messages").alias("n"))
    upto = F.sum("n").over(W.orderBy("dt"))  # one row per date of one conversation
    placed = per_day.withColumn("start", upto - F.col("n"))
    hit = (F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)
    dates = placed.where(hit).orderBy("dt").limit(max(limit, 1)).collect()
    rows = messages.where(F.col("conversation_name") == conversation)
    if not dates or limit < 1:
        return rows.limit(0)
    rows = rows.where(F.col("dt").cast("string").isin([r["dt"] for r in dates]))
    return rows.orderBy("ts_us", "id").offset(offset - dates[0]["start"]).limit(limit)


def get_messages(
    messages: DataFrame, channels: DataFrame, conversation: str, limit: int = 100, offset: int = 0,
    since_us: int | None = None, until_us: int | None = None,
) -> DataFrame:
    """Oldest messages first, bounds inclusive; an empty page is retried under the channel's id.

    The name is looked up before the query is built, so the scan gets a literal
    filter that parquet can use.
    """
    page = _page(messages, conversation, limit, offset, since_us, until_us)
    channel_id = _first_channel_id(channels, conversation)
    if channel_id is not None and page.isEmpty():
        page = _page(messages, channel_id, limit, offset, since_us, until_us)
    return page


def search_messages(
    messages: DataFrame, query: str, conversation: str | None = None, user: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Newest messages whose search text or clean text contains the lower-cased query."""
    term = query.lower()
    rows = messages.where(F.col("search_text").contains(term) | F.col("clean_text").contains(term))
    if conversation is not None:
        rows = rows.where(F.col("conversation_name") == conversation)
    if user is not None:
        rows = rows.where(F.col("user_name").contains(user))
    return rows.orderBy(F.desc("ts_us"), "id").limit(limit)


def list_conversations(
    conversations: DataFrame, messages: DataFrame, kind: str | None = None, ordered: bool = True
) -> DataFrame:
    """Conversations with the count, first, last date and last time of their messages.

    `messages` are the messages or the kept counts (`kept.daily`); either is reduced
    to one row per conversation before the join.
    """
    if "first_ts_us" in messages.columns:
        counted = totals(messages).select(
            "name", F.col("message_count").alias("_n"), F.col("first_message_ts_us").alias("_first"), "last_message_ts_us"
        )
    else:
        counted = messages.groupBy(F.col("conversation_name").alias("name")).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("ts_us").alias("_first"),
            F.max("ts_us").alias("last_message_ts_us"),
        )
    wanted = conversations if kind is None else conversations.where(F.col("type") == kind)
    listed = wanted.join(counted, "name", "left").select(
        *wanted.columns,
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("actual_message_count"),
        _date(F.col("_first")).alias("start_date"),
        _date(F.col("last_message_ts_us")).alias("end_date"),
        "last_message_ts_us",
    )
    return listed.orderBy(F.desc_nulls_last("last_message_ts_us"), "id") if ordered else listed


def db_stats(
    conversations: DataFrame, users: DataFrame, messages: DataFrame, as_of_us: int
) -> DataFrame:
    """One row of totals. Each table is reduced to one row, the rows are summed."""
    reply = F.col("thread_ts_us").isNotNull() & ~F.col("is_thread_parent")
    parts = [
        conversations.agg(
            F.count(F.lit(1)).alias("total_conversations"),
            F.count_if(F.col("type") == "channel").alias("channels"),
            F.count_if(F.col("type") == "dm").alias("dms"),
        ),
        users.agg(F.count(F.lit(1)).alias("total_users")),
        messages.agg(
            F.count(F.lit(1)).alias("total_messages"),
            F.count_if(F.col("ts_us") >= as_of_us - DAY_US).alias("messages_last_24h"),
            F.count_if(F.col("is_thread_parent")).alias("threads"),
            F.count_if(reply).alias("thread_replies"),
            _date(F.min("ts_us")).alias("first_datetime"),
            _date(F.max("ts_us")).alias("last_datetime"),
        ),
        messages.agg(F.countDistinct("user_name").alias("active_users")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def conversations_by_type(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("type").agg(F.count(F.lit(1)).alias("conversations"))


def busiest_channels(messages: DataFrame, n: int = 5) -> DataFrame:
    """Channels with most messages."""
    counted = (
        messages.where(F.col("conversation_type") == "channel")
        .groupBy("conversation_name").agg(F.count(F.lit(1)).alias("message_count"))
    )
    return counted.orderBy(F.desc("message_count"), "conversation_name").limit(n)


def mapping_stats(users: DataFrame, channels: DataFrame) -> DataFrame:
    people = users.agg(
        F.count(F.lit(1)).alias("total_users"), F.count_if(F.col("is_bot")).alias("bot_users")
    )
    rooms = channels.agg(
        F.count(F.lit(1)).alias("total_channels"), F.count_if(F.col("is_private")).alias("private_channels")
    )
    both = people.unionByName(rooms, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def channel_to_id(channels: DataFrame, wanted: str) -> DataFrame:
    """Id of a channel name: exact, without leading '#', then prefix, then inside (one row, NULL if none)."""
    clean = wanted.lstrip("#")
    name = F.col("name")
    tier = F.when(name == wanted, 0).when(name == clean, 1).when(name.startswith(clean), 2).otherwise(3)
    hits = channels.where((name == wanted) | name.contains(clean))
    return hits.agg(F.min_by("slack_id", F.struct(tier, name, "slack_id")).alias("channel_id"))


def channel_ids_for_names(names: Sequence[str], channels: DataFrame) -> DataFrame:
    """`channel_to_id` for the names of a configuration in one pass: (name, channel_id)."""
    asked = F.array(*[F.struct(F.lit(n).alias("asked"), F.lit(n.lstrip("#")).alias("clean")) for n in names])
    name = F.col("name")
    hits = channels.select(
        "slack_id",
        "name",
        F.explode(
            F.filter(asked, lambda a: (name == a["asked"]) | F.contains(name, a["clean"]))
        ).alias("a"),
    )
    tier = (
        F.when(name == F.col("a.asked"), 0).when(name == F.col("a.clean"), 1)
        .when(F.startswith(name, F.col("a.clean")), 2).otherwise(3)
    )
    return hits.groupBy(F.col("a.asked").alias("asked")).agg(
        F.min_by("slack_id", F.struct(tier, name, "slack_id")).alias("channel_id")
    )


def match_channels(channels: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Best channel matches, case-sensitive: 100 exact, 90 prefix, 80 inside."""
    score = match_score(F.col("name"), F.lit(term))
    scored = channels.select("name", "slack_id", score.alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "name", "slack_id").limit(limit)


def channel_suggestions(channels: DataFrame, term: str) -> DataFrame:
    return match_channels(channels, term, limit=5)


def _scored_users(users: DataFrame, term: str) -> DataFrame:
    known = F.coalesce("name", "real_name")
    return users.select(
        F.coalesce(known, F.col("slack_id")).alias("name"),
        "slack_id",
        match_score(F.lower(known), F.lower(F.lit(term))).alias("score"),
    ).where("score > 0")


def match_users(users: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Best user matches on name, else real name, ignoring case."""
    scored = _scored_users(users, term)
    return scored.orderBy(F.desc("score"), "name", "slack_id").limit(limit)


def user_ambiguity(users: DataFrame, term: str) -> DataFrame:
    """One row: may a query about this person go on? All matches count, the best five are suggested."""
    counted = _scored_users(users, term).agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.col("score") == 100).alias("exact_matches")
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name", "slack_id")))
    best = match_users(users, term, limit=5).agg(F.transform(ranked, lambda r: r["name"]).alias("suggestions"))
    both = counted.unionByName(best, allowMissingColumns=True)
    judged = both.agg(*[F.max(c).alias(c) for c in ("matches", "exact_matches", "suggestions")])
    status = (
        F.when(F.col("matches") == 0, "not_found")
        .when((F.col("matches") > 1) & (F.col("exact_matches") != 1), "ambiguous")
        .otherwise("ok")
    )
    return judged.select("matches", "exact_matches", status.alias("status"), "suggestions")


def resolve_conversation(conversations: DataFrame, channels: DataFrame, wanted: str) -> DataFrame:
    """(asked, resolved_name): itself when known, else the conversation of the best channel match."""
    named = F.lit(wanted).alias("resolved_name")
    known = get_conversation(conversations, channels, wanted).select(F.lit(0).alias("rank"), "id", named)
    best = match_channels(channels, wanted, limit=1).select(
        F.col("name").alias("_name"), F.col("slack_id").alias("_id")
    )
    both = [
        conversations.join(best, F.col("name") == F.col("_name")),
        conversations.join(best, F.col("id") == F.col("_id")),
    ]
    close = [
        hit.select(F.lit(1).alias("rank"), "id", F.col("name").alias("resolved_name")) for hit in both
    ]
    given = conversations.agg(F.lit(2).alias("rank"), F.max(F.lit("")).alias("id"), named)
    found = known.unionByName(close[0]).unionByName(close[1]).unionByName(given)
    return found.agg(F.min_by("resolved_name", F.struct("rank", "id")).alias("resolved_name")).select(
        F.lit(wanted).alias("asked"), "resolved_name"
    )


def conversation_containing(messages: DataFrame, part: str) -> DataFrame:
    """First channel conversation whose name contains the text (one row, NULL if none)."""
    return (
        messages.where((F.col("conversation_type") == "channel") & F.col("conversation_name").contains(part))
        .agg(F.min("conversation_name").alias("conversation_name"))
    )


def user_by_any_name(users: DataFrame, wanted: str) -> DataFrame:
    """Id of the user with that name, display name or real name (one row, NULL if none)."""
    hit = (F.col("name") == wanted) | (F.col("display_name") == wanted) | (F.col("real_name") == wanted)
    return users.where(hit).agg(F.min("slack_id").alias("slack_id"))
