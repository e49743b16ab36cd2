"""Activity, interactions, follow-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.bots import is_bot
from parley.operators import activity as ac, followups as fu, people as pe
from parley.operators.bots import filter_bots
from parley.operators.resolve import with_display_name
from parley.plans import views as v
from parley.plans.registry import query
from parley.session import written

DISPLAY = "coalesce(u.name, u.real_name, m.user_name)"
OWNER = fu.Owner(v.OWNER)
IGNORED = ["#00000000", "u14"]


def _all(spark, sf, **kw):
    return v.messages(spark, sf, **kw)


def _window(spark, sf, **kw):
    return ac.channel_window(_all(spark, sf, **kw), v.CUTOFF_14D)


LISTED = """SELECT c.id, c.name, c.type, c.participants, count(m.id) AS message_count, min(m.datetime) AS start_date, max(m.datetime) AS end_date, max(m.ts_us) AS last_activity_us
  FROM conversations_dim c LEFT JOIN messages m ON m.conversation_name = c.name GROUP BY c.id, c.name, c.type, c.participants"""


@query("list_channels", f"""SELECT l.id, coalesce(bn.name, bi.name, l.name) AS name, message_count, start_date, end_date, last_activity_us FROM ({LISTED}) l
  LEFT JOIN channels bn ON bn.slack_id = l.name LEFT JOIN channels bi ON bi.slack_id = l.id WHERE l.type = 'channel' AND NOT contains(coalesce(bn.name, bi.name, l.name), 'ion_2')""")
def list_channels(spark, sf):
    m = _all(spark, sf, threads=False, clean=False)
    return ac.list_channels(v.conversations_dim(spark, sf), v.channels(spark, sf), m, ["ION_2"], ordered=False)


@query("list_dms", f"""SELECT id, name, array_to_string(list_filter(participants, lambda p: NOT contains(lower(p), 'slackbot') AND NOT contains(lower(p), 'u14')), ',') AS participants,
  message_count, start_date, end_date, last_activity_us FROM ({LISTED}) WHERE type = 'dm'""")
def list_dms(spark, sf):
    m = _all(spark, sf, threads=False, clean=False)
    dms = ac.list_dms(v.conversations_dim(spark, sf), m, ["U14"], ordered=False)
    return dms.withColumn("participants", F.array_join("participants", ","))


@query("channel_summary", f"""SELECT conversation_name, count(*) AS total_messages, count(DISTINCT user_name) AS unique_participants, min(ts_us) AS first_message_ts_us,
  max(ts_us) AS last_message_ts_us, count(*) FILTER (is_thread_parent) AS thread_count, count(*) FILTER (thread_ts_us IS NOT NULL AND NOT is_thread_parent) AS thread_reply_count
  FROM messages WHERE conversation_type = 'channel' AND ts_us > {v.CUTOFF_14D} GROUP BY conversation_name""")
def channel_summary(spark, sf):
    return ac.channel_summary(_window(spark, sf, clean=False))


@query("channel_participants", f"""SELECT conversation_name, user_name, {DISPLAY} AS display_name, count(*) AS message_count, max(ts_us) AS last_activity_us
  FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name WHERE conversation_type = 'channel' AND ts_us > {v.CUTOFF_14D} GROUP BY conversation_name, user_name, u.name, u.real_name""")
def channel_participants(spark, sf):
    return ac.channel_participants(_window(spark, sf, threads=False, clean=False), v.users(spark, sf), ordered=False)


@query("channel_main", f"""SELECT conversation_name, id, ts_us, datetime, user_name, clean_text, is_thread_parent, reply_count, thread_ts_us, {DISPLAY} AS display_user_name
  FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name WHERE conversation_type = 'channel' AND ts_us > {v.CUTOFF_14D} AND (thread_ts_us IS NULL OR is_thread_parent)""")
def channel_main(spark, sf):
    return ac.channel_main(_window(spark, sf), v.users(spark, sf), ordered=False)


REPLIES = f"""SELECT m.*, {DISPLAY} AS display_user_name FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name
  JOIN (SELECT conversation_name AS pc, thread_ts_us AS pt FROM messages WHERE conversation_type = 'channel' AND ts_us > {v.CUTOFF_14D} AND is_thread_parent AND reply_count > 0) p
  ON p.pc = m.conversation_name AND p.pt = m.thread_ts_us WHERE NOT is_thread_parent"""


@query("channel_threads", f"SELECT conversation_name, thread_ts_us AS parent_ts_us, id, ts_us, datetime, user_name, clean_text, display_user_name FROM ({REPLIES})")
def channel_threads(spark, sf):
    m = _all(spark, sf)
    return ac.channel_threads(ac.channel_window(m, v.CUTOFF_14D), m, v.users(spark, sf), v.CUTOFF_14D)


@query("channel_threads_kept", f"SELECT conversation_name, thread_ts_us AS parent_ts_us, id, ts_us, datetime, user_name, clean_text, display_user_name FROM ({REPLIES})")
def channel_threads_kept(spark, sf):
    """Replies filed by the date of their root: older roots are not read."""
    t = v.kept_tables(spark, sf)
    return ac.channel_threads(ac.channel_window(t["messages"], v.CUTOFF_14D), t["replies"], v.users(spark, sf), v.CUTOFF_14D)


def _flow_sql(where: str) -> str:
    return f"""SELECT conversation_name, ts_us AS root_ts_us, FALSE AS is_reply, ts_us, id, datetime, {DISPLAY} AS "user", clean_text AS text,
    CASE WHEN is_thread_parent THEN 'thread_parent' ELSE 'message' END AS type, reply_count FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name
    WHERE conversation_type = 'channel' AND ts_us > {v.CUTOFF_14D} AND (thread_ts_us IS NULL OR is_thread_parent) {where}
  UNION ALL SELECT conversation_name, thread_ts_us, TRUE, ts_us, id, datetime, display_user_name, clean_text, 'thread_reply', reply_count FROM ({REPLIES}) WHERE TRUE {where}"""


@query("conversation_flow", _flow_sql(""))
def conversation_flow(spark, sf):
    m = _all(spark, sf)
    return ac.conversation_flow(
        ac.channel_window(m, v.CUTOFF_14D), m, v.users(spark, sf), ordered=False, cutoff_us=v.CUTOFF_14D
    )


@query("channel_activity", _flow_sql("AND conversation_name = 'nation_20'"))
def channel_activity(spark, sf):
    """Asked for by part of the name; the best match is nation_20."""
    found = ac.channel_activity(
        v.conversations_dim(spark, sf), v.channels(spark, sf), v.users(spark, sf), _all(spark, sf),
        "ation_20", v.AS_OF_US,
    )
    return found.flow


#: Asked by name, id, part of a name, an unknown name, and at a time without messages.
ASKED = [("nation_5", 0), ("C6", 0), ("ation_20", 0), ("Nation", 0), ("nation_7", 400)]


def _asked_sql(asked: str, name: str | None, later_days: int) -> str:
    if name is None:
        return f"""SELECT '{asked}' AS asked, 'not_found' AS status, CAST(NULL AS VARCHAR) AS resolved_name, coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM (
          SELECT name FROM channels WHERE contains(name, '{asked}') ORDER BY name LIMIT 5)), '') AS suggestions, CAST(NULL AS BIGINT) AS total_messages,
          CAST(NULL AS BIGINT) AS unique_participants, CAST(NULL AS BIGINT) AS thread_count, CAST(NULL AS BIGINT) AS thread_reply_count"""
    found = f"conversation_name = '{name}' AND ts_us > {v.CUTOFF_14D + later_days * 86_400_000_000}"
    return f"""SELECT '{asked}' AS asked, CASE WHEN count(*) = 0 THEN 'no_activity' ELSE 'ok' END AS status, '{name}' AS resolved_name, '' AS suggestions,
      nullif(count(*), 0) AS total_messages, nullif(count(DISTINCT user_name), 0) AS unique_participants,
      CASE WHEN count(*) > 0 THEN count(*) FILTER (is_thread_parent) END AS thread_count,
      CASE WHEN count(*) > 0 THEN count(*) FILTER (thread_ts_us IS NOT NULL AND NOT is_thread_parent) END AS thread_reply_count FROM messages WHERE {found}"""


_RESOLVED = ["nation_5", "nation_6", "nation_20", None, "nation_7"]


@query("channel_activity_status", " UNION ALL ".join(_asked_sql(a, n, d) for (a, d), n in zip(ASKED, _RESOLVED)))
def channel_activity_status(spark, sf):
    """All forms of the answer: status, resolved name, suggestions and the summary."""
    dims = (v.conversations_dim(spark, sf), v.channels(spark, sf), v.users(spark, sf), _all(spark, sf))
    parts = ["total_messages", "unique_participants", "thread_count", "thread_reply_count"]
    rows = None
    for asked, later in ASKED:
        found = ac.channel_activity(*dims, asked, v.AS_OF_US + later * 86_400_000_000)
        told = [
            F.lit(asked).alias("asked"), F.lit(found.status).alias("status"),
            F.lit(found.resolved_name).cast("string").alias("resolved_name"), F.lit("|".join(found.suggestions)).alias("suggestions"),
        ]
        if found.summary is None:
            told = dims[0].limit(1).select(*told, *[F.lit(None).cast("bigint").alias(c) for c in parts])
        else:
            told = found.summary.where(F.col("conversation_name") == found.resolved_name).select(*told, *parts)
        rows = told if rows is None else rows.unionByName(told)
    return rows


@query("channel_activity_people", f"""SELECT conversation_name, user_name, {DISPLAY} AS display_name, count(*) AS message_count, max(ts_us) AS last_activity_us
  FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name WHERE conversation_name = 'nation_6' AND ts_us > {v.CUTOFF_14D} GROUP BY conversation_name, user_name, u.name, u.real_name""")
def channel_activity_people(spark, sf):
    """Asked for by id."""
    found = ac.channel_activity(
        v.conversations_dim(spark, sf), v.channels(spark, sf), v.users(spark, sf), _all(spark, sf), "C6", v.AS_OF_US
    )
    return found.participants


PERSON = v.PERSON.lower()
SHOWN = f"""SELECT m.id, m.ts_us, m.datetime, m.user_name, m.clean_text, m.conversation_name, m.conversation_type, m.thread_ts_us, m.is_thread_parent,
  {DISPLAY} AS display_user_name, array_to_string(c.participants, ',') AS participants FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name
  LEFT JOIN conversations_dim c ON c.name = m.conversation_name WHERE m.ts_us > {v.CUTOFF_30D}"""
MENTIONS = f"""{SHOWN} AND (contains(lower({DISPLAY}), '{PERSON}') OR contains(lower(m.clean_text), '{PERSON}')) ORDER BY m.ts_us DESC, m.id LIMIT 200"""
EVERYTHING = f"""{SHOWN} AND m.conversation_name IN (SELECT conversation_name FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name
  WHERE contains(lower({DISPLAY}), '{PERSON}')) ORDER BY m.ts_us DESC, m.id LIMIT 500"""


def _shown(df):
    return df.withColumn("participants", F.array_join("participants", ","))


def _mentions(spark, sf):
    return pe.interactions_mentions(
        _all(spark, sf), v.users(spark, sf), v.conversations_dim(spark, sf), v.PERSON, v.CUTOFF_30D
    )


def _everything(spark, sf):
    return pe.interactions_all(
        _all(spark, sf), v.users(spark, sf), v.conversations_dim(spark, sf), v.PERSON, v.CUTOFF_30D
    )


@query("interactions_mentions", MENTIONS)
def interactions_mentions(spark, sf):
    return _shown(_mentions(spark, sf))


@query("interactions_all", EVERYTHING)
def interactions_all(spark, sf):
    return _shown(_everything(spark, sf))


@query("interactions_all_kept", EVERYTHING)
def interactions_all_kept(spark, sf):
    """Who wrote where comes from the kept counts; only the window of the messages is read."""
    t = v.kept_tables(spark, sf)
    return _shown(pe.interactions_all(
        t["messages"], v.users(spark, sf), v.conversations_dim(spark, sf), v.PERSON, v.CUTOFF_30D, authors=t["daily"]
    ))


BY_CONVERSATION = f"""SELECT conversation_name, min(conversation_type) AS type, count(*) AS interaction_count, max(ts_us) AS latest_ts_us,
  count(*) FILTER (thread_ts_us IS NOT NULL AND is_thread_parent) AS thread_parents, count(*) FILTER (thread_ts_us IS NOT NULL AND NOT is_thread_parent) AS thread_replies
  FROM ({EVERYTHING.split(" ORDER BY m.ts_us DESC")[0]}) GROUP BY conversation_name"""


def _hits(spark, sf):
    return pe.conversation_hits(_all(spark, sf), v.users(spark, sf), v.PERSON, v.CUTOFF_30D)



@query("interactions_by_conv", BY_CONVERSATION)
def interactions_by_conv(spark, sf):
    return pe.interactions_by_conversation(_hits(spark, sf))


@query("interactions_summary", f"""SELECT CAST(coalesce(sum(interaction_count), 0) AS BIGINT) AS interactions_before_filter, count(*) AS conversations_before_filter,
  count(*) FILTER (type = 'dm') AS dms_before_filter, count(*) FILTER (type = 'channel') AS channels_before_filter FROM ({BY_CONVERSATION})""")
def interactions_summary(spark, sf):
    return pe.interactions_summary(pe.interactions_by_conversation(_hits(spark, sf)))


@query("user_interactions", f"""SELECT b.conversation_name AS name, b.type, interaction_count, latest_ts_us, thread_parents, thread_replies,
  array_to_string(list_filter(c.participants, lambda p: NOT contains(lower(p), 'slackbot') AND NOT contains(lower(p), 'u14')), ',') AS participants
  FROM ({BY_CONVERSATION}) b LEFT JOIN conversations_dim c ON c.name = b.conversation_name WHERE NOT contains(lower(b.conversation_name), 'u14')""")
def user_interactions(spark, sf):
    """The whole answer, grouped by conversation with its participants, bots filtered."""
    found = pe.user_interactions(
        _all(spark, sf), v.users(spark, sf), v.conversations_dim(spark, sf), v.PERSON, v.AS_OF_US, ignored=["U14"]
    )
    return found.conversations.withColumn("participants", F.array_join("participants", ","))


MENTIONED = f"""SELECT m.id, m.conversation_name, m.ts_us, m.user_name, m.clean_text, {DISPLAY} AS display_user_name FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name
  WHERE m.conversation_type = 'channel' AND m.ts_us > {v.CUTOFF_72H} AND {DISPLAY} <> '{v.OWNER}' AND contains(m.clean_text, '{v.OWNER}')
  AND NOT EXISTS (SELECT 1 FROM messages m2 LEFT JOIN users u2 ON u2.slack_id = m2.user_name WHERE m2.conversation_name = m.conversation_name
    AND m2.ts_us > m.ts_us AND coalesce(u2.name, u2.real_name, m2.user_name) = '{v.OWNER}')"""
WAITING = f"""SELECT m.id, c.name AS conversation_name, m.ts_us, m.user_name, m.clean_text, {DISPLAY} AS display_user_name FROM conversations_dim c
  JOIN messages m ON m.conversation_name = c.name LEFT JOIN users u ON u.slack_id = m.user_name
  WHERE c.type = 'dm' AND m.ts_us = (SELECT max(ts_us) FROM messages m2 WHERE m2.conversation_name = c.name)
  AND {DISPLAY} <> '{v.OWNER}' AND m.ts_us > {v.CUTOFF_72H} AND {v.AS_OF_US} - m.ts_us > 86400000000"""
OPEN_COLUMNS = ["id", "conversation_name", "ts_us", "user_name", "clean_text", "display_user_name"]


def _open(df, spark, sf):
    return with_display_name(df, v.users(spark, sf)).select(*OPEN_COLUMNS)


@query("unanswered_mentions", MENTIONED)
def unanswered_mentions(spark, sf):
    m = _all(spark, sf, threads=False)
    return _open(fu.unanswered_mentions(m, v.users(spark, sf), v.OWNER, v.CUTOFF_72H), spark, sf)


@query("unanswered_dms", WAITING)
def unanswered_dms(spark, sf):
    m = _all(spark, sf, threads=False)
    dms = fu.unanswered_dms(m, v.conversations_dim(spark, sf), v.users(spark, sf), v.OWNER, v.CUTOFF_72H, v.AS_OF_US)
    return _open(dms, spark, sf)


ITEMS = f"""SELECT * FROM (SELECT id, conversation_name, type, location, ts_us, concat(ts_us // 1000000, '.', lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0')) AS ts,
  concat(substr(clean_text, 1, 100), CASE WHEN length(clean_text) > 100 THEN '...' ELSE '' END) AS snippet,
  round(CAST({v.AS_OF_US} - ts_us AS DOUBLE) / 3600000000.0::DOUBLE, 1) AS age_hours, display_user_name AS "user"
  FROM (SELECT *, 'mention' AS type, concat('#', conversation_name) AS location FROM ({MENTIONED}) UNION ALL SELECT *, 'dm', conversation_name FROM ({WAITING}))) WHERE age_hours <= 72"""


def _items(spark, sf):
    return fu.followups(
        _all(spark, sf, threads=False), v.conversations_dim(spark, sf), v.users(spark, sf), OWNER, v.AS_OF_US,
        ordered=False,
    )


@query("followups", ITEMS)
def followups(spark, sf):
    return _items(spark, sf)


@query("followups_summary", f"""SELECT count(*) AS total_before_filter, count(*) FILTER (type = 'mention') AS mentions_before_filter,
  count(*) FILTER (type = 'dm') AS dms_before_filter, CASE WHEN count(*) = 0 THEN 'all_clear' ELSE 'pending' END AS status FROM ({ITEMS})""")
def followups_summary(spark, sf):
    return fu.followups_summary(_items(spark, sf))


CONTEXT_FROM = v.CUTOFF_72H - fu.CONTEXT_DAYS * 86_400_000_000


@query("followup_context", f"""--more
items AS ({ITEMS}), ends AS (SELECT conversation_name AS ec, max(ts_us) AS last_us FROM items GROUP BY conversation_name),
firsts AS (SELECT conversation_name AS ic, ts_us AS next_item_ts_us, min(id) AS next_item_id FROM items GROUP BY conversation_name, ts_us),
ctx AS (SELECT m.conversation_name, m.id, m.ts_us, m.datetime, {DISPLAY} AS "user", m.clean_text AS text
  FROM messages m JOIN ends ON ec = m.conversation_name LEFT JOIN users u ON u.slack_id = m.user_name
  WHERE m.ts_us >= {CONTEXT_FROM} AND m.ts_us < last_us)
SELECT ctx.*, next_item_id, next_item_ts_us FROM ctx ASOF LEFT JOIN firsts ON ic = ctx.conversation_name AND ctx.ts_us < next_item_ts_us""")
def followup_context(spark, sf):
    items = written(_items(spark, sf), "items")
    context = fu.followup_context(_all(spark, sf, threads=False), items, v.users(spark, sf), CONTEXT_FROM)
    return fu.link_context(context, items)


@query("bot_predicate", """SELECT slack_id, coalesce(contains(lower(name), '#00000000') OR contains(lower(name), 'u14') OR contains(lower(name), 'slackbot'), FALSE) AS is_bot FROM users""")
def bot_predicate(spark, sf):
    return v.users(spark, sf).select("slack_id", is_bot(F.col("name"), IGNORED).alias("is_bot"))


BOT = "coalesce(contains(lower({0}), '#00000000') OR contains(lower({0}), 'u14') OR contains(lower({0}), 'slackbot'), FALSE)"


@query("filter_bots", f"""SELECT c.id, m.id AS message_id, m.user_name, c.location, c.type, array_to_string(list_filter(c.participants, lambda p: NOT {BOT.format('p')}), ',') AS participants
  FROM (SELECT *, CASE WHEN id = 'D30' THEN 'DM: Slackbot, (U14)' ELSE name END AS location FROM conversations_dim) c JOIN messages m ON m.conversation_name = c.name
  WHERE NOT {BOT.format('m.user_name')} AND NOT (c.type = 'dm' AND c.id = 'D30')""")
def filter_bots_query(spark, sf):
    dim = v.conversations_dim(spark, sf).withColumn(
        "location", F.when(F.col("id") == "D30", "DM: Slackbot, (U14)").otherwise(F.col("name"))
    )
    m = _all(spark, sf, threads=False, clean=False).selectExpr("id as message_id", "user_name", "conversation_name")
    items = m.join(dim, F.col("name") == F.col("conversation_name")).select(
        "id", "message_id", "user_name", "location", "type", "participants"
    )
    return filter_bots(items, IGNORED).withColumn("participants", F.array_join("participants", ","))
