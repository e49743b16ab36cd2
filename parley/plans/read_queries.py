"""Reads, filters, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import lookup as lk, resolve as rs, search as se
from parley.plans import views as v
from parley.plans.registry import query

LINES = "id, conversation_name, ts_us, user_name, clean_text"


def _m(spark, sf):
    return v.messages(spark, sf, threads=False)


@query("get_conversation", "SELECT id, name, type FROM conversations_dim WHERE id = 'D27' OR name = 'nation_12'")
def get_conversation(spark, sf):
    dim, rooms = v.conversations_dim(spark, sf), v.channels(spark, sf)
    by_id = lk.get_conversation(dim, rooms, "D27")
    return by_id.unionByName(lk.get_conversation(dim, rooms, "nation_12")).select("id", "name", "type")


@query("get_messages", f"""SELECT * FROM (SELECT {LINES} FROM messages WHERE conversation_name = 'nation_7' AND ts_us >= {v.CUTOFF_30D} AND ts_us <= {v.CUTOFF_14D}
  ORDER BY ts_us, id LIMIT 100 OFFSET 5)""")
def get_messages(spark, sf):
    page = lk.get_messages(
        _m(spark, sf), v.channels(spark, sf), "nation_7", limit=100, offset=5,
        since_us=v.CUTOFF_30D, until_us=v.CUTOFF_14D,
    )
    return page.select(*LINES.split(", "))


@query("search_messages", f"""SELECT {LINES} FROM messages WHERE (contains(search_text, 'purchase in #gen') OR contains(clean_text, 'purchase in #gen'))
  AND contains(user_name, 'U1') ORDER BY ts_us DESC, id LIMIT 50""")
def search_messages(spark, sf):
    return lk.search_messages(_m(spark, sf), "Purchase in #GEN", user="U1").select(*LINES.split(", "))


@query("search_kept", f"""SELECT {LINES} FROM messages WHERE (contains(search_text, 'purchase in #gen') OR contains(clean_text, 'purchase in #gen'))
  AND contains(user_name, 'U1') ORDER BY ts_us DESC, id LIMIT 50""")
def search_kept(spark, sf):
    t = v.kept_tables(spark, sf)
    return se.search_kept(t["messages"], t["grams"], "Purchase in #GEN", user="U1").select(*LINES.split(", "))


@query("search_kept_short", f"""SELECT {LINES} FROM messages WHERE (contains(search_text, 'w ') OR contains(clean_text, 'w '))
  AND conversation_name = 'nation_9' ORDER BY ts_us DESC, id LIMIT 20""")
def search_kept_short(spark, sf):
    """A term shorter than the kept runs walks the dates."""
    t = v.kept_tables(spark, sf)
    return se.search_kept(t["messages"], t["grams"], "W ", conversation="nation_9", limit=20).select(*LINES.split(", "))


@query("deep_page", f"""SELECT * FROM (SELECT {LINES} FROM messages WHERE conversation_name = 'nation_7' ORDER BY ts_us, id LIMIT 100 OFFSET 12)""")
def deep_page(spark, sf):
    t = v.kept_tables(spark, sf)
    return lk.deep_page(t["messages"], t["daily"], "nation_7", limit=100, offset=12).select(*LINES.split(", "))


@query("list_conversations_kept", """SELECT c.id, c.name, c.type, count(m.id) AS actual_message_count, min(m.datetime) AS start_date,
  max(m.datetime) AS end_date, max(m.ts_us) AS last_message_ts_us FROM conversations_dim c LEFT JOIN messages m ON m.conversation_name = c.name
  GROUP BY c.id, c.name, c.type""")
def list_conversations_kept(spark, sf):
    dim = v.conversations_dim(spark, sf).drop("participants")
    return lk.list_conversations(dim, v.kept_tables(spark, sf)["daily"], ordered=False)


@query("list_conversations", """SELECT c.id, c.name, c.type, count(m.id) AS actual_message_count, min(m.datetime) AS start_date,
  max(m.datetime) AS end_date, max(m.ts_us) AS last_message_ts_us
  FROM (SELECT id, name, type FROM conversations_dim UNION ALL SELECT concat('p', id), concat('p', name), type FROM prose_dim) c LEFT JOIN messages m ON m.conversation_name = c.name GROUP BY c.id, c.name, c.type""")
def list_conversations(spark, sf):
    quiet = v.prose_dim(spark, sf).selectExpr("concat('p', id) as id", "concat('p', name) as name", "type")
    dim = v.conversations_dim(spark, sf).drop("participants").unionByName(quiet)
    return lk.list_conversations(dim, v.messages(spark, sf, threads=False, clean=False), ordered=False)


@query("db_stats", f"""SELECT (SELECT count(*) FROM conversations_dim) AS total_conversations,
  (SELECT count(*) FROM conversations_dim WHERE type = 'channel') AS channels, (SELECT count(*) FROM conversations_dim WHERE type = 'dm') AS dms,
  (SELECT count(*) FROM users) AS total_users, count(*) AS total_messages, count(*) FILTER (ts_us >= {v.AS_OF_US - 48 * 3600000000 - 86400000000}) AS messages_last_24h,
  count(*) FILTER (is_thread_parent) AS threads, count(*) FILTER (thread_ts_us IS NOT NULL AND NOT is_thread_parent) AS thread_replies,
  count(DISTINCT user_name) AS active_users, min(datetime) AS first_datetime, max(datetime) AS last_datetime FROM messages""")
def db_stats(spark, sf):
    two_days_before = v.AS_OF_US - 48 * 3_600_000_000
    m = v.messages(spark, sf, clean=False)
    return lk.db_stats(v.conversations_dim(spark, sf), v.users(spark, sf), m, two_days_before)


@query("conversations_by_type", "SELECT type, count(*) AS conversations FROM conversations_dim GROUP BY type")
def conversations_by_type(spark, sf):
    return lk.conversations_by_type(v.conversations_dim(spark, sf))


@query("busiest_channels", """SELECT conversation_name, count(*) AS message_count FROM messages WHERE conversation_type = 'channel'
  GROUP BY conversation_name ORDER BY message_count DESC, conversation_name LIMIT 5""")
def busiest_channels(spark, sf):
    return lk.busiest_channels(v.messages(spark, sf, threads=False, clean=False))


@query("user_mappings", "SELECT slack_id, name FROM users UNION ALL SELECT slack_id, name FROM channels")
def user_mappings(spark, sf):
    return rs.user_mappings(v.users(spark, sf)).unionByName(rs.channel_mappings(v.channels(spark, sf)))


@query("mapping_stats", """SELECT count(*) AS total_users, count(*) FILTER (is_bot) AS bot_users, (SELECT count(*) FROM channels) AS total_channels,
  (SELECT count(*) FROM channels WHERE is_private) AS private_channels FROM users""")
def mapping_stats(spark, sf):
    return lk.mapping_stats(v.users(spark, sf), v.channels(spark, sf))


@query("channel_to_id", """SELECT (SELECT slack_id FROM channels WHERE name = 'nation_3') AS exact_id, (SELECT slack_id FROM channels WHERE name = 'nation_4') AS hash_id,
  (SELECT slack_id FROM channels WHERE contains(name, 'tion_1') ORDER BY name LIMIT 1) AS inside_id, CAST(NULL AS VARCHAR) AS no_id""")
def channel_to_id(spark, sf):
    rooms = v.channels(spark, sf)
    asked = {"exact_id": "nation_3", "hash_id": "#nation_4", "inside_id": "tion_1", "no_id": "Nation_3"}
    rows = None
    for alias, wanted in asked.items():
        one = lk.channel_to_id(rooms, wanted).withColumnRenamed("channel_id", alias)
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in asked])


MATCH = "CASE WHEN {n} = '{t}' THEN 100 WHEN starts_with({n}, '{t}') THEN 90 ELSE 80 END"


@query("match_channels", f"""SELECT name, slack_id, CAST({MATCH.format(n='name', t='nation_1')} AS INTEGER) AS score FROM channels WHERE contains(name, 'nation_1')
  ORDER BY score DESC, name, slack_id LIMIT 10""")
def match_channels(spark, sf):
    return lk.match_channels(v.channels(spark, sf), "nation_1")


@query("channel_suggestions", f"""SELECT name, slack_id, CAST({MATCH.format(n='name', t='ation_2')} AS INTEGER) AS score FROM channels WHERE contains(name, 'ation_2')
  ORDER BY score DESC, name, slack_id LIMIT 5""")
def channel_suggestions(spark, sf):
    return lk.channel_suggestions(v.channels(spark, sf), "ation_2")


KNOWN = "lower(coalesce(name, real_name))"


@query("match_users", f"""SELECT coalesce(name, real_name) AS name, slack_id, CAST({MATCH.format(n=KNOWN, t='customer#00000001')} AS INTEGER) AS score FROM users
  WHERE contains({KNOWN}, 'customer#00000001') ORDER BY score DESC, coalesce(name, real_name), slack_id LIMIT 10""")
def match_users(spark, sf):
    return lk.match_users(v.users(spark, sf), "Customer#00000001")


def _gate_sql(term: str, alias: str) -> str:
    low = term.lower()
    return f"""SELECT '{alias}' AS asked, count(*) AS matches, count(*) FILTER (score = 100) AS exact_matches,
      CASE WHEN count(*) = 0 THEN 'not_found' WHEN count(*) > 1 AND count(*) FILTER (score = 100) <> 1 THEN 'ambiguous' ELSE 'ok' END AS status,
      coalesce(string_agg(name, '|' ORDER BY rn) FILTER (rn <= 5), '') AS suggestions
      FROM (SELECT *, row_number() OVER (ORDER BY score DESC, name, slack_id) AS rn FROM (SELECT coalesce(name, real_name) AS name, slack_id,
        {MATCH.format(n=KNOWN, t=low)} AS score FROM users WHERE contains({KNOWN}, '{low}')))"""


@query("user_ambiguity", " UNION ALL ".join(_gate_sql(t, t) for t in ("Customer#000000012", "omer#00000001", "nobody")))
def user_ambiguity(spark, sf):
    people = v.users(spark, sf)
    rows = None
    for term in ("Customer#000000012", "omer#00000001", "nobody"):
        one = lk.user_ambiguity(people, term).select(
            F.lit(term).alias("asked"), "matches", "exact_matches", "status",
            F.array_join("suggestions", "|").alias("suggestions"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("resolve_conversation", """SELECT 'nation_5' AS asked, max(name) AS resolved_name FROM conversations_dim WHERE name = 'nation_5'
  UNION ALL SELECT 'ation_2', (SELECT name FROM conversations_dim WHERE name = (SELECT min(name) FROM channels WHERE contains(name, 'ation_2')))
  UNION ALL SELECT 'D33', 'D33' FROM conversations_dim WHERE id = 'D33' UNION ALL SELECT 'unknown', 'unknown'""")
def resolve_conversation(spark, sf):
    dim, rooms = v.conversations_dim(spark, sf), v.channels(spark, sf)
    rows = None
    for asked in ("nation_5", "ation_2", "D33", "unknown"):
        one = lk.resolve_conversation(dim, rooms, asked)
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("conv_fallback", "SELECT min(conversation_name) AS conversation_name FROM messages WHERE conversation_type = 'channel' AND contains(conversation_name, 'on_1')")
def conv_fallback(spark, sf):
    return lk.conversation_containing(v.messages(spark, sf, threads=False, clean=False), "on_1")


@query("user_by_any_name", """SELECT (SELECT min(slack_id) FROM users WHERE name = 'Customer#000000012' OR display_name = 'Customer#000000012' OR real_name = 'Customer#000000012') AS by_name,
  (SELECT min(slack_id) FROM users WHERE display_name = 'cust16') AS by_display, (SELECT min(slack_id) FROM users WHERE real_name = 'Customer#000000015') AS by_real""")
def user_by_any_name(spark, sf):
    people = v.users(spark, sf)
    asked = {"by_name": "Customer#000000012", "by_display": "cust16", "by_real": "Customer#000000015"}
    rows = None
    for alias, wanted in asked.items():
        one = lk.user_by_any_name(people, wanted).withColumnRenamed("slack_id", alias)
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in asked])
