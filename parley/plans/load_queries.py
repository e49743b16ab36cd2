"""Sources, sinks, normalisation, incremental load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parley import schemas
from parley.functions import message as ms, text as tx, times as tm
from parley.operators import activity, ingest, normalize as nz, resolve as rs
from parley.plans import views as v
from parley.plans.registry import query
from parley.session import scratch_path, written
from parley.sources import landing, tables
from parley.streaming import load

# Expected values of the landed rows, for the oracle.
LANDED = """--more
landed AS (SELECT m.*, u3.name AS n3, ux.name AS nx, ua.name AS na,
    concat(m.ts_us // 1000000, '.', lpad(CAST(m.ts_us % 1000000 AS VARCHAR), 6, '0')) AS ts,
    coalesce(ua.name, m.user_name) AS author,
    CASE WHEN conversation_type = 'channel' THEN coalesce(cc.name, conversation_id) ELSE cd.name END AS cname
  FROM (SELECT * FROM messages WHERE event_id % 97 NOT IN (5, 6, 7)) m
  LEFT JOIN users u3 ON u3.slack_id = 'U3' LEFT JOIN users ux ON ux.slack_id = concat('U', m.event_id % 15)
  LEFT JOIN users ua ON ua.slack_id = m.user_name LEFT JOIN channels cc ON cc.slack_id = m.conversation_id
  LEFT JOIN conversations_dim cd ON cd.id = m.conversation_id),
shown AS (SELECT *, concat(cname, ':', ts) AS mid,
    CASE WHEN event_id % 17 = 0 THEN concat('hi :wave:@', coalesce(nx, concat('U', event_id % 15)))
      WHEN event_id % 17 = 1 THEN concat('[File: f', event_id, '.pdf] Plan') WHEN event_id % 17 = 2 THEN '' ELSE text END AS mtext,
    CASE WHEN event_id % 17 = 0 THEN concat('hi :wave:@', coalesce(nx, concat('U', event_id % 15)))
      WHEN event_id % 17 = 1 THEN concat('[File: f', event_id, '.pdf] Plan') WHEN event_id % 17 = 2 THEN '' ELSE clean_text END AS mclean,
    event_id % 17 IN (1, 4) AS with_files, event_id % 13 = 2 AS with_links FROM landed)
"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return landing.read_messages(spark, v.landing_dir(spark, sf))


def _book(spark: SparkSession, sf: str) -> DataFrame:
    return rs.name_book(v.users(spark, sf), v.channels(spark, sf))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = nz.split_bad_rows(_raw(spark, sf))
    return nz.with_conversation_name(good, v.conversations_dim(spark, sf), _book(spark, sf))


# --- sources, sinks, write semantics -------------------------------------------------


@query("src_messages", LANDED + """SELECT conversation_id, CASE WHEN event_id % 97 = 5 THEN NULL WHEN event_id % 97 = 6 THEN 'abc'
    ELSE concat(ts_us // 1000000, '.', lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0')) END AS ts,
  user_name AS "user", CAST(CASE WHEN event_id % 17 IN (1, 4) THEN 3 ELSE 0 END AS BIGINT) AS files
  FROM messages WHERE event_id % 97 <> 7 UNION ALL SELECT NULL, NULL, NULL, 0 FROM messages WHERE event_id % 97 = 7""")
def src_messages(spark, sf):
    raw = _raw(spark, sf)
    files = F.coalesce(F.when(F.size("files") >= 0, F.size("files")), F.lit(0)).cast("bigint")
    return raw.select("conversation_id", "ts", "user", files.alias("files"))


@query("dim_users", """SELECT concat('U', c_custkey) AS slack_id,
  CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 4 <> 0 THEN concat('Real ', c_custkey) ELSE concat('handle', c_custkey) END AS name,
  concat('handle', c_custkey) AS display_name, CASE WHEN c_custkey % 4 <> 0 THEN concat('Real ', c_custkey) END AS real_name,
  CASE WHEN c_custkey % 2 = 0 THEN concat(c_custkey, '@x.test') END AS email, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 37 = 0 END, FALSE) AS is_bot
  FROM customer""")
def dim_users(spark, sf):
    raw = v.load(spark, sf, "customer").selectExpr(
        """to_json(named_struct('id', concat('U', c_custkey), 'name', concat('handle', c_custkey),
            'real_name', case when c_custkey % 4 <> 0 then concat('Real ', c_custkey) else '' end,
            'is_bot', case when c_custkey % 5 > 0 then c_custkey % 37 = 0 end,
            'profile', named_struct('display_name', case when c_custkey % 3 = 0 then c_name else '' end,
               'email', case when c_custkey % 2 = 0 then concat(c_custkey, '@x.test') end))) as value"""
    )
    parsed = raw.select(F.from_json("value", landing.RAW_USER).alias("r")).select("r.*")
    return landing.user_dim(parsed).drop("created_at", "updated_at")


@query("dim_channels", """SELECT concat('C', n_nationkey) AS slack_id, lower(n_name) AS name, concat('#', lower(n_name)) AS display_name,
  CASE WHEN n_nationkey % 2 = 0 THEN concat('about ', n_name) END AS purpose, CASE WHEN n_nationkey % 3 = 0 THEN r_name END AS topic,
  n_nationkey % 4 = 0 AS is_private, CAST(n_nationkey * 3 AS BIGINT) AS member_count FROM nation JOIN region ON n_regionkey = r_regionkey""")
def dim_channels(spark, sf):
    both = v.load(spark, sf, "nation").join(v.load(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    raw = both.selectExpr(
        """to_json(named_struct('id', concat('C', n_nationkey), 'name', lower(n_name),
            'purpose', named_struct('value', case when n_nationkey % 2 = 0 then concat('about ', n_name) else '' end),
            'topic', case when n_nationkey % 3 = 0 then named_struct('value', r_name) end,
            'is_private', n_nationkey % 4 = 0, 'num_members', n_nationkey * 3)) as value"""
    )
    parsed = raw.select(F.from_json("value", landing.RAW_CHANNEL).alias("r")).select("r.*")
    return landing.channel_dim(parsed).drop("created_at", "updated_at")


@query("dm_participants", """SELECT DISTINCT concat('D', conv_id) AS id, CASE conv_id % 4 WHEN 0 THEN concat('U', conv_id % 15)
  WHEN 1 THEN concat('U', conv_id % 15, ',U', (conv_id + 1) % 15) ELSE '' END AS participants FROM conversations""")
def dm_participants(spark, sf):
    raw = v.load(spark, sf, "conversations").select("conv_id").distinct().selectExpr(
        """to_json(named_struct('id', concat('D', conv_id), 'is_im', conv_id % 4 in (0, 2), 'is_mpim', conv_id % 4 in (1, 3),
            'user', case when conv_id % 4 = 0 then concat('U', conv_id % 15) end,
            'members', case when conv_id % 4 = 1 then array(concat('U', conv_id % 15), concat('U', (conv_id + 1) % 15)) end)) as value"""
    )
    parsed = raw.select(F.from_json("value", landing.RAW_DM).alias("r")).select("r.*")
    return landing.dm_participants(parsed).select("id", F.array_join("participants", ",").alias("participants"))


@query("upsert_latest", """SELECT key, seq, text FROM (SELECT user_name AS key, event_id AS seq, text,
  row_number() OVER (PARTITION BY user_name ORDER BY event_id DESC) AS rn FROM messages) WHERE rn = 1""")
def upsert_latest(spark, sf):
    rows = v.messages(spark, sf, threads=False, clean=False).selectExpr("user_name as key", "event_id as seq", "text")
    half = rows.agg(F.expr("percentile_approx(seq, 0.5)").alias("mid"))
    mid = half.first()["mid"]
    old, new = rows.where(F.col("seq") <= mid), rows.where(F.col("seq") > mid)
    return tables.upsert(
        tables.upsert(old.limit(0), old, ["key"], [F.desc("seq")]), new, ["key"], [F.desc("seq")]
    )


@query("upsert_conversations", """--more
seen AS (SELECT id, type, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 4 = 3 THEN name END AS given, participants FROM broken_dms),
who AS (SELECT s.id, p.i, coalesce(u.name, p.w) AS person FROM (SELECT id, unnest(participants) AS w, generate_subscripts(participants, 1) AS i FROM seen) p
  JOIN seen s ON s.id = p.id LEFT JOIN users u ON u.slack_id = p.w),
lists AS (SELECT id, string_agg(person, ',' ORDER BY i) AS people, list(person ORDER BY person) AS sorted FROM who GROUP BY id)
SELECT s.id, coalesce(s.given, CASE WHEN s.type = 'channel' THEN s.id WHEN l.id IS NULL THEN concat('DM: ', s.id)
    WHEN len(sorted) = 1 THEN sorted[1] WHEN len(sorted) = 2 THEN concat(sorted[1], ' & ', sorted[2])
    ELSE concat(sorted[1], ', ', sorted[2], ' + ', len(sorted) - 2, ' others') END) AS name, s.type, l.people AS participants
FROM seen s LEFT JOIN lists l ON l.id = s.id""")
def upsert_conversations(spark, sf):
    dms = v.broken_dms(spark, sf)
    late_name = F.when(F.substring("id", 2, 20).cast("bigint") % 4 == 3, F.col("name"))
    first = dms.select("id", late_name.alias("name"), "type", "participants", F.lit(1).alias("seq"))
    # A later row that knows neither name nor participants must not wipe them out.
    again = first.withColumn("name", F.lit(None).cast("string")).withColumn(
        "participants", F.lit(None).cast("array<string>")
    ).withColumn("seq", F.lit(2))
    empty = dms.limit(0).selectExpr(
        "id", "name", "type", "participants", "cast(null as timestamp) as created_at",
        "cast(null as timestamp) as updated_at", "0L as message_count", "cast(null as bigint) as latest_message_ts_us",
    )
    done = ingest.upsert_conversations(empty, first, _book(spark, sf), F.expr("timestamp_micros(0)"))
    done = ingest.upsert_conversations(done, again, _book(spark, sf), F.expr("timestamp_micros(1)"))
    return done.select("id", "name", "type", F.array_join("participants", ",").alias("participants"))


@query("conversation_stats", """SELECT c.id, c.name, count(m.id) AS message_count, max(m.ts_us) AS latest_message_ts_us
  FROM conversations_dim c LEFT JOIN messages m ON m.conversation_name = c.name GROUP BY c.id, c.name""")
def conversation_stats(spark, sf):
    dim = v.conversations_dim(spark, sf).selectExpr("id", "name", "0L as message_count", "0L as latest_message_ts_us")
    return ingest.conversation_stats(dim, v.messages(spark, sf, threads=False, clean=False))


@query("infer_conv_type", """SELECT id, CASE WHEN event_id % 3 = 0 THEN conversation_type WHEN conversation_id LIKE 'D%' THEN 'dm'
  ELSE 'channel' END AS conversation_type FROM messages""")
def infer_conv_type(spark, sf):
    m = v.messages(spark, sf, threads=False, clean=False)
    landed = F.when(F.col("event_id") % 3 == 0, F.col("conversation_type"))
    typed = ingest.infer_conversation_type(m.withColumn("conversation_type", landed))
    return typed.select("id", "conversation_type")


@query("sink_roundtrip", "SELECT id, conversation_type, ts_us, clean_text FROM messages")
def sink_roundtrip(spark, sf):
    """Through the writers of tables, JSON and text, each reading what the one before wrote."""
    path = scratch_path(spark, "outputs")
    kind = T.StructType([T.StructField(n, k) for n, k in (
        ("id", T.StringType()), ("conversation_type", T.StringType()), ("ts_us", T.LongType()), ("clean_text", T.StringType()),
    )])
    filed = T.StructType([*kind.fields, T.StructField("dt", T.StringType())])
    rows = tables.with_date(v.messages(spark, sf, threads=False).select(*kind.names))
    tables.upsert_into(spark, f"{path}/table", rows, filed, ["id"], [F.desc("ts_us")], tables.MESSAGE_PARTITIONS)
    tables.write_json(tables.read_table(spark, f"{path}/table", filed).select(*kind.names), f"{path}/json")
    tables.write_text(spark.read.schema(kind).json(f"{path}/json").select(F.to_json(F.struct(*kind.names)).alias("line")), "line", f"{path}/text")
    return spark.read.text(f"{path}/text").select(F.from_json("value", kind).alias("r")).select("r.*")


# --- normalisation -------------------------------------------------------------------


@query("norm_text", LANDED + "SELECT mid AS id, mtext AS text FROM shown")
def norm_text(spark, sf):
    return _normalized(spark, sf).select("id", "text")


@query("rich_text", LANDED + "SELECT mid AS id, mtext AS rich_text FROM shown WHERE event_id % 17 = 0")
def rich_text(spark, sf):
    raw = _named(spark, sf).where(F.size("blocks") > 0)
    named = rs.attach_names(raw, tx.rich_text_user_ids(F.col("blocks")), _book(spark, sf))
    return named.select(
        ms.message_id(F.col("conversation_name"), F.col("ts")).alias("id"),
        tx.rich_text(F.col("blocks"), F.col("names")).alias("rich_text"),
    )


def _normalized(spark, sf):
    return nz.normalize(_named(spark, sf), _book(spark, sf))


def _rewritten(spark, sf, with_text, book, ids):
    m = v.messages(spark, sf, threads=False, clean=False)
    named = rs.attach_names(m, ids(F.col("text")), book)
    return named.select("id", with_text(F.col("text"), F.col("names")).alias("clean_text"))


USER_SQL = "concat('@', coalesce(u.name, concat('U', (user_id * 7 + event_id) % 15)))"


@query("resolve_mentions", f"""SELECT m.id, concat({USER_SQL}, substr(text, strpos(text, '>') + 1)) AS clean_text
  FROM messages m LEFT JOIN users u ON u.slack_id = concat('U', (m.user_id * 7 + m.event_id) % 15)""")
def resolve_mentions(spark, sf):
    return _rewritten(spark, sf, tx.resolve_user_mentions, rs.name_book(v.users(spark, sf)), tx.user_mention_ids)


@query("resolve_channels", """SELECT m.id, concat(substr(text, 1, strpos(text, '<#') - 1), '#',
    CASE WHEN event_id % 2 = 0 THEN 'general' ELSE coalesce(c.name, concat('C', event_id % 30)) END,
    substr(substr(text, strpos(text, '<#')), strpos(substr(text, strpos(text, '<#')), '>') + 1)) AS clean_text
  FROM messages m LEFT JOIN channels c ON c.slack_id = concat('C', m.event_id % 30)""")
def resolve_channels(spark, sf):
    return _rewritten(spark, sf, tx.resolve_channel_mentions, rs.name_book(v.channels(spark, sf)), tx.channel_mention_ids)


@query("special_mentions", "SELECT id, replace(text, '<!here>', '@here') AS clean_text FROM messages")
def special_mentions(spark, sf):
    m = v.messages(spark, sf, threads=False, clean=False)
    return m.select("id", tx.resolve_special_mentions(F.col("text")).alias("clean_text"))


@query("mentioned_users", """SELECT m.id, u.name AS mentions_users FROM messages m
  LEFT JOIN users u ON u.slack_id = concat('U', (m.user_id * 7 + m.event_id) % 15)""")
def mentioned_users(spark, sf):
    m = v.messages(spark, sf, threads=False, clean=False)
    done = rs.rewrite_mentions(m, _book(spark, sf))
    return done.select("id", F.array_join("mentions_users", ",").alias("mentions_users"))


@query("message_type", """SELECT id, CASE WHEN subtype = 'file_share' THEN 'file_share' WHEN subtype = 'bot_message' THEN 'bot'
  WHEN subtype IS NOT NULL THEN 'system' WHEN bot_id IS NOT NULL THEN 'bot' WHEN event_id % 17 IN (1, 4) OR event_id % 13 = 2 THEN 'file_share'
  ELSE 'message' END AS message_type FROM messages""")
def message_type(spark, sf):
    m = v.messages(spark, sf, threads=False, clean=False)
    files = F.when((F.col("event_id") % 17).isin(1, 4), F.array(F.lit("{}")))
    links = F.when(F.col("event_id") % 13 == 2, F.array(F.lit("{}")))
    kind = ms.message_type(F.col("subtype"), F.col("bot_id"), F.lit(None).cast("string"), files, links)
    return m.select("id", kind.alias("message_type"))


@query("content_flags", LANDED + """SELECT mid AS id, with_files OR with_links AS has_attachments, event_id % 7 = 0 AS has_reactions,
  event_id % 19 IN (0, 1) AS is_edited FROM shown""")
def content_flags(spark, sf):
    raw = _named(spark, sf)
    return raw.select(
        ms.message_id(F.col("conversation_name"), F.col("ts")).alias("id"),
        ms.has_attachments(F.col("files"), F.col("attachments")).alias("has_attachments"),
        ms.any_items(F.col("reactions")).alias("has_reactions"),
        ms.is_edited(F.col("edited")).alias("is_edited"),
    )


@query("thread_flags", "SELECT id, is_thread_parent, reply_count FROM messages")
def thread_flags(spark, sf):
    m = v.messages(spark, sf, clean=False)
    parent = ms.is_thread_parent(tm.ts_text(F.col("thread_ts_us")), tm.ts_text(F.col("ts_us")))
    return m.select("id", parent.alias("is_thread_parent"), ms.reply_count(parent, F.col("reply_count")).alias("reply_count"))


@query("edited_ts", LANDED + "SELECT mid AS id, CASE WHEN event_id % 19 = 0 THEN ts_us + 60000000 END AS edited_ts_us FROM shown")
def edited_ts(spark, sf):
    raw = _named(spark, sf)
    return raw.select(
        ms.message_id(F.col("conversation_name"), F.col("ts")).alias("id"),
        ms.edited_ts_us(F.col("edited")).alias("edited_ts_us"),
    )


@query("word_count", """SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'),
  lambda w: w <> '')) AS BIGINT) AS word_count FROM documents""")
def word_count(spark, sf):
    return v.load(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("word_count"))


@query("contains_links", "SELECT doc_id, regexp_matches(text, 'https?://') AS contains_links FROM documents")
def contains_links(spark, sf):
    return v.load(spark, sf, "documents").select("doc_id", tx.contains_links(F.col("text")).alias("contains_links"))


@query("search_text", """SELECT id, concat_ws(' ', nullif(lower(clean_text), ''), nullif(lower(user_name), ''), nullif(lower(conversation_name), '')) AS search_text
  FROM prose""")
def search_text(spark, sf):
    cols = [F.col(c) for c in ("clean_text", "user_name", "conversation_name")]
    return v.prose(spark, sf).select("id", tx.search_text(*cols).alias("search_text"))


@query("conversation_name", """--more
who AS (SELECT d.id, coalesce(u.name, d.w) AS person FROM (SELECT id, unnest(participants) AS w FROM broken_dms) d LEFT JOIN users u ON u.slack_id = d.w),
lists AS (SELECT id, list(person ORDER BY person) AS p FROM who GROUP BY id)
SELECT b.id, CASE WHEN type = 'channel' THEN b.id WHEN l.id IS NULL THEN concat('DM: ', b.id) WHEN len(p) = 1 THEN p[1]
  WHEN len(p) = 2 THEN concat(p[1], ' & ', p[2]) ELSE concat(p[1], ', ', p[2], ' + ', len(p) - 2, ' others') END AS name
FROM broken_dms b LEFT JOIN lists l ON l.id = b.id
UNION ALL SELECT concat('C', k), coalesce((SELECT name FROM channels WHERE slack_id = concat('C', k)), concat('C', k)) FROM (SELECT DISTINCT event_id % 40 AS k FROM events)""")
def conversation_name(spark, sf):
    dms = v.broken_dms(spark, sf).select("id", "type", "participants")
    rooms = v.load(spark, sf, "events").selectExpr("event_id % 40 as k").distinct().selectExpr(
        "concat('C', k) as id", "'channel' as type", "cast(null as array<string>) as participants"
    )
    return rs.name_conversations(dms.unionByName(rooms), _book(spark, sf)).select("id", "name")


@query("resolve_users", "SELECT m.id, coalesce(u.name, m.user_name) AS resolved FROM messages m LEFT JOIN users u ON u.slack_id = m.user_name")
def resolve_users(spark, sf):
    m = v.messages(spark, sf, threads=False, clean=False).select("id", "user_name")
    return rs.resolve_ids(m, rs.name_book(v.users(spark, sf)), "user_name", "resolved").select("id", "resolved")


@query("message_id", """SELECT event_id, concat(conversation_name, ':', ts_us // 1000000, '.', lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0')) AS message_id FROM messages""")
def message_id(spark, sf):
    m = v.messages(spark, sf, threads=False, clean=False)
    return m.select("event_id", ms.message_id(F.col("conversation_name"), tm.ts_text(F.col("ts_us"))).alias("message_id"))


@query("format_datetime", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime FROM events")
def format_datetime(spark, sf):
    e = v.load(spark, sf, "events")
    return e.select("event_id", tm.datetime_text(tm.ntz_us(F.col("ts"))).alias("datetime"))


@query("attachments_files", LANDED + """SELECT concat(mid, ':file:0') AS id, mid AS message_id, concat('f', event_id, '.pdf') AS file_name, 'pdf' AS file_type,
    event_id * 1000 AS file_size, 'https://f.test/a' AS url_private, 'Plan' AS title, FALSE AS is_image, FALSE AS is_video, TRUE AS is_document FROM shown WHERE with_files
  UNION ALL SELECT concat(mid, ':file:2'), mid, 'pic.png', 'png', event_id, NULL, NULL, TRUE, FALSE, FALSE FROM shown WHERE with_files""")
def attachments_files(spark, sf):
    return nz.attachments_from_files(_named(spark, sf))


@query("attachments_links", LANDED + """SELECT concat(mid, ':attachment:0') AS id, mid AS message_id, concat('link ', event_id) AS file_name, 'link' AS file_type,
  'https://l.test/b' AS url_private, concat('link ', event_id) AS title, FALSE AS is_image, FALSE AS is_video, FALSE AS is_document FROM shown WHERE with_links""")
def attachments_links(spark, sf):
    return nz.attachments_from_links(_named(spark, sf)).drop("file_size")


@query("reactions", LANDED + """SELECT DISTINCT message_id, emoji, emoji_name, user_name FROM (
  SELECT mid AS message_id, ':tada:' AS emoji, 'tada' AS emoji_name, author AS user_name FROM shown WHERE event_id % 7 = 0
  UNION ALL SELECT mid, ':tada:', 'tada', coalesce(n3, 'U3') FROM shown WHERE event_id % 7 = 0
  UNION ALL SELECT mid, ':eyes:', 'eyes', coalesce(nx, concat('U', event_id % 15)) FROM shown WHERE event_id % 7 = 0)""")
def reactions(spark, sf):
    return nz.reactions(_named(spark, sf), rs.name_book(v.users(spark, sf)), v.AS_OF_US).drop("ts_us")


@query("quarantine", """SELECT CASE event_id % 97 WHEN 5 THEN 'missing ts' WHEN 6 THEN 'ts is not a number' ELSE 'broken json' END AS reason,
  CASE WHEN event_id % 97 <> 7 THEN user_name END AS "user" FROM messages WHERE event_id % 97 IN (5, 6, 7)""")
def quarantine(spark, sf):
    _, bad = nz.split_bad_rows(_raw(spark, sf))
    return bad.select("reason", "user")


NORMALIZED = """SELECT mid AS id, cname AS conversation_name, conversation_type, ts_us, datetime, author AS user_name, mtext AS text, mclean AS clean_text,
    CASE WHEN subtype = 'file_share' THEN 'file_share' WHEN subtype = 'bot_message' THEN 'bot' WHEN subtype IS NOT NULL THEN 'system'
      WHEN bot_id IS NOT NULL THEN 'bot' WHEN with_files OR with_links THEN 'file_share' ELSE 'message' END AS message_type,
    subtype, thread_ts_us, is_thread_parent, reply_count, with_files OR with_links AS has_attachments, event_id % 7 = 0 AS has_reactions,
    event_id % 19 IN (0, 1) AS is_edited, CASE WHEN event_id % 19 = 0 THEN ts_us + 60000000 END AS edited_ts_us,
    CASE WHEN event_id % 17 > 2 THEN (SELECT name FROM users WHERE slack_id = concat('U', (user_id * 7 + event_id) % 15)) END AS mentions_users,
    CASE WHEN event_id % 17 > 2 THEN event_id % 3 = 0 ELSE FALSE END AS contains_links,
    CAST(CASE WHEN mclean = '' THEN 0 ELSE len(string_split(mclean, ' ')) END AS BIGINT) AS word_count,
    concat_ws(' ', nullif(lower(mclean), ''), lower(author), lower(cname)) AS search_text
  FROM shown"""


def _flat(messages: DataFrame) -> DataFrame:
    return messages.drop("author_name", "dt").withColumn("mentions_users", F.array_join("mentions_users", ","))


@query("normalize", LANDED + NORMALIZED)
def normalize(spark, sf):
    return _flat(_normalized(spark, sf))


# --- incremental load ----------------------------------------------------------------


def _landed_times(spark, sf):
    return v.messages(spark, sf, threads=False, clean=False).select("id", "conversation_id", "ts_us")


def _marks(spark, sf):
    """Marks of some conversations, at the middle of January."""
    k = v.load(spark, sf, "events").selectExpr("event_id % 40 as k").distinct()
    return k.where("k % 3 <> 0").selectExpr(
        "case when k < 25 then concat('C', k) else concat('D', k) end as conversation_id",
        "1705000000000000 + k * 10000000000 as last_ts_us",
    )


MARKS = """--more
marks AS (SELECT DISTINCT CASE WHEN k < 25 THEN concat('C', k) ELSE concat('D', k) END AS conversation_id, 1705000000000000 + k * 10000000000 AS last_ts_us FROM ev WHERE k % 3 <> 0)
"""


@query("hwm_read", MARKS + "SELECT c.id AS conversation_id, coalesce(s.last_ts_us, 0) AS last_ts_us FROM conversations_dim c LEFT JOIN marks s ON s.conversation_id = c.id")
def hwm_read(spark, sf):
    return ingest.read_marks(v.conversations_dim(spark, sf), _marks(spark, sf))


@query("hwm_update", MARKS + """SELECT conversation_id, max(last_ts_us) AS last_ts_us FROM (SELECT * FROM marks
  UNION ALL SELECT conversation_id, ts_us FROM messages) GROUP BY conversation_id""")
def hwm_update(spark, sf):
    loaded = v.messages(spark, sf, threads=False, clean=False)
    return ingest.update_marks(_marks(spark, sf), loaded)


@query("incr_filter", MARKS + f"""SELECT m.id, m.conversation_id, m.ts_us FROM messages m LEFT JOIN marks s ON s.conversation_id = m.conversation_id
  WHERE m.ts_us > greatest({v.CUTOFF_14D}, coalesce(s.last_ts_us, 0))""")
def incr_filter(spark, sf):
    return ingest.newer_than_marks(_landed_times(spark, sf), _marks(spark, sf), v.AS_OF_US, sync_days=14)


@query("full_refresh", "SELECT id, conversation_id, ts_us FROM messages")
def full_refresh(spark, sf):
    cleared = ingest.cleared_marks(_marks(spark, sf))
    return ingest.newer_than_marks(_landed_times(spark, sf), cleared, v.AS_OF_US, sync_days=0)


@query("dims_guard", "SELECT (SELECT count(*) FROM users) = 0 OR (SELECT count(*) FROM channels) = 0 AS load_needed, count(*) AS users FROM users")
def dims_guard(spark, sf):
    people = v.users(spark, sf)
    needed = ingest.dims_missing(people, v.channels(spark, sf))
    return people.agg(F.lit(needed).alias("load_needed"), F.count(F.lit(1)).alias("users"))


@query("thread_expand", """--more
hist AS (SELECT id, conversation_id, conversation_type, ts_us, thread_ts_us FROM messages WHERE thread_ts_us IS NULL OR is_thread_parent),
thr AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, thread_ts_us ORDER BY ts_us, id) AS rn FROM
  (SELECT id, conversation_id, conversation_type, ts_us, thread_ts_us FROM messages WHERE thread_ts_us IS NOT NULL))
SELECT * FROM hist UNION ALL SELECT id, conversation_id, conversation_type, ts_us, thread_ts_us FROM thr t WHERE rn > 1 AND conversation_type = 'channel'
  AND EXISTS (SELECT 1 FROM hist h WHERE h.conversation_id = t.conversation_id AND h.ts_us = h.thread_ts_us AND h.ts_us = t.thread_ts_us)""")
def thread_expand(spark, sf):
    m = v.messages(spark, sf, clean=False).select("id", "conversation_id", "conversation_type", "ts_us", "thread_ts_us", "is_thread_parent")
    m = written(m, "thread-messages")
    history = m.where("thread_ts_us is null or is_thread_parent").drop("is_thread_parent")
    return ingest.expand_threads(history, m.where("thread_ts_us is not null"))


@query("thread_topk", """SELECT id, conversation_name, ts_us, reply_count FROM (SELECT *, row_number() OVER (PARTITION BY conversation_name ORDER BY ts_us DESC, id) AS rn
  FROM messages WHERE is_thread_parent AND reply_count > 0) WHERE rn <= 10""")
def thread_topk(spark, sf):
    m = v.messages(spark, sf, clean=False)
    return ingest.threads_to_backfill(m, 10).select("id", "conversation_name", "ts_us", "reply_count")


@query("thread_backfill", "SELECT id, conversation_name, ts_us, reply_count FROM messages WHERE is_thread_parent AND reply_count > 0")
def thread_backfill(spark, sf):
    m = v.messages(spark, sf, clean=False)
    return ingest.threads_to_backfill(m).select("id", "conversation_name", "ts_us", "reply_count")


@query("stream_ingest", LANDED + NORMALIZED)
def stream_ingest(spark, sf):
    """Lands the lines in two batches that overlap, streams them into tables, returns the messages."""
    root = scratch_path(spark, "stream")
    lines = v.landed_lines(spark, sf)
    late = F.col("event_id") % 2 == 1
    store = load.Store(f"{root}/tables")
    dims = (v.conversations_dim(spark, sf), v.users(spark, sf), v.channels(spark, sf))
    for part in (lines.where(~late), lines.where(late | (F.col("event_id") % 10 == 0))):
        part.select("value").write.mode("append").text(f"{root}/landing")
        load.stream_load(spark, f"{root}/landing", store, *dims, v.AS_OF_US).awaitTermination()
    return _flat(load.read_messages_table(spark, store))


# --- a store with its own dimensions ----------------------------------------------------

FIRST_AT, SECOND_AT = v.AS_OF_US - 2 * tm.DAY_US, v.AS_OF_US - tm.DAY_US
_stores: dict[tuple[str, str], load.Store] = {}


def _land_dims(spark: SparkSession, sf: str, root: str, renamed: bool) -> None:
    """Users, channels and direct messages as the service lists them; in the second wave some users have new names."""
    shown = "case when c_custkey % 3 = 0 then c_name else '' end"
    if renamed:
        shown = "case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then concat('New ', c_name) else '' end"
    people = v.load(spark, sf, "customer").selectExpr(
        f"""to_json(named_struct('id', concat('U', c_custkey), 'name', concat('handle', c_custkey),
            'real_name', case when c_custkey % 4 <> 0 then concat('Real ', c_custkey) else '' end,
            'is_bot', c_custkey % 37 = 0, 'profile', named_struct('display_name', {shown}))) as value"""
    )
    rooms = v.load(spark, sf, "nation").selectExpr(
        """to_json(named_struct('id', concat('C', n_nationkey), 'name', lower(n_name), 'is_private', n_nationkey % 4 = 0)) as value"""
    )
    direct = v.conversations_dim(spark, sf).where("type = 'dm'").selectExpr(
        """to_json(named_struct('id', id, 'is_im', coalesce(size(participants) < 2, true), 'is_mpim', coalesce(size(participants) > 1, false),
            'user', case when size(participants) = 1 then participants[0] end,
            'members', case when size(participants) > 1 then participants end)) as value"""
    )
    for name, rows in (("users", people), ("channels", rooms), ("dms", direct)):
        rows.write.mode("append").text(f"{root}/{name}")


def loaded_store(spark: SparkSession, sf: str) -> load.Store:
    """Dimensions loaded twice, with renames between, then the landed messages streamed in; once per application."""
    known = (spark.sparkContext.applicationId, sf)
    if known not in _stores:
        root = scratch_path(spark, "store")
        landed = load.LandedDims(*[f"{root}/{name}" for name in ("users", "channels", "dms")])
        store = load.Store(f"{root}/tables")
        _land_dims(spark, sf, root, renamed=False)
        load.load_dimensions(
            spark, store, landing.read_users(spark, landed.users), landing.read_channels(spark, landed.channels),
            landing.read_dms(spark, landed.dms), FIRST_AT, only_if_missing=True,
        )
        _land_dims(spark, sf, root, renamed=True)
        nobody = spark.createDataFrame([], schemas.CONVERSATIONS)
        load.stream_load(
            spark, v.landing_dir(spark, sf), store, nobody, v.users(spark, sf), v.channels(spark, sf), SECOND_AT,
            landed_dims=landed,
        ).awaitTermination()
        _stores[known] = store
    return _stores[known]


STORED = f"""--more
su AS (SELECT concat('U', c_custkey) AS slack_id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN concat('New ', c_name)
    WHEN c_custkey % 4 <> 0 THEN concat('Real ', c_custkey) ELSE concat('handle', c_custkey) END AS name,
    CASE WHEN c_custkey % 3 = 1 THEN {SECOND_AT} ELSE {FIRST_AT} END AS updated_us FROM customer),
who AS (SELECT d.id, d.i, coalesce(su.name, d.w) AS person FROM (SELECT id, unnest(participants) AS w, generate_subscripts(participants, 1) AS i
  FROM conversations_dim WHERE type = 'dm') d LEFT JOIN su ON su.slack_id = d.w),
lists AS (SELECT id, string_agg(person, ',' ORDER BY i) AS people, list(person ORDER BY person) AS p FROM who GROUP BY id),
rooms AS (SELECT concat('C', n_nationkey) AS id, lower(n_name) AS name, 'channel' AS type, CAST(NULL AS VARCHAR) AS people FROM nation UNION ALL
  SELECT d.id, CASE WHEN l.id IS NULL THEN concat('DM: ', d.id) WHEN len(p) = 1 THEN p[1] WHEN len(p) = 2 THEN concat(p[1], ' & ', p[2])
    ELSE concat(p[1], ', ', p[2], ' + ', len(p) - 2, ' others') END, 'dm', people FROM conversations_dim d LEFT JOIN lists l ON l.id = d.id WHERE d.type = 'dm'),
sent AS (SELECT r.name, m.ts_us, m.datetime FROM messages m JOIN rooms r ON r.id = m.conversation_id WHERE m.event_id % 97 NOT IN (5, 6, 7)),
counted AS (SELECT name, count(*) AS n, min(datetime) AS first_date, max(datetime) AS last_date, max(ts_us) AS last_us FROM sent GROUP BY name)
"""


def _us(column: str):
    return F.unix_micros(column).alias(column.replace("_at", "_us"))


@query("stored_conversations", STORED + f"""SELECT id, r.name, type, people AS participants, {FIRST_AT} AS created_us, {SECOND_AT} AS updated_us,
  coalesce(n, 0) AS message_count, last_us AS latest_message_ts_us FROM rooms r LEFT JOIN counted c ON c.name = r.name""")
def stored_conversations(spark, sf):
    rows = load.read_conversations(spark, loaded_store(spark, sf))
    return rows.select(
        "id", "name", "type", F.array_join("participants", ",").alias("participants"), _us("created_at"), _us("updated_at"),
        "message_count", "latest_message_ts_us",
    )


@query("stored_users", STORED + f"SELECT slack_id, name, {FIRST_AT} AS created_us, updated_us FROM su")
def stored_users(spark, sf):
    people, _ = load.read_dims(spark, loaded_store(spark, sf))
    return people.select("slack_id", "name", _us("created_at"), _us("updated_at"))


@query("stored_channels", STORED + f"""SELECT id, r.name, {FIRST_AT} AS created_us, {SECOND_AT} AS updated_us, coalesce(n, 0) AS message_count,
  first_date AS start_date, last_date AS end_date, last_us AS last_activity_us FROM rooms r LEFT JOIN counted c ON c.name = r.name WHERE type = 'channel'""")
def stored_channels(spark, sf):
    store = loaded_store(spark, sf)
    _, rooms = load.read_dims(spark, store)
    rows = activity.list_channels(load.read_conversations(spark, store), rooms, load.read_daily(spark, store), ordered=False)
    return rows.select(
        "id", "name", _us("created_at"), _us("updated_at"), "message_count", "start_date", "end_date", "last_activity_us"
    )


@query("stored_dms", STORED + f"""SELECT id, r.name, array_to_string(list_filter(string_split(people, ','), lambda p: NOT contains(lower(p), 'slackbot')), ',') AS participants,
  {FIRST_AT} AS created_us, {SECOND_AT} AS updated_us, coalesce(n, 0) AS message_count, last_us AS last_activity_us
  FROM rooms r LEFT JOIN counted c ON c.name = r.name WHERE type = 'dm' AND NOT contains(lower(r.name), 'slackbot')""")
def stored_dms(spark, sf):
    store = loaded_store(spark, sf)
    rows = activity.list_dms(load.read_conversations(spark, store), load.read_daily(spark, store), ordered=False)
    return rows.select(
        "id", "name", F.array_join("participants", ",").alias("participants"), _us("created_at"), _us("updated_at"),
        "message_count", "last_activity_us",
    )


#: The messages of the store with the names it knows, for the tables beside them.
SENT = STORED.rstrip() + """,
filed AS (SELECT m.event_id, m.user_id, m.conversation_type, m.ts_us, r.name AS cname, strftime(make_timestamp(m.ts_us), '%Y-%m-%d') AS dt,
    concat(r.name, ':', m.ts_us // 1000000, '.', lpad(CAST(m.ts_us % 1000000 AS VARCHAR), 6, '0')) AS mid,
    coalesce(a.name, m.user_name) AS author, coalesce(x.name, concat('U', m.event_id % 15)) AS eyes, coalesce((SELECT name FROM su WHERE slack_id = 'U3'), 'U3') AS third
  FROM messages m JOIN rooms r ON r.id = m.conversation_id LEFT JOIN su a ON a.slack_id = m.user_name
  LEFT JOIN su x ON x.slack_id = concat('U', m.event_id % 15) WHERE m.event_id % 97 NOT IN (5, 6, 7))
"""


@query("stored_marks", SENT + "SELECT conversation_id, max(ts_us) AS last_ts_us FROM messages WHERE event_id % 97 NOT IN (5, 6, 7) GROUP BY conversation_id")
def stored_marks(spark, sf):
    return tables.read_small(spark, loaded_store(spark, sf).path("sync_state"), schemas.SYNC_STATE)


@query("stored_attachments", SENT + """SELECT concat(mid, ':file:0') AS id, mid AS message_id, concat('f', event_id, '.pdf') AS file_name, dt FROM filed WHERE event_id % 17 IN (1, 4)
  UNION ALL SELECT concat(mid, ':file:2'), mid, 'pic.png', dt FROM filed WHERE event_id % 17 IN (1, 4)
  UNION ALL SELECT concat(mid, ':attachment:0'), mid, concat('link ', event_id), dt FROM filed WHERE event_id % 13 = 2""")
def stored_attachments(spark, sf):
    rows = tables.read_table(spark, loaded_store(spark, sf).path("attachments"), load.ATTACHMENT_TABLE)
    return rows.select("id", "message_id", "file_name", "dt")


@query("stored_reactions", SENT + f"""SELECT DISTINCT message_id, emoji, user_name, {SECOND_AT} AS ts_us FROM (
  SELECT mid AS message_id, ':tada:' AS emoji, author AS user_name FROM filed WHERE event_id % 7 = 0
  UNION ALL SELECT mid, ':tada:', third FROM filed WHERE event_id % 7 = 0 UNION ALL SELECT mid, ':eyes:', eyes FROM filed WHERE event_id % 7 = 0)""")
def stored_reactions(spark, sf):
    rows = tables.read_table(spark, loaded_store(spark, sf).path("reactions"), load.REACTION_TABLE)
    return rows.select("message_id", "emoji", "user_name", "ts_us")


@query("stored_daily", SENT + """SELECT conversation_type, dt, cname AS conversation_name, author AS user_name, count(*) AS messages, min(ts_us) AS first_ts_us, max(ts_us) AS last_ts_us
  FROM filed GROUP BY conversation_type, dt, cname, author""")
def stored_daily(spark, sf):
    return load.read_daily(spark, loaded_store(spark, sf))


CONFIG_NAMES = ["nation_1", "nation_4", "#nation_8", "##nation_2", "ation_2", "no such channel"]


@query("resolve_config_channels", """SELECT n.name, coalesce(l.slack_id, x.slack_id, p.id) AS id FROM (SELECT unnest(['nation_1', 'nation_4', '#nation_8', '##nation_2', 'ation_2', 'no such channel']) AS name) n
  LEFT JOIN channels l ON l.name = n.name AND NOT l.is_private
  LEFT JOIN channels x ON x.name = ltrim(n.name, '#')
  LEFT JOIN (SELECT 'ation_2' AS name, min_by(slack_id, name) AS id FROM channels WHERE contains(name, 'ation_2')) p ON p.name = n.name""")
def resolve_config_channels(spark, sf):
    rooms = v.channels(spark, sf)
    listed = rooms.where("not is_private").select("name", F.col("slack_id").alias("id"))
    return ingest.resolve_config_channels(CONFIG_NAMES, listed, rooms)
