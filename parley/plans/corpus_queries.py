"""Corpora and name repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import corpus as co, repair as rp
from parley.plans import views as v
from parley.plans.registry import query

CORPUS = """SELECT user_name, conversation_name, last_ts_us, ts_us, id, text FROM (SELECT p.*, row_number() OVER (PARTITION BY p.conversation_name ORDER BY ts_us, p.id) AS rn,
    max(ts_us) OVER (PARTITION BY p.conversation_name) AS last_ts_us FROM prose p JOIN prose_dim d ON d.name = p.conversation_name WHERE d.type = 'dm')
  WHERE user_name IS NOT NULL AND text <> ''"""


def _corpus(spark, sf):
    return co.user_corpus(v.prose(spark, sf), v.prose_dim(spark, sf))


@query("user_corpus", CORPUS)
def user_corpus(spark, sf):
    return _corpus(spark, sf)


@query("chunk_corpus", f"""--more
texts AS (SELECT user_name, text, length(text) + 1 AS size, row_number() OVER (PARTITION BY user_name ORDER BY last_ts_us DESC, conversation_name, ts_us, id) AS rn FROM ({CORPUS})),
walk AS (SELECT user_name, rn, 0 AS chunk_no, size AS fill FROM texts WHERE rn = 1
  UNION ALL SELECT t.user_name, t.rn, CASE WHEN w.fill + t.size > 15000 THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN w.fill + t.size > 15000 THEN t.size ELSE w.fill + t.size END
  FROM walk w JOIN texts t ON t.user_name = w.user_name AND t.rn = w.rn + 1)
SELECT user_name, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS texts, concat(string_agg(text, chr(10) ORDER BY rn), chr(10)) AS chunk
FROM walk JOIN texts USING (user_name, rn) GROUP BY user_name, chunk_no""")
def chunk_corpus(spark, sf):
    return co.chunk_corpus(_corpus(spark, sf))


TRANSCRIPTS = """SELECT c.id, c.name AS conversation_name, c.type, concat_ws(chr(10), CASE WHEN c.type = 'channel' THEN concat(chr(10), '=== CHANNEL: ', c.name, ' ===')
    ELSE concat(chr(10), '=== DM: ', coalesce(array_to_string(c.participants, ' & '), ''), ' ===') END, l.lines) AS transcript, l.last_ts_us
  FROM (SELECT id, name, type, participants FROM conversations_dim UNION ALL SELECT concat('p', id), concat('p', name), type, participants FROM prose_dim) c
  JOIN (SELECT conversation_name, string_agg(CASE WHEN clean_text <> '' THEN concat(coalesce(user_name, 'None'), ': ', clean_text) END, chr(10) ORDER BY ts_us, id) AS lines, max(last_us) AS last_ts_us
    FROM (SELECT *, row_number() OVER (PARTITION BY conversation_name ORDER BY ts_us, id) AS rn, max(ts_us) OVER (PARTITION BY conversation_name) AS last_us FROM
      (SELECT id, conversation_name, ts_us, user_name, clean_text FROM messages UNION ALL SELECT id, concat('p', conversation_name), ts_us, user_name, clean_text FROM prose))
    GROUP BY conversation_name) l ON l.conversation_name = c.name"""


def _everyone(spark, sf):
    cols = ["id", "conversation_name", "ts_us", "user_name", "clean_text", "text"]
    prose = v.prose(spark, sf).withColumn("conversation_name", F.concat(F.lit("p"), "conversation_name"))
    messages = v.messages(spark, sf, threads=False).select(*cols).unionByName(prose.select(*cols))
    dms = v.prose_dim(spark, sf)
    for c in ("id", "name"):
        dms = dms.withColumn(c, F.concat(F.lit("p"), c))
    return messages, v.conversations_dim(spark, sf).unionByName(dms)


@query("transcripts", f"SELECT id, conversation_name, type, transcript FROM ({TRANSCRIPTS})")
def transcripts(spark, sf):
    return co.transcripts(*_everyone(spark, sf))


@query("transcript_budget", f"""SELECT id, conversation_name, CAST(start AS BIGINT) AS start, substr(transcript, 1, CAST(50000 - start AS BIGINT)) AS part FROM (
  SELECT *, coalesce(sum(length(transcript) + 1) OVER (ORDER BY last_ts_us DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ({TRANSCRIPTS})) WHERE start < 50000""")
def transcript_budget(spark, sf):
    return co.transcript_budget(*_everyone(spark, sf))


# --- repairs -------------------------------------------------------------------------


def _broken(spark, sf):
    return v.broken_dms(spark, sf).drop("people")


def _prose_under(spark, sf, dims):
    """Prose messages filed under the broken names."""
    names = dims.select(F.col("id").alias("conversation_id"), F.col("name").alias("conversation_name"))
    return v.prose(spark, sf).drop("conversation_name").join(names, "conversation_id")


def _after(conversations, renames, messages):
    """Names after the repair with the number of messages that follow."""
    moved = rp.rename_conversations(messages, renames)
    counted = moved.groupBy("conversation_id", "conversation_name").agg(F.count(F.lit(1)).alias("messages"))
    return conversations.join(counted, F.col("id") == F.col("conversation_id")).select(
        "id", "name", "conversation_name", "messages"
    )


NAME_SQL = """CASE WHEN len(p) = 1 THEN p[1] WHEN len(p) = 2 THEN concat(p[1], ' & ', p[2]) ELSE concat(p[1], ', ', p[2], ' + ', len(p) - 2, ' others') END"""
AFTER_SQL = """renames AS (SELECT f.name AS old_name, min_by(new_name, f.id) AS new_name FROM fixes x JOIN broken_dms f ON f.id = x.id GROUP BY f.name)
SELECT b.id, coalesce(x.new_name, b.name) AS name, coalesce(r.new_name, b.name) AS conversation_name, n.messages FROM broken_dms b LEFT JOIN fixes x ON x.id = b.id
LEFT JOIN renames r ON r.old_name = b.name JOIN (SELECT conversation_id, count(*) AS messages FROM prose GROUP BY conversation_id) n ON n.conversation_id = b.id"""


@query("repair_dm_names", f"""--more
alias AS (SELECT w, min(slack_id) AS uid FROM (SELECT slack_id, name AS w FROM users UNION ALL SELECT slack_id, real_name FROM users UNION ALL SELECT slack_id, display_name FROM users) WHERE w IS NOT NULL GROUP BY w),
who AS (SELECT b.id, b.name, coalesce(u.name, a.uid) AS person FROM (SELECT id, name, unnest(people) AS w FROM broken_dms WHERE type = 'dm' AND (name = id OR name LIKE 'C%' OR name LIKE 'D%')) b
  JOIN alias a ON a.w = b.w LEFT JOIN users u ON u.slack_id = a.uid),
built AS (SELECT id, name, list(person ORDER BY person) AS p FROM who GROUP BY id, name),
fixes AS (SELECT id, {NAME_SQL} AS new_name FROM built WHERE {NAME_SQL} <> name AND {NAME_SQL} <> id),
""" + AFTER_SQL)
def repair_dm_names(spark, sf):
    dims = v.broken_dms(spark, sf).drop("participants").withColumnRenamed("people", "participants")
    fixed, renames = rp.repair_dm_names(dims, v.users(spark, sf))
    return _after(fixed, renames, _prose_under(spark, sf, dims))


@query("repair_message_names", "SELECT id, CASE WHEN conversation_type = 'channel' THEN conversation_name WHEN event_id % 4 = 0 THEN conversation_id ELSE conversation_name END AS conversation_name FROM messages")
def repair_message_names(spark, sf):
    m = v.messages(spark, sf, threads=False, clean=False)
    by_id = F.when(F.col("event_id") % 4 == 0, F.col("conversation_id")).otherwise(F.col("conversation_name"))
    return rp.repair_message_names(v.conversations_dim(spark, sf), m.withColumn("conversation_name", by_id)).select(
        "id", "conversation_name"
    )


@query("repair_dm_format", """--more
wrong AS (SELECT id FROM broken_dms WHERE type = 'dm' AND name NOT LIKE 'DM:%' AND (name LIKE 'U%' OR name LIKE 'D%')),
authors AS (SELECT DISTINCT conversation_name, user_name FROM prose WHERE user_name IS NOT NULL),
found AS (SELECT id, string_agg(DISTINCT user_name, ',' ORDER BY user_name) AS people FROM wrong JOIN authors ON contains(conversation_name, id) GROUP BY id)
SELECT b.id, CASE WHEN w.id IS NULL THEN b.name ELSE concat('DM: ', b.id) END AS name, CASE WHEN w.id IS NULL THEN array_to_string(b.participants, ',') ELSE f.people END AS participants
FROM broken_dms b LEFT JOIN wrong w ON w.id = b.id LEFT JOIN found f ON f.id = b.id""")
def repair_dm_format(spark, sf):
    fixed = rp.repair_dm_format(_broken(spark, sf), v.prose(spark, sf))
    return fixed.select("id", "name", F.array_join("participants", ",").alias("participants"))


@query("repair_dm_readable", f"""--more
who AS (SELECT b.id, b.name, b.i, coalesce(u.name, b.w) AS person FROM (SELECT id, name, unnest(participants) AS w, generate_subscripts(participants, 1) AS i FROM broken_dms WHERE type = 'dm') b
  LEFT JOIN users u ON u.slack_id = b.w WHERE b.w <> 'USLACKBOT'),
built AS (SELECT id, name, list(person ORDER BY i) AS p FROM who GROUP BY id, name),
fixes AS (SELECT id, {NAME_SQL} AS new_name FROM built WHERE {NAME_SQL} <> name),
""" + AFTER_SQL)
def repair_dm_readable(spark, sf):
    dims = _broken(spark, sf)
    fixed, renames = rp.repair_dm_readable(dims, v.users(spark, sf))
    return _after(fixed, renames, _prose_under(spark, sf, dims))
