"""The engine's tables, derived by Spark from the driver's tables.

events + customer + nation give chat messages with threads, users and channels;
conversations gives prose messages in one DM per conv_id. SQL holds the same
views for the oracle. `conversations_dim` is the engine's conversations table;
the driver's table of that name stays `conversations`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.functions.times import DAY_US, HOUR_US, datetime_text, ntz_us
from parley.operators import kept
from parley.operators.keyed import broadcast_if_small, is_small
from parley.session import scratch_path
from parley.sources import tables

AS_OF_US = 1_706_788_800_000_000
OWNER = "Customer#000000001"
PERSON = "Customer#000000012"
CUTOFF_72H = AS_OF_US - 72 * HOUR_US
CUTOFF_14D = AS_OF_US - 14 * DAY_US
CUTOFF_30D = AS_OF_US - 30 * DAY_US
PROSE_START_US = 1_704_067_200_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.selectExpr(
        "concat('U', c_custkey) as slack_id",
        "case when c_custkey % 5 <> 0 then c_name end as name",
        "concat('cust', c_custkey) as display_name",
        "case when c_custkey % 7 <> 0 then c_name end as real_name",
        "c_custkey % 37 = 0 as is_bot",
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").selectExpr(
        "concat('C', n_nationkey) as slack_id", "lower(n_name) as name", "n_nationkey % 4 = 0 as is_private"
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("ts_us", ntz_us(F.col("ts")))
    return e.selectExpr(
        "event_id", "ts_us", "user_id", "event_type", "event_id % 40 as k",
        "case when event_type <> 'view' then event_id - cast(floor(event_id / 40) as bigint) % 4 * 40 end as parent_id",
    )


def _text(user: str, channel: str, here: str) -> str:
    return f"""concat({user}, ' saw ', event_type, ' in ', {channel},
        case when event_id % 3 = 0 then ' see https://x.test/p' else '' end,
        case when event_id % 10 = 0 then ' {here}' else '' end)"""


RAW_TEXT = _text(
    "concat('<@U', (user_id * 7 + event_id) % 15, '>')",
    "concat('<#C', event_id % 30, case when event_id % 2 = 0 then '|general' else '' end, '>')",
    "<!here>",
)
CLEAN_TEXT = _text(
    "concat('@', coalesce(un.name, concat('U', (user_id * 7 + event_id) % 15)))",
    "concat('#', case when event_id % 2 = 0 then 'general' else coalesce(cn.name, concat('C', event_id % 30)) end)",
    "@here",
)


def messages(
    spark: SparkSession, sf_dir: str, threads: bool = True, clean: bool = True, spread: int | None = None
) -> DataFrame:
    """Event messages; the thread columns and the readable text only on request.

    Threads and names are looked up for the few columns of an event; the texts are built
    after that, so they do not move. `spread` deals the events out to so many tasks first.
    """
    e = _events(spark, sf_dir)
    if threads:
        parent = e.selectExpr("event_id as parent_id", "ts_us as thread_ts_us")
        replies = e.where("parent_id <> event_id").groupBy(F.col("parent_id").alias("event_id")).agg(
            F.count(F.lit(1)).alias("_replies")
        )
        e = e.join(parent, "parent_id", "left").join(replies, "event_id", "left")
        e = e.withColumn("is_thread_parent", F.expr("event_id = parent_id"))
        e = e.withColumn("reply_count", F.expr("case when is_thread_parent then coalesce(_replies, 0) else 0 end"))
    if clean:
        e = e.withColumn("_named", F.expr("concat('U', (user_id * 7 + event_id) % 15)"))
        un = users(spark, sf_dir).selectExpr("slack_id as un_id", "name as un_name")
        if not is_small(un):
            named = _events(spark, sf_dir).selectExpr("concat('U', (user_id * 7 + event_id) % 15) as un_id").distinct()
            un = broadcast_if_small(un.join(named, "un_id", "left_semi"))
        cn = channels(spark, sf_dir).selectExpr("slack_id as cn_id", "name as cn_name")
        e = e.join(un, F.col("un_id") == F.col("_named"), "left")
        e = e.join(cn, F.expr("cn_id = concat('C', event_id % 30)"), "left")
    if spread:
        e = e.repartition(spread)
    e = e.selectExpr(
        "*",
        "concat(k, ':', event_id) as id",
        "case when k < 25 then concat('nation_', k) else concat('DM: D', k) end as conversation_name",
        "case when k < 25 then concat('C', k) else concat('D', k) end as conversation_id",
        "case when k < 25 then 'channel' else 'dm' end as conversation_type",
        "concat('U', user_id) as user_name",
        f"{RAW_TEXT} as text",
        "case event_id % 11 when 1 then 'file_share' when 2 then 'channel_join' "
        "when 3 then 'bot_message' when 4 then 'channel_topic' end as subtype",
        "case when event_id % 11 = 5 then concat('B', event_id % 7) end as bot_id",
    )
    e = e.withColumn("datetime", datetime_text(F.col("ts_us")))
    kept = ["id", "event_id", "conversation_id", "conversation_name", "conversation_type", "ts_us", "datetime",
            "user_name", "text", "subtype", "bot_id"]
    if clean:
        e = e.withColumn("clean_text", F.expr(CLEAN_TEXT.replace("un.name", "un_name").replace("cn.name", "cn_name")))
        e = e.withColumn("search_text", F.expr("lower(concat_ws(' ', clean_text, user_name, conversation_name))"))
        kept += ["clean_text", "search_text"]
    if threads:
        kept += ["thread_ts_us", "is_thread_parent", "reply_count"]
    return e.select(*kept)


def conversations_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event conversations; DMs have one to three participant ids or none."""
    k = _events(spark, sf_dir).select("k").distinct()
    return k.selectExpr(
        "case when k < 25 then concat('C', k) else concat('D', k) end as id",
        "case when k < 25 then concat('nation_', k) else concat('DM: D', k) end as name",
        "case when k < 25 then 'channel' else 'dm' end as type",
        """case when k < 25 or k % 5 = 0 then null
                when k % 3 = 0 then array(concat('U', k % 15))
                when k % 3 = 1 then array(concat('U', k % 15), 'Slackbot', concat('U', (k + 1) % 15))
                else array(concat('U', (k + 2) % 15), concat('U', k % 15), concat('U', (k + 1) % 15)) end as participants""",
    )


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose messages: one DM per conv_id, a message a minute, system turns without author."""
    return load(spark, sf_dir, "conversations").selectExpr(
        "concat('D', conv_id, ':', turn) as id",
        "concat('D', conv_id) as conversation_id",
        "concat('DM: D', conv_id) as conversation_name",
        "'dm' as conversation_type",
        f"{PROSE_START_US} + conv_id * 3600000000 + turn * 60000000 as ts_us",
        """case role when 'user' then concat('U', conv_id % 15)
                     when 'assistant' then concat('U', (conv_id + 1) % 15) end as user_name""",
        "text", "text as clean_text",
    ).withColumn("datetime", datetime_text(F.col("ts_us")))


def prose_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DMs of the prose messages."""
    c = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.selectExpr(
        "concat('D', conv_id) as id", "concat('DM: D', conv_id) as name", "'dm' as type",
        "array(concat('U', conv_id % 15), concat('U', (conv_id + 1) % 15)) as participants",
    )


def broken_dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DMs with names in need of repair, participants given as names in `people` and as ids in `participants`."""
    c = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.selectExpr(
        "concat('D', conv_id) as id",
        """case conv_id % 4 when 0 then concat('D', conv_id) when 1 then concat('U', conv_id % 15)
                when 2 then concat('DM: D', conv_id) else concat('room ', conv_id) end as name""",
        "case when conv_id % 9 = 8 then 'channel' else 'dm' end as type",
        """case when conv_id % 5 = 0 then null
                when conv_id % 5 = 1 then array(concat('U', conv_id % 15))
                when conv_id % 5 = 2 then array('USLACKBOT', concat('U', (conv_id + 2) % 15), concat('U', conv_id % 15))
                else array(concat('U', (conv_id + 1) % 15), concat('U', conv_id % 15), concat('U', (conv_id + 3) % 15),
                           concat('U', (conv_id + 2) % 15)) end as participants""",
        """case when conv_id % 5 = 0 then null
                when conv_id % 5 < 3 then array(concat('cust', (conv_id + 2) % 15), concat('cust', conv_id % 15))
                else array('nobody', concat('Customer#', lpad(cast((conv_id + 4) % 15 as string), 9, '0')),
                           concat('cust', conv_id % 15), concat('cust', (conv_id + 1) % 15)) end as people""",
    )


def landed_lines(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """Raw JSON lines made from the events: rich text, files, links, reactions, edits, bad rows.

    Whole seconds and six decimals, as the service writes ts.
    """
    m = messages(spark, sf_dir, threads=True, clean=False, spread=spread)
    ts = "format_string('%d.%06d', ({0}) div 1000000, ({0}) % 1000000)"
    m = m.selectExpr(
        "event_id", "conversation_id", "conversation_type",
        f"case when event_id % 97 = 5 then null when event_id % 97 = 6 then 'abc' else {ts.format('ts_us')} end as ts",
        "user_name as user",
        "case when event_id % 17 < 3 then '' else text end as text",
        f"case when thread_ts_us is not null then {ts.format('thread_ts_us')} end as thread_ts",
        "reply_count", "subtype", "bot_id",
        f"""case when event_id % 19 = 0 then named_struct('ts', {ts.format('ts_us + 60000000')}, 'user', user_name)
                 when event_id % 19 = 1 then named_struct('ts', null, 'user', user_name) end as edited""",
        """case when event_id % 17 in (1, 4) then array(
                  to_json(named_struct('name', concat('f', event_id, '.pdf'), 'filetype', 'pdf', 'size', event_id * 1000,
                    'url_private', 'https://f.test/a', 'title', 'Plan', 'mimetype', 'application/pdf')),
                  '"odd"',
                  to_json(named_struct('name', 'pic.png', 'filetype', 'png', 'size', event_id, 'mimetype', 'image/png'))
                ) end as files""",
        """case when event_id % 13 = 2 then array(
                  to_json(named_struct('title', concat('link ', event_id), 'title_link', 'https://l.test/b')), '7') end as attachments""",
        """case when event_id % 7 = 0 then array(
                  to_json(named_struct('name', 'tada', 'users', array(user_name, user_name, 'U3'))),
                  to_json(named_struct('name', 'eyes', 'users', array(concat('U', event_id % 15))))) end as reactions""",
        """case when event_id % 17 = 0 then array(
                  to_json(named_struct('type', 'divider')),
                  to_json(named_struct('type', 'rich_text', 'elements', array(
                    named_struct('type', 'rich_text_section', 'elements', array(
                      named_struct('type', 'text', 'text', 'hi ', 'name', null, 'user_id', null),
                      named_struct('type', 'emoji', 'text', null, 'name', 'wave', 'user_id', null),
                      named_struct('type', 'user', 'text', null, 'name', null, 'user_id', concat('U', event_id % 15)),
                      named_struct('type', 'link', 'text', 'x', 'name', null, 'user_id', null))),
                    named_struct('type', 'rich_text_list', 'elements', array(
                      named_struct('type', 'text', 'text', 'no', 'name', null, 'user_id', null))))))) end as blocks""",
    )
    fields = [c for c in m.columns if c not in ("event_id", "files", "attachments", "reactions", "blocks")]
    body = F.to_json(F.struct(*fields))
    lists = F.lit("")
    for name in ("files", "attachments", "reactions", "blocks"):
        items = F.concat(F.lit(f',"{name}":['), F.array_join(name, ","), F.lit("]"))
        lists = F.concat(lists, F.when(F.col(name).isNotNull(), items).otherwise(F.lit("")))
    line = F.concat(F.substring(body, F.lit(1), F.char_length(body) - 1), lists, F.lit("}"))
    broken = F.when(F.expr("event_id % 97 = 7"), F.concat(F.lit("{"), F.substring(line, 1, 40)))
    return m.select("event_id", F.coalesce(broken, line).alias("value"))


_kept: dict[tuple[str, str], str] = {}


def kept_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The event messages filed by type and date, with what a load keeps beside them; written once per application."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _kept:
        path = scratch_path(spark, "kept")
        filed = {"messages": tables.MESSAGE_PARTITIONS, "daily": tables.MESSAGE_PARTITIONS,
                 "grams": tables.MESSAGE_PARTITIONS, "replies": ("conversation_type", "root_dt")}

        def file(name: str, rows: DataFrame) -> None:
            rows.hint("rebalance", *filed[name]).write.partitionBy(*filed[name]).parquet(f"{path}/{name}")

        file("messages", tables.with_date(messages(spark, sf_dir)))
        m = spark.read.parquet(f"{path}/messages")
        file("daily", kept.daily(m))
        file("grams", kept.grams(m))
        file("replies", kept.replies(m.drop("dt")))
        _kept[known] = path
    return {name: spark.read.parquet(f"{_kept[known]}/{name}") for name in ("messages", "daily", "grams", "replies")}


_landed: dict[tuple[str, str], str] = {}


def landing_dir(spark: SparkSession, sf_dir: str) -> str:
    """Landing files of the events, written once per application."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _landed:
        path = scratch_path(spark, "landing")
        cores = spark.sparkContext.defaultParallelism
        few = len(load(spark, sf_dir, "events").inputFiles()) < cores
        landed_lines(spark, sf_dir, spread=cores if few else None).select("value").write.text(path)
        _landed[known] = path
    return _landed[known]


SQL = f"""WITH RECURSIVE
users AS (SELECT concat('U', c_custkey) AS slack_id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name,
    concat('cust', c_custkey) AS display_name, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS real_name,
    c_custkey % 37 = 0 AS is_bot FROM customer),
channels AS (SELECT concat('C', n_nationkey) AS slack_id, lower(n_name) AS name, n_nationkey % 4 = 0 AS is_private FROM nation),
ev AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, event_id % 40 AS k,
    CASE WHEN event_type <> 'view' THEN event_id - (event_id // 40) % 4 * 40 END AS parent_id FROM events),
replies AS (SELECT parent_id, count(*) AS n FROM ev WHERE parent_id <> event_id GROUP BY parent_id),
messages AS (SELECT concat(e.k, ':', e.event_id) AS id, e.event_id, e.user_id,
    CASE WHEN e.k < 25 THEN concat('C', e.k) ELSE concat('D', e.k) END AS conversation_id,
    CASE WHEN e.k < 25 THEN concat('nation_', e.k) ELSE concat('DM: D', e.k) END AS conversation_name,
    CASE WHEN e.k < 25 THEN 'channel' ELSE 'dm' END AS conversation_type,
    e.ts_us, strftime(make_timestamp(e.ts_us), '%Y-%m-%d %H:%M:%S') AS datetime, concat('U', e.user_id) AS user_name,
    {RAW_TEXT} AS text,
    {CLEAN_TEXT} AS clean_text,
    lower(concat_ws(' ', {CLEAN_TEXT}, concat('U', e.user_id),
      CASE WHEN e.k < 25 THEN concat('nation_', e.k) ELSE concat('DM: D', e.k) END)) AS search_text,
    CASE e.event_id % 11 WHEN 1 THEN 'file_share' WHEN 2 THEN 'channel_join' WHEN 3 THEN 'bot_message' WHEN 4 THEN 'channel_topic' END AS subtype,
    CASE WHEN e.event_id % 11 = 5 THEN concat('B', e.event_id % 7) END AS bot_id,
    p.parent_us AS thread_ts_us, e.event_id = e.parent_id AS is_thread_parent,
    CASE WHEN e.event_id = e.parent_id THEN coalesce(r.n, 0) ELSE 0 END AS reply_count
  FROM ev e LEFT JOIN (SELECT event_id AS pid, ts_us AS parent_us FROM ev) p ON p.pid = e.parent_id
  LEFT JOIN (SELECT parent_id AS reply_to, n FROM replies) r ON r.reply_to = e.event_id
  LEFT JOIN (SELECT slack_id, name FROM users) un ON un.slack_id = concat('U', (e.user_id * 7 + e.event_id) % 15)
  LEFT JOIN (SELECT slack_id, name FROM channels) cn ON cn.slack_id = concat('C', e.event_id % 30)),
conversations_dim AS (SELECT DISTINCT CASE WHEN k < 25 THEN concat('C', k) ELSE concat('D', k) END AS id,
    CASE WHEN k < 25 THEN concat('nation_', k) ELSE concat('DM: D', k) END AS name,
    CASE WHEN k < 25 THEN 'channel' ELSE 'dm' END AS type,
    CASE WHEN k < 25 OR k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN [concat('U', k % 15)]
      WHEN k % 3 = 1 THEN [concat('U', k % 15), 'Slackbot', concat('U', (k + 1) % 15)]
      ELSE [concat('U', (k + 2) % 15), concat('U', k % 15), concat('U', (k + 1) % 15)] END AS participants FROM ev),
prose AS (SELECT concat('D', conv_id, ':', turn) AS id, concat('D', conv_id) AS conversation_id,
    concat('DM: D', conv_id) AS conversation_name, 'dm' AS conversation_type,
    {PROSE_START_US} + conv_id * 3600000000 + turn * 60000000 AS ts_us,
    CASE role WHEN 'user' THEN concat('U', conv_id % 15) WHEN 'assistant' THEN concat('U', (conv_id + 1) % 15) END AS user_name,
    text, text AS clean_text FROM conversations),
prose_dim AS (SELECT DISTINCT concat('D', conv_id) AS id, concat('DM: D', conv_id) AS name, 'dm' AS type,
    [concat('U', conv_id % 15), concat('U', (conv_id + 1) % 15)] AS participants FROM conversations),
broken_dms AS (SELECT DISTINCT concat('D', conv_id) AS id,
    CASE conv_id % 4 WHEN 0 THEN concat('D', conv_id) WHEN 1 THEN concat('U', conv_id % 15)
      WHEN 2 THEN concat('DM: D', conv_id) ELSE concat('room ', conv_id) END AS name,
    CASE WHEN conv_id % 9 = 8 THEN 'channel' ELSE 'dm' END AS type,
    CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN [concat('U', conv_id % 15)]
      WHEN conv_id % 5 = 2 THEN ['USLACKBOT', concat('U', (conv_id + 2) % 15), concat('U', conv_id % 15)]
      ELSE [concat('U', (conv_id + 1) % 15), concat('U', conv_id % 15), concat('U', (conv_id + 3) % 15),
            concat('U', (conv_id + 2) % 15)] END AS participants,
    CASE WHEN conv_id % 5 = 0 THEN NULL
      WHEN conv_id % 5 < 3 THEN [concat('cust', (conv_id + 2) % 15), concat('cust', conv_id % 15)]
      ELSE ['nobody', concat('Customer#', lpad(CAST((conv_id + 4) % 15 AS VARCHAR), 9, '0')),
            concat('cust', conv_id % 15), concat('cust', (conv_id + 1) % 15)] END AS people FROM conversations)
"""
