"""Times the operators on replicated messages with one hot conversation.

Reads the driver's tables, repeats each message SCALE_COPIES times (a third of
the copies go to one channel), writes the table as the load does, and prints one
JSON line. SCALE_HOT=0 spreads the copies evenly.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from parley.operators import activity, corpus, followups, ingest, lookup, people  # noqa: E402
from parley.plans import views as v  # noqa: E402
from parley.session import local_session, scratch_path  # noqa: E402
from parley.sources import tables  # noqa: E402


def replicated(spark, sf_dir: str, copies: int, hot: bool):
    m = v.messages(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    to_hot = (F.col("copy") % 3 == 0) & F.lit(hot)
    name = F.when(to_hot, "nation_0").otherwise(
        F.concat("conversation_name", F.when(F.col("copy") > 2, F.concat(F.lit(" "), F.col("copy") % 50)).otherwise(""))
    )
    rows = (
        m.withColumn("conversation_type", F.when(to_hot, "channel").otherwise(F.col("conversation_type")))
        .withColumn("conversation_name", name)
        .withColumn("id", F.concat("id", F.lit(":"), "copy"))
        .withColumn("ts_us", F.col("ts_us") + F.col("copy") * 7)
        .withColumn("thread_ts_us", F.col("thread_ts_us") + F.col("copy") * 7)
        .drop("copy", "event_id", "subtype", "bot_id")
    )
    path = scratch_path(spark, "scale")
    tables.with_date(rows).hint("rebalance", *tables.MESSAGE_PARTITIONS).write.partitionBy(
        *tables.MESSAGE_PARTITIONS
    ).parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("SCALE_COPIES", "10"))
    hot = os.environ.get("SCALE_HOT", "1") == "1"
    spark = local_session(cores, "bench-scale", 16)
    spark.sparkContext.setLogLevel("ERROR")
    m, users = replicated(spark, sf_dir, copies, hot), v.users(spark, sf_dir)
    dims = m.select(
        F.col("conversation_name").alias("id"), F.col("conversation_name").alias("name"),
        F.col("conversation_type").alias("type"),
    ).distinct().withColumn("participants", F.lit(None).cast("array<string>"))
    window = activity.channel_window(m, v.CUTOFF_14D)
    owner = followups.Owner(v.OWNER)
    context_from = v.CUTOFF_72H - followups.CONTEXT_DAYS * 86_400_000_000
    runs = {
        "list_conversations": lambda: lookup.list_conversations(dims, m, ordered=False),
        "channel_summary": lambda: activity.channel_summary(window),
        "channel_participants": lambda: activity.channel_participants(window, users, ordered=False),
        "conversation_flow": lambda: activity.conversation_flow(window, m, users, ordered=False),
        "search_messages": lambda: lookup.search_messages(m, "purchase in #general see"),
        "interactions_mentions": lambda: people.interactions_mentions(m, users, dims, v.PERSON, v.CUTOFF_30D),
        "interactions_all": lambda: people.interactions_all(m, users, dims, v.PERSON, v.CUTOFF_30D),
        "followups": lambda: followups.followups(m, dims, users, owner, v.AS_OF_US, ordered=False),
        "followup_context": lambda: followups.followup_context(
            m, followups.followups(m, dims, users, owner, v.AS_OF_US, ordered=False), users, context_from
        ),
        "thread_topk": lambda: ingest.threads_to_backfill(m, 10),
        "user_corpus": lambda: corpus.user_corpus(m, dims),
        "chunk_corpus": lambda: corpus.chunk_corpus(corpus.user_corpus(m, dims)),
        "transcripts": lambda: corpus.transcripts(m, dims),
        "upsert": lambda: tables.upsert(m, m.where(F.col("dt") > "2024-01-25"), ["id"], [F.desc("ts_us")]),
    }
    seconds = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
    print(json.dumps({"rows": m.count(), "hot": hot, "cores": cores, "seconds": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
