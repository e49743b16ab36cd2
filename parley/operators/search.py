"""Search over kept runs of three characters: only dates and conversations that can hold a hit are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.operators.kept import GRAM
from parley.operators.keyed import broadcast_if_small
from parley.operators.lookup import search_messages

PLACE = ["conversation_type", "dt", "conversation_name"]


def candidates(grams: DataFrame, term: str, conversation: str | None = None) -> DataFrame:
    """(conversation_type, dt, conversation_name) that hold all runs of the term; all places for a short term."""
    rows = grams if conversation is None else grams.where(F.col("conversation_name") == conversation)
    rows = rows.withColumn("dt", F.col("dt").cast("string"))
    wanted = sorted({term[k:k + GRAM] for k in range(len(term) - GRAM + 1)})
    if not wanted:
        return rows.select(*PLACE).distinct()
    found = rows.where(F.col("gram").isin(wanted)).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(wanted)).select(*PLACE)


def search_kept(
    messages: DataFrame, grams: DataFrame, query: str, conversation: str | None = None, user: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """`search_messages` over a table partitioned by type and date, with its kept `grams`.

    The runs of the term are intersected first. Candidate dates are then walked from
    the newest on, twice as many at each step, until the limit is met: later dates
    hold later messages, so nothing older can be among the newest hits. The texts
    themselves decide; runs only name candidates.
    """
    places = candidates(grams, query.lower(), conversation)
    dates = [r["dt"] for r in places.select("dt").distinct().orderBy(F.desc("dt")).collect()]
    where = broadcast_if_small(places)
    filed = messages.withColumn("dt", F.col("dt").cast("string"))

    def hits(taken: list[str]) -> DataFrame:
        rows = filed.where(F.col("dt").isin(taken)).join(where, PLACE, "left_semi")
        return search_messages(rows, query, conversation, user, limit)

    step, upto, found = 1, 0, 0
    while upto < len(dates) and found < limit:
        found += hits(dates[upto:upto + step]).count()
        upto, step = min(upto + step, len(dates)), 2 * step
    return hits(dates[:upto])
