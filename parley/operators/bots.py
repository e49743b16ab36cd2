"""Bot filter on rows and on the lists nested in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from parley.functions.bots import NAME_FIELDS, all_bots, is_bot


def _any_bot(fields: Sequence[str], value, ignored: Sequence[str]) -> Column:
    test = F.lit(False)
    for name in fields:
        test = test | is_bot(value(name), ignored)
    return test


def _people_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.StructType))


def _without_bots(items: Column, kind: T.ArrayType, ignored: Sequence[str]) -> Column:
    element = kind.elementType
    if isinstance(element, T.StringType):
        return F.filter(items, lambda x: ~is_bot(x, ignored))
    present = [f for f in NAME_FIELDS if f in element.names]
    return F.filter(items, lambda x: ~_any_bot(present, lambda f: x[f], ignored))


def filter_bots(df: DataFrame, ignored: Sequence[str] = (), fields: Sequence[str] = NAME_FIELDS) -> DataFrame:
    """Drop rows that name a bot, DM items with bots only, and bots inside nested lists.

    A conversation whose own name contains an ignored word goes too, since `name`
    is one of the fields; pass other `fields` to change that.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    present = [f for f in fields if isinstance(kinds.get(f), T.StringType)]
    kept = df.where(~_any_bot(present, F.col, ignored))
    if "type" in kinds and "location" in kinds:
        kept = kept.where(~((F.col("type") == "dm") & all_bots(F.col("location"), ignored)))
    for nested in ("context_messages", "participants", "recent_replies"):
        if nested in kinds and _people_list(kinds[nested]):
            kept = kept.withColumn(nested, _without_bots(F.col(nested), kinds[nested], ignored))
    thread = kinds.get("thread")
    if isinstance(thread, T.StructType) and "replies" in thread.names and _people_list(thread["replies"].dataType):
        replies = _without_bots(F.col("thread.replies"), thread["replies"].dataType, ignored)
        kept = kept.withColumn("thread", F.col("thread").withField("replies", replies))
    return kept
