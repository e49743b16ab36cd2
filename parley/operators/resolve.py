"""Id -> name lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import text as tx
from parley.functions.names import conversation_name
from parley.operators.keyed import broadcast_if_small, is_small
from parley.session import written

# Mentioned ids per row that are looked up directly.
DIRECT_IDS = 3


def user_mappings(users: DataFrame) -> DataFrame:
    return users.select("slack_id", "name")


def channel_mappings(channels: DataFrame) -> DataFrame:
    return channels.select("slack_id", "name")


def name_book(*dims: DataFrame) -> DataFrame:
    """One (id, name) pair for each known id of users, channels or conversations with a non-empty name.

    Of several names of an id the first in order counts.
    """
    book = None
    for dim in dims:
        key = "slack_id" if "slack_id" in dim.columns else "id"
        part = dim.select(F.col(key).alias("ref_id"), tx.blank_to_null(F.col("name")).alias("ref_name"))
        book = part if book is None else book.unionByName(part)
    return book.where("ref_name is not null").groupBy("ref_id").agg(F.min("ref_name").alias("ref_name"))


def book_for(book: DataFrame, ids: DataFrame) -> DataFrame:
    """What rows that need these `ids` (one column) have to know of a name book.

    A small book is used whole. Of a large one only the entries of the ids that occur
    are kept: these are often few enough to be broadcast, and then the rows never move.
    """
    if is_small(book):
        return F.broadcast(book)
    wanted = ids.toDF("ref_id").distinct()
    return broadcast_if_small(written(book.join(wanted, "ref_id", "left_semi"), "book-part"))


def resolve_ids(df: DataFrame, book: DataFrame, id_col: str, out: str) -> DataFrame:
    """Name of an id, the id itself when unknown, NULL when empty.

    Rows without an id match nothing; where rows are shuffled they are dealt out
    evenly and do not meet in one task.
    """
    named = book.select(F.col("ref_id").alias("_ref"), F.col("ref_name").alias("_ref_name"))
    ident = tx.blank_to_null(F.col(id_col))
    key = F.coalesce(ident, F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    return df.withColumn("_key", key).join(named, F.col("_key") == F.col("_ref"), "left").withColumn(
        out, F.coalesce("_ref_name", ident)
    ).drop("_key", "_ref", "_ref_name")


def attach_names(
    df: DataFrame, ids: Column, book: DataFrame, out: str = "names", most: int = DIRECT_IDS
) -> DataFrame:
    """Add to each row a small map id -> name holding just the ids the row mentions.

    `book` is unique by id. Counted as small, or with few of its ids mentioned, it answers
    rows of up to `most` ids by broadcast lookups, and those rows never move; only rows
    with more ids are shuffled. Where very many ids are mentioned all rows go the second way.
    """
    no_ids = F.array().cast("array<string>")
    tagged = df.withColumn("_wanted", F.array_distinct(F.coalesce(ids, no_ids)))
    if not is_small(book):
        wanted = tagged.select(F.explode("_wanted").alias("ref_id")).distinct()
        book = written(book.join(wanted, "ref_id", "left_semi"), "book-part")
        if not is_small(book):
            return _attach_by_pairs(tagged, book, out).select(*df.columns, out)
    few = tagged.where(F.size("_wanted") <= most)
    entries = []
    side = F.broadcast(book.select(F.col("ref_id").alias("_ref"), F.col("ref_name").alias("_ref_name")))
    for i in range(most):
        few = few.join(side, F.get("_wanted", F.lit(i)) == F.col("_ref"), "left")
        few = few.withColumnsRenamed({"_ref": f"_id{i}", "_ref_name": f"_name{i}"})
        entries.append(F.struct(F.col(f"_id{i}").alias("ref_id"), F.col(f"_name{i}").alias("ref_name")))
    found = F.filter(F.array(*entries), lambda e: e["ref_id"].isNotNull())
    direct = few.withColumn(out, F.map_from_entries(found)).select(*df.columns, out)
    many = _attach_by_pairs(tagged.where(F.size("_wanted") > most), book, out)
    return direct.unionByName(many.select(*df.columns, out))


def _attach_by_pairs(tagged: DataFrame, book: DataFrame, out: str) -> DataFrame:
    """Only (row, id) pairs travel to the lookup, not the rows; they come back as one map per row.

    The rows are numbered and written aside, so that any keys they have may repeat or be missing.
    """
    tagged = written(tagged.withColumn("_row", F.monotonically_increasing_id()), "many-ids")
    wanted = tagged.select("_row", F.explode("_wanted").alias("ref_id"))
    found = (
        wanted.join(book, "ref_id")
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_set(F.struct("ref_id", "ref_name"))).alias(out))
    )
    return tagged.join(found, "_row", "left").withColumn(out, F.coalesce(out, F.create_map().cast("map<string,string>")))


def mention_ids(text: Column, blocks: Column | None = None) -> Column:
    """Every id whose name the text rewrite may need."""
    empty = F.array().cast("array<string>")
    parts = [tx.user_mention_ids(text), tx.channel_mention_ids(text)]
    if blocks is not None:
        parts += [tx.rich_text_user_ids(blocks)]
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def rewrite_mentions(messages: DataFrame, book: DataFrame) -> DataFrame:
    """Set `clean_text` and `mentions_users` from `text`."""
    named = attach_names(messages, mention_ids(F.col("text")), book)
    named = named.withColumn("mentions_users", tx.mentioned_users(F.col("text"), F.col("names")))
    return with_clean_text(named, "text", "clean_text").drop("names")


def with_clean_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """The three rewrites in order, each a column of its own so that none is computed twice."""
    names = F.col("names")
    return (
        df.withColumn("_people", tx.resolve_user_mentions(F.col(text), names))
        .withColumn("_rooms", tx.resolve_channel_mentions(F.col("_people"), names))
        .withColumn(out, tx.resolve_special_mentions(F.col("_rooms")))
        .drop("_people", "_rooms")
    )


def name_conversations(conversations: DataFrame, book: DataFrame, out: str = "name") -> DataFrame:
    """Readable names: channel name, or one built from the resolved participants.

    Takes id, type and participants (ids); also returns the participants as
    names, without empties, NULL when there are none.
    """
    people = (
        conversations.select("id", F.posexplode("participants").alias("_pos", "_who"))
        .where(tx.blank_to_null(F.col("_who")).isNotNull())
    )
    people = resolve_ids(people, book, "_who", "_person")
    lists = people.groupBy("id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", "_person"))), lambda s: s["_person"]
        ).alias("_names")
    )
    titled = conversations.join(lists, "id", "left")
    titled = titled.join(
        book.select(F.col("ref_id").alias("id"), F.col("ref_name").alias("_channel")), "id", "left"
    )
    return titled.withColumn(
        out, conversation_name(F.col("type"), F.col("id"), F.col("_channel"), F.col("_names"))
    ).withColumn("participants", F.col("_names")).drop("_names", "_channel")


def display_names(users: DataFrame) -> DataFrame:
    """(slack_id, display): name, else real name; users without either are left out."""
    return users.select(
        F.col("slack_id").alias("_uid"), F.coalesce("name", "real_name").alias("_display")
    ).where("_display is not null")


def with_display_name(df: DataFrame, users: DataFrame, out: str = "display_user_name") -> DataFrame:
    """Add the author's display name; unresolved ids show as they are."""
    return (
        df.join(display_names(users), F.col("user_name") == F.col("_uid"), "left")
        .withColumn(out, F.coalesce("_display", "user_name"))
        .drop("_uid", "_display")
    )


def with_author_test(df: DataFrame, users: DataFrame, test, out: str) -> DataFrame:
    """Add `test(display name)` without looking every author up.

    Only users whose display name or id passes the test can change its outcome:
    an author missing from that short list either fails the test under both
    names or has no display name, and then the id decides. So the lookup side
    holds the few users in question instead of the whole dimension.
    """
    in_question = display_names(users).where(test(F.col("_display")) | test(F.col("_uid")))
    return (
        df.join(broadcast_if_small(in_question), F.col("user_name") == F.col("_uid"), "left")
        .withColumn(out, test(F.coalesce("_display", "user_name")))
        .drop("_uid", "_display")
    )
