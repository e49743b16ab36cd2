"""Name repairs. Each returns the conversations after the repair and the renames for messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.functions.names import dm_name
from parley.functions.text import blank_to_null
from parley.operators.keyed import broadcast_if_small
from parley.operators.resolve import name_book, resolve_ids
from parley.session import written

# Fixed value: id of the service's own bot user.
SERVICE_BOT_ID = "USLACKBOT"
PIECE = 256


def rename_conversations(messages: DataFrame, renames: DataFrame) -> DataFrame:
    """Replace old conversation names by new ones; renames are unique by old name.

    They are written out first: finding them may have read all messages.
    """
    named = messages.join(
        broadcast_if_small(written(renames, "renames")), F.col("conversation_name") == F.col("old_name"), "left"
    )
    return named.withColumn("conversation_name", F.coalesce("new_name", "conversation_name")).drop(
        "old_name", "new_name"
    )


def _apply(conversations: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set new names by id; of conversations sharing a name the lowest id decides for messages."""
    joined = conversations.join(changes, "id", "left")
    fixed = joined.withColumn("_old", F.col("name")).withColumn("name", F.coalesce("new_name", "name"))
    renames = (
        fixed.where("new_name is not null")
        .groupBy(F.col("_old").alias("old_name"))
        .agg(F.min_by("new_name", "id").alias("new_name"))
    )
    return fixed.drop("_old", "new_name"), renames


def _people_in_order(people: DataFrame, name_col: str) -> DataFrame:
    """(id, people): the names of a conversation in participant order."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(name_col).alias("n"))))
    return people.groupBy("id").agg(F.transform(pairs, lambda s: s["n"]).alias("people"))


def _participants(conversations: DataFrame) -> DataFrame:
    return conversations.select("id", F.posexplode("participants").alias("pos", "who"))


def repair_dm_names(conversations: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name DMs still called by an id after their participants.

    Participants are stored as names: each is traced to a user by any of the
    three names (unknown ones are dropped) and shown under that user's name.
    """
    wanted = conversations.where(
        (F.col("type") == "dm")
        & ((F.col("name") == F.col("id")) | F.col("name").startswith("C") | F.col("name").startswith("D"))
    )
    known_as = (
        users.select("slack_id", F.explode(F.array("name", "real_name", "display_name")).alias("who"))
        .where("who is not null")
        .groupBy("who").agg(F.min("slack_id").alias("user_id"))
    )
    people = _participants(wanted).join(known_as, "who")
    named = resolve_ids(people, name_book(users), "user_id", "person")
    built = _people_in_order(named, "person").select("id", dm_name(F.col("people")).alias("new_name"))
    current = wanted.select("id", F.col("name").alias("_now"))
    changes = (
        built.join(current, "id")
        .where((F.col("new_name") != F.col("_now")) & (F.col("new_name") != F.col("id")))
        .drop("_now")
    )
    return _apply(conversations, changes)


def message_name_fixes(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Renames for channel messages filed under a channel id: (old_name, new_name)."""
    used = messages.where(
        (F.col("conversation_type") == "channel")
        & (F.col("conversation_name").startswith("C") | F.col("conversation_name").startswith("D"))
    ).select(F.col("conversation_name").alias("old_name")).distinct()
    rooms = conversations.where(F.col("type") == "channel").select(
        F.col("id").alias("old_name"), F.col("name").alias("new_name")
    )
    return used.join(rooms, "old_name").where(F.col("new_name") != F.col("old_name"))


def repair_message_names(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    return rename_conversations(messages, message_name_fixes(conversations, messages))


def _ids_inside(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conversation_name, id): the wanted ids that occur in a name, inside its runs of capitals and digits.

    Turns "name contains id" into an equality join. Only parts of lengths that occur
    among the wanted ids are taken, so a name costs a few parts per character.
    """
    lengths = [r["n"] for r in wanted.select(F.char_length("id").alias("n")).distinct().collect()]
    runs = names.select(
        "conversation_name", F.explode(F.regexp_extract_all("conversation_name", F.lit("([A-Z0-9]+)"), F.lit(1))).alias("run")
    )
    size = F.col("n") - 1
    runs = runs.withColumn("n", F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>")))
    runs = runs.where(F.char_length("run") >= F.col("n"))
    # Long runs are cut into overlapping pieces first, as taking a part walks the text before it.
    count = F.ceil((F.char_length("run") - size) / F.lit(PIECE)).cast("int")
    pieces = runs.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1))).select(
        "conversation_name", "n", F.col("run").substr(F.col("k") * PIECE + 1, PIECE + size).alias("piece")
    )
    at = F.explode(F.sequence(F.lit(1), F.char_length("piece") - size))
    parts = pieces.withColumn("a", at).select("conversation_name", F.col("piece").substr(F.col("a"), F.col("n")).alias("id"))
    return parts.join(wanted, "id", "left_semi").distinct()


def repair_dm_format(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """DMs named U… or D… (but not `DM:…`) become `DM: id`, with the authors of their messages as participants."""
    wrong = conversations.where(
        (F.col("type") == "dm")
        & ~F.col("name").startswith("DM:")
        & (F.col("name").startswith("U") | F.col("name").startswith("D"))
    ).select("id")
    authors = (
        messages.where(
            blank_to_null(F.col("user_name")).isNotNull() & (F.col("user_name") != "None")
        ).select("conversation_name", "user_name").distinct()
    )
    spelled = _ids_inside(authors.select("conversation_name").distinct(), wrong)
    people = (
        spelled.join(authors, "conversation_name").select("id", "user_name").distinct()
        .groupBy("id").agg(F.array_sort(F.collect_list("user_name")).alias("_people"))
    )
    fixes = wrong.join(people, "id", "left").withColumn("_fix", F.lit(True))
    joined = conversations.join(fixes, "id", "left")
    return joined.withColumn(
        "name", F.when(F.col("_fix"), F.concat(F.lit("DM: "), "id")).otherwise(F.col("name"))
    ).withColumn(
        "participants", F.when(F.col("_fix"), F.col("_people")).otherwise(F.col("participants"))
    ).drop("_fix", "_people")


def repair_dm_readable(conversations: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name DMs after their participants (ids) in stored order, leaving out the service's bot."""
    people = _participants(conversations.where(F.col("type") == "dm")).where(F.col("who") != SERVICE_BOT_ID)
    named = resolve_ids(people, name_book(users), "who", "person")
    built = _people_in_order(named, "person").select("id", dm_name(F.col("people"), ordered=False).alias("new_name"))
    current = conversations.select("id", F.col("name").alias("_now"))
    changes = built.where("new_name is not null").join(current, "id").where(
        F.col("new_name") != F.col("_now")
    ).drop("_now")
    return _apply(conversations, changes)
