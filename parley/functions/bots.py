"""Which names count as bots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: always ignored.
ALWAYS_IGNORED = "slackbot"
# Fields that may name a person, in rows and nested items.
NAME_FIELDS = ("user_name", "user", "display_user_name", "display_name", "name", "thread_starter")


def is_bot(name: Column, ignored: Sequence[str] = ()) -> Column:
    """The lower-cased name contains an ignored word; missing names are not bots."""
    words = sorted({w.lower() for w in ignored if w} | {ALWAYS_IGNORED})
    lowered = F.lower(name)
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lowered, w))
    return F.coalesce(hit, F.lit(False))


def all_bots(location: Column, ignored: Sequence[str] = ()) -> Column:
    """Every comma-separated name of a DM location is a bot."""
    bare = F.regexp_replace(F.regexp_replace(location, "DM:", ""), r"[()]", "")
    return F.coalesce(
        F.forall(F.split(bare, ",", -1), lambda p: is_bot(F.trim(p), ignored)), F.lit(False)
    )
