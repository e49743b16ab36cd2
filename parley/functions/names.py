"""Display names of people and conversations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parley.functions.text import blank_to_null


# How conversations without a name of their own are called.
DM_PREFIX, PAIR, OTHERS = "DM: ", " & ", " others"


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def dm_name(names: Column, conversation_id: Column | None = None, ordered: bool = True) -> Column:
    """One name, `A & B`, or `A, B + n others`; without names `DM: id` (NULL when no id is given)."""
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    kept = F.array_sort(kept) if ordered else kept
    count = F.coalesce(F.size(kept), F.lit(0))
    first, second = F.get(kept, F.lit(0)), F.get(kept, F.lit(1))
    nobody = F.lit(None).cast("string") if conversation_id is None else F.concat(F.lit(DM_PREFIX), conversation_id)
    return (
        F.when(count < 1, nobody)
        .when(count == 1, first)
        .when(count == 2, F.concat(first, F.lit(PAIR), second))
        .otherwise(
            F.concat(first, F.lit(", "), second, F.lit(" + "), (count - 2).cast("string"), F.lit(OTHERS))
        )
    )


def conversation_name(
    kind: Column, conversation_id: Column, channel_name: Column, participant_names: Column
) -> Column:
    return (
        F.when(kind == "channel", F.coalesce(blank_to_null(channel_name), conversation_id))
        .when(kind == "dm", dm_name(participant_names, conversation_id))
        .otherwise(conversation_id)
    )


def match_score(name: Column, term: Column) -> Column:
    """100 equal, 90 prefix, 80 inside, 0 no match; the term is taken literally."""
    return (
        F.when(name == term, 100)
        .when(F.startswith(name, term), 90)
        .when(F.contains(name, term), 80)
        .otherwise(0)
    )
