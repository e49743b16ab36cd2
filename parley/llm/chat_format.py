"""Chat formatting: turn-aligned windows of a token budget, with history and loss mask.

Every turn is put between marks of its role. Marks inside a text are broken up by a
backslash after their first character, and backslashes are doubled, so the text can
be read back exactly.

Windows come from prefix sums of turn tokens. Turns are laid on a line by their
running token count; the line is cut into cells of what system turn and history leave
of the budget, and a turn belongs to the cell it starts in: the window's new turns
end with the last one whose prefix sum lies in the cell, so over a long conversation
windows hold as many new tokens as the budget has room for. A cell
that would overflow the room gives its last turn a window of its own, so a window
goes over budget only by a single turn that is longer than the room. Each window
repeats the leading system turn and as much of the turns right before it as
`HISTORY` tokens and the room allow. Every turn is fresh in exactly one window;
assistant turns are under the loss mask there and masked where they are repeated.

Order and prefix sums come from a range sort over (conversation, turn): a
conversation may spread over many partitions, of which only the sums are combined.
From there on rows meet by (conversation, cell), which holds a bounded number of
tokens, so one huge conversation is formatted by many tasks.

Defined results: NULL texts are empty turns; a NULL role reads back as an empty
one; a NULL conversation id is a conversation of its own; rows are ordered by turn
(NULL first), then role and text, and repeated rows are turns of their own; a
conversation of a system turn only gives one window; a turn longer than the budget is
a window of its own; other columns are not read and may have any name; an empty
table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.common import mapped
from parley.session import written

BUDGET = 1024
HISTORY = 256

#: The marks of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE_OPEN, ROLE_END, ROLE_CLOSE = "[ROLE]", "[=]", "[/ROLE]"
TARGET = "assistant"

#: The first character of a mark, before the rest of the mark.
_MARK_START = r"(<)(?=/?s>|</?SYS>>)|(\[)(?=/?INST\]|/?ROLE\]|=\])"
_PIECES = re.compile(
    r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>"
    r"|\[ROLE\](?P<role>.*?)\[=\](?P<other>.*?)\[/ROLE\]",
    re.DOTALL,
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _MARK_START, r"$1$2\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def count_tokens(text: Column) -> Column:
    """Letters in a row, digits in a row, and single other characters."""
    return F.regexp_count(text, F.lit(_TOKEN))


def _piece(role: Column, text: Column) -> Column:
    known = F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_END), escape(text), F.lit(ROLE_CLOSE))
    for name, (open_, close) in MARKS.items():
        known = F.when(role == name, F.concat(F.lit(open_), escape(text), F.lit(close))).otherwise(known)
    return known


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str, tokens) -> DataFrame:
    """Turns with position and first token in their conversation."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("piece", _piece(F.col("role"), F.col("text")))
    order = ["conv_id", "turn", "role", "text"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(
        spread.select(
            "conv_id", "role", "piece", tokens(F.col("piece")).cast("bigint").alias("tokens"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
        ),
        "turns",
    )
    sums = rows.groupBy("conv_id", "part").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("t").over(earlier).alias("t0"), F.sum("n").over(earlier).alias("n0")
    ).where("n0 > 0")
    # At most one conversation reaches into a partition from the one before: no more rows than partitions.
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    rows = rows.join(F.broadcast(carried), same, "left")
    here = W.partitionBy("conv_id", "part").orderBy("place")
    return rows.select(
        "conv_id", "role", "piece", "tokens",
        (F.coalesce("n0", F.lit(0)) + F.row_number().over(here) - 1).alias("pos"),
        (F.coalesce("t0", F.lit(0)) + F.sum("tokens").over(here) - F.col("tokens")).alias("first"),
    )


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", tokens=count_tokens,
) -> DataFrame:
    """(conv_id, window, text, tokens, spans): one row per window, numbered in order.

    `spans` lists the turns of the window: position, role, start and end of the piece
    in code points, `fresh` where the turn is not repeated, and `loss_start`,
    `loss_end` of the text under the loss mask (NULL where masked).
    """
    placed = written(_placed(turns, conv, turn, role, text, tokens), "placed")
    lead = placed.where((F.col("pos") == 0) & (F.col("role") == "system")).select(
        F.col("conv_id").alias("s_conv"), F.col("tokens").alias("s_tokens"), F.col("piece").alias("s_piece")
    )
    rows = placed.join(lead.drop("s_piece"), F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").drop("s_conv")
    led = F.coalesce("s_tokens", F.lit(0))
    room = F.greatest(F.lit(budget) - led, F.lit(2 * history))
    stride = room - history
    rows = rows.withColumns({
        "room": room.cast("bigint"),
        "at": F.greatest(F.col("first") - led, F.lit(0)),
        "lead": F.col("s_tokens").isNotNull() & (F.col("pos") == 0),
    })
    rows = rows.withColumn("cell", F.floor(F.col("at") / stride))
    # A turn is also sent to the next cell when it is near enough to be history there.
    near = ~F.col("lead") & (F.col("at") + history >= (F.col("cell") + 1) * stride)
    rows = rows.withColumn("to", F.explode(F.when(near, F.array("cell", F.col("cell") + 1)).otherwise(F.array("cell"))))
    one = F.struct("pos", "at", "tokens", "role", "piece", "lead", (F.col("cell") == F.col("to")).alias("own"))
    cells = rows.groupBy("conv_id", "to", "room", "s_tokens").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    cells = cells.withColumn("own", F.filter("turns", lambda x: x["own"] & ~x["lead"]))
    cells = cells.where((F.size("own") > 0) | F.exists("turns", lambda x: x["lead"]))

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"])

    cells = cells.withColumn("many", (total(F.col("own")) > F.col("room")) & (F.size("own") > 1))
    cells = cells.withColumn("part", F.explode(F.when(F.col("many"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rest, last = F.slice("own", F.lit(1), F.greatest(F.size("own") - 1, F.lit(0))), F.slice("own", F.greatest(F.size("own"), F.lit(1)), F.lit(1))
    cells = cells.withColumn(
        "fresh", F.when(~F.col("many"), F.col("own")).when(F.col("part") == 0, rest).otherwise(last)
    )
    cells = cells.withColumn("begin", F.get("fresh", F.lit(0)))
    cells = cells.withColumn("left", F.least(F.lit(history), F.col("room") - total(F.col("fresh"))))
    cells = cells.withColumn("past", F.filter("turns", lambda x: (
        ~x["lead"] & (x["pos"] < F.col("begin.pos")) & (x["at"] >= F.col("begin.at") - F.col("left"))
    )))
    cells = cells.join(lead.drop("s_tokens"), F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").drop("s_conv")

    def shown(array: Column, fresh: Column) -> Column:
        return F.transform(array, lambda x: F.struct(
            x["pos"].cast("bigint").alias("pos"), x["role"].alias("role"), x["piece"].alias("piece"), x["tokens"].alias("tokens"), fresh.alias("fresh")
        ))

    first = F.coalesce(F.col("begin.pos") == 1, F.lit(True))
    system = F.when(F.col("s_piece").isNotNull(), F.array(F.struct(
        F.lit(0).cast("bigint").alias("pos"), F.lit("system").alias("role"), F.col("s_piece").alias("piece"),
        F.col("s_tokens").alias("tokens"), first.alias("fresh"),
    ))).otherwise(F.filter(shown(F.col("fresh"), F.lit(True)), lambda x: F.lit(False)))
    cells = cells.withColumn("all", F.concat(system, shown(F.col("past"), F.lit(False)), shown(F.col("fresh"), F.lit(True))))
    cells = cells.withColumn("sizes", F.transform("all", lambda x: F.char_length(x["piece"])))
    cells = cells.withColumn("ends", F.transform(
        F.sequence(F.lit(1), F.size("sizes")),
        lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda a, n: a + n),
    ))
    open_, close = MARKS[TARGET]

    def span(x: Column, end: Column) -> Column:
        start = end - F.char_length(x["piece"])
        loss = x["fresh"] & (x["role"] == TARGET)
        return F.struct(
            x["pos"].alias("pos"), x["role"].alias("role"), start.alias("start"), end.alias("end"), x["fresh"].alias("fresh"),
            F.when(loss, start + len(open_)).alias("loss_start"), F.when(loss, end - len(close)).alias("loss_end"),
        )

    return cells.select(
        "conv_id", (F.col("to") * 2 + F.col("part")).alias("window"),
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("text"),
        total(F.col("all")).alias("tokens"),
        F.zip_with("all", "ends", span).alias("spans"),
    )


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted window."""
    found = []
    for m in _PIECES.finditer(text):
        if m.lastgroup == "other":
            found.append((unescape(m["role"]), unescape(m["other"])))
        else:
            found.append((m.lastgroup, unescape(m[m.lastgroup])))
    return found


_DIGEST = [
    T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
    T.StructField("formatted_chars", T.LongType()), T.StructField("n_windows", T.LongType()),
]


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation read back as, in order.

    A digest depends on all text before it, so the windows of one conversation pass
    through one task, one after the other; no more than a window is held.
    """
    rows = formatted.select("conv_id", "window", "text", "spans")
    schema = T.StructType([rows.schema["conv_id"], *_DIGEST])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close():
            if state is not None:
                n, turns, chars, loss, formatted_chars, count = state
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, count))

        def out():
            columns = list(zip(*done)) or [()] * len(arrow)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "spans"))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[4] += len(text)
                state[5] += 1
                for (role, said), span in zip(read_turns(text), spans, strict=True):
                    if span["fresh"]:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    if span["loss_start"] is not None:
                        target = unescape(text[span["loss_start"]:span["loss_end"]])
                        state[2] += len(target)
                        state[3].update(target.encode())
            yield out()
        close()
        yield out()

    return mapped(rows.repartition("conv_id").sortWithinPartitions("conv_id", "window"), run, schema)
