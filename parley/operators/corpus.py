"""Text corpora: one person's direct messages, chunks of them, transcripts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

from parley.functions.text import body
from parley.operators.keyed import first_n_per_group, running_start
from parley.session import written

# Executors need not have this package installed: its task functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_CHARS = 15_000
TRANSCRIPT_BUDGET = 50_000
# Headers of a transcript, and the author of messages without one.
CHANNEL_HEADER, DM_HEADER, HEADER_END, NO_AUTHOR = "\n=== CHANNEL: ", "\n=== DM: ", " ===", "None"
# Shortest possible transcript: line break and a header without names.
SHORTEST_TRANSCRIPT = len(DM_HEADER + HEADER_END)
BLOCK_CHARS = 4_000_000


def _first_messages(messages: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first n messages of each conversation, or all of them."""
    by_time = [F.asc("ts_us"), F.asc("id")] if order == "oldest" else [F.desc("ts_us"), F.desc("id")]
    narrow = messages.select("conversation_name", "id", "ts_us", "user_name", "clean_text", "text")
    return narrow if n is None else first_n_per_group(narrow, ["conversation_name"], by_time, ["id"], n)


def _last_times(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_name").agg(F.max("ts_us").alias("last_ts_us"))


def user_corpus(
    messages: DataFrame, conversations: DataFrame, user_name: str | None = None,
    per_conversation: int | None = None, order: str = "oldest",
) -> DataFrame:
    """Texts a user wrote in DMs (among the first `per_conversation` messages of each, if given); all users when none is named.

    Reading order: DMs by last activity, newest first, then messages by time.
    """
    dms = conversations.where(F.col("type") == "dm").select(F.col("name").alias("conversation_name")).distinct()
    in_dms = messages.join(dms, "conversation_name", "left_semi")
    first = _first_messages(in_dms, per_conversation, order)
    theirs = first.where(F.col("user_name").isNotNull() if user_name is None else F.col("user_name") == user_name)
    texts = theirs.withColumn("text", body(F.col("clean_text"), F.col("text"))).where("text is not null")
    return texts.join(_last_times(in_dms), "conversation_name").select(
        "user_name", "conversation_name", "last_ts_us", "ts_us", "id", "text"
    )


def _offsets(texts: DataFrame) -> DataFrame:
    """(_row, user_name, size, start, block): characters before each text in its user's reading order.

    Each text counts one line break. Summed per DM first; only one row per (user, DM)
    is ordered per user. Sizes are ordered and summed, the texts stay where they are.
    """
    dm = ["user_name", "conversation_name"]
    sized = texts.select("_row", *dm, "last_ts_us", "ts_us", "id", (F.char_length("text") + 1).cast("bigint").alias("size"))
    per_dm = sized.groupBy(*dm, "last_ts_us").agg(F.sum("size").alias("_dm_size"))
    earlier = (
        W.partitionBy("user_name").orderBy(F.desc("last_ts_us"), "conversation_name")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    starts = per_dm.select(*dm, F.coalesce(F.sum("_dm_size").over(earlier), F.lit(0)).alias("_dm_start"))
    inside = running_start(sized, dm, ["ts_us", "id"], "size", "_row").withColumnRenamed("start", "_inside")
    placed = sized.join(inside, "_row").join(starts, dm).withColumn("start", F.col("_dm_start") + F.col("_inside"))
    return placed.select(
        "_row", "user_name", "size", "start", F.floor(F.col("start") / F.lit(BLOCK_CHARS)).cast("bigint").alias("block")
    )


def _next_breaks(start: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """For a chunk starting at text i, the text that starts the next chunk."""
    ends = start + size
    return np.maximum(np.searchsorted(ends, start + limit, side="right"), np.arange(len(size)) + 1)


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted batches; one run at a time is held."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if pdf.empty:
            continue
        changed = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        cuts = np.flatnonzero(changed)
        if held and (held[-1][keys].iloc[-1] == pdf[keys].iloc[0]).all():
            cuts = cuts[1:]
        for cut_from, cut_to in zip([0, *cuts], [*cuts, len(pdf)]):
            if cut_from == cut_to:
                continue
            if held and cut_from in cuts:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[cut_from:cut_to])
    if held:
        yield pd.concat(held, ignore_index=True)


def _in_frames(parts: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Small results gathered into batches."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _per_run(keys: list[str], run):
    """A mapInPandas function that applies `run` to each run of equal keys."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_frames(run(pdf) for pdf in _groups(frames, keys))

    return apply


def _summarise_block(limit: int):
    """What a block does to the fill of the chunk that is open when it begins.

    The first break falls on text p, the first with fill + characters up to p
    above the limit; from there on the chunks of the block do not depend on the
    fill. So one entry per possible p describes the block in full.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, size = pdf["start"].to_numpy("int64"), pdf["size"].to_numpy("int64")
        n, total = len(size), int(size.sum())
        upto = start + size - start[0]
        last = int(np.searchsorted(upto, limit, side="right"))
        first_breaks = range(min(last + 1, n))
        nxt = _next_breaks(start, size, limit)
        breaks, fill = {}, {}
        for p in first_breaks:
            path, i = [], p
            while i < n and i not in breaks:
                path.append(i)
                i = int(nxt[i])
            for j in reversed(path):
                after = int(nxt[j])
                inside = after < n
                breaks[j] = 1 + (breaks[after] if inside else 0)
                fill[j] = fill[after] if inside else total - int(upto[j] - size[j])
        return pd.DataFrame(
            {
                "user_name": [pdf["user_name"].iloc[0]],
                "block": [int(pdf["block"].iloc[0])],
                "total": [total],
                "upto": [upto[: len(first_breaks)].tolist()],
                "breaks": [[breaks[p] for p in first_breaks]],
                "fill": [[fill[p] for p in first_breaks]],
            }
        )

    return run


def _enter_blocks(limit: int):
    """Walk block summaries in order: chunk number and fill at the start of each block."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, chunk, fill = None, 0, 0
        for pdf in frames:
            entry = []
            for who, total, upto, breaks, left in zip(
                pdf["user_name"], pdf["total"], pdf["upto"], pdf["breaks"], pdf["fill"]
            ):
                if who != user:
                    user, chunk, fill = who, 0, 0
                entry.append((chunk, fill))
                p = int(np.searchsorted(np.asarray(upto), limit - fill, side="right"))
                if p < len(upto) and fill + total > limit:
                    # An empty chunk is never closed: a user's first text cannot start a second one.
                    first_empty = 1 if fill == 0 and p == 0 else 0
                    chunk, fill = chunk + int(breaks[p]) - first_empty, int(left[p])
                else:
                    fill += int(total)
            yield pd.DataFrame(
                {
                    "user_name": pdf["user_name"].to_numpy(),
                    "block": pdf["block"].to_numpy(),
                    "entry_chunk": [c for c, _ in entry],
                    "entry_fill": [f for _, f in entry],
                }
            )

    return walk


def _place_texts(limit: int):
    """Chunk number of each text of a block, given the state at its start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, size = pdf["start"].to_numpy("int64"), pdf["size"].to_numpy("int64")
        chunk, fill = int(pdf["entry_chunk"].iloc[0]), int(pdf["entry_fill"].iloc[0])
        n = len(size)
        numbers = np.empty(n, dtype="int64")
        upto = start + size - start[0]
        i = int(np.searchsorted(upto, limit - fill, side="right"))
        numbers[:i] = chunk
        if i == 0 and fill == 0:
            chunk -= 1
        nxt = _next_breaks(start, size, limit)
        while i < n:
            chunk += 1
            after = int(nxt[i])
            numbers[i:after] = chunk
            i = after
        return pd.DataFrame({"_row": pdf["_row"], "start": start, "chunk_no": numbers})

    return run


def chunk_corpus(corpus: DataFrame, max_length: int = CHUNK_CHARS) -> DataFrame:
    """Greedy chunks of at most `max_length` characters per user, every text followed by a line break.

    A text longer than the limit is a chunk of its own; empty chunks are not
    made. Greedy filling depends on everything before, yet no task reads a whole
    user: texts are cut into blocks by their character offset, each block is
    reduced to a short table, the tables are walked in order, and each block then
    numbers its own texts. Sizes travel through Python, texts do not. Texts and
    offsets are written out first, as several steps read them.
    """
    kept = written(corpus.withColumn("_row", F.monotonically_increasing_id()), "corpus")
    sizes = written(_offsets(kept), "offsets")
    block = ["user_name", "block"]
    summaries = sizes.drop("_row").repartition(*block).sortWithinPartitions("user_name", "start").mapInPandas(
        _per_run(block, _summarise_block(max_length)),
        "user_name string, block bigint, total bigint, upto array<bigint>, breaks array<bigint>, fill array<bigint>",
    )
    entries = summaries.repartition("user_name").sortWithinPartitions(*block).mapInPandas(
        _enter_blocks(max_length), "user_name string, block bigint, entry_chunk bigint, entry_fill bigint"
    )
    placed = (
        sizes.join(entries, block).repartition(*block).sortWithinPartitions("user_name", "start")
        .mapInPandas(_per_run(block, _place_texts(max_length)), "_row bigint, start bigint, chunk_no bigint")
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda s: s["text"])
    # A chunk holds at most max_length characters or one text.
    return (
        kept.select("_row", "user_name", "text").join(placed, "_row")
        .groupBy("user_name", "chunk_no")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.concat(F.array_join(texts, "\n"), F.lit("\n")).alias("chunk"),
        )
    )


def _lines(
    messages: DataFrame, per_conversation: int | None, order: str, line_chars: int | None
) -> DataFrame:
    """(name, ts_us, id, line) per message, `user: text`; the line is NULL without a text."""
    said = body(F.col("clean_text"), F.col("text"))
    if line_chars is not None:
        said = F.substring(said, 1, line_chars)
    line = F.concat(F.coalesce("user_name", F.lit(NO_AUTHOR)), F.lit(": "), said)
    return _first_messages(messages, per_conversation, order).select(
        F.col("conversation_name").alias("name"), "ts_us", "id", line.alias("line")
    )


def _header():
    return F.when(
        F.col("type") == "channel", F.concat(F.lit(CHANNEL_HEADER), "name", F.lit(HEADER_END))
    ).otherwise(
        F.concat(
            F.lit(DM_HEADER),
            F.coalesce(F.array_join("participants", " & "), F.lit("")),
            F.lit(HEADER_END),
        )
    )


def _joined(order: tuple[str, ...] = ("ts_us", "id"), lines: str = "line"):
    """Aggregate: the lines in order, joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(lines).isNotNull(), F.struct(*order, lines))))
    return F.array_join(F.transform(ordered, lambda s: s[lines]), "\n")


def _line_blocks(lines: DataFrame, block_chars: int) -> DataFrame:
    """(name, block, text): the lines of each block of `block_chars` characters joined.

    `lines` are written aside and carry `_row`. Offsets come from the sizes alone, and
    no task orders a whole conversation.
    """
    sized = lines.where("line is not null").select(
        "_row", "name", "ts_us", "id", F.xxhash64("line").alias("_hash"), (F.char_length("line") + 1).cast("bigint").alias("_size")
    )
    starts = running_start(sized, ["name"], ["ts_us", "id", "_hash"], "_size", "_row")
    placed = lines.select("_row", "name", "line").join(starts, "_row")
    return placed.withColumn("block", F.floor(F.col("start") / F.lit(block_chars)).cast("bigint")).groupBy("name", "block").agg(
        _joined(("start",)).alias("text")
    )


def _kept_lines(
    messages: DataFrame, per_conversation: int | None, order: str, line_chars: int | None
) -> DataFrame:
    """The lines, numbered and written aside, as names, sizes and texts are read from them."""
    lines = _lines(messages, per_conversation, order, line_chars)
    return written(lines.withColumn("_row", F.monotonically_increasing_id()), "lines")


def transcript_blocks(
    messages: DataFrame, conversations: DataFrame, per_conversation: int | None = None,
    order: str = "oldest", line_chars: int | None = None, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Transcripts as rows (id, conversation_name, type, block, text) in place of one string each.

    A line belongs to the block that its character offset among the lines falls
    into, so a block holds at most `block_chars` characters and the rest of its
    last line. The header opens block 0; block numbers may have gaps behind long
    lines. The blocks of a conversation joined by line breaks are its transcript.
    """
    lines = _kept_lines(messages, per_conversation, order, line_chars)
    # Without any line there is no block; the header alone is block 0 then.
    rows = conversations.join(lines.select("name").distinct(), "name").join(
        _line_blocks(lines, block_chars), "name", "left"
    ).withColumn("block", F.coalesce("block", F.lit(0)))
    return rows.select(
        "id", F.col("name").alias("conversation_name"), "type", "block",
        F.when(F.col("block") == 0, F.concat_ws("\n", _header(), "text")).otherwise(F.col("text")).alias("text"),
    )


def transcripts(
    messages: DataFrame, conversations: DataFrame, per_conversation: int | None = None,
    order: str = "oldest", line_chars: int | None = None,
) -> DataFrame:
    """Per conversation a header and `user: text` lines of its first messages.

    `per_conversation` and `line_chars` shorten transcripts only when they are given.
    Conversations without messages are left out. Each is one string in one row;
    `transcript_blocks` gives conversations that do not fit a row.
    """
    lines = _kept_lines(messages, per_conversation, order, line_chars)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"])
    bodies = _line_blocks(lines, BLOCK_CHARS).groupBy("name").agg(F.array_join(texts, "\n").alias("_text"))
    return conversations.join(lines.select("name").distinct(), "name").join(bodies, "name", "left").select(
        "id", F.col("name").alias("conversation_name"), "type",
        F.concat_ws("\n", _header(), "_text").alias("transcript"),
    )


def transcript_budget(
    messages: DataFrame, conversations: DataFrame, budget: int = TRANSCRIPT_BUDGET,
    per_conversation: int | None = None, order: str = "oldest", line_chars: int | None = None,
) -> DataFrame:
    """The part of the joined transcript that fits the budget, one row per conversation.

    Conversations come newest first. Every one of them takes at least a header
    and a joining line break, which bounds how many can fit: only those are
    measured, and the running sum runs over that short list. Of the conversations
    that fit, only lines that begin inside the budget are joined.
    """
    can_fit = budget // (SHORTEST_TRANSCRIPT + 1) + 1
    newest = written(
        conversations.join(_last_times(messages).withColumnRenamed("conversation_name", "name"), "name")
        .orderBy(F.desc("last_ts_us"), "id").limit(can_fit),
        "newest",
    )
    names = newest.select(F.col("name").alias("conversation_name")).distinct()
    lines = _lines(
        messages.join(F.broadcast(names), "conversation_name", "left_semi"), per_conversation, order, line_chars
    )
    size = F.coalesce(F.char_length("line") + 1, F.lit(0)).cast("bigint")
    sizes = newest.join(lines.groupBy("name").agg(F.sum(size).alias("_lines_size")), "name").select(
        "id", "name", "last_ts_us", _header().alias("_header"), "_lines_size"
    )
    # At most `can_fit` rows, so one task may order them.
    before = W.orderBy(F.desc("last_ts_us"), "id").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn(
        "start", F.coalesce(F.sum(F.char_length("_header") + F.col("_lines_size") + 1).over(before), F.lit(0))
    )
    kept = written(placed.where(F.col("start") < budget), "kept")
    # A line takes at least three characters with its line break, so later ones begin beyond the budget.
    fitting = lines.where("line is not null").join(F.broadcast(kept.select("name").distinct()), "name", "left_semi")
    fitting = first_n_per_group(
        fitting, ["name"], [F.asc("ts_us"), F.asc("id"), F.asc("line")], ["id"], budget // 3 + 1
    )
    inside = W.partitionBy("name").orderBy("ts_us", "id", "line").rowsBetween(W.unboundedPreceding, -1)
    fitting = fitting.withColumn("_at", F.coalesce(F.sum(F.char_length("line") + 1).over(inside), F.lit(0)))
    bodies = (
        fitting.where(F.col("_at") < budget).withColumn("line", F.substring("line", 1, budget))
        .groupBy("name").agg(_joined().alias("_text"))
    )
    return kept.join(bodies, "name", "left").select(
        "id", F.col("name").alias("conversation_name"), "start",
        F.substring(F.concat_ws("\n", "_header", "_text"), F.lit(1), (F.lit(budget) - F.col("start")).cast("int")).alias("part"),
    )


def joined_transcript(parts: DataFrame, budget: int = TRANSCRIPT_BUDGET) -> DataFrame:
    """The budgeted parts as one text of at most `budget` characters."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda s: s["part"])
    return parts.agg(F.substring(F.array_join(ordered, "\n"), 1, budget).alias("transcript"))
