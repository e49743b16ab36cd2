"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule bounds one measure of a text. Measures are expressions over the text,
its words and its lines, so the whole table becomes columns of a single row-wise
projection: no shuffle, no user function, nothing kept beyond one row.

Defined results: a NULL or empty text has no words and fails; measures with an
empty denominator are 0; texts of any length are read whole; repeated rows are judged
each by itself; an empty table gives an empty result; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import free_name, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "al con de del el en es la las lo los no para por que se su un una y "
    "au aux ce dans des du et le les ne pas pour qui sur une est avec par plus "
    "auf das dem den der die ein eine im in ist mit nicht sich und von zu als für"
).split()

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
)
MEASURES = (
    "mean_word_chars", "symbols_per_word", "bangs_per_word", "stop_word_share", "dup_line_share", "words_per_line",
)


@dataclass(frozen=True)
class Rule:
    """A measure with its allowed range, ends included; None leaves an end open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def holds(self, measure: Column) -> Column:
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (measure >= F.lit(float(self.least)))
        if self.most is not None:
            ok = ok & (measure <= F.lit(float(self.most)))
        return ok


RULES = (
    Rule("word_length", "mean_word_chars", least=2.0, most=16.0),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("exclamations", "bangs_per_word", most=0.5),
    Rule("stop_words", "stop_word_share", least=0.03),
    Rule("repeated_lines", "dup_line_share", most=0.5),
    Rule("line_length", "words_per_line", least=1.5),
)


def _repeated_words(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; `windows` holds the hashes by position.

    Equal windows meet by sorting (hash, position); the positions found are then
    walked in order and the union of their spans is summed up.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        at = F.transform(
            s,
            lambda x, k: F.when(
                (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]
            ),
        )
        return F.array_sort(F.filter(at, lambda i: i.isNotNull()))

    # A lambda over a one-element array evaluates the sorted pairs once.
    places = F.transform(F.array(pairs), twice)[0]
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    total = F.aggregate(
        places, start,
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total)


def _from(array: Column, k: int) -> Column:
    """The array without its first k items."""
    return F.slice(array, F.lit(k + 1), F.greatest(F.size(array) - k, F.lit(0)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def judged(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, out: str = "judged") -> DataFrame:
    """The rows with one struct column `out`: counts, measures, `base_failed`, `failed` rules and `kept`."""
    taken = list(docs.columns)
    names = {}
    for part in ("words", "lines", "pairs", "fours", "eights", "windows", "counts", "measures"):
        names[part] = free_name([*taken, *names.values(), out], f"_{part}")
    # Each step below is read several times by the next one, so each is its own projection.
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines, windows, counts, measures = (F.col(names[n]) for n in ("words", "lines", "windows", "counts", "measures"))
    rows = docs.withColumns({
        names["words"]: words_of(F.col(text_col)),
        names["lines"]: F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
    })
    # Hashes of 2, 4 and 8 words in a row, each made of two of the step before.
    for part, source, step in (("pairs", words, 1), ("fours", F.col(names["pairs"]), 2), ("eights", F.col(names["fours"]), 4)):
        rows = rows.withColumn(names[part], F.zip_with(source, _from(source, step), lambda x, y: F.xxhash64(x, y)))
    rows = rows.withColumn(
        names["windows"], F.slice(F.col(names["eights"]), F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    )
    stop = [F.lit(w) for w in STOP_WORDS]
    rows = rows.withColumn(names["counts"], F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("bigint").alias("n_bangs"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(windows).cast("bigint").alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))).cast("bigint").alias("n_stop_words"),
    ))
    n = counts["n_words"]
    rows = rows.withColumn(names["measures"], F.struct(
        _share(counts["word_chars"], n).alias("mean_word_chars"),
        _share(counts["n_symbols"], n).alias("symbols_per_word"),
        _share(counts["n_bangs"], n).alias("bangs_per_word"),
        _share(counts["n_stop_words"], n).alias("stop_word_share"),
        _share(counts["n_dup_lines"], counts["n_lines"]).alias("dup_line_share"),
        _share(n, counts["n_lines"]).alias("words_per_line"),
        ((n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
    ))
    failed = F.array_compact(F.array(*[F.when(~r.holds(measures[r.measure]), F.lit(r.name)) for r in rules]))
    judged_col = F.struct(
        *[counts[c].alias(c) for c in COUNTS], *[measures[m].alias(m) for m in (*MEASURES, "base_failed")],
        failed.alias("failed"),
        (~measures["base_failed"] & (F.size(failed) == 0)).alias("kept"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in taken], judged_col.alias(out))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass, with their own columns only."""
    out, kept = free_name(docs.columns, "_judged"), free_name(docs.columns, "_kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Exploded, the verdict is a plain column: a filter on the expression itself would be moved
    # below the projections, where all measures are worked out again for each of its uses.
    rows = judged(docs, text_col, rules, out).select(*columns, F.explode(F.array(F.col(out)["kept"])).alias(kept))
    return rows.where(F.col(kept)).drop(kept)
