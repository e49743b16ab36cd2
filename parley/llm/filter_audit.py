"""Filter interaction audit: what each filter removes in every order of application.

One table of failing row ids is stored per filter. A prefix of filters is a relation
of (prefix, row): a left-anti join with the next filter's ids leaves the survivors,
a left-semi join gives the removals, and the removals of the empty prefix are all
rows that fail a filter; those that an earlier filter took are redundant. Only rows
that fail something are joined: the others survive every prefix and are counted once.

What a prefix leaves does not depend on its order, so of all orders of a set of
filters only the alphabetical one is carried on: 2^n relations instead of n!.
Labels are laid beside the failing rows once. The joins' key (row, filter) is unique,
so no filter, part or text that holds most rows gathers in one task. Texts that
occur again are found by a 256-bit hash; hashes with more than one row in `HOT` are
met by broadcast, of which there are fewer than `HOT`.

Defined results: a NULL text is empty; a NULL part is the empty string; every row is
a document of its own; a row without id has no labels, and is neither a copy of
another row nor another row's original; rows that share an id are not copies of one
another; of several labels of an id the greatest counts; extra columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import words_of
from parley.session import written

LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
#: A text with more than one row in so many is met by broadcast.
HOT = 1000


def text_conditions(text: Column) -> dict[str, Column]:
    """Filter letter -> whether the text fails it, for the filters that look at one text."""
    words = words_of(text)
    size = F.char_length(text)
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        "C": 100 * (size - F.char_length(F.translate(text, CAPITALS, ""))) > MOST_CAPITAL_PERCENT * size,
        "D": text.rlike(SYMBOLS),
    }


def _copies(rows: DataFrame) -> DataFrame:
    """Row numbers of the texts that a smaller id has too."""
    n = rows.count()
    again = written(
        rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .where("first < last").select("key", "first", "n"),
        "audit-copies",
    )
    hot, rest = (again.where(test).select("key", "first") for test in (F.col("n") * HOT > n, F.col("n") * HOT <= n))
    few = F.broadcast(hot)
    met = rows.join(few, "key").unionByName(rows.join(few.select("key"), "key", "left_anti").join(rest, "key"))
    return met.where("doc_id > first").select("row")


def failing_ids(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """(rows with part and labels, failing rows per filter), both stored; one folder per filter."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    tests = text_conditions(F.col("text"))
    rows = written(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"),
            *[test.alias(name) for name, test in tests.items()],
        ),
        "audit-rows",
    )
    each = [rows.where(name).select("row", F.lit(name).alias("filter")) for name in tests]
    fails = _copies(rows).withColumn("filter", F.lit("E"))
    for ids in each:
        fails = fails.unionByName(ids)
    fails = written(fails, "audit-fails", ["filter"])
    known = labels.groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    marked = rows.select("row", "doc_id", "part").join(known, "doc_id", "left").select(
        "row", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    return marked, fails


def prefix_counts(marked: DataFrame, fails: DataFrame, letters: str = FILTERS) -> tuple[DataFrame, DataFrame]:
    """(removals per prefix, next filter and part; survivors per prefix and part).

    Prefixes are sets, written in alphabetical order. Survivors leave out the rows
    that fail no filter.
    """
    keys = ["row", "filter"]
    at = marked.join(fails, "row", "left_semi").withColumn("prefix", F.lit(""))
    removals, survivors = None, None
    for step in range(len(letters)):
        following = F.filter(F.array(*map(F.lit, letters)), lambda x: ~F.contains(F.col("prefix"), x))
        candidates = at.withColumn("filter", F.explode(following))
        gone = candidates.join(fails, keys, "left_semi")
        removals = gone if removals is None else removals.unionByName(gone)
        left = candidates.join(fails, keys, "left_anti").where(F.col("filter") > F.substring("prefix", -1, 1))
        at = left.withColumn("prefix", F.concat("prefix", "filter")).drop("filter")
        survivors = at if survivors is None else survivors.unionByName(at)
    counted = removals.groupBy("prefix", "filter", "part").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    return counted, survivors.groupBy("prefix", "part").agg(F.count("*").alias("n"))


def _steps(letters: str) -> str:
    """All steps of all orders, as JSON: a fixed list."""
    return json.dumps([
        {"filter_order": "".join(order), "step": k + 1, "filter": order[k], "before": "".join(sorted(order[:k])),
         "after": "".join(sorted(order[:k + 1])), "others": "".join(sorted(set(letters) - {order[k]}))}
        for order in permutations(letters) for k in range(len(letters))
    ])


_STEP = "array<struct<filter_order string, step int, filter string, before string, after string, others string>>"


def _mapped(counts: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """One row per part: at most one entry per prefix and filter."""
    return counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    marked, fails = failing_ids(docs, labels, id_col, text_col, part_col)
    removals, survivors = prefix_counts(marked, fails)
    removals = written(removals, "audit-removals")
    size = len(FILTERS)
    orders = F.element_at(
        F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)]), F.char_length("prefix") + 1
    )
    shares = removals.groupBy("part", "filter").agg(F.sum(F.col("n") * orders).alias("n"))
    parts = marked.groupBy("part").agg(F.count("*").alias("total"))
    clean = marked.join(fails, "row", "left_anti").groupBy("part").agg(F.count("*").alias("clean"))
    tables = [
        _mapped(removals, F.concat("prefix", F.lit(">"), "filter"), F.struct("n", "good", "toxic"), "gone"),
        _mapped(survivors, F.col("prefix"), F.col("n"), "left_over"), _mapped(shares, F.col("filter"), F.col("n"), "share"),
    ]
    grid = parts.join(clean, "part", "left")
    for one in tables:
        grid = grid.join(one, "part", "left")
    grid = grid.withColumn("s", F.explode(F.from_json(F.lit(_steps(FILTERS)), _STEP)))

    def count(found: Column) -> Column:
        return F.coalesce(found, F.lit(0)).cast("bigint")

    def gone(before: Column) -> Column:
        return F.try_element_at("gone", F.concat(before, F.lit(">"), F.col("s.filter")))

    here = gone(F.col("s.before"))
    return grid.select(
        "part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step"),
        (count(F.col("clean")) + count(F.try_element_at("left_over", F.col("s.after")))).alias("kept"),
        count(here["n"]).alias("removed"),
        (count(gone(F.lit(""))["n"]) - count(here["n"])).alias("redundant"),
        count(gone(F.col("s.others"))["n"]).alias("unique_fails"),
        count(here["good"]).alias("good_lost"), count(here["toxic"]).alias("toxic_lost"),
        count(F.try_element_at("share", F.col("s.filter"))).alias("shapley"),
    )
