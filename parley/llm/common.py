"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from parley.session import ship

#: Blanks between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def free_name(taken: Iterable[str], base: str) -> str:
    """A column name that is not taken yet, whatever the letter case."""
    used = {name.lower() for name in taken}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The words of a text; none for an empty or missing one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, so that other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def salted_left_join(rows: DataFrame, side: DataFrame, key: Sequence[str], hot_keys: DataFrame, salts: int = 64) -> DataFrame:
    """rows left join side on `key`, which is unique in `side`.

    The rows of the few `hot_keys` are dealt over `salts` tasks, and those rows of
    `side` sent to each; only the keys are broadcast.
    """
    hot, salt = free_name([*rows.columns, *side.columns], "_hot"), free_name([*rows.columns, *side.columns], "_salt")
    few = F.broadcast(hot_keys.select(*key).withColumn(hot, F.lit(True)))
    dealt = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(few, [*key], "left")
    dealt = dealt.withColumn(salt, F.when(F.col(hot), F.col(salt)).otherwise(0)).drop(hot)
    copies = F.sequence(F.lit(0), F.when(F.col(hot), F.lit(salts - 1)).otherwise(0))
    sent = side.join(few, [*key], "left").withColumn(salt, F.explode(copies)).drop(hot)
    return dealt.join(sent, [*key, salt], "left").drop(salt)


def mapped(rows: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` with a function of this package, which the executors need not have."""
    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)
