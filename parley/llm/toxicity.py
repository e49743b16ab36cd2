"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Labels come only from rows outside the held-out third (by the CRC-32 of the id) and
are used in a bounded, hash-chosen sample of `SAMPLE` documents, dealt by hash into
five folds: two teach the lexicon, two the trees, one the calibration.

1. Lexicon: words and word beginnings that occur in significantly more toxic than
   other documents, with their log odds; at most `LEXICON` entries.
2. Features of a whole text: lexicon densities, hits near a second-person pronoun,
   capitals, punctuation, and words disguised by digits and symbols, also looked up
   after undoing the disguise.
3. Gradient-boosted trees, whose margin an isotonic regression turns into a score.

Id, labels, language and source are never features.

Defined results: NULL texts count as empty and are scored like an empty text; a
document labelled several times counts as toxic if one label says so; without
labels of both classes the score of all documents is the share of toxic labels (0
without any); a NULL id is not held out; repeated rows are answered each, and an id
with several texts teaches the first of them; texts of any length are read whole;
only id and text are read, so other columns may have any name; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.common import keyed_texts, mapped
from parley.session import written

#: Bounds of what the model is fitted on.
SAMPLE = 12_000
LEXICON = 1_000

LEAST_DOCS = 4
LEAST_Z = 5.0
LEAST_ODDS = 1.0
STEMS = range(4, 9)
NEAR = 4
CUT = 0.7
KEPT_WORDS = 200_000

#: Pronouns of the second person.
SECOND_PERSON = frozenset(
    "you your yours u ur yourself tu toi vous ton ta tes votre vos du dich dir dein deine euch ihr usted ustedes ti te tus vosotros".split()
)
#: Digits and symbols that stand for letters.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})

WORD = re.compile(r"[^\W\d_]+")
#: Entered at the start of a word only and without giving back letters, so that long words take linear time.
MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[@$!|*+0-9]++[^\W\d_][\w@$!|*+]*+")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
MARKS = re.compile(r"[^\w\s]")
DRAWN = re.compile(r"(.)\1{2,}")

FEATURES = (
    "weight_density", "hit_density", "most_weight", "hits", "kinds", "near_you", "capitals", "shouted",
    "exclaimed", "asked", "marks", "mixed", "disguised", "drawn_out", "size",
)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(word: str) -> Iterator[str]:
    """The word itself and its beginnings, marked as such."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "-"


def _term_counts(labelled: DataFrame) -> DataFrame:
    """(term, n, toxic): documents with the term, counted per batch before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, toxic = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                terms = {t for w in set(WORD.findall((text or "").lower())) for t in _terms(w)}
                total.update(terms)
                if label:
                    toxic.update(terms)
            names = list(total)
            yield pa.RecordBatch.from_pydict(
                {"term": pa.array(names, pa.string()), "n": pa.array([total[t] for t in names], pa.int64()),
                 "toxic": pa.array([toxic[t] for t in names], pa.int64())}
            )

    counts = mapped(labelled.select("text", "label"), run, "term string, n bigint, toxic bigint")
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def lexicon(labelled: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Terms of toxic documents with their log odds, the most significant `size`."""
    docs, toxic = labelled.agg(F.count("*"), F.sum("label")).first()
    toxic = toxic or 0
    clean = docs - toxic
    if not toxic or not clean:
        return {}
    p1 = (F.col("toxic") + 0.5) / (toxic + 1)
    p0 = (F.col("n") - F.col("toxic") + 0.5) / (clean + 1)
    both = (F.col("n") + 1.0) / (docs + 2)
    z = (p1 - p0) / F.sqrt(both * (1 - both) * (1 / toxic + 1 / clean))
    found = _term_counts(labelled).where(F.col("n") >= LEAST_DOCS).select("term", F.log(p1 / p0).alias("odds"), z.alias("z"))
    best = found.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "term").limit(size)
    return {r["term"]: r["odds"] for r in best.collect()}


class Words(dict):
    """Lower-cased word -> (weight, term) of its best lexicon entry, (0, '') when it has none."""

    def __init__(self, entries: dict[str, float]):
        self.entries = entries

    def __missing__(self, word: str) -> tuple[float, str]:
        found = max(((self.entries.get(t, 0.0), t) for t in _terms(word)), default=(0.0, ""))
        if found[0] <= 0:
            found = (0.0, "")
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 48:
            self[word] = found
        return found


def features(text: str | None, words: Words) -> list[float]:
    text = text or ""
    low = WORD.findall(text.lower())
    n = max(1, len(low))
    size = max(1, len(text))
    looked = [words[w] for w in low]
    at = [k for k, (weight, _) in enumerate(looked) if weight]
    near = 0
    if at:
        people = [k for k, w in enumerate(low) if w in SECOND_PERSON]
        for k in at:
            i = bisect_left(people, k - NEAR)
            near += i < len(people) and people[i] <= k + NEAR
    mixed = MIXED.findall(text)
    disguised = sum(words[DRAWN.sub(r"\1", m.lower().translate(PLAIN).replace("*", ""))][0] > 0 for m in mixed)
    drawn = 0
    for m in DRAWN.finditer(text):
        drawn += m.group(1).isalpha()
    capitals = sum(map(len, CAPITALS.findall(text)))
    return [
        sum(looked[k][0] for k in at) / n, len(at) / n, max((looked[k][0] for k in at), default=0.0),
        math.log1p(len(at)), math.log1p(len({looked[k][1] for k in at})), near / n,
        capitals / size, len(SHOUTED.findall(text)) / n, text.count("!") / size, text.count("?") / size,
        len(MARKS.findall(text)) / size, len(mixed) / n, disguised / n, drawn / n, math.log1p(len(low)),
    ]


def with_features(rows: DataFrame, entries: dict[str, float], *kept: str) -> DataFrame:
    """The kept columns and `features`, an array of doubles, from the column `text`."""
    shared = rows.sparkSession.sparkContext.broadcast(entries)
    taken = rows.select(*kept, "text")
    schema = T.StructType([*[taken.schema[c] for c in kept], T.StructField("features", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                found = [features(t, words) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in kept], pa.array(found, pa.list_(pa.float64()))], schema=arrow
                )

    return mapped(taken, run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, label, fold) of at most `size` labelled documents outside the held-out third."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.join(F.broadcast(chosen), "doc_id")  # bounded by the sample size
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one text per id, however often it occurs
    return rows.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).alias("fold"))


def fit(sample: DataFrame) -> tuple[dict[str, float], Callable[[DataFrame], DataFrame]]:
    """The lexicon, and a function that adds `score` to rows with `features`."""
    entries = lexicon(sample.where("fold < 2"))
    rows = written(with_features(sample.where("fold >= 2"), entries, "label", "fold").coalesce(4), "features")
    rows = rows.withColumn("vector", array_to_vector("features"))
    trees_on, scale_on = rows.where("fold < 4"), rows.where("fold = 4")

    def classes(part: DataFrame) -> tuple[int, int]:
        n, toxic = part.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        return n - toxic, toxic

    clean, toxic = classes(trees_on)
    if not clean or not toxic:
        share = toxic / (clean + toxic) if clean + toxic else 0.0
        return entries, lambda scored: scored.withColumn("score", F.lit(float(share)))
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=7
    ).fit(trees_on)

    def margin(scored: DataFrame) -> DataFrame:
        out = trees.transform(scored)
        return out.withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1)))

    if not all(classes(scale_on)):
        def raw(scored: DataFrame) -> DataFrame:
            out = trees.transform(scored.withColumn("vector", array_to_vector("features")))
            return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))

        return entries, raw
    scale = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(
        margin(scale_on).select("margin", F.col("label").cast("double").alias("label"))
    )

    def calibrated(scored: DataFrame) -> DataFrame:
        out = scale.transform(margin(scored.withColumn("vector", array_to_vector("features"))))
        return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")))

    return entries, calibrated


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "toxic", size: int = SAMPLE,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    texts = keyed_texts(docs, id_col, text_col)
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("label"))
    sample = written(labelled_sample(texts, known, size), "labelled")
    entries, score = fit(sample)
    found = score(with_features(texts, entries, "doc_id"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
