"""Quality classifier: document evidence combined with shrunk rates of its site.

1. A logistic regression over measures of the text gives each document a
   probability of being good. It is fitted on a bounded, hash-chosen sample of
   `SAMPLE` labelled documents.
2. Every document contributes to its host and path: its label where it has one,
   its probability otherwise. Sums are taken by grouped aggregation.
3. Path rates are shrunk toward their host, hosts toward the whole, with strengths
   estimated from the spread of the rates. A document's own contribution is taken
   out of the sums before they judge it.
4. The classifier's log odds, less those of the overall rate, are added to the log
   odds of the path: the posterior. Documents at `CUT` or above are kept.

Defined results: NULL texts count as empty; a NULL host or path is a group of its
own; several labels of one document count as the lowest; without labels of both
classes the evidence is neutral and everything is kept; texts of any length are read
whole; repeated rows are judged each; only id, text, host and path are read, so other
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm import quality_rules
from parley.llm.shrinkage import shrunk, strength
from parley.operators.keyed import broadcast_if_small
from parley.session import written

SAMPLE = 12_000
CUT = 0.5
LEAST_P = 1e-4


def _features(judged: Column) -> Column:
    n = F.greatest(judged["n_words"], F.lit(1))
    return F.array(
        F.least(judged["symbols_per_word"], F.lit(2.0)), F.least(judged["bangs_per_word"], F.lit(2.0)),
        judged["stop_word_share"], judged["dup_line_share"], judged["n_repeat_words"] / n,
        F.least(judged["mean_word_chars"], F.lit(20.0)), F.log1p(judged["words_per_line"]), F.log1p(judged["n_words"].cast("double")),
    )


def measured(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, features) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host.alias("host"), path.alias("path"))
    return quality_rules.judged(rows).select("doc_id", "host", "path", _features(F.col("judged")).alias("features"))


def fit(labelled: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
    """A function that adds `p` to rows with `features`, from (features, quality); None without both classes."""
    n, good = labelled.agg(F.count("*"), F.sum("quality")).first()
    if not n or not good or good == n:
        return None
    model = LogisticRegression(featuresCol="vector", labelCol="quality", regParam=1e-3, maxIter=50).fit(
        labelled.withColumn("vector", array_to_vector("features"))
    )

    def add(rows: DataFrame) -> DataFrame:
        out = model.transform(rows.withColumn("vector", array_to_vector("features")))
        p = F.get(vector_to_array("probability"), F.lit(1))
        return out.withColumn("p", p).drop("vector", "rawPrediction", "probability", "prediction")

    return add


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(LEAST_P), F.least(F.lit(1 - LEAST_P), p))
    return F.log(p / (1 - p))


def posteriors(rows: DataFrame) -> DataFrame:
    """Adds host_mean, path_mean and score to (doc_id, host, path, p, quality)."""
    said = F.coalesce(F.col("quality").cast("double"), F.col("p"))
    rows = rows.withColumn("said", said)
    paths = written(
        rows.groupBy("host", "path").agg(F.count("*").alias("pn"), F.sum("said").alias("pg")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("pg").alias("hg"))
    n, good = hosts.agg(F.sum("hn"), F.sum("hg")).first()
    overall = F.lit(good / n if n else 0.5)
    m_host = strength(hosts, "hg", "hn", overall)
    same = F.col("host").eqNullSafe(F.col("h"))
    both = paths.join(hosts.withColumnRenamed("host", "h"), same).drop("h")
    m_path = strength(both, "pg", "pn", shrunk(F.col("hg"), F.col("hn"), overall, m_host))
    both = both.withColumnsRenamed({"host": "h", "path": "q"})
    found = rows.join(broadcast_if_small(both), same & F.col("path").eqNullSafe(F.col("q"))).drop("h", "q")
    # Sums without the document itself.
    host_mean = shrunk(F.col("hg") - F.col("said"), F.col("hn") - 1, overall, m_host)
    found = found.withColumn("host_mean", host_mean)
    found = found.withColumn("path_mean", shrunk(F.col("pg") - F.col("said"), F.col("pn") - 1, F.col("host_mean"), m_path))
    odds = _logit(F.col("path_mean")) + _logit(F.col("p")) - _logit(overall)
    return found.withColumn("score", 1 / (1 + F.exp(-odds)))


def judged(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
    size: int = SAMPLE,
) -> DataFrame:
    """(doc_id, host, path, p, host_mean, path_mean, score, kept) of every document.

    `labels` has (doc_id, quality) with quality 0 or 1; `host` and `path` are
    expressions over `docs`.
    """
    told = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = written(measured(docs, id_col, text_col, host, path), "measured")
    rows = rows.join(told, "doc_id", "left")
    chosen = rows.where(F.col("quality").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    model = fit(written(chosen.select("features", "quality"), "labelled").coalesce(4))
    scored = model(rows) if model else rows.withColumn("p", F.lit(0.5))
    scored = written(scored.select("doc_id", "host", "path", "p", "quality"), "evidence")
    return posteriors(scored).select(
        "doc_id", "host", "path", "p", "host_mean", "path_mean", "score", (F.col("score") >= CUT).alias("kept")
    )
