from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from llm_helpers import SMALL, plan_of, read
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import oracle
from parley.llm import quality_rules

KEY = "op6_quality_rules"


def plain(text):
    import re

    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    spots = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeat = {i + k for i in range(len(words) - 7) if spots[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(repeat),
    )


def counts(df):
    rows = quality_rules.judged(df).select("doc_id", "judged.*").collect()
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows], rows


def test_equals_sql(shared):
    db = oracle.connect(SMALL)
    assert oracle.compare(entry_points.queries()[KEY](shared, SMALL), db, entry_points.oracle_sql()[KEY]) is None


def test_plan_is_a_projection(shared):
    plan = plan_of(entry_points.queries()[KEY](shared, SMALL))
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas", "Join"))


words = st.sampled_from(["a", "b", "the", "x|", "é", "&&"])
gaps = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x0b"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(words, gaps), max_size=60), min_size=1, max_size=20))
def test_equals_plain_counts(shared, texts):
    texts = ["".join(w + g for w, g in t) for t in texts]
    df = shared.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert counts(df)[0] == [plain(t) for t in texts]


def test_odd_rows(odd_documents):
    found, rows = counts(odd_documents.coalesce(1))
    texts = [r.text for r in odd_documents.coalesce(1).collect()]
    assert found == [plain(t) for t in texts]
    assert all(r.base_failed and not r.kept for r, t in zip(rows, texts) if not (t or "").strip())


def test_extra_columns_pass_through(odd_documents):
    long = " ".join(f"the w{i}" for i in range(30))
    good = odd_documents.withColumn("text", F.lit(long))
    kept = quality_rules.keep_good(good)
    assert kept.columns == good.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, good.collect()))
    assert quality_rules.keep_good(odd_documents).columns == odd_documents.columns


def test_empty_table(odd_documents):
    assert quality_rules.judged(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("wanted, least", [(1, 0.95), (0, 0.05)])
def test_agrees_with_labels(shared, wanted, least):
    docs = quality_rules.judged(read(shared, "documents", "/root/testdata/sf0.01"))
    rows = docs.join(read(shared, "labels", "/root/testdata/sf0.01"), "doc_id").where(f"quality = {wanted}")
    share = rows.selectExpr("avg(cast(judged.kept as int)) as k").first().k
    assert share >= least if wanted else share <= least
