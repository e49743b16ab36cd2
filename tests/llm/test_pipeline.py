"""The pipeline stage by stage against plain versions, and what it does to planted rows."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import SMALL, read
from test_decontaminate import plain_pairs
from test_quality_rules import plain as plain_counts
from test_secret_scan import plain_base
from test_simhash import plain_similar_of_each
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from parley.llm import quality_rules


def plain_good(text):
    n, chars, symbols, _, repeat = plain_counts(text)
    if n < 20 or 100 * repeat > 30 * n:
        return False
    words = (text or "").split()
    lines = [x for x in text.split("\n") if x.strip()]
    measures = {
        "mean_word_chars": chars / n, "symbols_per_word": symbols / n, "bangs_per_word": text.count("!") / n,
        "stop_word_share": sum(w.lower() in quality_rules.STOP_WORDS for w in words) / n,
        "dup_line_share": (len(lines) - len(set(lines))) / len(lines), "words_per_line": n / len(lines),
    }
    return all(
        (r.least is None or measures[r.measure] >= r.least) and (r.most is None or measures[r.measure] <= r.most)
        for r in quality_rules.RULES
    )


def test_equals_plain_pipeline(shared):
    """Stage by stage; the fourth is held to plain patterns, and to the library on what it returns."""
    docs = [(r.doc_id, r.text) for r in read(shared, "documents").collect()]
    items = [tuple(r) for r in read(shared, "benchmark").select("item_id", "text").collect()]
    good = [(i, t) for i, t in docs if plain_good(t)]
    one = plain_similar_of_each(good)
    leaked = {d for d, _ in plain_pairs(one, items)}
    clean = [(i, t) for i, t in one if i not in leaked]
    assert 0 < len(clean) < len(one) < len(good) < len(docs)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in entry_points.queries()["pipeline"](shared, SMALL).collect()}
    assert set(rows) == {i for i, _ in clean}
    left = shared.createDataFrame(clean, "doc_id long, text string")
    hidden = {r.doc_id: r.text for r in corpus_pipeline.STAGES[3][1](shared, left, SMALL).collect()}
    for i, text in clean:
        spans = plain_base(text)
        assert all(text[a:b] not in hidden[i] for a, _, b in spans) and (spans or hidden[i] == text or "[SECRET]" in hidden[i])
        ids = np.array(library.encode(hidden[i], add_special_tokens=False).ids, "<u4").tobytes()
        assert rows[i].ids_sha256 == hashlib.sha256(ids).hexdigest() and rows[i].n_tokens == len(ids) // 4


@pytest.mark.parametrize("k", range(4))
def test_stages_return_the_columns_of_documents(shared, odd_documents, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(shared, odd_documents, SMALL)
    assert out.columns == odd_documents.columns
    assert out.count() <= odd_documents.count()
    assert stage(shared, odd_documents.limit(0), SMALL).count() == 0


def test_last_stage_takes_odd_rows(shared, odd_documents):
    _, stage = corpus_pipeline.STAGES[-1]
    assert stage(shared, odd_documents, SMALL).count() == odd_documents.count()
