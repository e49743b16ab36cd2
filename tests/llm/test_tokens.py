"""BPE round trip and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from llm_helpers import SMALL, read
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from parley.llm import bpe, token_counts
from parley.llm.bpe_files import file_text, read_vocabulary

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LIBRARY = {f: Tokenizer.from_file(f) for f in (WORDS, BYTES)}
ENCODER = bpe.Encoder(read_vocabulary(file_text(WORDS)))
COUNTER = token_counts.Counter(read_vocabulary(file_text(BYTES)))
ODD = [
    "", " ", "<|endoftext|>a<|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ İstanbul ǅ ½²Ⅷ ٣٤ \x1c\x1d a\x85b\xa0c", "é ﬁ Å 가",
    "日本語テキスト𝒳😀👩‍👩‍👧", "don't I'LL we'VE", "aaaaaaaaaaaaaaaa " * 50, "!" * 1000, "x" * 5000, "\n\n  \n a  b   \t", "<|END",
]
ALPHABET = "abcAZ 's'tΣİßǅé́½٣ \n\t\x1c\x85 😀中!#<|>"


def ids_of(text):
    return LIBRARY[WORDS].encode(text or "", add_special_tokens=False).ids


def assert_same(text):
    ids = ids_of(text)
    packed = ENCODER.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert ENCODER.decode(packed) == LIBRARY[WORDS].decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert_same(text)
    assert COUNTER.counts([text, None, text]) == [len(LIBRARY[BYTES].encode(t, add_special_tokens=False).ids) for t in (text, "", text)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(ALPHABET, max_size=80)))
def test_any_text(text):
    assert_same(text)
    assert COUNTER.counts([text]) == [len(LIBRARY[BYTES].encode(text, add_special_tokens=False).ids)]


def test_every_character():
    """All characters, with letters around them: classes, case and composition as in the library."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(every), 1 << 16):
        text = "".join(f"a{c}b:{c}-" for c in every[at:at + (1 << 16)])
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(text)
        assert COUNTER.counts([text]) == [len(LIBRARY[BYTES].encode(text, add_special_tokens=False).ids)]


def test_small_tables_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(200)) for _ in range(60)]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 20)
    monkeypatch.setattr(token_counts, "BATCH_SYMBOLS", 16)
    encoder, counter = bpe.Encoder(ENCODER.vocabulary), token_counts.Counter(ENCODER.vocabulary)
    assert [encoder.encode(t) for t in texts] == [ENCODER.encode(t) for t in texts]
    counter = token_counts.Counter(read_vocabulary(file_text(BYTES)))
    got = [n for at in range(0, 60, 7) for n in counter.counts(texts[at:at + 7])]
    assert got == [len(LIBRARY[BYTES].encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(encoder) <= 20


def want(rows, kind):
    out = {}
    for r in rows:
        text = r.text or ""
        if kind == "bpe":
            ids = ids_of(text)
            decoded = LIBRARY[WORDS].decode(ids, skip_special_tokens=False)
            out[r.doc_id, text] = (
                len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
            )
        else:
            n = len(LIBRARY[BYTES].encode(text, add_special_tokens=False).ids)
            out[r.doc_id, text] = (len(text.encode()), n, n > 512)
    return out


@pytest.mark.parametrize("name, kind", [("op1_bpe_encode_decode", "bpe"), ("op10_token_counts", "count")])
def test_query_equals_library(shared, name, kind):
    expected = {k[0]: v for k, v in want(read(shared, "documents").collect(), kind).items()}
    assert {r[0]: tuple(r[1:]) for r in entry_points.queries()[name](shared, SMALL).collect()} == expected


def test_odd_rows(odd_documents):
    rows = odd_documents.collect()
    counted = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd_documents, BYTES).collect())
    assert counted == sorted((str(r.doc_id), *want([r], "count")[r.doc_id, r.text or ""][:2]) for r in rows)
    encoded = bpe.encode(odd_documents, WORDS)
    assert sorted((str(r.doc_id), len(r.ids) // 4) for r in encoded.collect()) == sorted((str(r.doc_id), len(ids_of(r.text))) for r in rows)
    decoded = bpe.decode(encoded, WORDS).collect()
    both = bpe.encode_and_decode(odd_documents, WORDS).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in decoded) == sorted((str(r.doc_id), r.decoded) for r in both)


def test_empty_table(odd_documents):
    assert bpe.encode_and_decode(odd_documents.limit(0), WORDS).count() == 0
    assert token_counts.token_counts(odd_documents.limit(0), BYTES).count() == 0
