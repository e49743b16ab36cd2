import math
import random
import re
from collections import defaultdict

import pytest
from llm_helpers import SMALL, read

import __spark_entry__ as entry_points
from parley.llm import pii

#: The patterns as they are written down, for short texts.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    def passes(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        if kind == "card":
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0
        return True

    return [
        (kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text) if passes(kind, m.group())
    ]


def plain_spans(texts):
    """Findings per text by counting over all pairs of entities and terms in plain dictionaries."""
    bases = [plain_base(t) for t in texts]
    lower = lambda s: s.translate(str.maketrans(pii.UPPER, pii.LOWER))
    kept = lambda s: pii.TERM_CHARS[0] <= len(s) <= pii.TERM_CHARS[1]
    word = re.compile(r"(?:[0-9A-Za-z']|[^\x00-\x7F])+")
    n_term, n_entity, both, variants = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    near_of, free_of = [], []
    for text, base in zip(texts, bases):
        for term in {lower(m.group()) for m in word.finditer(text) if kept(m.group())}:
            n_term[term] += 1
        free = [
            (lower(m.group()), *m.span()) for m in word.finditer(text)
            if kept(m.group()) and not any(a < m.end() and m.start() < b for _, a, b in base)
        ]
        near = set()
        for kind, a, b in base:
            value = re.sub("[^0-9]", "", text[a:b]) if kind in ("card", "phone") else lower(text[a:b])
            before = [t for t, s, _ in free if s < a][-pii.WINDOW:]
            after = [t for t, s, _ in free if s >= a][:pii.WINDOW]
            near |= {(f"{kind}:{value}", t) for t in before + after}
            near |= {(f"{kind}:{value}", None)}
        for e in {e for e, _ in near}:
            n_entity[e] += 1
        near = {(e, t) for e, t in near if t is not None}
        for pair in near:
            both[pair] += 1
            variants[pair].add(text)
        near_of.append(near)
        free_of.append(free)
    n, share = len(texts), {}
    for (e, t), k in both.items():
        if len(variants[e, t]) >= pii.LEAST_TEXTS and n_entity[e] < n:
            share[e, t] = math.log(n * k / (n_entity[e] * n_term[t])) / math.log(n / n_entity[e])
    out = []
    for base, near, free in zip(bases, near_of, free_of):
        told = defaultdict(float)
        for e, t in near:
            told[t] = max(told[t], share.get((e, t), -1.0))
        more = [
            ("remove" if told[t] >= pii.REMOVE else "generalise", a, b)
            for t, a, b in free if told.get(t, -1.0) >= pii.GENERALISE
        ]
        out.append((base, more))
    return out


def joined(spans):
    order = sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


TELLING = [f"On day {k} Torvaldsen{x} can be reached at +1 (377) 555-0271 or t{k}@mail.example.org today" for k, x in enumerate("   's")]
OTHERS = [f"Plain text number {k} with nothing to protect, can be read on any day or today" for k in range(40)]
EDGES = [
    "a@b", "a@b.c@d.e", "x@y..z", "@@a@b.c.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.2.3.4", "0001.02.003.4", "4736 9625-7309 9581 1",
    "4736962573099581", "+1 2 3 4 5 6 7 8 9", "+123456789012345678", "++12 (34) 56-78.90)", "é@ü.de 😀 ab@cd.ef", "1-2-3", "",
]


@pytest.mark.parametrize("text", EDGES)
def test_patterns_equal_the_plain_ones(text):
    assert pii.base_spans(text) == plain_base(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 1_000_000, "@" * 300_000, "a@" * 200_000, "1" * 1_000_000, "1." * 300_000, "+1 " * 200_000, "a@b" + "-" * 400_000):
        pii.base_spans(text)


def test_telling_terms_are_found_and_hidden(shared):
    docs = shared.createDataFrame(list(enumerate(TELLING + OTHERS)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.scan(docs).collect()}
    name = [TELLING[0].index("Torvaldsen"), TELLING[0].index("Torvaldsen") + len("Torvaldsen")]
    assert f"remove:{name[0]}:{name[1]}" in spans[0]
    assert all(not s for k, s in spans.items() if k >= len(TELLING))
    assert spans == {k: joined(b + m) for k, (b, m) in enumerate(plain_spans(TELLING + OTHERS))}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Torvaldsen" not in clean[0] and "555" not in clean[0] and "[PHONE]" in clean[0] and "[EMAIL]" in clean[0]
    assert "today" in clean[0]
    assert all(clean[len(TELLING) + k] == t for k, t in enumerate(OTHERS))


def test_copies_of_one_text_convict_nothing(shared):
    docs = shared.createDataFrame([(k, TELLING[0]) for k in range(9)] + [(k, t) for k, t in enumerate(OTHERS, 9)], "doc_id long, text string")
    assert not any("remove" in r.spans or "generalise" in r.spans for r in pii.scan(docs).collect())


def test_small_table_equals_plain_counting(shared):
    rows = read(shared, "documents", SMALL.replace("0.001", "0.01")).select("doc_id", "text").collect()
    found = {r.doc_id: r for r in entry_points.queries()["op12_pii"](shared, SMALL.replace("0.001", "0.01")).collect()}
    plain = plain_spans([r.text or "" for r in rows])
    for row, (base, more) in zip(rows, plain):
        assert found[row.doc_id].spans == joined(base + more)
        assert found[row.doc_id].n_email == sum(s[0] == "email" for s in base)


def test_made_documents_equal_plain_counting(shared):
    """People with a number and a nickname each, names also used elsewhere, and common words."""
    draw = random.Random(12)
    common = [f"word{k}" for k in range(30)]
    texts = []
    for k in range(240):
        words = draw.choices(common, k=draw.randrange(5, 40))
        if k % 3 == 0:
            who = draw.randrange(12)
            at = draw.randrange(len(words))
            words[at:at] = [f"Nick{who}", f"Pal{who}", f"+1 (555) 010-{who:04d}", draw.choice(common)]
        if k % 12 == 1:
            words.append(f"Pal{k // 12 % 12}")
        texts.append(" ".join(words))
    docs = shared.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = plain_spans(texts)
    assert {r.doc_id: r.spans for r in pii.scan(docs).collect()} == {k: joined(b + m) for k, (b, m) in enumerate(plain)}
    kinds = {kind for _, more in plain for kind, _, _ in more}
    assert kinds == {"generalise", "remove"}


def test_both_ways_to_bring_the_marks(shared, monkeypatch):
    texts = TELLING + OTHERS + TELLING * 2
    docs = shared.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, pii.scan(docs).collect()))
    monkeypatch.setattr(pii, "is_small", lambda *a: False)
    monkeypatch.setattr(pii, "HOT", 5)
    assert sorted(map(tuple, pii.scan(docs).collect())) == want


def test_odd_documents(odd_documents):
    found = pii.scan(odd_documents)
    assert found.count() == odd_documents.count()
    assert pii.scan(odd_documents.limit(0)).count() == 0
    assert pii.sanitised(odd_documents).columns == odd_documents.columns
    assert pii.sanitised(odd_documents).count() == odd_documents.count()
