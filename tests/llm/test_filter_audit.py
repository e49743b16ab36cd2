from itertools import permutations

from llm_helpers import SMALL, plan_of, read

import __spark_entry__ as entry_points
import oracle
from parley.llm import filter_audit

KEY = "op13_filter_audit"


def plain(rows, labels):
    """All orders walked document by document."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    told = {}
    for i, q, t in labels:
        good, toxic = told.get(i, (False, False))
        told[i] = (good or q == 1, toxic or t == 1)
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and first[text] < i,
        }
        docs.append((part or "", {f for f in fails if fails[f]}, *told.get(i, (False, False))))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in mine)
                share[f] += len(gone)
                found.append((
                    part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone), f,
                ))
        out += [(*r[:-1], share[r[-1]]) for r in found]
    return sorted(out)


def test_small_table_equals_sql(shared):
    assert oracle.compare(entry_points.queries()[KEY](shared, SMALL), oracle.connect(SMALL), entry_points.oracle_sql()[KEY]) is None


def test_small_table_equals_a_walk(shared):
    docs = [tuple(r) for r in read(shared, "documents").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in read(shared, "labels").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, entry_points.queries()[KEY](shared, SMALL).collect())) == plain(docs, labels)


def test_odd_documents(shared, odd_documents):
    docs = odd_documents.selectExpr("*", "if(doc_id % 2 = 0, 'x', null) AS lang", "1 AS row", "true AS A", "'z' AS part", "'z' AS prefix")
    told = [(8, 1, 0), (8, 0, 1), (None, 1, 1), (6, None, 1), (1, 1, None), (77, 1, 1)]
    labels = shared.createDataFrame(told, "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    told = [t for t in told if t[0] is not None]
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == plain(rows, told)
    assert filter_audit.audit(docs.limit(0), labels.limit(0)).count() == 0


def test_a_text_in_most_rows(shared, monkeypatch):
    rows = [(k, "same text", "en") for k in range(60)] + [(k, f"text {k // 2}", "de") for k in range(60, 90)]
    docs = shared.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = shared.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    for hot in (2, 10 ** 6):
        monkeypatch.setattr(filter_audit, "HOT", hot)
        assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == plain(rows, [(3, 1, 1)])


def test_counts_come_from_semi_and_anti_joins(shared):
    marked, fails = filter_audit.failing_ids(read(shared, "documents"), read(shared, "labels"))
    plan = plan_of(filter_audit.prefix_counts(marked, fails)[0])
    assert "LeftSemi" in plan and "LeftAnti" in plan and "Python" not in plan and "Arrow" not in plan
