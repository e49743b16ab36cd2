"""Toxicity, URL reputation and site quality."""

import zlib

import pytest
from llm_helpers import SMALL, read
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import oracle
from parley.llm import shrinkage, site_quality, toxicity, url_reputation

MIDDLE = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"  # enough labels for five folds


@pytest.fixture(scope="module")
def toxic(shared):
    return entry_points.queries()["op5_toxicity"](shared, LARGE).cache()


def test_held_out_third(toxic):
    rows = toxic.collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_accuracy(shared, toxic):
    known = toxic.join(read(shared, "labels", LARGE), "doc_id").where("held_out").collect()
    bad = sorted(r.score for r in known if r.toxic)
    good = sorted(r.score for r in known if not r.toxic)
    wins = sum((a > b) + 0.5 * (a == b) for a in bad for b in good)
    assert wins / len(bad) / len(good) > 0.93
    assert sum(r.predicted for r in known if not r.toxic) <= 0.01 * len(good)
    assert sum(r.predicted for r in known if r.toxic) >= 0.85 * len(bad)


def test_disguised_words_and_pronouns_count():
    words = toxicity.Words({"idiot": 3.0, "stup-": 2.0})
    shown = dict(zip(toxicity.FEATURES, toxicity.features("You idiot! STUPIDLY 1d1ot id!ot stuuuupid", words)))
    assert shown["hits"] > 0 and shown["near_you"] > 0 and shown["shouted"] > 0 and shown["exclaimed"] > 0
    assert shown["disguised"] > 0 and shown["drawn_out"] > 0 and shown["most_weight"] == 3.0
    assert len(toxicity.features(None, words)) == len(toxicity.FEATURES) and toxicity.features("", words) == toxicity.features(None, words)


def test_toxicity_of_odd_rows_and_without_labels(shared, odd_documents):
    none = shared.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scores(odd_documents, none).collect()
    assert len(rows) == odd_documents.count() and {r.score for r in rows} == {0.0}
    one = shared.createDataFrame([(1, 1), (1, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.scores(odd_documents, one).count() == odd_documents.count()
    assert toxicity.scores(odd_documents.limit(0), none).count() == 0


def test_url_query_equals_sql(shared):
    key = "op7_url_filter"
    assert oracle.compare(entry_points.queries()[key](shared, SMALL), oracle.connect(SMALL), entry_points.oracle_sql()[key]) is None


URLS = [
    ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/a", "x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/a", "notexample.com", "/en/a", "com/", "allow"),
    ("https://example.com", "example.com", "", None, "allow"),
    ("https://example.com?x=/en/", "example.com", "", None, "allow"),
    ("ftp://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), ("a://b.net#/fr/", "b.net", "", None, "allow"),
    (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://É.org/x://y", "É.org", "/x://y", None, "allow"), ("http://É.org/x://y", "É.org", "/x://y", None, "allow"),
]


def test_rules_and_parts(shared):
    pages = shared.createDataFrame([(k, u[0]) for k, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("other"))
    none = shared.createDataFrame([], "url string, bad int")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.verdicts(pages, none).collect()}
    assert rows == {k: u[1:] for k, u in enumerate(URLS)}
    assert url_reputation.verdicts(pages.limit(0), none).count() == 0


def test_sparse_hosts_lean_on_their_domain(shared):
    told = [(f"http://h{k}.bad.org/", 1) for k in range(20) for _ in range(20)] + [(f"http://h{k}.good.org/", 0) for k in range(20) for _ in range(20)]
    told += [("http://once.good.org/", 1), ("http://x.org/", None)]
    pages = shared.createDataFrame([(k, u) for k, u in enumerate(["http://new.bad.org/", "http://new.good.org/", "http://once.good.org/", "http://h1.bad.org/"])], "page_id long, url string")
    rows = {r.page_id: r for r in url_reputation.verdicts(pages, shared.createDataFrame(told, "url string, bad int")).collect()}
    assert [rows[k].verdict for k in range(4)] == ["block", "allow", "allow", "block"]
    assert rows[1].mean < rows[2].mean < 0.5 and rows[3].lower > 0.9


def test_reputation_decides_and_equals_sql(shared, tmp_path):
    """Tables in which poor articles stand on some hosts, and pages without an article."""
    key, text = "op7_url_filter", "poor words of page {} and so on"
    docs = [(k, text.format(k)) for k in range(300)] + [(900, ""), (901, "!!"), (902, None)]
    labels = [(k, int(k >= 150)) for k in range(300)] + [(900, 0), (901, 0), (902, 0)]
    article = "<html><h1>t</h1><p>{}</p></article></html>"
    pages = [(k, f"http://h{k % 5}.bad.org:8080/{k}", article.format(text.format(k))) for k in range(150)]
    pages += [(k, f"https://user@h{k % 5}.good.org/{k}", article.format(text.format(k))) for k in range(150, 300)]
    pages += [(1000 + k, f"http://plain.example.io/{k}", "no article at all") for k in range(30)]
    pages += [(2000, "http://new.bad.org/", None), (2001, "http://new.good.org/", None), (2002, "http://10.0.0.1:80/", None)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string"), ("labels", labels, "doc_id long, quality int"),
        ("pages", pages, "page_id long, url string, html string"),
    ):
        shared.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    found = entry_points.queries()[key](shared, str(tmp_path))
    assert oracle.compare(found, db, entry_points.oracle_sql()[key]) is None
    verdicts = {r.page_id: r.verdict for r in found.collect()}
    assert all(verdicts[k] == ("block" if k < 150 else "allow") for k in range(300))
    assert all(verdicts[1000 + k] == "allow" for k in range(30))
    assert (verdicts[2000], verdicts[2001], verdicts[2002]) == ("block", "allow", "allow")


def test_suffixes_are_given(shared):
    hosts = shared.createDataFrame([("a.b.co.uk",), ("a.b.city.kobe.jp",), ("x@a.b.org:99",), ("1.2.3.4:5",)], "host string")
    domain, suffix = url_reputation.domain_and_suffix(F.col("host"), ["co.uk", "kobe.jp"])
    assert [tuple(r) for r in hosts.select(domain, suffix).collect()] == [
        ("b.co.uk", "co.uk"), ("city.kobe.jp", "kobe.jp"), ("b.org", "org"), ("1.2.3.4", "")]


def test_strength_finds_the_spread(shared):
    import random

    r = random.Random(3)
    rows = []
    for k in range(2000):
        rate = r.betavariate(0.3 * 20, 0.7 * 20)
        rows.append((k, 50, sum(r.random() < rate for _ in range(50))))
    groups = shared.createDataFrame(rows, "g long, n long, hits long")
    assert 15 < shrinkage.strength(groups, "hits", "n", F.lit(0.3)) < 27


def test_site_quality_agrees_with_labels(shared):
    rows = entry_points.queries()["op8_quality_classifier"](shared, MIDDLE).join(read(shared, "labels", MIDDLE), "doc_id").collect()
    good, poor = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) / len(good) > 0.97 and sum(poor) / len(poor) < 0.1


def test_site_quality_on_hidden_labels(shared):
    """A third of the labels is hidden from the fit and judged afterwards."""
    docs, labels = read(shared, "documents", LARGE), read(shared, "labels", LARGE)
    hidden = F.pmod(F.xxhash64("doc_id", F.lit("hidden")), F.lit(3)) == 0
    rows = site_quality.judged(docs, labels.where(~hidden), F.col("source"), F.col("lang")).join(labels.where(hidden), "doc_id").collect()
    good, poor = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert len(poor) > 100 and sum(good) / len(good) > 0.97 and sum(poor) / len(poor) < 0.1


def test_posteriors_equal_plain_arithmetic(shared):
    import math
    import random

    r = random.Random(8)
    rows = [(k, f"h{k % 7 if k % 3 else 0}", f"p{k % 4}", r.random(), r.choice([None, 0, 1])) for k in range(500)]
    said = [p if q is None else float(q) for _, _, _, p, q in rows]
    overall = sum(said) / len(said)

    def sums(key):
        out = {}
        for row, s in zip(rows, said):
            n, g = out.get(key(row), (0, 0.0))
            out[key(row)] = (n + 1, g + s)
        return out

    def strength(groups):
        top = sum(n * (g / n - m) ** 2 - m * (1 - m) for n, g, m in groups)
        bottom = sum((n - 1) * m * (1 - m) for n, _, m in groups if n > 1)
        return 1 / min(max(top / bottom, shrinkage.LEAST_RHO), shrinkage.MOST_RHO) - 1

    hosts, paths = sums(lambda x: x[1]), sums(lambda x: x[1:3])
    mh = strength([(n, g, overall) for n, g in hosts.values()])
    mean = {h: (g + mh * overall) / (n + mh) for h, (n, g) in hosts.items()}
    mp = strength([(n, g, mean[h]) for (h, _), (n, g) in paths.items()])
    logit = lambda p: math.log(max(1e-4, min(1 - 1e-4, p)) / (1 - max(1e-4, min(1 - 1e-4, p))))
    df = shared.createDataFrame(rows, "doc_id long, host string, path string, p double, quality int")
    found = {x.doc_id: x for x in site_quality.posteriors(df).collect()}
    for (k, h, q, p, _), s in zip(rows, said):
        host_mean = (hosts[h][1] - s + mh * overall) / (hosts[h][0] - 1 + mh)
        path_mean = (paths[h, q][1] - s + mp * host_mean) / (paths[h, q][0] - 1 + mp)
        odds = logit(path_mean) + logit(p) - logit(overall)
        assert math.isclose(found[k].host_mean, host_mean, rel_tol=1e-9) and math.isclose(found[k].path_mean, path_mean, rel_tol=1e-9)
        assert math.isclose(found[k].score, 1 / (1 + math.exp(-odds)), rel_tol=1e-9)


def test_site_evidence_moves_unclear_documents(shared):
    rows = [(k, "good", "a", 0.99, None) for k in range(300)] + [(1000 + k, "poor", "a", 0.02, None) for k in range(300)]
    rows += [(5000, "good", "a", 0.5, None), (5001, "poor", "a", 0.5, None), (5002, "new", None, 0.5, None), (5003, None, "x", 0.5, None)]
    df = shared.createDataFrame(rows, "doc_id long, host string, path string, p double, quality int")
    out = {r.doc_id: r for r in site_quality.posteriors(df).collect()}
    assert len(out) == len(rows) and out[5000].score > 0.8 and out[5001].score < 0.2
    assert abs(out[5002].score - out[5002].path_mean) < 0.2 and 0.3 < out[5003].path_mean < 0.7


def test_site_quality_of_odd_rows(shared, odd_documents):
    none = shared.createDataFrame([], "doc_id long, quality int")
    host, path = F.lit(None).cast("string"), F.lit("p")
    rows = site_quality.judged(odd_documents, none, host, path).collect()
    assert len(rows) == odd_documents.count() and all(r.kept for r in rows)
    assert site_quality.judged(odd_documents.limit(0), none, host, path).count() == 0
