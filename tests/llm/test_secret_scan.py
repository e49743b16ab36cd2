import hashlib
import random
import re

import pytest
from llm_helpers import SMALL, read
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from parley.llm import secret_scan

KINDS = ("assign", "access", "hex")


def plain_base(text):
    text, out = text or "", []
    pattern = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


PARTS = ["AKIA", "token", "SECRET", "api_key", "ApiKey", "passwd", " ", "=", ":", '"', "'", "a1", "ff00" * 9, "ABC123XYZ09", "é", "ſecret", "\n", ".-", "zz"]


@pytest.mark.parametrize("seed", range(20))
def test_base_spans_equal_plain_patterns(seed):
    r = random.Random(seed)
    for _ in range(200):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
        assert [(s.start, KINDS.index(s.kind), s.end) for s in secret_scan.base_spans(text)] == plain_base(text)


def test_query_keeps_the_base(shared):
    texts = {r.doc_id: r.text for r in read(shared, "documents", "/root/testdata/sf0.01").collect()}
    rows = entry_points.queries()["op3_secret_scan"](shared, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(filter(None, listed(base).split(","))) <= set(r.spans.split(","))
    assert sum(r.n_assign for r in rows) > 0


def keys(n, letters, size, seed):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(size)) for _ in range(n)]


def test_automata_know_formats_from_words():
    hexes = keys(300, "0123456789abcdef", 40, 1)
    marked = ["sk_live_" + k for k in keys(300, "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 24, 2)]
    words = ["".join(p) for p in zip(keys(500, "etaoinsr", 3, 3), keys(500, "hldcum", 3, 4))]
    formats = secret_scan.Formats.fit({"hex": hexes, "assign": marked}, words)
    assert all(formats.accepts(k) for k in keys(50, "0123456789abcdef", 24, 5))
    assert sum(formats.accepts("sk_live_" + k) for k in keys(50, "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 24, 6)) >= 45
    for usual in ("www.example.org/en/8423", "2024-01-01T00:00:00", "version-2.0-beta-release", "chapter12andverse34ofthebook"):
        assert not formats.accepts(usual)


def test_merging_keeps_different_states_apart():
    """Strings of the form x?y+ : after many examples the second letter is never x."""
    automaton = secret_scan.Automaton(["x" + "y" * k for k in range(1, 60)] + ["y" * k for k in range(1, 60)])
    assert 1 < len(automaton.states) < 10
    assert automaton.score("xyyy") > automaton.score("xxyy") and automaton.score("yyyy") > automaton.score("yxyy")
    assert sum(s.ends for s in automaton.states) == 118


def test_added_spans_and_redaction(shared):
    hexes = keys(40, "0123456789abcdef", 40, 7)
    rows = [(k, f"plain words and token = '{h}' after") for k, h in enumerate(hexes)]
    rows += [(100, "loose 3f9ac0de77b1d2e4a9c0 key"), (101, "clean text of 2024-01-01T00:00:00 and more"), (102, None), (103, "")]
    df = shared.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(7))
    found = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    assert found[100] == "format:6:26" and not found[101] and not found[102] and not found[103]
    out = {r.doc_id: r for r in secret_scan.redact(df, length_col="n_chars").collect()}
    assert out[100].text == "loose [SECRET] key" and out[100].n_chars == 18
    assert out[101].text == rows[-3][1] and out[101].n_chars == 7 and out[102].text is None and out[103].text == ""
    assert not any(hexes[k] in out[k].text for k in range(40)) and len(out) == len(rows)


def test_odd_rows(shared, odd_documents):
    rows = secret_scan.scan(odd_documents).collect()
    assert sorted((str(r.doc_id), r.base) for r in rows) == sorted(
        (str(r.doc_id), listed(plain_base(r.text))) for r in odd_documents.collect()
    )
    hidden = secret_scan.redact(odd_documents)
    assert hidden.columns == odd_documents.columns and hidden.count() == odd_documents.count()
    assert secret_scan.scan(odd_documents.limit(0)).count() == 0 and secret_scan.redact(odd_documents.limit(0)).count() == 0


def found_in(formats, text):
    return [s.value for s in secret_scan.format_spans(text, secret_scan.base_spans(text), formats)]


def test_pieces_short_keys_and_what_remains_beside_a_base_finding():
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["".join(p) for p in zip(keys(500, "etaoinsr", 3, 3), keys(500, "hldcum", 3, 4))]
    words += [w.capitalize() for w in words[:150]] + [w.upper() for w in words[150:200]]
    access = ["AKIA" + k for k in keys(300, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 8)]
    formats = secret_scan.Formats.fit(
        {"hex": keys(300, "0123456789abcdef", 40, 1), "assign": keys(300, mixed, 40, 9), "access": access}, words
    )
    key, other, short = keys(1, "0123456789abcdef", 20, 10)[0], keys(1, mixed, 40, 11)[0], "3f9ac0de77b1"
    assert found_in(formats, f"see {key}. Then") == [key] or found_in(formats, f"see {key}. Then") == [key + "."]
    assert found_in(formats, f"KEY={key} and /{short}/ there") == [key, short]
    assert found_in(formats, f"{access[0]}/{other} pair") == [other] or found_in(formats, f"{access[0]}/{other} pair") == ["/" + other]
    hidden = secret_scan._hidden(formats, f"{access[0]}/{other} pair, {short}")
    assert other not in hidden and short not in hidden and access[0] not in hidden
    for usual in ("4111111111111111", "20240101 and 1234567", "NASA HTTP DataFrame", "MP3 B2B UTF-8 COVID19 v2.0.1", "www.example.org/en/8423"):
        assert found_in(formats, usual) == []


MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
LOWER_HEX = "0123456789abcdef"


def uuids(n, seed):
    return ["-".join(k[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))) for k in keys(n, LOWER_HEX, 32, seed)]


def three_parts(n, seed):
    url = MIXED + "-_"
    return [f"eyJhbGciOi{a}.{b}.{c}" for a, b, c in zip(keys(n, url, 26, seed), keys(n, url, 60, seed + 1), keys(n, url, 43, seed + 2))]


#: Formats of credentials: name -> n fresh ones from a seed.
FORMATS = {
    "access": lambda n, s: ["AKIA" + k for k in keys(n, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, s)],
    "ghp": lambda n, s: ["ghp_" + k for k in keys(n, MIXED, 36, s)],
    "sk_live": lambda n, s: ["sk_live_" + k for k in keys(n, MIXED, 24, s)],
    "base64": lambda n, s: keys(n, MIXED + "+/", 40, s),
    "hex": lambda n, s: [keys(1, LOWER_HEX, random.Random(s + k).randint(20, 64), s + k)[0] for k in range(n)],
    "uuid": uuids,
    "three parts": three_parts,
}


@pytest.fixture(scope="module")
def planted(shared):
    """The documents of a given table and, assigned to names, sixty values of each format."""
    docs = read(shared, "documents", "/root/testdata/sf0.1").select("doc_id", "text")
    rows = [
        (10 ** 6 + 1000 * f + k, f"key {value} here" if kind == "access" else f"the token = '{value}' is set")
        for f, (kind, fresh) in enumerate(FORMATS.items()) for k, value in enumerate(fresh(60, 100 * f))
    ]
    return docs.unionByName(shared.createDataFrame(rows, docs.schema))


@pytest.fixture(scope="module")
def fitted(planted):
    return secret_scan.fit(secret_scan.found_spans(planted))


def test_automata_of_a_given_table_keep_the_length(shared):
    formats = secret_scan.fit(secret_scan.found_spans(read(shared, "documents", "/root/testdata/sf0.1")))
    assert {kind for kind, _ in formats.kinds} == {"assign", "hex"}
    assert all(len(automaton.states) > 20 for _, automaton in formats.kinds)


def test_planted_formats_are_recalled_where_nothing_names_them(fitted):
    assert {kind for kind, _ in fitted.kinds} == {"assign", "access", "hex"}
    assert all(len(automaton.states) > 1 for _, automaton in fitted.kinds)
    for f, (name, fresh) in enumerate(FORMATS.items()):
        values = fresh(200, 7000 + 1000 * f)
        caught = 0
        for value in values:
            text = f"so see {value} and go on"
            base = secret_scan.base_spans(text)
            spans = base + secret_scan.format_spans(text, base, fitted)
            caught += any(s.start <= 7 and s.end >= 7 + len(value) for s in spans)
        assert caught >= 180, (name, caught)


def test_ordinary_text_has_no_hits(shared, fitted):
    for r in read(shared, "documents", "/root/testdata/sf0.1").where("doc_id % 7 = 3").collect():
        base = secret_scan.base_spans(r.text or "")
        assert not secret_scan.format_spans(r.text or "", base, fitted), r.doc_id
    usual = (
        "See https://www.example.org/en/8423?id=77&lang=de, version 2.0.1-beta of getElementsByTagName() and "
        "internationalization-of_long_identifiers_with_many_words; call +1 (555) 010-0199 or 4111111111111111, "
        "2024-01-01T00:00:00Z, ISBN 978-3-16-148410-0, UTF-8, COVID19, deadbeef, facade, SELECT_FROM_WHERE, MP3."
    )
    assert secret_scan.format_spans(usual, [], fitted) == []


def plain_accepts(formats, run):
    """Every automaton walked to the end, with likelihoods from its counts."""
    import math

    def counted(automaton):
        whole = {}
        for state in automaton.states:
            for x, n in state.seen.items():
                whole[x] = whole.get(x, 0) + n
        return whole

    def walked(automaton):
        """(log likelihood, expected, variance) of each letter."""
        whole, at = counted(automaton), 0
        total = sum(whole.values()) + secret_scan.SMOOTHING * (secret_scan.ALPHABET + 1)
        for letter in run:
            state = automaton.states[at]
            backing = max(1, len(state.seen))
            share = (whole.get(letter, 0) + secret_scan.SMOOTHING) / total
            own = math.log((state.seen.get(letter, 0) + backing * share) / (state.count + backing))
            fresh, seen = {}, sum(state.seen.values())
            for x, n in state.seen.items():
                left = max(backing - 1 if n == 1 else backing, 0.5)
                fresh[x] = math.log((n - 1 + left * (whole[x] + secret_scan.SMOOTHING) / total) / (state.count - 1 + left))
            mean = sum(state.seen[x] * y for x, y in fresh.items()) / seen if seen else 0.0
            spread = sum(state.seen[x] * (y - mean) ** 2 for x, y in fresh.items()) / seen if seen else 0.0
            yield own, mean, max(spread, secret_scan.LEAST_SPREAD ** 2)
            led = {}
            for x, t in state.to.items():
                led[t] = led.get(t, 0) + state.seen[x]
            at = state.to.get(letter, max(led, key=lambda t: (led[t], -t), default=0))

    ordinary = sum(max(own, -8.0) for own, _, _ in walked(formats.ordinary))
    for pattern, size in (("[0-9]+", 10), ("[a-z]+", 26), ("[A-Z]+", 26), ("[A-Za-z]+", 52), ("[A-Z0-9]{1,15}", 36), ("[0-9._/-]+", 14)):
        if re.fullmatch(pattern, run):
            ordinary = max(ordinary, -len(run) * math.log(size + 1))
            break
    for _, automaton in formats.kinds:
        steps = list(walked(automaton))
        beyond, variance = sum(a - m for a, m, _ in steps), sum(v for _, _, v in steps)
        slack = secret_scan.SLACK * min(1, len(run) / secret_scan.SLACK_CHARS)
        likely = beyond >= -secret_scan.DEVIATIONS * math.sqrt(variance) - slack
        likely = likely and not any(c in "+/_.=-" and c not in counted(automaton) for c in run)
        margin = secret_scan.MARGIN * len(run) if len(run) >= secret_scan.LONG else secret_scan.EVIDENCE
        if likely and sum(a for a, _, _ in steps) >= ordinary + margin:
            return True
    return False


def plain_format(formats, text):
    """Runs beside base findings: whole, without outer punctuation, or in pieces."""
    free = list(text)
    for a, _, b in plain_base(text):
        free[a:b] = "\n" * (b - a)
    out = []
    for m in re.finditer("[A-Za-z0-9+/_.=-]+", "".join(free)):
        run, at = m.group(), m.start()
        inner = run.strip("+/_.=-")
        start = at + len(run) - len(run.lstrip("+/_.=-"))
        if not inner:
            continue
        if plain_accepts(formats, run):
            out.append((at, m.end()))
        elif inner != run and plain_accepts(formats, inner):
            out.append((start, start + len(inner)))
        elif len(re.findall("[^=/]+", inner)) > 1:
            for piece in re.finditer("[^=/]+", inner):
                bare = piece.group().strip("+/_.=-")
                begin = start + piece.start() + len(piece.group()) - len(piece.group().lstrip("+/_.=-"))
                if bare and plain_accepts(formats, bare):
                    out.append((begin, begin + len(bare)))
    return out


def test_added_spans_equal_plain_scoring(planted, fitted):
    rows = planted.where("doc_id >= 1000000 and doc_id % 1000 < 4 or doc_id % 1000 = 7").collect()
    mixed = "; ".join(fresh(1, 99)[0] for fresh in FORMATS.values())
    found = 0
    loose = [f"so see {value} and go on." for fresh in FORMATS.values() for value in fresh(6, 55)]
    for text in [(r.text or "")[-3000:] for r in rows] + [*loose, mixed, f"A={mixed}", mixed.replace("; ", "/")]:
        spans = secret_scan.format_spans(text, secret_scan.base_spans(text), fitted)
        assert [(s.start, s.end) for s in spans] == plain_format(fitted, text)
        found += len(spans)
    assert found > 30
