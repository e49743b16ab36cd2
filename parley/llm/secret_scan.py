"""Secret scans with probabilistic automata inferred from labelled credentials.

Three fixed patterns (assigned values, access keys, long hexadecimal runs) give the
base findings. Their values are labelled credentials: a bounded, hash-chosen sample
of each kind is parted by shape (a beginning that many share, else the characters
used), and each shape with enough examples gets a deterministic automaton with
probabilities, merged from its prefix tree in two steps. First states of one depth
whose endings and continuations do not differ significantly (Hoeffding bound) are
merged, largest first, so that beginnings, fixed places and lengths stay. Then a
state is merged with the one before it where both were visited often enough to tell
and nothing that follows differs, up to the ends; lengths that vary become loops.
Ordinary runs of the corpus, taken outside the base findings, give one more
automaton, of which any compatible states are merged.

Every run of credential letters, also what remains of it beside base findings, is
scored as a whole, without outer punctuation, and cut at `=` and `/`: the first of
these that passes becomes a finding. It passes under a shape when its log likelihood
along its path lies no more than `DEVIATIONS` standard deviations plus `SLACK` (less
for short runs; enough for another length) below what the states on that path lead
one to expect of a fresh example, if it has no punctuation that the shape never has,
and beats what is ordinary: by `MARGIN` per character, or by `EVIDENCE` in all when it
has fewer than `LONG` characters. Ordinary is the better of that automaton and, for
runs of digits or letters only (short ones of capitals and digits too), of even draws
from these, so numbers and capitals do not pass for lack of examples.

The sample is taken from a first reading of the texts; a second one scores their
runs against the broadcast automata.

Defined results: NULL texts count as empty and have no findings; shapes with fewer
than `LEAST_EXAMPLES` different examples of a kind are taken together, and infer
nothing when they are still fewer; repeated rows are answered each; texts of any
length are read whole; `scan` reads id and text only and `redact` keeps all other
columns whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import fmean

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.common import keyed_texts, mapped
from parley.session import written

#: Bounds of the sample that the automata are inferred from.
EXAMPLES_PER_KIND = 1000
ORDINARY_WORDS = 2000
EXAMPLE_CHARS = 256
LEAST_EXAMPLES = 10

ALPHA = 0.01
#: Visits from which states of different depths may be told apart, and merged.
VISITS = 30
#: Letters of a beginning that makes a shape when enough examples share it.
BEGINNING = 4
SMOOTHING = 0.05
SLACK, SLACK_CHARS = 10.0, 32
#: What a character that ordinary runs lack costs at most.
LEAST_USUAL = -8.0
MARGIN = 0.5
EVIDENCE = 20.0
LONG = 16
DEVIATIONS = 3.0
LEAST_SPREAD = 0.1
ALPHABET = 66
#: Runs whose answer a task remembers.
KNOWN_RUNS = 200_000
MARK = "[SECRET]"

#: The base patterns and the order of kinds.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST = 8

RUNS = re.compile("[A-Za-z0-9+/_.=-]+")
PUNCTUATION = "+/_.=-"
CUTS = re.compile("[^=/]+")
#: Runs of one kind of characters (short ones also of capitals and digits, as in names of
#: products), and the log likelihood of each of them in even draws (with an end).
EVEN = tuple(
    (re.compile(letters).fullmatch, -math.log(n + 1))
    for letters, n in (
        ("[0-9]+", 10), ("[a-z]+", 26), ("[A-Z]+", 26), ("[A-Za-z]+", 52), ("[A-Z0-9]{1,%d}" % (LONG - 1), 36), ("[0-9._/-]+", 14),
    )
)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    value: str


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [
            Span("assign", m.start(), m.end(), m.group(2))
            for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [Span("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def runs_beside(text: str, base: list[Span]) -> Iterator[tuple[int, str]]:
    """(start, run): the runs of credential letters without what base findings cover."""
    if not base:
        yield from ((m.start(), m.group()) for m in RUNS.finditer(text))
        return
    at = 0
    for span in [*base, Span("", len(text), len(text), "")]:
        if span.start > at:
            yield from ((m.start(), m.group()) for m in RUNS.finditer(text, at, span.start))
        at = max(at, span.end)


def _trimmed(start: int, run: str) -> tuple[int, str]:
    inner = run.lstrip(PUNCTUATION)
    return start + len(run) - len(inner), inner.rstrip(PUNCTUATION)


def secrets_in(run: str, accepts: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Places of the run that pass: all of it, all without outer punctuation, or pieces."""
    at, inner = _trimmed(0, run)
    if not inner:
        return []
    if accepts(run):
        return [(0, len(run))]
    if inner != run and accepts(inner):
        return [(at, at + len(inner))]
    cut = [_trimmed(at + m.start(), m.group()) for m in CUTS.finditer(inner)]
    if len(cut) == 1:
        return []
    return [(start, start + len(piece)) for start, piece in cut if piece and accepts(piece)]


def format_spans(text: str, base: list[Span], formats: Formats) -> list[Span]:
    """Runs, or pieces of them, that look like a secret and lie outside the base findings."""
    return [
        Span("format", start + a, start + b, run[a:b])
        for start, run in runs_beside(text, base) for a, b in formats.secrets(run)
    ]


@dataclass
class State:
    count: int = 0
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)


class Automaton:
    """Merged prefix tree of example strings with transition counts.

    With `keep_length` states are merged depth by depth first, else any two that agree.
    """

    def __init__(self, examples: list[str], alpha: float = ALPHA, keep_length: bool = False):
        self.states = [State()]
        self.paths: list[tuple[dict[str, tuple[float, int, float]], tuple[float, int, float], float]] = []
        parent: list[tuple[int, str]] = [(-1, "")]
        for text in sorted(examples):
            at = 0
            self.states[0].count += 1
            for letter in text:
                state = self.states[at]
                state.seen[letter] = state.seen.get(letter, 0) + 1
                if letter not in state.to:
                    state.to[letter] = len(self.states)
                    self.states.append(State())
                    parent.append((at, letter))
                at = state.to[letter]
                self.states[at].count += 1
            self.states[at].ends += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        if keep_length:
            self._merge_along(self._merge_levels())
        else:
            self._merge(parent)

    def _differ(self, n1: int, k1: int, n2: int, k2: int) -> bool:
        return abs(k1 / n1 - k2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            p, q = self.states[a], self.states[b]
            if not p.count or not q.count:
                continue
            if self._differ(p.count, p.ends, q.count, q.ends):
                return False
            for letter in {*p.seen, *q.seen}:
                if self._differ(p.count, p.seen.get(letter, 0), q.count, q.seen.get(letter, 0)):
                    return False
                if letter in p.to and letter in q.to:
                    open_.append((p.to[letter], q.to[letter]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            p, q = self.states[a], self.states[b]
            p.count += q.count
            p.ends += q.ends
            for letter, n in q.seen.items():
                p.seen[letter] = p.seen.get(letter, 0) + n
                if letter in p.to:
                    open_.append((p.to[letter], q.to[letter]))
                else:
                    p.to[letter] = q.to[letter]

    def _merge(self, parent: list[tuple[int, str]]) -> None:
        kept = [0]
        while True:
            known = set(kept)
            fringe = [
                (self.states[t].count, -s, letter, t, s)
                for s in kept for letter, t in self.states[s].to.items() if t not in known
            ]
            if not fringe:
                break
            _, _, letter, new, source = max(fringe)
            for old in kept:
                if self._compatible(old, new):
                    self.states[source].to[letter] = old
                    self._fold(old, new)
                    break
            else:
                kept.append(new)
        self._renumber(kept)

    def _renumber(self, kept: list[int]) -> None:
        number = {s: k for k, s in enumerate(kept)}
        self.states = [
            State(s.count, s.ends, {x: number[t] for x, t in s.to.items()}, s.seen)
            for s in (self.states[k] for k in kept)
        ]

    def _merge_levels(self) -> list[list[int]]:
        """Merge compatible states of one depth, the most visited first; the states that stay, by depth."""
        levels = [[0]]
        while True:
            entered: dict[int, list[tuple[int, str]]] = {}
            for s in levels[-1]:
                for letter, t in self.states[s].to.items():
                    entered.setdefault(t, []).append((s, letter))
            if not entered:
                return levels
            kept: list[int] = []
            for new in sorted(entered, key=lambda t: (-self.states[t].count, entered[t])):
                for old in kept:
                    if self._compatible(old, new):
                        self._fold(old, new)
                        for s, letter in entered[new]:
                            self.states[s].to[letter] = old
                        break
                else:
                    kept.append(new)
            levels.append(kept)

    def _merge_along(self, levels: list[list[int]]) -> None:
        """Merge states with those right before them where neither they nor what follows them differ."""
        root = list(range(len(self.states)))

        def find(s: int) -> int:
            while root[s] != s:
                root[s] = root[root[s]]
                s = root[s]
            return s

        def agree(a: int, b: int) -> bool:
            open_, met = [(a, b)], {(a, b)}
            while open_:
                a, b = open_.pop()
                p, q = self.states[a], self.states[b]
                if self._differ(p.count, p.ends, q.count, q.ends):
                    return False
                for letter in {*p.seen, *q.seen}:
                    if self._differ(p.count, p.seen.get(letter, 0), q.count, q.seen.get(letter, 0)):
                        return False
                    if letter in p.to and letter in q.to:
                        pair = (find(p.to[letter]), find(q.to[letter]))
                        if pair[0] != pair[1] and pair not in met:
                            met.add(pair)
                            open_.append(pair)
            return True

        def unite(a: int, b: int) -> None:
            open_ = [(a, b)]
            while open_:
                a, b = map(find, open_.pop())
                if a == b:
                    continue
                root[b] = a
                p, q = self.states[a], self.states[b]
                p.count += q.count
                p.ends += q.ends
                for letter, n in q.seen.items():
                    p.seen[letter] = p.seen.get(letter, 0) + n
                for letter, t in q.to.items():
                    if letter in p.to:
                        open_.append((p.to[letter], t))
                    else:
                        p.to[letter] = t

        for before, level in zip(levels, levels[1:]):
            for b in level:
                for a in before:
                    x, y = find(a), find(b)
                    if x == y or b not in self.states[a].to.values():
                        continue
                    if min(self.states[x].count, self.states[y].count) >= VISITS and agree(x, y):
                        unite(x, y)
        for state in self.states:
            state.to = {letter: find(t) for letter, t in state.to.items()}
        kept, open_ = [], [find(0)]
        while open_:
            s = open_.pop()
            if s not in kept:
                kept.append(s)
                open_.extend(self.states[s].to.values())
        self._renumber(kept)

    def _prepare(self) -> None:
        """Per state: letter -> (log likelihood, next state, its difference from what is expected), the same for
        other letters, and the variance.

        A state's counts are backed by as many draws from the letters of the whole automaton as it has seen
        different letters, since at one place of a format few examples show few of its letters.
        """
        whole: dict[str, int] = {}
        for state in self.states:
            for letter, n in state.seen.items():
                whole[letter] = whole.get(letter, 0) + n
        total = sum(whole.values()) + SMOOTHING * (ALPHABET + 1)
        share = {letter: (n + SMOOTHING) / total for letter, n in whole.items()}
        for state in self.states:
            backing = max(1, len(state.seen))
            size = state.count + backing
            p = {x: (state.seen.get(x, 0) + backing * q) / size for x, q in share.items()}
            logs = {x: math.log(v) for x, v in p.items()}
            # What a fresh example would get here: each one seen is judged by the others (past an end, nothing is expected).
            alone = {x: backing - (n == 1) for x, n in state.seen.items()}
            fresh = {
                x: math.log((n - 1 + max(alone[x], 0.5) * share[x]) / (state.count - 1 + max(alone[x], 0.5)))
                for x, n in state.seen.items()
            }
            weight = sum(state.seen.values())
            mean = sum(n * fresh[x] for x, n in state.seen.items()) / weight if weight else 0.0
            spread = sum(n * (fresh[x] - mean) ** 2 for x, n in state.seen.items()) / weight if weight else 0.0
            other = math.log(backing * SMOOTHING / total / size)
            # A letter that was not seen here leads where most letters lead.
            led: dict[int, int] = {}
            for x, t in state.to.items():
                led[t] = led.get(t, 0) + state.seen[x]
            usual = max(led, key=lambda t: (led[t], -t), default=0)
            steps = {x: (log, state.to.get(x, usual), log - mean) for x, log in logs.items()}
            self.paths.append((steps, (other, usual, other - mean), max(spread, LEAST_SPREAD ** 2)))
        self.most = max(spread for _, _, spread in self.paths)

    def scores(self, text: str) -> list[float]:
        """Log likelihood of each character along its path."""
        if not self.paths:
            self._prepare()
        at, found = 0, []
        for letter in text:
            steps, other, _ = self.paths[at]
            log, at, _ = steps.get(letter) or other
            found.append(log)
        return found

    def follows(self, text: str) -> float | None:
        """Log likelihood of the text, None when it is too unlikely for its path or has foreign punctuation."""
        if not self.paths:
            self._prepare()
        slack = SLACK * min(1.0, len(text) / SLACK_CHARS)
        least = -DEVIATIONS * math.sqrt(self.most * len(text)) - slack
        at, total, beyond, variance, paths = 0, 0.0, 0.0, 0.0, self.paths
        for letter in text:
            steps, other, spread = paths[at]
            step = steps.get(letter)
            if step is None and letter in PUNCTUATION:
                return None
            log, at, difference = step or other
            total += log
            beyond += difference
            variance += spread
            if beyond < least:
                return None
        return total if beyond >= -DEVIATIONS * math.sqrt(variance) - slack else None

    def score(self, text: str) -> float:
        """Mean log likelihood per character."""
        return fmean(self.scores(text)) if text else 0.0


def shape(value: str) -> str:
    """The characters that a value is made of."""
    marks = "".join(m for m, used in ((".", "."), ("-", "-_"), ("/", "+/=")) if any(c in value for c in used))
    if marks:
        return marks
    for name, letters in (("digits", "[0-9]+"), ("hex", "[0-9a-f]+"), ("HEX", "[0-9A-F]+"), ("CAPITALS", "[0-9A-Z]+")):
        if re.fullmatch(letters, value):
            return name
    return "letters"


def by_shape(values: list[str]) -> list[list[str]]:
    """Values that share a beginning or are made of the same characters; small groups together."""
    begin: dict[str, list[str]] = {}
    for value in values:
        begin.setdefault(value[:BEGINNING], []).append(value)
    groups: dict[str, list[str]] = {}
    for start, own in begin.items():
        for value in own:
            groups.setdefault(f"{start}..." if len(own) >= LEAST_EXAMPLES else shape(value), []).append(value)
    large = [groups[name] for name in sorted(groups) if len(groups[name]) >= LEAST_EXAMPLES]
    rest = [value for name in sorted(groups) if len(groups[name]) < LEAST_EXAMPLES for value in groups[name]]
    return [*large, rest] if len(rest) >= LEAST_EXAMPLES else large


@dataclass
class Formats:
    """The automata of the shapes of each kind, and the ordinary one."""

    kinds: list[tuple[str, Automaton]]
    ordinary: Automaton | None
    known: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    @staticmethod
    def fit(examples: dict[str, list[str]], ordinary: list[str]) -> Formats:
        kinds = [
            (kind, Automaton(own, keep_length=True))
            for kind in sorted(examples) for own in by_shape(sorted(set(examples[kind])))
        ]
        return Formats(kinds, Automaton(ordinary) if ordinary else None)

    def accepts(self, run: str) -> bool:
        size, usual = len(run), None
        for _, automaton in self.kinds:
            score = automaton.follows(run)
            if score is None:
                continue
            if usual is None:
                usual = size * self.usual(run)
            if score >= usual + (MARGIN * size if size >= LONG else EVIDENCE):
                return True
        return False

    def usual(self, run: str) -> float:
        """Mean log likelihood per character of the run as an ordinary one."""
        even = next((p for matches, p in EVEN if matches(run)), -math.inf)
        known = self.ordinary.scores(run) if self.ordinary else []
        return max(even, fmean(max(x, LEAST_USUAL) for x in known) if known else -math.inf)

    def secrets(self, run: str) -> list[tuple[int, int]]:
        """`secrets_in` the run; answers for runs of common length are kept, as words come again."""
        if not self.kinds:
            return []
        found = self.known.get(run)
        if found is None:
            found = secrets_in(run, self.accepts)
            if len(run) <= 64:
                if len(self.known) >= KNOWN_RUNS:
                    self.known.clear()
                self.known[run] = found
        return found


_SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()),
]))
_FOUND = [
    T.StructField("base", _SPANS),
    T.StructField("ordinary", T.ArrayType(T.StringType())),
]
_LISTED = [
    *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS[:3]],
    T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()),
]


def _ordinary(text: str, base: list[Span]) -> list[str]:
    """A few runs from places all over the text, outside the base findings."""
    found = []
    for k in range(3):
        # From a blank on, so that no run is met in its middle.
        at = len(text) * k // 3
        m = RUNS.search(text, text.find(" ", at) + 1 if at else 0)
        if m and not any(s.start < m.end() and m.start() < s.end for s in base):
            found.append(m.group()[:EXAMPLE_CHARS])
    return found


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, ordinary) per document."""
    texts = keyed_texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *_FOUND])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, ordinary = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([vars(s) for s in spans])
                ordinary.append(_ordinary(text, spans))
            columns = [pa.array(c, f.type) for c, f in zip((base, ordinary), list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow.field(0).type), *columns], schema=arrow)

    return mapped(texts, run, schema)


def fit(found: DataFrame) -> Formats:
    """Automata from a bounded sample of the values found."""
    values = found.select(F.explode("base").alias("s")).select(
        "s.kind", F.substring("s.value", 1, EXAMPLE_CHARS).alias("value")
    ).distinct()
    first = W.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    sample = values.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= EXAMPLES_PER_KIND)
    examples: dict[str, list[str]] = {}
    for row in sample.collect():
        examples.setdefault(row["kind"], []).append(row["value"])
    words = found.select(F.explode("ordinary").alias("word")).distinct()
    ordinary = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(ORDINARY_WORDS).collect()]
    return Formats.fit(examples, ordinary)


def _with_formats(rows: DataFrame, formats: Formats, work: Callable, schema: T.StructType) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(shared.value, batch)

    return mapped(rows, run, schema)


def _listed(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in order)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): findings as kind:start:end, comma-joined."""
    formats = fit(written(found_spans(docs, id_col, text_col), "spans"))
    texts = keyed_texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *_LISTED])
    arrow = to_arrow_schema(schema)

    def work(formats: Formats, batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: dict[str, list] = {name: [] for name in schema.names[1:]}
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            for kind in KINDS[:3]:
                columns[f"n_{kind}"].append(sum(s.kind == kind for s in base))
            columns["base"].append(_listed(base))
            columns["spans"].append(_listed(base + format_spans(text or "", base, formats)))
        rest = [pa.array(columns[f.name], f.type) for f in list(arrow)[1:]]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow.field(0).type), *rest], schema=arrow)

    return _with_formats(texts, formats, work, schema)


def _hidden(formats: Formats, text: str) -> str:
    """The text with each stretch of findings replaced by the mark."""
    base = base_spans(text)
    spans = base + format_spans(text, base, formats)
    parts, at, end = [], 0, -1
    for span in sorted(spans, key=lambda s: s.start):
        if span.start >= end:
            parts += [text[at:span.start], MARK]
        end = at = max(end, span.end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, secrets replaced by the mark; `length_col` is renewed where a text changed."""
    formats = fit(written(found_spans(docs, id_col, text_col), "spans"))

    def work(formats: Formats, batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(text_col).to_pylist()
        new = [t if t is None else _hidden(formats, t) for t in old]
        at = batch.schema.get_field_index(text_col)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
        if length_col is not None:
            at = batch.schema.get_field_index(length_col)
            size = [n if a == b else len(b) for n, a, b in zip(batch.column(length_col).to_pylist(), old, new)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(size, batch.schema.field(at).type))
        return batch

    return _with_formats(docs, formats, work, docs.schema)
