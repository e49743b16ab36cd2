"""Personal data: fixed patterns, and terms that give the protected entities away.

Four patterns (e-mail, IP address, card number, phone number) give the base findings;
each value found is a protected entity. What a term tells about an entity is
estimated from the corpus: with n documents, n(c) that hold the entity c, n(t) that
hold the term t, and n(c, t) that hold t within `WINDOW` terms of c,

    PMI(c; t) = log(n * n(c, t) / (n(c) * n(t))),    IC(c) = log(n / n(c)),

and t discloses the share PMI / IC of the entity's information. A pair counts from
`LEAST_TEXTS` different texts on, so that neither a chance meeting nor copies of one
text convict a term. In a document with the entity, the terms near it that disclose at
least `GENERALISE` are replaced by their class wherever they stand in it; from
`REMOVE` on they are removed. Documents without a base finding protect nothing and
are left alone.

Pairs are taken within a window, so their number grows with the findings and not with
the square of a text; counting is grouped aggregation over all documents. Texts meet
their terms by a 128-bit hash: texts are moved only when more than `BROADCAST_MARKS`
marks exist, and then only those with an `@` or a digit.

Terms are runs of `TERM_CHARS` characters out of ASCII letters, digits, apostrophes
and all that is not ASCII, with A-Z in lower case; what base findings cover is not a
term near them.

Defined results: a NULL text counts as empty and has no findings; repeated rows and
rows without id are documents of their own and answered each; of overlapping findings
of different kinds all are listed, and the text is hidden from the first start to the
last end; an entity that every document holds is not protected by terms (its
information is zero); texts of any length take linear time; extra columns are not
read by `scan` and kept by `sanitised`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.llm.common import free_name, keyed_texts, mapped, salted_left_join
from parley.operators.keyed import is_small
from parley.session import written

WINDOW = 16
LEAST_TEXTS = 3
GENERALISE = 0.8
REMOVE = 0.95
TERM_CHARS = (3, 64)
BROADCAST_MARKS = 50_000
#: A text with more than one row in so many is dealt over many tasks.
HOT = 1000
PAIRS_AT_ONCE = 50_000

#: The base patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
BASE_KINDS = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PART = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

SEPARATORS = r"\x00-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = re.compile(f"[^{SEPARATORS}]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each `@` back to the start of its local part: one pass, whatever the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Each four parts in a row of a dotted run of digits; no part above 255."""
    for run in DOTTED.finditer(text):
        parts = [m.span() for m in PART.finditer(text, run.start(), run.end())]
        for k in range(0, len(parts) - 3, 4):
            four = [text[a:b].lstrip("0") for a, b in parts[k:k + 4]]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in four):
                yield parts[k][0], parts[k + 3][1]


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        n = int(digit) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind, then start."""
    return [(kind, a, b) for kind, find in FINDERS.items() for a, b in find(text)]


def entity(kind: str, value: str) -> str:
    """One name for the spellings of a value."""
    if kind in ("card", "phone"):
        value = NOT_DIGITS.sub("", value)
    return f"{kind}:{value.translate(_LOWERED)}"


def terms_outside(text: str, base: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all terms that no base finding touches, in order."""
    covered = sorted((a, b) for _, a, b in base)
    reach, k = 0, 0
    for m in TERM.finditer(text):
        a, b = m.span()
        while k < len(covered) and covered[k][0] < b:
            reach = max(reach, covered[k][1])
            k += 1
        if reach <= a and TERM_CHARS[0] <= b - a <= TERM_CHARS[1]:
            yield m.group().translate(_LOWERED), a, b


def near_pairs(text: str, base: list[Span]) -> Iterator[tuple[str, str]]:
    """(entity, term) for the terms up to `WINDOW` terms before or after each finding."""
    terms = list(terms_outside(text, base))
    starts = [a for _, a, _ in terms]
    for kind, a, b in base:
        at = bisect_left(starts, a)
        name = entity(kind, text[a:b])
        for term, _, _ in terms[max(at - WINDOW, 0):at + WINDOW]:
            yield name, term


def _key(text: str) -> bytes:
    return hashlib.md5(text.encode(), usedforsecurity=False).digest()


def listed(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in order)


_FOUND = [
    T.StructField("key", T.BinaryType()), *[T.StructField(f"n_{kind}", T.LongType()) for kind in BASE_KINDS],
    T.StructField("base", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType())),
]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key of the text, counts, base findings, entities) per document."""
    texts = keyed_texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *_FOUND])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {field.name: [] for field in _FOUND}
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                columns["key"].append(_key(text))
                for kind in BASE_KINDS:
                    columns[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                columns["base"].append(listed(base))
                columns["entities"].append(sorted({entity(kind, text[a:b]) for kind, a, b in base}))
            rest = [pa.array(columns[f.name], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow.field(0).type), *rest], schema=arrow)

    return mapped(texts, run, schema)


def contexts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, key, entity, term): the terms near each entity of a document, each at least once."""
    texts = docs.select(F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("entity", T.StringType()), T.StructField("term", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple] = set()

        def out() -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(arrow)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for text, row in zip(batch.column("text").to_pylist(), batch.column("row").to_pylist()):
                base = base_spans(text or "")
                if not base:
                    continue
                key = _key(text)
                for name, term in near_pairs(text, base):
                    found.add((row, key, name, term))
                    if len(found) >= PAIRS_AT_ONCE:
                        yield out()
        yield out()

    return mapped(texts, run, schema)


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_term): documents that hold the term."""
    words = F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), f"[{SEPARATORS}]+")
    own = F.array_distinct(F.filter(words, lambda w: F.char_length(w).between(*TERM_CHARS)))
    return docs.select(F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def disclosures(near: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """(entity, term, share): what each term tells of an entity, from `GENERALISE` on."""
    per_text = near.distinct().groupBy("entity", "term", "key").agg(F.count("*").alias("n"))
    pairs = per_text.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"))
    pairs = pairs.where(F.col("texts") >= LEAST_TEXTS)
    held = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = F.lit(float(found.count()))
    told = F.log(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    share = F.try_divide(told, F.log(n / F.col("n_entity")))
    rows = pairs.join(held, "entity").join(counts, "term")
    return rows.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def _marks(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """(key, terms with their kind) of the texts that need more than base findings."""
    near = written(contexts(docs, text_col), "pii-contexts")
    told = written(disclosures(near, found, term_counts(docs, text_col)), "pii-disclosures")
    each = near.join(told, ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")
    each = written(each.select("key", "term", kind.alias("kind")), "pii-marks")
    grouped = each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    return F.broadcast(grouped) if is_small(each, BROADCAST_MARKS) else grouped


def _text_key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def marked_spans(text: str, base: list[Span], kinds: dict[str, str]) -> list[Span]:
    """The places of the marked terms."""
    return [(kinds[term], a, b) for term, a, b in terms_outside(text, base) if term in kinds]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): findings as kind:start:end, comma-joined."""
    found = written(findings(docs, id_col, text_col), "pii-findings")
    marks = _marks(docs, found, text_col)
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("more", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for text, kinds in zip(batch.column("text").to_pylist(), batch.column("kinds").to_pylist()):
                more.append(listed(marked_spans(text, base_spans(text), dict(kinds))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(more, arrow.field(1).type)], schema=arrow)

    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[@0-9]"))
    texts = texts.withColumn("key", _text_key("text")).join(marks, "key").select("key", "text", "kinds")
    extra = mapped(texts, run, schema).groupBy("key").agg(F.max("more").alias("more"), F.count("*").alias("n"))
    extra = written(extra, "pii-extra")
    n = found.count()
    hot = extra.where(F.col("n") * HOT > n)
    found = found.drop("entities")
    plain, rich = found.where(F.col("base") == ""), found.where(F.col("base") != "")
    rich = salted_left_join(rich, extra.drop("n"), ["key"], hot)
    rows = rich.unionByName(plain.withColumn("more", F.lit(None).cast("string")))
    spans = F.concat_ws(",", "base", F.when(F.col("more") != "", F.col("more")))
    return rows.select("doc_id", *[f"n_{kind}" for kind in BASE_KINDS], "base", spans.alias("spans"))


def hidden(text: str, kinds: dict[str, str]) -> str:
    """The text with base findings and generalised terms replaced by their class and removed terms left out."""
    base = base_spans(text)
    parts, at = [], 0
    for kind, a, b in sorted(base + marked_spans(text, base, kinds), key=lambda s: (s[1], s[2])):
        if a >= at:
            parts.append(text[at:a])
            if kind == "generalise":
                word = text[a:b]
                parts.append("[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]")
            elif kind != "remove":
                parts.append(f"[{kind.upper()}]")
        at = max(at, b)
    return "".join([*parts, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with the texts as `hidden` leaves them; a NULL text stays NULL."""
    found = written(findings(docs, id_col, text_col), "pii-findings")
    marks = _marks(docs, found, text_col)
    key, kinds = free_name(docs.columns, "_key"), free_name(docs.columns, "_kinds")
    rows = docs.withColumn(key, _text_key(text_col)).join(
        marks.withColumnsRenamed({"key": key, "kinds": kinds}), key, "left"
    ).select(*docs.columns, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            given = zip(batch.column(text_col).to_pylist(), batch.column(kinds).to_pylist())
            new = [t if t is None else hidden(t, dict(k or ())) for t, k in given]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch.drop_columns([kinds])

    return mapped(rows, run, docs.schema)
