"""URL filters: fixed rules first, then an empirical-Bayes reputation of hosts.

Labelled outcomes of pages (bad or not) are counted per host. Rates are shrunk along
host, registered domain, suffix and the whole set: each level's posterior mean is
the mean of the beta prior below it, with a strength estimated from how much the
level's rates vary beyond chance. A page without a rule is blocked when the lower
bound of its host's posterior rate of bad pages lies above `MOST_BAD`.

Hosts are counted before anything is joined, so a host with a third of all pages
costs one row; its pages meet that row in a join that Spark may split.

The registered domain of a host is found below its public suffix: one label, or one of
the `two_labels` given. Public suffixes are a long list that changes; the default
holds a few common ones, and a caller passes the list it trusts. User and port are
no part of the domain.

Defined results: a NULL url, or one without `://`, has an empty host and path and
is judged by the empty host's counts; NULL outcomes are not counted; hosts without
outcomes get the posterior of their domain, suffix or the whole; without any
outcome nothing but rules blocks; a page that shows no letters or digits has no
outcome; repeated pages are judged each; only the columns named are read, so others
may have any name; texts of any length meet by hash; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.shrinkage import shrunk, strength
from parley.operators.keyed import broadcast_if_small
from parley.session import written

#: Credible bound in standard deviations, and the rate of bad pages above which a host is blocked.
DEVIATIONS = 1.64
MOST_BAD = 0.5

#: Common public suffixes of two labels.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "co.in", "co.za", "com.mx", "com.tr", "com.cn")


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule(True, "com", "/"), Rule(False, "example.com", "/en/"), Rule(True, "www.example.com", "/en/"),
    Rule(False, "net", "/es/"), Rule(False, "net", "/fr/"),
)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lower-cased, and the path up to query or fragment."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def domain_and_suffix(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> tuple[Column, Column]:
    """Registered domain and suffix; a numeric address is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    last_two = F.substring_index(bare, ".", -2)
    two = last_two.isin(*two_labels)
    suffix = F.when(two, last_two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two, F.substring_index(bare, ".", -3)).otherwise(last_two)
    address = bare.rlike("^[0-9.]+$")
    return F.when(address, bare).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def rule_for(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, NULL without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested first in the end
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit("allow" if rule.allow else "block")).otherwise(verdict)
    return name, verdict


def reputations(hosts: DataFrame) -> DataFrame:
    """Adds `mean` and `lower`, the posterior rate of bad pages and its bound, to (host, domain, suffix, n, bad)."""
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    if not n:
        return hosts.withColumns({"mean": F.lit(0.0), "lower": F.lit(0.0)})
    overall = F.lit(bad / n)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("bad").alias("sb"))
    m = strength(suffixes, "sb", "sn", overall)
    suffixes = suffixes.select("suffix", shrunk(F.col("sb"), F.col("sn"), overall, m).alias("s_mean"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db")).join(suffixes, "suffix")
    m = strength(domains, "db", "dn", F.col("s_mean"))
    domains = domains.select("domain", "suffix", shrunk(F.col("db"), F.col("dn"), F.col("s_mean"), m).alias("d_mean"))
    rows = hosts.join(domains, ["domain", "suffix"])
    m = strength(rows, "bad", "n", F.col("d_mean"))
    a = F.col("bad") + m * F.col("d_mean")
    b = F.col("n") - F.col("bad") + m * (1 - F.col("d_mean"))
    mean = a / (a + b)
    return rows.withColumns({"mean": mean, "lower": mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (a + b + 1))}).drop("d_mean")


def verdicts(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url",
    two_labels: Sequence[str] = TWO_LABELS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, lower) of every page.

    `outcomes` has (url, bad), urls of labelled pages with a 0/1 outcome, or
    (host, bad, n), n pages of a host with that outcome.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    counted = "host" in outcomes.columns
    labelled = outcomes.where(F.col("bad").isNotNull()).select(
        F.col("host") if counted else host.alias("host"), F.col("bad").cast("bigint").alias("bad"),
        (F.col("n") if counted else F.lit(1)).cast("bigint").alias("n"),
    )
    seen = rows.groupBy("host").agg(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("bad"))
    told = labelled.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("bad") * F.col("n")).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"), two_labels)
    hosts = written(
        seen.unionByName(told).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix}),
        "hosts",
    )
    known = written(reputations(hosts).select("host", "mean", "lower"), "reputations")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("lower") > MOST_BAD, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(broadcast_if_small(known), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "mean", "lower"
    )


def shown_text(html: Column) -> Column:
    """Letters and digits of a page's article without tags, for matching with plain texts."""
    body = F.regexp_extract(html, "(?s)</h1>(.*)</article>", 1)
    bare = F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), "&(amp|lt|gt|quot|apos|nbsp|#[0-9]+|#x[0-9A-Fa-f]+);", "")
    return letters(bare)


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def outcomes_by_text(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad, n): pages per host whose article is the text of a labelled document.

    Texts meet by hash, not in full; texts without letters or digits meet nothing.
    Pages are counted per host and text before they are joined. Documents with one
    text vote; a tie is bad.
    """
    told = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    plain = documents.select("doc_id", letters(F.coalesce("text", F.lit(""))).alias("said")).where("said <> ''")
    keys = plain.select("doc_id", F.xxhash64("said").alias("key"))
    votes = keys.join(told, "doc_id").groupBy("key").agg((F.avg(F.col("quality").cast("double")) <= 0.5).cast("bigint").alias("bad"))
    host, _ = host_and_path(F.col("url"))
    shown = pages.where(F.col("html").isNotNull()).select(host.alias("host"), shown_text(F.col("html")).alias("said"))
    shown = shown.where("said <> ''").groupBy("host", F.xxhash64("said").alias("key")).agg(F.count("*").alias("n"))
    return shown.join(votes, "key").select("host", "bad", "n")
