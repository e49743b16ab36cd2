"""Registered queries of this package and the SQL that answers the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm import bpe, chat_format, decontaminate, filter_audit, pii, prefix_trie, quality_rules, secret_scan, shrinkage, simhash, site_quality, token_counts as counted, toxicity, url_reputation

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bounds(rule: quality_rules.Rule) -> str:
    tests = []
    if rule.least is not None:
        tests.append(f"{rule.measure} >= {rule.least}")
    if rule.most is not None:
        tests.append(f"{rule.measure} <= {rule.most}")
    return " AND ".join(tests) or "true"


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

RULES_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(replace(text, '!', '')) AS n_bangs,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
m AS (SELECT *, n_words < {quality_rules.MIN_WORDS}
      OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN n_bangs / n_words ELSE 0 END AS bangs_per_word,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_lines > 0 THEN n_words / n_lines ELSE 0 END AS words_per_line FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_bounds(r) for r in quality_rules.RULES)} AS kept FROM m"""


@query("op6_quality_rules", RULES_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("judged")[f].alias(f) for f in fields])


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op1_bpe_encode_decode")
def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return rows.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counted.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op2_chat_format")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    return chat_format.digests(chat_format.windows(given.unionByName(more)))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _prior(hits: str, n: str, mean: str, source: str) -> str:
    spread = f"{mean} * (1 - {mean})"
    rho = (
        f"sum(CASE WHEN {n} > 0 THEN {n} * pow({hits} / {n} - {mean}, 2) - {spread} END)"
        f" / nullif(sum(CASE WHEN {n} > 1 THEN ({n} - 1) * {spread} END), 0)"
    )
    low, high = shrinkage.LEAST_RHO, shrinkage.MOST_RHO
    return f"SELECT 1 / least(greatest(coalesce({rho}, {low}), {low}), {high}) - 1 AS m FROM {source}"


def _fits(rule: url_reputation.Rule) -> str:
    return f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"


_LONGEST = sorted(url_reputation.RULES, key=lambda r: -len(r.name))
_TWO = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABELS)

URL_SQL = f"""WITH u AS (SELECT page_id, html, CASE WHEN coalesce(instr(url, '://'), 0) > 0
    THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
told AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
votes AS (SELECT regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key,
    CASE WHEN avg(quality) <= 0.5 THEN 1 ELSE 0 END AS bad FROM documents JOIN told USING (doc_id) GROUP BY 1 HAVING key <> ''),
shown AS (SELECT host, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<[^>]*>', '', 'g'),
    '&(amp|lt|gt|quot|apos|nbsp|#[0-9]+|#x[0-9A-Fa-f]+);', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key FROM p WHERE html IS NOT NULL),
counted AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM shown JOIN votes USING (key) GROUP BY host),
bare AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM (SELECT DISTINCT host FROM p)),
hosts AS (SELECT host, name, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS two
  FROM bare LEFT JOIN counted USING (host)),
h AS (SELECT host, n, bad,
    CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name
      WHEN two IN ({_TWO}) THEN array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') ELSE two END AS domain,
    CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN '' WHEN two IN ({_TWO}) THEN two
      ELSE string_split(name, '.')[-1] END AS suffix FROM hosts),
o AS (SELECT sum(bad) / nullif(sum(n), 0) AS mu FROM h),
s AS (SELECT suffix, sum(n) AS sn, sum(bad) AS sb, any_value(mu) AS mu FROM h, o GROUP BY suffix),
sm AS ({_prior("sb", "sn", "mu", "s")}),
sp AS (SELECT suffix, (sb + m * mu) / (sn + m) AS s_mean FROM s, sm),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS db, any_value(s_mean) AS s_mean FROM h JOIN sp USING (suffix) GROUP BY domain, suffix),
dm AS ({_prior("db", "dn", "s_mean", "d")}),
dp AS (SELECT domain, suffix, (db + m * s_mean) / (dn + m) AS d_mean FROM d, dm),
hd AS (SELECT host, n, bad, d_mean FROM h JOIN dp USING (domain, suffix)),
hm AS ({_prior("bad", "n", "d_mean", "hd")}),
hp AS (SELECT host, (bad + m * d_mean) / (n + m) AS mean, n + m AS w FROM hd, hm),
judged AS (SELECT host, coalesce(mean - {url_reputation.DEVIATIONS} * sqrt(mean * (1 - mean) / (w + 1)), 0) > {url_reputation.MOST_BAD} AS blocked FROM hp)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{'allow' if r.allow else 'block'}'" for r in _LONGEST)}
    WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN judged USING (host)"""


@query("op7_url_filter", URL_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_reputation.outcomes_by_text(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = url_reputation.verdicts(pages, outcomes)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = site_quality.judged(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return found.select("doc_id", "p", "host_mean", "path_mean", "score", "kept")


_BITS = {letter: 1 << k for k, letter in enumerate(filter_audit.FILTERS)}
_ORDERS = "\n  ".join(["CROSS JOIN l AS l2", "CROSS JOIN l AS l3", "CROSS JOIN l AS l4", "CROSS JOIN l AS l5"])

AUDIT_SQL = f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
told AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < {filter_audit.LEAST_WORDS} THEN {_BITS['A']} ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < {filter_audit.LEAST_DISTINCT_PERCENT} * len(w) THEN {_BITS['B']} ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {filter_audit.MOST_CAPITAL_PERCENT} * length(text)
        THEN {_BITS['C']} ELSE 0 END
    + CASE WHEN regexp_matches(text, '{filter_audit.SYMBOLS}') THEN {_BITS['D']} ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN {_BITS['E']} ELSE 0 END AS mask
  FROM t LEFT JOIN told USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (SELECT concat(l1.x, l2.x, l3.x, l4.x, l5.x) AS filter_order FROM l AS l1 {_ORDERS}
  WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31 AND l1.b | l2.b | l3.b | l4.b | l5.b = 31),
steps AS (SELECT filter_order, step, b,
    sum(b) OVER (PARTITION BY filter_order ORDER BY step) - b AS before
  FROM (SELECT filter_order, step, substring(filter_order, step, 1) AS x FROM orders, range(1, 6) AS r(step)) JOIN l USING (x)),
told_steps AS (SELECT part, filter_order, step, b,
    sum(CASE WHEN mask & (before + b)::INT = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before::INT = 0 AND mask & b <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before::INT <> 0 AND mask & b <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before::INT = 0 AND mask & b <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before::INT = 0 AND mask & b <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, b)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM told_steps"""


@query("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


#: CRC-32 of a decimal number: eight steps per character from the fixed start value, inverted at the end.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda s, k: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)),
    4294967295), 4294967295)"""

TRIE_SQL = f"""WITH t AS (SELECT conv_id AS c, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM conversations),
p AS (SELECT c, key, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM t),
convs AS (SELECT c, {_CRC} % {prefix_trie.HEADS} AS h, c - c % {prefix_trie.GROUP} AS base FROM (SELECT DISTINCT c FROM p)),
r AS (SELECT convs.c, 0 AS own, pos, key, words FROM convs JOIN p ON p.c = base AND pos < h
  UNION ALL SELECT convs.c, 1, pos, key, words FROM convs JOIN p ON p.c = convs.c AND pos >= h),
s AS (SELECT c, list(key ORDER BY own, pos) AS keys, list(words ORDER BY own, pos) AS words FROM r GROUP BY c),
q AS (SELECT convs.c, array_to_string(coalesce(keys, []), '') AS whole, coalesce(words, []) AS words, len(coalesce(keys, [])) AS n FROM convs LEFT JOIN s ON s.c = convs.c),
n AS (SELECT substring(whole, 1, 32 * d) AS node, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
    any_value(CASE WHEN d > 0 THEN words[d] ELSE 0 END) AS words
  FROM (SELECT c, whole, words, unnest(range(0, n + 1)) AS d FROM q) GROUP BY 1, 2),
k AS (SELECT substring(node, 1, 32 * (depth - 1)) AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, depth)),
below AS (SELECT substring(node, 1, 32 * a) AS node, a AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM m) GROUP BY 1, 2),
e AS (SELECT whole AS node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM q GROUP BY whole)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM m JOIN below USING (node, depth) LEFT JOIN e ON e.node = m.node
LEFT JOIN m AS up ON up.node = substring(m.node, 1, 32 * (m.depth - 1)) AND up.depth = m.depth - 1"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))
