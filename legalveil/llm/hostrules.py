"""Host-level quality rules, with DataFrame operations only.

Each document gets the base rules from its words and lines, in its own row. Failures are summed by
host, the hosts' failure rates are shrunk with a beta prior fitted to all hosts by moments, and the
hosts' verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, read, written

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
MOST_FAILED = 0.5  # a host whose shrunk failure rate is above this is refused
LEAST_PRIOR = 2.0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def window_hashes(d: DataFrame, window: int) -> DataFrame:
    """Replaces the word hashes in __lv_h by hashes of the windows that start at each word, by
    doubling: windows of 1, 2, 4, ... words, and for other widths of two that overlap."""
    width = 1
    while width < window:
        step = min(width, window - width)
        m = F.greatest(F.size("__lv_h") - step, F.lit(0))
        d = d.withColumn("__lv_h", F.transform(F.slice("__lv_h", 1, m), lambda x, i: F.xxhash64(x, F.get("__lv_h", i + step))))
        width += step
    return d


def base_rules(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs.

    Repeated windows are found by a 64-bit hash of each window: first whether any repeats at all,
    and only then where, from the sorted (hash, position) pairs. Null and empty text have no words
    and fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("__lv_w", words_of(text))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__lv_l", F.when(text.contains("\n"), lines).otherwise(F.array().cast("array<string>")))
    n = F.size("__lv_w")
    d = window_hashes(d.withColumn("__lv_h", F.transform("__lv_w", lambda x: F.xxhash64(x))), window)
    pairs = F.sort_array(F.transform(F.col("__lv_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__lv_s", F.when(F.size(F.array_distinct("__lv_h")) < F.size("__lv_h"), pairs))
    s = F.col("__lv_s")
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("__lv_p", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate("__lv_p", F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")), lambda a, p: F.struct((a["n"] + F.least(p - a["at"], F.lit(window))).alias("n"), p.alias("at")), lambda a: a["n"])
    d = d.withColumn("n_words", n.cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("__lv_w", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("__lv_l") - F.size(F.array_distinct("__lv_l"))).cast("long"))
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("__lv_w", "__lv_l", "__lv_h", "__lv_s", "__lv_p")


def host_rates(facts: DataFrame, host_col: str = "host", least_prior: float = LEAST_PRIOR) -> DataFrame:
    """One row per host: n_docs, n_failed, rate, shrunk. The beta prior has the mean and variance
    of the hosts' rates beyond what sampling explains; its strength is at least ``least_prior``
    documents, and where hosts do not differ the prior alone decides nothing: the strength is then
    the mean host size."""
    by = facts.groupBy(host_col).agg(F.count("*").alias("n_docs"), F.count_if(F.col("base_failed")).alias("n_failed"))
    by = by.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    prior = by.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.avg("n_docs").alias("size"), F.coalesce(F.var_samp("rate"), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv"))
    extra = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv")
    strength = F.when(extra > 0, F.greatest(F.lit(least_prior), F.least(F.col("m") * (1 - F.col("m")) / extra - 1, F.col("size")))).otherwise(F.greatest(F.lit(least_prior), F.col("size")))
    m, k = prior.select("m", strength.alias("strength")).first()  # two numbers
    m, k = F.lit(m or 0.0), F.lit(k or least_prior)
    return by.select(host_col, "n_docs", "n_failed", "rate", ((F.col("n_failed") + m * k) / (F.col("n_docs") + k)).alias("shrunk"))


def host_rules(docs: DataFrame, *, id_col="doc_id", text_col="text", host: Column | str = "source", most_failed: float = MOST_FAILED) -> DataFrame:
    """Per row of docs: doc_id, host, the base facts, host_rate (shrunk) and kept.

    ``host`` is a column or an expression such as parse_url(url, 'HOST'). Rows without a host have
    no host verdict and keep their own; repeated rows each count. Rates are few beside documents and
    mostly broadcast by their size; beyond that, a hot host's partition is split by the adaptive
    skew join."""
    host = F.col(host) if isinstance(host, str) else host
    facts = base_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host.alias("host")))
    facts = written(facts.drop("text"), "hostfacts")
    rates = written(host_rates(facts.filter("host is not null")).select("host", F.col("shrunk").alias("host_rate")), "hostrates")
    # rows without a host go where the hash of their id takes them, not all to one task
    own = F.coalesce(F.concat(F.lit("="), F.col("host")), F.xxhash64("doc_id").cast("string"))
    out = facts.join(rates.withColumnRenamed("host", "of"), own == F.concat(F.lit("="), F.col("of")), "left").drop("of")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= most_failed))


def op6_host_rules(spark, sf_dir: str) -> DataFrame:
    out = host_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], chr(1))) AS h FROM d, unnest(range(1, len(w) - 6)) AS r(i) WHERE len(w) >= 8),
b AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS k FROM h),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + j AS p FROM b, unnest(range(0, 8)) AS s(j) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line FROM d, unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
f AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
r AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM g WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS m, avg(n) AS size, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS inv FROM r),
q AS (SELECT m, CASE WHEN v - m * (1 - m) * inv > 0 THEN greatest(2.0, least(m * (1 - m) / (v - m * (1 - m) * inv) - 1, size)) ELSE greatest(2.0, size) END AS strength FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce((k + m * strength) / (n + strength), 0) <= 0.5 AS kept
FROM g LEFT JOIN r USING (source) CROSS JOIN q
"""
