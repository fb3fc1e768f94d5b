"""Operator 8, quality rules with host verdicts, in DataFrame functions only.

Rules are judged per text; failures are summed by host (a column naming the domain or source); each host's
failure rate is shrunk towards the pooled rate by a beta prior fitted to all hosts by moments; hosts whose
shrunk rate is above ``reject_rate`` lose their documents too. Documents are never moved by host: only one row per
host is, so a host with a third of all rows costs no more than others.

Null and empty texts have no words and fail the rules. A null host is a host of its own. Repeated rows are
judged each. An empty table gives an empty result. Other columns of the input are kept by ``reject`` and
ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspan.llm.common import GAP_CHARS, documents, shielded, small, stored, whole, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REJECT_RATE = 0.8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(tri: Column) -> Column:
    """Words covered by windows found twice or more; ``tri`` has a hash per window, in order."""
    order = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(tri)
    as_next = lambda s: F.zip_with(s, F.slice(s, 2, n), lambda a, b: F.coalesce(a.h == b.h, F.lit(False)))
    either = lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda x, y: F.coalesce(x, F.lit(False)) | y)
    at = F.transform(F.array(order), lambda s: F.zip_with(s, either(as_next(s)), lambda a, f: F.when(f, a.i)))[0]
    at = F.array_sort(F.filter(at, lambda p: p.isNotNull()))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")),
        lambda a: a.n,
    )
    return F.when(F.size(F.array_distinct(tri)) == n, F.lit(0)).otherwise(covered)


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The input's columns (or ``keep``) and the five counts, prefixed ``_q_`` to stay clear of the input's names."""
    t = whole(F.col(text))
    cols = [F.col(c) for c in (df.columns if keep is None else keep)]
    own = [F.col(f"_q_{c}") for c in COUNTS]
    df = df.select(*cols, t.alias("_q_t"), words_of(F.col(text)).alias("_q_w"))
    lines = F.filter(F.split("_q_t", "\n", -1), lambda x: F.translate(x, GAP_CHARS, "") != "")
    df = df.select(
        *cols,
        F.size("_q_w").cast("long").alias("_q_n_words"),
        F.length(F.translate("_q_t", GAP_CHARS, "")).cast("long").alias("_q_word_chars"),
        (F.length("_q_t") - F.length(F.translate("_q_t", SYMBOLS, ""))).cast("long").alias("_q_n_symbols"),
        lines.alias("_q_lines"),
        F.transform("_q_w", lambda w: F.xxhash64(w)).alias("_q_h"),
    )
    n = F.size("_q_h")
    pair = F.zip_with("_q_h", F.slice("_q_h", 2, n), lambda a, b: F.xxhash64(a, b))
    tri = F.zip_with(pair, F.slice("_q_h", 3, n), lambda a, b: F.xxhash64(a, b))
    df = df.select(
        *cols, *own[:3],
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_n_dup_lines"),
        F.when(n >= 3, F.slice(tri, F.lit(1), n - 2)).otherwise(F.expr("array()").cast("array<bigint>")).alias("_q_tri"),
    )
    return df.select(*cols, *own[:4], _repeat_words(F.col("_q_tri")).cast("long").alias("_q_n_repeat_words"))


def failed(prefix: str = "_q_", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < min_words) | (r * 100 > n * max_repeat_percent)


def host_verdicts(judged: DataFrame, host: str, fail: str, reject_rate: float = REJECT_RATE) -> DataFrame:
    """A row per host: _host, _n, _fails, _rate (shrunk), _rejected. The prior has the moments of the hosts' rates."""
    by = judged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_n"), F.sum(F.col(fail).cast("long")).alias("_fails"))
    pooled = by.agg(
        F.sum("_n").alias("n"), F.sum("_fails").alias("f"),
        F.sum(F.col("_fails") * F.col("_fails") / F.col("_n")).alias("ff"),
    ).select(
        (F.col("f") / F.col("n")).alias("_m"),
        F.greatest(F.lit(1e-9), F.col("ff") / F.col("n") - F.pow(F.col("f") / F.col("n"), F.lit(2.0))).alias("_v"),
    ).select("_m", F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1)).alias("_k"))
    rate = (F.col("_fails") + F.col("_m") * F.col("_k")) / (F.col("_n") + F.col("_k"))
    return by.crossJoin(F.broadcast(pooled)).select("_host", "_n", "_fails", F.round(rate, 6).alias("_rate"), (F.round(rate, 6) > reject_rate).alias("_rejected"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", reject_rate: float = REJECT_RATE) -> DataFrame:
    """Per row: key, the five counts, base_failed, host_rate, kept."""
    counts = stored(
        measured(docs.select(key, text, F.col(host).alias("_q_host")), text, (key, "_q_host")).withColumn("_q_failed", failed())
    )
    hosts = stored(host_verdicts(counts, "_q_host", "_q_failed", reject_rate))
    return counts.join(small(hosts), F.col("_q_host").eqNullSafe(F.col("_host")), "left").select(
        key, *(F.col(f"_q_{c}").alias(c) for c in COUNTS), F.col("_q_failed").alias("base_failed"),
        F.col("_rate").alias("host_rate"), (~F.col("_q_failed") & ~F.coalesce("_rejected", F.lit(False))).alias("kept"),
    )


def reject(docs: DataFrame, text: str = "text", host: str = "source", reject_rate: float = REJECT_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept, columns as they are. Texts are read twice and never shuffled."""
    docs, named = shielded(docs, text, host)
    counts = measured(docs.select(text, F.col(host).alias("_q_host")), text, ("_q_host",)).withColumn("_q_failed", failed())
    hosts = stored(host_verdicts(counts, "_q_host", "_q_failed", reject_rate)).where("_rejected").select("_host")
    # a generator of one row or none: a filter would be pushed below the counts and evaluate them again for each use
    good = measured(docs, text).withColumn("_q_failed", failed())
    good = good.select(*docs.columns, F.explode(F.when(~F.col("_q_failed"), F.array(F.lit(1)))).alias("_q_one")).select(*docs.columns)
    return named(good.join(small(hosts), F.col(host).eqNullSafe(F.col("_host")), "left_anti"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS fails FROM b GROUP BY source
), p AS (
  SELECT sum(fails)::DOUBLE / sum(n) AS m,
         greatest(1e-9, sum(fails * fails / n::DOUBLE) / sum(n) - pow(sum(fails)::DOUBLE / sum(n), 2.0)) AS v FROM h
), k AS (
  SELECT m, least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) AS k FROM p
), r AS (
  SELECT source, round((fails + m * k) / (n + k), 6) AS host_rate FROM h, k
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
       (NOT base_failed AND host_rate <= 0.8) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
