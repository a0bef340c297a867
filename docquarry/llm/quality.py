"""Host-level quality rules (operator 6): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import SPACES, materialize, spread, with_columns_free

COUNTERS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTERS, "base_failed", "rules_failed", "host_docs", "host_failures", "host_rate", "host_failed", "kept")
SYMBOL = r"[#*$%&|<>]"


def _repeat_words(words: Column, size: int) -> Column:
    """Words that stand in some window of ``size`` words found twice or more in the array.

    Windows become 64-bit hashes. Only where two are equal (a hash set over longs decides) are the
    hashes sorted with their places; a repeated place p then covers p .. p+size-1, of which the part
    beyond the next repeated place is counted there.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - F.lit(size)),
        lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(size)]),
    )
    def with_neighbours(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        return F.array_sort(
            F.transform(
                F.filter(
                    F.transform(
                        sorted_,
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            (
                                F.coalesce((k > 0) & (F.get(sorted_, k - 1)["h"] == x["h"]), F.lit(False))
                                | F.coalesce((k < last) & (F.get(sorted_, k + 1)["h"] == x["h"]), F.lit(False))
                            ).alias("again"),
                        ),
                    ),
                    lambda x: x["again"],
                ),
                lambda x: x["i"],
            )
        )

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-size).alias("end")),
            lambda s, p: F.struct(
                (s["n"] + p + F.lit(size) - F.greatest(p, s["end"])).alias("n"), (p + F.lit(size)).alias("end")
            ),
            lambda s: s["n"],
        )

    # Arrays that are used more than once are bound by one-element transforms, so each is made once.
    def of(array: Column, then) -> Column:
        return F.get(F.transform(F.array(array), then), F.lit(0))

    found = of(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            of(
                F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                lambda s: covered(with_neighbours(s)),
            )
        ),
    )
    return F.when(F.size(words) > F.lit(size), found).otherwise(F.lit(0))


def quality_counters(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with the rule counters of each whole text; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACES + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("_words", words)
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words(F.col("_words"), window).cast("long"))
        .drop("_words", "_lines")
    )


def host_verdicts(judged: DataFrame, host_col: str, fail_col: str, max_rate: float) -> DataFrame:
    """One row per host: documents, failures, failure rate shrunk by a beta prior, verdict.

    The prior is fitted to all hosts by moments: mean m = failures / documents; the variance of the host
    rates around m, weighted by documents and less what binomial chance explains, gives the strength
    s = m(1-m)/variance - 1, held between 1 and 10000; rate = (failures + s m) / (documents + s).
    """
    hosts = judged.groupBy(F.col(host_col).alias("_host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(fail_col).cast("long")).alias("host_failures")
    )
    totals = hosts.agg(
        F.sum("host_docs").alias("_n"),
        F.sum("host_failures").alias("_k"),
        F.count(F.lit(1)).alias("_h"),
        F.sum(F.col("host_failures") * F.col("host_failures") / F.col("host_docs")).alias("_kk"),
    )
    mean = F.col("_k") / F.col("_n")
    between = (F.col("_kk") / F.col("_n") - mean * mean) - mean * (1 - mean) * F.col("_h") / F.col("_n")
    strength = F.when(
        (between > 0), F.greatest(F.lit(1.0), F.least(F.lit(10000.0), mean * (1 - mean) / between - 1))
    ).otherwise(F.lit(10000.0))
    prior = totals.select(mean.alias("_mean"), strength.alias("_strength"))
    # The prior is one row, so this broadcast has a fixed size.
    rated = hosts.join(F.broadcast(prior), F.lit(True)).withColumn(
        "host_rate",
        F.round((F.col("host_failures") + F.col("_strength") * F.col("_mean")) / (F.col("host_docs") + F.col("_strength")), 9),
    )
    return rated.withColumn("host_failed", F.col("host_rate") > max_rate).drop("_mean", "_strength")


def apply_quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_symbol_percent: int = 10,
    max_dup_line_percent: int = 30,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """``docs`` without the text, with counters, rule failures, host figures and ``kept``.

    A document fails a rule if it is too short or too repetitive (the base rules, which also reject it
    by themselves), or has too many symbols or repeated lines. Failures are summed by host (``host_col``,
    null is a host of its own), each host's rate is shrunk by the empirical beta prior, and hosts above
    ``max_host_rate`` fail; ``kept`` is false for failed documents and for all documents of failed hosts.

    Counters are made once and written as a narrow table, as both the host sums and the join back read
    them; hosts are summed map-side first, and the join back is on the small host table, so a hot host
    only matters if that table is not broadcast, where the adaptive skew join splits it.

    Null or empty text: counters 0, fails as too short. Repeated rows count one by one for their host and
    are judged alike. Very long texts are counted whole, in one task each. No rows: no rows. Columns that
    clash are replaced.
    """
    base = with_columns_free(docs, *ADDED, "_host", "_key")
    counted = quality_counters(base, text_col).drop(text_col)
    n = F.col("n_words")
    counted = counted.withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n))
    counted = counted.withColumn(
        "rules_failed",
        F.col("base_failed")
        | (100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines")),
    )
    counted = materialize(counted, "quality")
    verdicts = host_verdicts(counted, host_col, "rules_failed", max_host_rate)
    return (
        counted.join(verdicts, counted[host_col].eqNullSafe(verdicts["_host"]))
        .drop("_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return apply_quality_rules(docs).select(
        "doc_id", *COUNTERS, "base_failed", "kept", "rules_failed", "host_docs", "host_failures", "host_rate", "host_failed"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, md5(list_aggregate(words[i:i + 4], 'string_agg', ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c >= 2),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
k AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM k),
j AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS rules_failed FROM b),
h AS (SELECT source, count(*) AS host_docs, sum(rules_failed::BIGINT)::BIGINT AS host_failures FROM j GROUP BY source),
t AS (
  SELECT sum(host_failures)::DOUBLE / sum(host_docs)::DOUBLE AS m, sum(host_docs)::DOUBLE AS n, count(*)::DOUBLE AS h,
         sum((host_failures * host_failures)::DOUBLE / host_docs::DOUBLE) AS kk FROM h),
v AS (SELECT m, (kk / n - m * m) - m * (1 - m) * h / n AS between_ FROM t),
s AS (
  SELECT m, CASE WHEN between_ > 0 THEN greatest(1.0::DOUBLE, least(10000.0::DOUBLE, m * (1 - m) / between_ - 1))
            ELSE 10000.0::DOUBLE END AS s FROM v),
r AS (
  SELECT h.source, host_docs, host_failures, round((host_failures + s.s * s.m) / (host_docs + s.s), 9) AS host_rate
  FROM h, s)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_rate > 0.5) AS kept, rules_failed, host_docs, host_failures, host_rate,
       host_rate > 0.5 AS host_failed
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""
