"""Quality rules with host-level verdicts; DataFrame functions only.

Rules run over each whole text. Failures are counted by host, the failure rates are shrunk with a beta prior whose
parameters are fitted to the hosts' own rates (method of moments), and a host whose shrunk rate reaches the limit is
rejected with all its documents.

Nulls: a null text counts as empty and fails the rule on length; null hosts form one host; null doc_ids are kept.
Repeated rows and ties are separate documents, and each counts for its host. Very long texts are measured whole: repeated
windows are found by sorting. An empty table gives an empty one. Input columns of the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import GAP, WORD, let, staged, words_of

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
HOST_LIMIT = 0.5


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Windows are compared by 64-bit hashes. The starts of repeated ones, in order, each cover three words less what
    the next one covers again.
    """
    n = F.size(words)

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - starts[i - 1]))), F.lit(0), lambda a, x: a + x)

    def repeated_starts(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))

        def pick(s: Column) -> Column:
            again = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["hash"] == x["hash"]) | (F.get(s, i + 1)["hash"] == x["hash"]), x["at"]))
            return F.sort_array(F.filter(again, lambda at: at.isNotNull()))

        return let(keyed, pick)

    def of_hashes(h: Column) -> Column:
        repeated = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(repeated, let(repeated_starts(h), covered)).otherwise(F.lit(0))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, of_hashes))


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    both = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")))
    return (
        docs.withColumns({
            "_both": both,
            "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        })
        .withColumns({"n_words": F.col("_both.n"), "n_repeat_words": F.col("_both.r")})
        .drop("_both")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    )


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(_host, host_docs, host_failed, host_rate, host_rejected); one row a host."""
    failed = F.col("base_failed") | (F.col("n_symbols") * 100 > F.col("word_chars") * SYMBOL_PERCENT) | (F.col("n_dup_lines") * 100 > F.col("n_words") * DUP_LINE_PERCENT)
    hosts = measured.groupBy(F.coalesce(F.concat(F.lit("s"), F.col(host)), F.lit("n")).alias("_host")).agg(
        F.count("*").alias("host_docs"), F.count_if(failed).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("inv"))
    # the variance between hosts, less what sampling alone gives; at least a little, at most that of a flat prior
    spread = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv"), F.lit(1e-4))
    weight = F.greatest(F.least(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(1000.0)), F.lit(2.0))
    prior = prior.select(F.struct((F.col("m") * weight).alias("a"), ((1 - F.col("m")) * weight).alias("b")))
    shrunk = (F.col("host_failed") + F.col("_prior.a")) / (F.col("host_docs") + F.col("_prior.a") + F.col("_prior.b"))
    return hosts.withColumn("_prior", prior.scalar()).withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") >= limit).drop("_prior")


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: measures, its host's shrunk rate and the verdict kept."""
    measured = measures(docs.select("doc_id", F.col(host).alias("source"), "text")).drop("text")
    measured = staged(measured, "quality")
    hosts = host_verdicts(measured, "source", limit)
    keyed = measured.withColumn("_host", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    return keyed.join(hosts, "_host", "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))).drop("_host")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, source, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT rid, i, a || ' ' || b || ' ' || c AS g FROM (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id AS rid, w FROM t WHERE len(w) >= 3))),
rep AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, COUNT(DISTINCT p) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT t.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, COALESCE(r, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN cov ON rid = t.doc_id),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m),
h AS (SELECT source, COUNT(*) AS n, COUNT(*) FILTER (base_failed OR n_symbols * 100 > word_chars * 10 OR n_dup_lines * 100 > n_words * 30) AS k FROM f GROUP BY source),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v, avg(1 / n) AS inv FROM h),
q AS (SELECT m, GREATEST(LEAST(m * (1 - m) / GREATEST(v - m * (1 - m) * inv, 1e-4) - 1, 1000), 2) AS s FROM p),
x AS (SELECT source, (k + m * s) / (n + s) >= 0.5 AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
"""
