"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Every document of a source has the same number of expected copies, target / source size. Their prefix sum within the
source is that number times the rank of the document, so ranks are all that has to be counted. Ranks come in two
levels: a window inside small cells (source, size class, salt), and a prefix sum over the counts of the cells; no task
ever holds a whole source. A salt is a hash of the doc_id, or of the text if that is null; there are as many as give each
of them max(ROWS_PER_SALT, square root of all rows) rows, so both levels grow with the root. One random offset a source,
and a document is emitted once per integer boundary that its stretch of the prefix sum crosses.

Nulls: a null text has size 0; null sources form one source, the last one; a null doc_id is kept. Repeated rows are
separate documents. Ties of size are ordered by doc_id and then by the text's hash, so reruns agree but for rows that are
equal in all three, which may swap their copies. Very long texts are counted whole. An empty table gives an empty one.
Input columns of the result's names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.llm.common import staged, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
ROWS_PER_SALT = 2_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_key, source_size) for each source -> with target and rate.

    Targets are min(cap * size, level * weight): capping what is above and sharing the excess by weight again, until
    none is above, ends at this level. Sources sorted by cap * size / weight are capped from the front. The windows
    here run over one row a source.
    """
    order = Window.orderBy(F.col("_key") == "n", "_key")
    by_ratio = Window.orderBy("_ratio", "_pos")
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_pos"), F.lit(len(weights))) + 1).cast("int"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("_pos", F.row_number().over(order) - 1)
        .withColumn("_w", weight)
        .withColumn("_most", F.col("source_size") * F.lit(cap))
        .withColumn("_ratio", F.col("_most") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("_full", F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_left"))
    )
    # the first source in this order that its level leaves below its cap
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_pos", "_level"))).over(whole)["_level"]
    target = F.coalesce(F.least(F.col("_most"), level * F.col("_w")), F.col("_most"))
    return ranked.withColumn("target", target).select(
        "_key", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"),
    )


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the source's key and a hash of the text."""
    return docs.withColumns({
        "_tie": F.md5(F.coalesce(F.col("text"), F.lit(""))),
        "size": F.when(F.col("text").isNull(), 0).otherwise(F.size(words_of(F.col("text")))).cast("long"),
        "_key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
    })


def with_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """docs (with text, or with size, _key and _tie instead) plus size, source_size, target, copies and taken."""
    base = docs if "_key" in docs.columns else sized(docs)
    thin = base if "text" not in docs.columns else staged(base.select("_key", "size", "doc_id", "_tie"), "mix-sizes")
    n = thin.count()
    salts = max(1, math.ceil(n / max(rows_per_salt, math.ceil(math.sqrt(n)))))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("_tie"))), 1, 8), 16, 10).cast("long")

    def celled(df: DataFrame) -> DataFrame:
        return df.withColumns({"_class": F.length(F.bin("size")), "_salt": F.pmod(hashed, F.lit(salts)).cast("long")})

    cells = celled(thin).groupBy("_key", "_class", "_salt").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    sources = source_targets(cells.groupBy("_key").agg(F.sum("_size").alias("source_size")), weights, share, cap)
    ahead = Window.partitionBy("_key").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    cells = (
        cells.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .join(sources, "_key")
        .select("_key", "_class", "_salt", "_ahead", "source_size", "target", "_rate", offset.alias("_offset"))
    )
    cells = staged(cells, "mix-cells")
    inside = Window.partitionBy("_key", "_class", "_salt").orderBy("size", "doc_id", "_tie")
    ranked = celled(base.drop("source_size", "target", "copies", "taken")).withColumn("_rank", F.row_number().over(inside))
    rank = F.col("_ahead") + F.col("_rank")
    copies = F.floor(F.col("_rate") * rank + F.col("_offset")) - F.floor(F.col("_rate") * (rank - 1) + F.col("_offset"))
    return (
        ranked.join(cells, ["_key", "_class", "_salt"])
        .withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_key", "_class", "_salt", "_rank", "_ahead", "_rate", "_offset", "_tie")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as often as it has copies, with the columns of docs.

    Rows get numbers and are staged with them; only numbers, sizes and hashes are ranked, and the copies come back to the
    documents by a hash join that holds no text. So no sort or window holds the texts of a cell.
    """
    rows = staged(sized(docs.withColumn("_doc", F.struct(*docs.columns))).select("_doc", "doc_id", "size", "_key", "_tie", F.monotonically_increasing_id().alias("_row")), "mix-rows")
    copies = with_copies(rows.drop("_doc"), **options).where("copies > 0").select("_row", "copies")
    out = rows.select("_doc", "_row").join(copies.hint("shuffle_hash"), "_row")
    out = out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
    out.staged_inputs = [rows]  # to be discarded when the result has been written
    return out


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_copies(staged(sized(docs).select("doc_id", "size", "_key", "_tie"), "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, md5(COALESCE(text, '')))), 1, 8))::UBIGINT AS h, md5(COALESCE(text, '')) AS tie
  FROM documents),
src AS (SELECT k, SUM(size)::BIGINT AS source_size FROM base GROUP BY k),
pos AS (SELECT *, CASE (row_number() OVER (ORDER BY k = 'n', k) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         row_number() OVER (ORDER BY k = 'n', k) AS p FROM src),
lev AS (SELECT *, 2.0::DOUBLE * source_size AS most,
  (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(2.0::DOUBLE * source_size) OVER before, 0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER before, 0)) AS level
  FROM pos WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT *, COALESCE(LEAST(most, w * (SELECT level FROM lev WHERE most / w >= level ORDER BY most / w, p LIMIT 1)), most) AS target FROM lev),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix:' || k), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM tgt),
salts AS (SELECT GREATEST(1, ceil(COUNT(*)::DOUBLE / GREATEST(2000, ceil(sqrt(COUNT(*))))))::UBIGINT AS s FROM base),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY k ORDER BY length(bin(size)), h % s, size, doc_id, tie) AS r FROM base b, salts),
emitted AS (SELECT doc_id, size, source_size, target, (floor(rate * r + u) - floor(rate * (r - 1) + u))::BIGINT AS copies FROM ranked JOIN rates USING (k))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM emitted
"""
