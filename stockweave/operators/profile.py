"""Statistical column profiles: one grouped aggregate over long rows (col_name, row_index, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave import catalog
from stockweave.functions.text import is_number, strip

SAMPLE = 200


def long_rows(df: DataFrame, row_index: str) -> DataFrame:
    """col_name, row_index, value of every other column of a wide frame."""
    names = [c for c in df.columns if c != row_index]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]))
    return df.select(F.col(row_index).alias("row_index"), cells.alias("_c")).select("_c.col_name", "row_index", "_c.value")


def sample(cells: DataFrame, size: int | None = SAMPLE) -> DataFrame:
    """The first size values of each column that aren't null or empty; all, if size is None."""
    full = cells.where("value IS NOT NULL AND value != ''")
    if size is None:
        return full
    first = Window.partitionBy("col_name").orderBy("row_index")
    return full.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= size).drop("_rn")


def unit_of(value: Column) -> Column:
    return reduce(lambda out, p: out.when(value.rlike(p[1]), F.lit(p[0])), catalog.UNIT_PATTERNS[1:], F.when(value.rlike(catalog.UNIT_PATTERNS[0][1]), F.lit(catalog.UNIT_PATTERNS[0][0])))


def matches(value: Column, patterns: list[str]) -> Column:
    return value.rlike("|".join(f"(?:{p})" for p in patterns))


def _without(v: Column, pattern: str) -> Column:
    return F.regexp_replace(v, pattern, "")


def profile(cells: DataFrame, size: int | None = SAMPLE) -> DataFrame:
    """One row a column: sample_size, null_count, type, pattern and unit ratios, cardinality, lengths, character classes.

    Values repeat, so they are counted first (with a partial aggregate before the shuffle); every statistic but the
    sample follows from distinct values and their counts.
    """
    nulls = cells.groupBy("col_name").agg(F.count_if(F.col("value").isNull() | (F.col("value") == "")).alias("null_count"))
    clean = sample(cells, size).select("col_name", strip(F.col("value")).alias("v")).where("v != ''")
    v, n = F.col("v"), F.col("n")
    share = lambda c: F.sum(F.when(c, n).otherwise(0)) / F.sum(n)
    digits, letters = F.length(_without(v, r"[^\p{Nd}]")), F.length(_without(v, r"[^\p{L}]"))
    spaces, puncts = F.length(_without(v, r"\S")), F.length(v) - F.length(F.translate(v, catalog.PUNCTUATION, ""))
    percent = lambda c: F.when(F.sum(F.length(v) * n) > 0, F.sum(c * n) * 100.0 / F.sum(F.length(v) * n)).otherwise(0.0)
    values = clean.groupBy("col_name", "v").agg(F.count("*").alias("n"))
    counted = values.withColumns({"_unit": unit_of(v), "_num": is_number(v)}).groupBy("col_name").agg(
        F.sum("n").alias("sample_size"), share(F.col("_num")).alias("numeric"), share(~F.col("_num")).alias("text"),
        share(matches(v, catalog.MPN_PATTERNS)).alias("mpn_like"), share(matches(v, catalog.REFDES_PATTERNS)).alias("ref_des_like"),
        (F.count("*") / F.sum("n")).alias("unique_ratio"), (F.count_if(n > 1) / F.count("*")).alias("repeated_ratio"),
        F.count("*").alias("unique_count"), F.sum("n").alias("total_count"),
        (F.sum(F.length(v) * n) / F.sum("n")).alias("len_mean"), F.percentile(F.length(v), F.lit(0.5), n).alias("len_median"),
        F.min(F.length(v)).alias("len_min"), F.max(F.length(v)).alias("len_max"),
        percent(digits).alias("pct_digits"), percent(puncts).alias("pct_punctuation"), percent(letters).alias("pct_letters"), percent(spaces).alias("pct_whitespace"),
    ).withColumn("mixed", ((F.col("numeric") > 0) & (F.col("text") > 0)).cast("double"))
    return nulls.join(counted, "col_name", "left").join(unit_presence(values), "col_name", "left").withColumns({
        "sample_size": F.coalesce("sample_size", F.lit(0).cast("long")),
        "error": F.when(F.col("total_count").isNull(), F.lit("No non-null values found")),
        "unit_presence": F.when(F.col("total_count").isNotNull(), F.coalesce("unit_presence", F.create_map().cast("map<string,double>"))),
    })


def unit_presence(values: DataFrame) -> DataFrame:
    """col_name, unit_presence of counted values (col_name, v, n)."""
    units = values.withColumn("_unit", unit_of(F.col("v"))).groupBy("col_name", "_unit").agg(F.sum("n").alias("k"))
    entry = F.when(F.col("_unit").isNotNull(), F.struct("_unit", "k"))
    return units.groupBy("col_name").agg(F.sum("k").alias("_all"), F.array_sort(F.array_compact(F.collect_list(entry))).alias("_u")).select(
        "col_name", F.map_from_entries(F.transform("_u", lambda e: F.struct(e["_unit"], (e["k"] / F.col("_all")).alias("share")))).alias("unit_presence")
    )


def map_likeness(a: Column, b: Column) -> Column:
    """Mean over the keys of both: 1 less the relative difference; 0 where only one is 0; 1 without keys."""
    zero = F.lit(0.0)

    def one(k: Column) -> Column:
        x, y = F.coalesce(F.try_element_at(a, k), zero), F.coalesce(F.try_element_at(b, k), zero)
        far = F.least(F.abs(x - y) / F.greatest(F.abs(x), F.abs(y)), F.lit(1.0))
        return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(1.0 - far)

    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.when(F.size(keys) == 0, 1.0).otherwise(F.aggregate(F.transform(keys, one), zero, lambda s, x: s + x) / F.size(keys))


def compare(profiles: DataFrame, others: DataFrame) -> DataFrame:
    """column_a, column_b, similarity of all pairs of profiles: one row a column on either side, so the product is small."""
    packed = [F.col("col_name"), F.col("error"), F.col("unique_ratio"), F.col("len_mean"), F.col("unit_presence").alias("units"),
              _packed("numeric", "text", "mixed").alias("types"), _packed("mpn_like", "ref_des_like").alias("hits"),
              _packed("pct_digits", "pct_punctuation", "pct_letters", "pct_whitespace").alias("chars")]
    a, b = (p.select(F.struct(*packed).alias(x)) for p, x in ((profiles, "a"), (others, "b")))
    length = F.when((F.col("a.len_mean") > 0) & (F.col("b.len_mean") > 0), 1.0 - F.least(F.abs(F.col("a.len_mean") - F.col("b.len_mean")) / F.greatest("a.len_mean", "b.len_mean"), F.lit(1.0)))
    scores = F.array_compact(F.array(
        map_likeness(F.col("a.types"), F.col("b.types")), map_likeness(F.col("a.hits"), F.col("b.hits")), map_likeness(F.col("a.units"), F.col("b.units")),
        1.0 - F.least(F.abs(F.col("a.unique_ratio") - F.col("b.unique_ratio")), F.lit(1.0)), length, map_likeness(F.col("a.chars"), F.col("b.chars")),
    ))
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    failed = F.col("a.error").isNotNull() | F.col("b.error").isNotNull()
    return a.crossJoin(b).select(F.col("a.col_name").alias("column_a"), F.col("b.col_name").alias("column_b"), F.when(failed, 0.0).otherwise(mean).alias("similarity"))


def _packed(*names: str) -> Column:
    return F.create_map(*[x for k in names for x in (F.lit(k), F.col(k))])
