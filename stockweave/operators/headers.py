"""Header mapping: arbitrary column names to the template."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave import catalog
from stockweave.functions.text import header_key


def alias_index() -> list[tuple[str, str]]:
    """(spelling, header): a spelling keeps the place of its first header and means its last one."""
    index: dict[str, str] = {}
    for header, spellings in catalog.ALIASES.items():
        index |= dict.fromkeys(spellings, header)
    return list(index.items())


def template() -> list[str]:
    return list(catalog.HEADERS)


def resolve(name: str | None) -> str | None:
    """The header that a column name means; for plan time, where names are metadata."""
    if not name:
        return None
    key = re.sub(r"[\s_\-]+", " ", name.lower().strip())
    index = dict(alias_index())
    return index.get(key) or next((h for s, h in index.items() if s in key or key in s), None)


def resolve_column(name: Column) -> Column:
    """The same as an expression, for names that are data: an exact spelling, else the first that holds or is held."""
    key = header_key(name)
    index = alias_index()
    exact = F.create_map(*[F.lit(x) for kv in index for x in kv])
    rows = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(h).alias("h")) for s, h in index])
    near = F.get(F.filter(rows, lambda r: key.contains(r["s"]) | r["s"].contains(key)), F.lit(0))["h"]
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(F.try_element_at(exact, key), near))


def mapping_report(columns: list[str]) -> dict:
    """Columns by header, and those without one, sorted; of no columns only the two empty groups."""
    if not columns:
        return {"mapped": {}, "unmapped": []}
    mapped: dict[str, list[str]] = {}
    unmapped = []
    for c in sorted(set(columns)):
        header = resolve(c)
        (mapped.setdefault(header, []) if header else unmapped).append(c)
    return {"mapped": mapped, "unmapped": unmapped, "standard_headers": template()}


def mapping_report_frame(names: DataFrame, column: str = "col_name") -> DataFrame:
    """standard (null: unmapped) and the sorted distinct names that mean it, for names held as rows."""
    named = names.where(F.col(column).isNotNull()).select(column).distinct().withColumn("standard", resolve_column(F.col(column)))
    return named.groupBy("standard").agg(F.array_sort(F.collect_list(column)).alias("columns"))


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, h) for i, (s, h) in enumerate(alias_index())], "ord int, variation string, standard string")
