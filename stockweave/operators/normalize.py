"""Rows under arbitrary headers to the ten-column template, and template rows to part name, quantity and maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave import catalog
from stockweave.functions import jvm, refdes, text
from stockweave.operators.headers import resolve

_APPEND = ("reference_designator", "notes")


def _append(held: Column, more: Column, sep: str) -> Column:
    return F.when(held != "", F.concat(held, F.lit(sep), more)).otherwise(more)


def _clean(header: str, c: Column) -> Column:
    return refdes.expand(c) if header == "reference_designator" else text.strip(c)  # expand strips, too


def normalize(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The template's columns, and those of keep, of a wide frame; one projection, no shuffle.

    Columns go in file order. Designators and notes of several columns are joined by a comma, even empty ones after the
    first that has text; elsewhere the first value that isn't empty counts, before stripping. Columns without a header
    end in notes as "name: value", if they aren't empty.
    """
    keep = keep or []
    held: dict[str, Column] = {h: F.lit("") for h in catalog.HEADERS}
    for name in raw.columns:
        if name in keep:
            continue
        cell, header = F.col(f"`{name}`").cast("string"), resolve(name)
        if header is None:
            noted = F.concat(F.lit(f"{name}: "), cell)
            held["notes"] = F.when(F.coalesce(cell, F.lit("")) == "", held["notes"]).otherwise(_append(held["notes"], noted, "; "))
        elif header in _APPEND:
            held[header] = F.when(held[header] != "", F.concat(held[header], F.lit(", "), F.coalesce(cell, F.lit("None")))).otherwise(F.coalesce(cell, F.lit("")))
        else:
            held[header] = F.when(held[header] != "", held[header]).otherwise(F.coalesce(cell, F.lit("")))
    return raw.select(*[F.col(f"`{k}`") for k in keep], *[_clean(h, c).alias(h) for h, c in held.items()])


_RUN = "_pos array<int>, _names array<string>, _headers array<string>, _values array<string>"


def _runs(row: list[str]):
    """Batches of cells to one row for each run of cells whose row columns are equal."""

    def codes(c: pa.Array) -> np.ndarray:
        return pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, str | None] = {}
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for k in row:
                at = codes(b.column(k))
                new[1:] |= at[1:] != at[:-1]
            first = np.flatnonzero(new)
            names = b.column("col_name").dictionary_encode()
            for n in names.dictionary.to_pylist():
                if n not in known:
                    known[n] = resolve(n)
            headers = pa.DictionaryArray.from_arrays(names.indices, pa.array([known[n] for n in names.dictionary.to_pylist()], pa.string())).cast(pa.string())
            offsets = pa.array(np.append(first, b.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, c) for c in (b.column("col_pos"), b.column("col_name"), headers, b.column("value"))]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(first)) for k in row], *lists], [*row, "_pos", "_names", "_headers", "_values"])

    return gather


def normalize_cells(cells: DataFrame, row: list[str]) -> DataFrame:
    """The same for long rows (row..., col_pos, col_name, value), whose headers are data; one shuffle, by row.

    Cells of a row mostly come one after the other, so they are gathered into arrays where they are read: runs are
    shuffled instead of cells, and grouped only after that, so no sort before the shuffle holds a partition's cells.
    """
    columns = cells.select(*row, F.col("col_pos").cast("int").alias("col_pos"), "col_name", "value")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[: len(row)])
    runs = columns.mapInArrow(_runs(row), f"{keys}, {_RUN}").repartition(*row)
    # a window, since an aggregate into a list is sorted and serialized twice
    every = Window.partitionBy(*row).orderBy(F.col("_pos")[0])
    whole = F.collect_list(F.struct("_pos", "_names", "_headers", "_values")).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    grouped = runs.select(*row, whole.alias("_runs"), F.row_number().over(every).alias("_n")).where("_n = 1")
    parts = [F.flatten(F.col(f"_runs.{c}")) for c in ("_pos", "_names", "_headers", "_values")]
    held = jvm.call("Fold", T.ArrayType(T.StringType()), *parts, F.lit("\n".join(catalog.HEADERS)))
    return grouped.select(*row, held.alias("_held")).select(*row, *[_clean(h, F.get("_held", F.lit(i))).alias(h) for i, h in enumerate(catalog.HEADERS)])


def part_name() -> Column:
    number, description = (text.strip(F.col(c)) for c in ("part_number", "description"))
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(description, F.lit("")), F.lit(catalog.UNNAMED))


def _filled(**columns: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c)]), lambda k, v: v.isNotNull() & (v != ""))


def parsed(rows: DataFrame, index: str = "row_index") -> DataFrame:
    """part_name, quantity, attributes, context and the index of template rows."""
    kept = {k: F.col(k) for k in ("value", "package", "manufacturer", "manufacturer_part_number", "description", "unit")}
    return rows.select(
        part_name().alias("part_name"), text.quantity(F.col("quantity")).alias("quantity"),
        _filled(**kept, tolerance=text.tolerance(F.col("notes"))).alias("attributes"),
        _filled(reference_designator=F.col("reference_designator"), notes=F.col("notes")).alias("context"),
        F.col(index).cast("int").alias("row_index"),
    )


def part_attributes(attributes: Column) -> Column:
    return text.pick(attributes, catalog.PART_KEYS)


def usage_context(context: Column) -> Column:
    return text.pick(context, catalog.CONTEXT_KEYS)


def snapshot_attributes(context: Column) -> Column:
    return text.pick(context, ["reference_designator"])


def invalid_fields(rows: DataFrame) -> DataFrame:
    """Template rows with the headers whose values match none of their field's patterns (empty values pass)."""
    bad = [F.when((F.col(h) != "") & ~F.col(h).rlike("|".join(f"(?:{p})" for p in ps)), F.lit(h)) for h, (_, ps) in catalog.FIELD_PATTERNS.items()]
    return rows.withColumn("invalid_fields", F.array_compact(F.array(*bad)))
