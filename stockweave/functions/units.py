"""Numbers with units to base units.

A closed table takes the place of a unit library: the spellings in the catalogue, case-sensitively; others leave the
value as it is. Kinds are tried in order, each by its leftmost match anywhere in the text, whatever the case; the first
whose matched spelling is in the table wins. That keeps known oddities: 5mm is 5 metres, since m is tried first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave import catalog
from stockweave.functions.text import is_number, number, strip

_STEMS = {"capacitance": ["F"], "resistance": ["R", "Ω", "ohm"], "voltage": ["V"], "current": ["A"], "frequency": ["Hz"], "power": ["W"], "length": ["m"], "mass": ["g"], "time": ["s"]}


def factors(kind: str, spellings: list[str]) -> dict[str, float]:
    """Each spelling's factor to the base unit, from its prefix; the base of mass is the kilogram."""
    scale = 1e-3 if kind == "mass" else 1.0
    out = {}
    for s in spellings:
        stem = next(x for x in _STEMS[kind] if s.endswith(x))
        out[s] = catalog.SI_PREFIXES[s[: len(s) - len(stem)]] * scale
    return out


def normalize_unit(c: Column) -> Column:
    """struct<num double, text string, unit_in string, unit_out string>: text is set where there is nothing to convert."""
    text = strip(c)
    none = F.lit(None)

    def result(num: Column, unit_in: Column, unit_out: Column, raw: Column) -> Column:
        return F.struct(num.cast("double").alias("num"), raw.cast("string").alias("text"), unit_in.cast("string").alias("unit_in"), unit_out.cast("string").alias("unit_out"))

    out = F.when(c.isNull() | (text == ""), result(none, none, none, c)).when(is_number(c), result(number(c), none, none, none))
    for kind, spellings, base in catalog.QUANTITY_UNITS:
        pattern = rf"(?iu)([0-9.]+)\s*({'|'.join(spellings)})"
        num, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
        table = F.create_map(*[F.lit(x) for kv in factors(kind, spellings).items() for x in kv])
        scaled = num * F.try_element_at(table, unit)
        out = out.when(scaled.isNotNull(), result(scaled, unit, F.lit(base), none))
    pattern = r"(?iu)([0-9.]+)\s*([pnumkMG])(?![a-zA-Z])"
    num, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
    small = F.create_map(*[F.lit(x) for kv in (("p", 1e-12), ("n", 1e-9), ("u", 1e-6), ("µ", 1e-6)) for x in kv])
    low = F.lower(unit)
    out = out.when(num.isNotNull() & F.try_element_at(small, low).isNotNull(), result(num * F.try_element_at(small, low), unit, F.lit("F"), none))
    out = out.when(num.isNotNull() & (low == "k"), result(num * 1e3, unit, F.lit("ohm"), none))
    out = out.when(num.isNotNull() & (low == "m"), result(num, unit, none, none))
    return out.otherwise(result(none, none, none, c))


def engineering(c: Column) -> Column:
    """struct<num, unit> of a number with a bare prefix, as 10n (farad) or 4k (ohm); null without one."""
    pattern = r"(?iu)([0-9.]+)\s*([pnumkMG])(?![a-zA-Z])"
    num, low = F.regexp_extract(c, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(c, pattern, 2))
    scale = F.when(low == "p", 1e-12).when(low == "n", 1e-9).when(low == "u", 1e-6).when(low == "k", 1e3).when(low == "m", 1.0)
    unit = F.when(low.isin("p", "n", "u"), "F").when(low == "k", "ohm")
    return F.when(scale.isNotNull() & num.isNotNull(), F.struct((num * scale).alias("num"), unit.alias("unit")))


def normalize_columns(df, columns: list[str] | None = None):
    """df with the columns (all of them, if None) converted to text of base-unit numbers where they have units."""
    from stockweave.functions.text import json_number

    done = {}
    for name in columns if columns is not None else df.columns:
        u = normalize_unit(F.col(f"`{name}`").cast("string"))
        done[name] = F.coalesce(F.when(u["num"].isNotNull(), json_number(u["num"])), u["text"], F.lit(""))
    return df.withColumns(done)
