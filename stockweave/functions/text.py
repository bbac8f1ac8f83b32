"""Scalar text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pyspark.sql import types as T

from stockweave import catalog
from stockweave.functions import jvm

#: What float() reads, in ASCII: sign, digits with single underscores between them, exponent, nan, inf.
NUMBER = r"^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?|(?i:nan|inf|infinity))$"


def _visible(c: Column) -> Column:
    return (c >= "!") & (c <= "~")


def strip(c: Column) -> Column:
    """Texts whose ends are visible ASCII, as most, need no pattern."""
    ends = _visible(F.substring(c, 1, 1)) & _visible(F.substring(c, -1, 1))
    return F.when(ends, c).otherwise(F.regexp_replace(c, r"^(?U:\s)+|(?U:\s)+$", ""))


def squeeze(c: Column) -> Column:
    """White space at the ends goes, runs of it become one space."""
    return F.regexp_replace(strip(c), r"(?U:\s)+", " ")


def header_key(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), r"(?U:[\s_\-])+", " ")


def is_number(c: Column) -> Column:
    return strip(c).rlike(NUMBER)


def number(c: Column) -> Column:
    """The double that a text spells, else null."""
    plain = F.regexp_replace(F.lower(strip(c)), r"_|^\+", "")
    word = F.regexp_replace(F.regexp_replace(plain, "infinity|inf", "Infinity"), "nan", "NaN")
    return F.when(is_number(c), word.try_cast("double"))


def quantity(c: Column) -> Column:
    """Whole part of the number; null without one and for NaN, infinities and what no int holds."""
    n = number(c)
    return F.when(~F.isnan(n) & (F.abs(n) < 2147483648.0), n.cast("int"))


def tolerance(notes: Column) -> Column:
    found = F.regexp_extract(notes, r"(?i)tolerance[:\s]+([0-9.]+%)", 1)
    return F.when(found != "", found)


def json_text(c: Column) -> Column:
    """A JSON string literal; other than ASCII stays ASCII, as escapes."""
    quoted = F.to_json(F.struct(c.alias("v")), {"writeNonAsciiCharacterAsCodePoint": "true"})
    return F.when(c.isNull(), F.lit("null")).otherwise(quoted.substr(F.lit(6), F.length(quoted) - 6))  # of {"v":"..."}


def json_number(c: Column) -> Column:
    """Integral doubles as whole numbers; null as null."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(c.isNull(), F.lit("null")).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def semantic(attributes: Column) -> Column:
    """Attributes without bookkeeping keys; null becomes no attributes."""
    none = F.create_map().cast("map<string,string>")
    return F.map_filter(F.coalesce(attributes, none), lambda k, v: ~k.isin(catalog.NON_SEMANTIC_KEYS))


BOOKKEEPING = "\n".join(sorted(catalog.NON_SEMANTIC_KEYS))


def _json(attributes: Column, without: str = "", squeezed: bool = False, nulls: bool = True) -> Column:
    return jvm.call("Json", T.StringType(), F.map_keys(attributes), F.map_values(attributes), F.lit(without), F.lit(squeezed), F.lit(nulls))


def json_map(attributes: Column) -> Column:
    """A JSON object with sorted keys and a space after colons and commas."""
    return _json(attributes)


def json_semantic(attributes: Column, nulls: bool = True) -> Column:
    """json_map of what semantic keeps; nulls: whether keys without a value stay."""
    return F.coalesce(_json(attributes, BOOKKEEPING, nulls=nulls), F.lit("{}"))


def checksum(qty: Column, attributes: Column) -> Column:
    """SHA-256 of quantity and semantic attributes; white space inside values doesn't count."""
    clean = F.coalesce(_json(attributes, BOOKKEEPING, True), F.lit("{}"))
    return F.sha2(F.concat(F.lit('{"attributes": '), clean, F.lit(', "quantity": '), json_number(qty), F.lit("}")), 256)


def part_key(part_id: Column) -> Column:
    return F.coalesce(part_id, F.lit(catalog.NO_PART))


def semantic_key(part_id: Column, qty: Column, attributes: Column) -> Column:
    return F.md5(F.concat_ws("|", part_key(part_id), F.coalesce(qty.cast("string"), F.lit("NO_QTY")), json_semantic(attributes)))


def pick(attributes: Column, keys: list[str]) -> Column:
    """Non-empty values of these keys."""
    return F.map_filter(attributes, lambda k, v: k.isin(keys) & v.isNotNull() & (v != ""))


def default_org_name(org_id: Column) -> Column:
    return F.concat(F.lit("Organization "), F.substring(org_id, 1, 8))
