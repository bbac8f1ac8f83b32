"""Differences of two snapshots: three matching tiers, field changes, counters.

A state is a row (bom_item_id, part_id, quantity, attributes, checksum). Tiers run on what the one before has left:
same id; same semantic key, first those with equal checksums; same part (items without a part match each other). Within
a key, items pair one to one by ascending id.

The two states meet in one full outer join by id. It is written once, and only what later steps read of it: of pairs with
equal checksums the id, of other pairs their changes, of items that are left their keys and, where changes are asked for,
their fields. Ids and checksums in hexadecimal digits go through that join as bytes.

Only what is left goes through the other tiers. Their keys all begin with the part, so one shuffle by part serves them all.
Parts of very many items (HOT) would make one task large; there ranks within a key are counted in two levels, by the first
characters of the id and inside them, so no task holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import jvm, text
from stockweave.operators.staging import staged

_PREFIX = 3


def state(items: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Snapshot items as states; part_id from details (bom_item_id, part_id), null where it has none."""
    out = items if details is None else items.join(details.select("bom_item_id", "part_id"), "bom_item_id", "left")
    none = F.create_map().cast("map<string,string>")
    return out.select("bom_item_id", "part_id", F.col("quantity").cast("double").alias("quantity"), F.coalesce("attributes", none).alias("attributes"), "checksum")


def ranked(df: DataFrame, keys: list[str], by: str = "bom_item_id") -> DataFrame:
    """df with _rank, from 1, within the keys by ascending id."""
    df = df.withColumn("_part", F.substring(by, 1, _PREFIX))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_part").orderBy(by)
    return df.withColumn("_rank", F.row_number().over(inside)).join(cells, [*keys, "_part"]).withColumn("_rank", F.col("_rank") + F.col("_ahead")).drop("_part", "_ahead")


def _pair(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left = ranked(a.select("bom_item_id", *keys), keys).withColumnRenamed("bom_item_id", "id_a")
    right = ranked(b.select("bom_item_id", *keys), keys).withColumnRenamed("bom_item_id", "id_b")
    return left.join(right, [*keys, "_rank"]).select("id_a", "id_b")


def _rest(a: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    return a.join(pairs.select(F.col(column).alias("bom_item_id")), "bom_item_id", "left_anti")


#: Items of a part, of both states, from which on they are ranked in two levels.
HOT = 1_000_000


def packed(c: Column) -> Column:
    """A text as bytes, without loss: its hexadecimal digits in half as many, other texts as they are."""
    digits = F.unhex(c)
    return F.when(F.lower(F.hex(digits)) == c, F.concat(digits, F.lit(b"\x01"))).otherwise(F.concat(c.cast("binary"), F.lit(b"\x00")))


def unpacked(c: Column) -> Column:
    body = F.substring(c, F.lit(1), F.length(c) - 1)
    return F.when(F.substring(c, -1, 1) == F.lit(b"\x01"), F.lower(F.hex(body))).otherwise(body.cast("string"))


def _digest(quantity: Column, entries: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(quantity.cast("string"), F.lit("NO_QTY")), entries)))


def _content(quantity: Column, attributes: Column) -> Column:
    """Stands for quantity and attributes as the second tier sees them."""
    return _digest(quantity, text.json_semantic(attributes))


def _side(states: DataFrame, side: str, fields: bool) -> DataFrame:
    """A state's columns as they are joined. Without fields, content stands for them, and loose, where it differs, for what
    changes can be seen in: nulls and missing keys are one to them."""
    quantity, attributes = F.col("quantity"), F.col("attributes")
    out = {"id": packed(F.col("bom_item_id")), "part_id": F.col("part_id"), "checksum": packed(F.col("checksum"))}
    if fields:
        out |= {"quantity": quantity, "attributes": attributes}
    else:
        nulls = F.when(text.json_semantic(attributes).contains(": null"), _digest(quantity, text.json_semantic(attributes, nulls=False)))
        out |= {"content": _content(quantity, attributes), "loose": nulls}
    return states.select([c.alias(f"{side}_{n}") for n, c in out.items()])


_NONE = "array<struct<type:string,field:string,from_value:string,to_value:string>>"


def _compared(met: DataFrame, fields: bool, both: Column) -> DataFrame:
    """met with status and changes of its pairs; those of other rows mean nothing."""
    same = F.col("a_checksum").eqNullSafe(F.col("b_checksum"))
    if not fields:
        alike = F.coalesce("a_loose", "a_content") == F.coalesce("b_loose", "b_content")
        return met.withColumn("status", F.when(same, "UNCHANGED").when(alike, "NOOP").otherwise("MODIFIED"))
    changes = field_changes(*[F.col(f"{s}_{c}") for s in "ab" for c in ("quantity", "attributes")])
    found = met.withColumn("changes", F.when(both & ~same, changes).otherwise(F.array().cast(_NONE)))
    return found.withColumn("status", F.when(same, "UNCHANGED").when(F.size("changes") > 0, "MODIFIED").otherwise("NOOP"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, tier) of the second and third tier by ranks in two levels, for any number of items of a key."""
    pairs = None
    for tier, keys in ((2, ["part", "content", "checksum"]), (2, ["part", "content"]), (3, ["part"])):
        left, right = (s if pairs is None else _rest(s, pairs, c) for s, c in ((a, "id_a"), (b, "id_b")))
        found = _pair(left, right, keys).withColumn("tier", F.lit(tier))
        pairs = staged(found if pairs is None else pairs.unionByName(found), "diff-pairs")
    return pairs


def _tiers(left: DataFrame) -> DataFrame:
    """left (side 0 or 1, part, content, checksum, bom_item_id) with tier (null: no partner) and _match, which partners share."""
    out = left.withColumns({"tier": F.lit(None).cast("int"), "_match": F.lit(None).cast("struct<tier:int,content:binary,checksum:binary,rank:int>")}).repartition("part")
    none = F.lit(None).cast("binary")
    for tier, keys in ((2, ["content", "checksum"]), (2, ["content"]), (3, [])):
        free = F.col("tier").isNull() & (F.col("checksum").isNotNull() if len(keys) > 1 else F.lit(True))
        among = Window.partitionBy("part", "_free", *keys)
        mine = Window.partitionBy("part", "_free", *keys, "side").orderBy("bom_item_id")
        paired = F.least(F.sum(F.col("side")).over(among), F.sum(1 - F.col("side")).over(among))
        # one sort does for both windows, that of the second
        out = out.withColumn("_free", free).withColumn("_rank", F.row_number().over(mine)).withColumn("_paired", paired)
        now = F.col("_free") & (F.col("_rank") <= F.col("_paired"))
        at = F.struct(F.lit(len(keys)).alias("tier"), F.col("content") if keys else none, F.col("checksum") if len(keys) > 1 else none, F.col("_rank").alias("rank"))
        at = at.cast("struct<tier:int,content:binary,checksum:binary,rank:int>")
        out = out.withColumns({"_match": F.when(now, at).otherwise(F.col("_match")), "tier": F.when(now, F.lit(tier)).otherwise(F.col("tier"))}).drop("_free", "_rank", "_paired")
    return out


def _partners(left: DataFrame, fields: list[str]) -> DataFrame:
    """a, b and tier of items that are left: structs of bom_item_id and fields, b or a null where there is no partner."""
    kept = F.struct("bom_item_id", *fields)
    many = [r.part for r in left.groupBy("part").count().where(F.col("count") > HOT).select("part").collect()]
    few = left.where(~F.col("part").isin(many)) if many else left
    alone = F.col("tier").isNull()
    other = F.lead(kept).over(Window.partitionBy("part", "tier", "_match").orderBy("side"))
    both = _tiers(few).withColumns({"_k": kept, "_other": other}).where(alone | (F.col("side") == 0))
    out = both.select(F.when(~alone | (F.col("side") == 0), F.col("_k")).alias("a"), F.when(~alone, F.col("_other")).when(F.col("side") == 1, F.col("_k")).alias("b"), "tier")
    if many:
        hot = left.where(F.col("part").isin(many)).select("side", kept.alias("_k"), "bom_item_id", "part", "content", "checksum")
        a, b = (hot.where(F.col("side") == s).drop("side") for s in (0, 1))
        pairs = _pairs(a.drop("_k"), b.drop("_k"))
        both = pairs.join(a.select(F.col("bom_item_id").alias("id_a"), F.col("_k").alias("a")), "id_a").join(b.select(F.col("bom_item_id").alias("id_b"), F.col("_k").alias("b")), "id_b")
        no, null = F.lit(None).cast(hot.schema["_k"].dataType), F.lit(None).cast("int").alias("tier")
        lone = _rest(a, pairs, "id_a").select(F.col("_k").alias("a"), no.alias("b"), null).unionByName(_rest(b, pairs, "id_b").select(no.alias("a"), F.col("_k").alias("b"), null))
        out = out.unionByName(both.select("a", "b", "tier")).unionByName(lone)
    return out


def _matched(a: DataFrame, b: DataFrame, fields: bool) -> DataFrame:
    """id_a, id_b, tier, status and, with fields, part_id and changes: a row for each pair and each item without one."""
    kept = ["part_id", "checksum", *(["quantity", "attributes"] if fields else ["content", "loose"])]
    found = ["part_id", "changes"] if fields else []
    both, part = F.col("a_id").isNotNull() & F.col("b_id").isNotNull(), F.coalesce("b_part_id", "a_part_id")
    met = _compared(_side(a, "a", fields).join(_side(b, "b", fields), F.col("a_id") == F.col("b_id"), "full"), fields, both)
    one = {c: F.coalesce(f"a_{c}", f"b_{c}") for c in kept} | {"part_id": part}
    held = {c: F.when(~both, x) for c, x in one.items()} | ({"part_id": part, "changes": F.when(both, F.col("changes"))} if fields else {})
    flat = staged(met.select(
        F.coalesce("a_id", "b_id").alias("id"), F.when(~both, F.when(F.col("a_id").isNotNull(), 0).otherwise(1)).alias("side"), F.when(both, F.col("status")).alias("status"),
        *[x.alias(c) for c, x in held.items()],
    ), "diff-met")
    id_ = unpacked(F.col("id"))
    first = flat.where("side IS NULL").select(id_.alias("id_a"), id_.alias("id_b"), F.lit(1).alias("tier"), "status", *found)
    left = flat.where("side IS NOT NULL").select("side", id_.alias("bom_item_id"), text.part_key(F.col("part_id")).alias("part"), *kept)
    left = left.withColumn("content", _content(F.col("quantity"), F.col("attributes"))) if fields else left
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in kept]
    paired = _partners(left, kept).select(F.col("a.bom_item_id").alias("id_a"), F.col("b.bom_item_id").alias("id_b"), "tier", *sides)
    later = _compared(paired, fields, F.col("id_a").isNotNull() & F.col("id_b").isNotNull()).withColumn("part_id", part)
    status = F.when(F.col("id_a").isNull(), "ADDED").when(F.col("id_b").isNull(), "REMOVED").otherwise(F.col("status"))
    return first.unionByName(later.select("id_a", "id_b", "tier", status.alias("status"), *found))


def match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, tier) of matched items."""
    return _matched(a, b, False).where("tier IS NOT NULL").select("id_a", "id_b", "tier")


def match_by_id(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b) of the first tier alone: one join of ids."""
    ids = [s.select(packed(F.col("bom_item_id")).alias("_id")) for s in (a, b)]
    return ids[0].join(ids[1], "_id").select(unpacked(F.col("_id")).alias("id_a"), unpacked(F.col("_id")).alias("id_b"))


def _change(kind: str | Column, field: Column, before: Column, after: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), field.cast("string").alias("field"), before.cast("string").alias("from_value"), after.cast("string").alias("to_value"))


def field_changes(qty_a: Column, attrs_a: Column, qty_b: Column, attrs_b: Column) -> Column:
    """Array of (type, field, from_value, to_value): the quantity first, then semantic attributes by name."""
    found = jvm.call("Changes", jvm.CHANGES, *[f(x) for x in (attrs_a, attrs_b) for f in (F.map_keys, F.map_values)], F.lit(text.BOOKKEEPING))
    qty = F.when(qty_a.eqNullSafe(qty_b), F.array().cast(_NONE)).otherwise(F.array(_change("QUANTITY_CHANGED", F.lit(None), qty_a, qty_b)))
    return F.concat(qty, found)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """bom_item_id, id_a, id_b, tier, status, changes and part_id, one row for each pair and each item without one.

    Pairs with equal checksums are UNCHANGED, others MODIFIED under b's id, or NOOP if no field differs.
    """
    return _matched(a, b, True).select(F.coalesce("id_b", "id_a").alias("bom_item_id"), "id_a", "id_b", "tier", "status", "changes", "part_id")


def statuses(a: DataFrame, b: DataFrame) -> DataFrame:
    """diff without changes and part_id; no attributes are moved for it."""
    return _matched(a, b, False).select(F.coalesce("id_b", "id_a").alias("bom_item_id"), "id_a", "id_b", "tier", "status")


def ordered(diffed: DataFrame) -> DataFrame:
    """The rows of a diff in the order of reports: added, removed, modified, the rest; each by id."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in ("ADDED", "REMOVED", "MODIFIED")]), F.col("status")), F.lit(0)), F.lit(4))
    return diffed.orderBy(place, "bom_item_id")


def counts(diffed: DataFrame) -> DataFrame:
    return diffed.agg(*[F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in ("ADDED", "REMOVED", "MODIFIED", "UNCHANGED")])
