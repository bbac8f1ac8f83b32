"""Registered queries over the driver's tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockweave import catalog
from stockweave.functions import refdes, text, units
from stockweave.operators import diff, events, headers, normalize, profile, resolve, store
from stockweave.operators.staging import shared_root
from stockweave.plans import testdata as t
from stockweave.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_NAMES = sorted({n for s, _ in headers.alias_index() for n in (s, s.upper(), s.replace(" ", "_"), f"{s.title()} x")} | {"Item#", "Cmp name", "Ref", "Qnty", "_qty", " ", "-", "zzz", "Lead time", "Supplier Part Number", "p", "num"})
_NAMES_SQL = ", ".join(f"({_quoted(n)})" for n in _NAMES)
_ALIAS_SQL = ", ".join(f"({i}, {_quoted(s)}, {_quoted(h)})" for i, (s, h) in enumerate(headers.alias_index()))
_RESOLVED_SQL = rf"""
al(ord, s, h) AS (VALUES {_ALIAS_SQL}), nm(col_name) AS (VALUES {_NAMES_SQL}),
keyed AS (SELECT col_name, regexp_replace(regexp_replace(lower(col_name), '^\s+|\s+$', '', 'g'), '[\s_\-]+', ' ', 'g') AS k FROM nm),
res AS (SELECT col_name, COALESCE((SELECT h FROM al WHERE s = k), (SELECT arg_min(h, ord) FROM al WHERE contains(k, s) OR contains(s, k))) AS standard FROM keyed)"""


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "col_name string")


@query(f"WITH {_RESOLVED_SQL} SELECT * FROM res")
def header_mapping(spark, sf):
    return _names(spark).withColumn("standard", headers.resolve_column(F.col("col_name")))


@query(f"WITH {_RESOLVED_SQL} SELECT standard, string_agg(col_name, '|' ORDER BY col_name) AS columns FROM res GROUP BY standard")
def mapping_report(spark, sf):
    return headers.mapping_report_frame(_names(spark)).withColumn("columns", F.array_join("columns", "|"))


@query(f"SELECT unnest([{', '.join(map(_quoted, catalog.HEADERS))}]) AS header, unnest(range(10))::INTEGER AS pos")
def standard_template(spark, sf):
    return spark.createDataFrame([(h, i) for i, h in enumerate(headers.template())], "header string, pos int")


_FOLD_SQL = f"""WITH {t.LINES}
SELECT item_id, '' AS part_number, name AS description, qty::BIGINT::VARCHAR AS quantity, '' AS unit, maker AS manufacturer, '' AS manufacturer_part_number,
  'C7, R' || (l_linenumber * 3) || ', R' || (l_linenumber * 3 + 1) || ', R' || (l_linenumber * 3 + 2) AS reference_designator, val AS value, pkg AS package,
  CASE WHEN l_linenumber % 2 = 0 THEN 'Lead time: ' || l_linenumber || ', ' || mpn ELSE mpn END AS notes FROM bom"""


def _wide(spark, sf):
    lead = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise("")
    return t.lines(spark, sf).select(
        "item_id", F.col("refdes").alias("Ref"), F.col("qty").cast("long").cast("string").alias("Qnty"), F.col("val").alias("Value"), F.col("name").alias("Cmp name"), F.col("pkg").alias("Footprint"),
        F.col("mpn").alias("Description"), F.concat(F.lit(" "), "maker").alias("Vendor"), lead.alias("Lead time"), F.lit("C7").alias("Designator"), F.col("mpn").alias("Remarks"),
    )


@query(_FOLD_SQL)
def row_fold(spark, sf):
    return normalize.normalize(_wide(spark, sf), keep=["item_id"])


@query(_FOLD_SQL)
def row_fold_cells(spark, sf):
    wide = _wide(spark, sf)
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col_name"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(wide.columns) if c != "item_id"]))
    return normalize.normalize_cells(wide.select("item_id", cell.alias("_c")).select("item_id", "_c.*"), ["item_id"])


@query(f"""WITH {t.LINES} SELECT l_linenumber AS row_index, name AS part_name, qty::INTEGER AS quantity,
  '{{"description":"' || name || '","manufacturer":"' || maker || '","package":"' || pkg || '"' || CASE WHEN l_linenumber % 2 = 1 THEN ',"tolerance":"' || l_linenumber || '%"' ELSE '' END || ',"value":"' || val || '"}}' AS attributes,
  '{{"notes":"' || CASE WHEN l_linenumber % 2 = 1 THEN 'tolerance ' || l_linenumber || '%' ELSE 'x' END || '","reference_designator":"C7, R' || (l_linenumber * 3) || ', R' || (l_linenumber * 3 + 1) || ', R' || (l_linenumber * 3 + 2) || '"}}' AS context FROM bom""")
def normalized_row(spark, sf):
    n = F.col("l_linenumber")
    notes = F.when(n % 2 == 1, F.concat(F.lit("tolerance "), n, F.lit("%"))).otherwise("x")
    wide = t.lines(spark, sf).select(
        n.alias("row_index"), F.col("refdes").alias("Ref"), F.col("qty").cast("long").cast("string").alias("Qnty"), F.col("val").alias("Value"), F.col("name").alias("Cmp name"),
        F.col("pkg").alias("Footprint"), F.concat(F.lit(" "), "maker").alias("Vendor"), F.lit("C7").alias("Designator"), notes.alias("Notes"),
    )
    kept = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c)
    return normalize.parsed(normalize.normalize(wide, keep=["row_index"])).select("row_index", "part_name", "quantity", kept("attributes"), kept("context"))


_TEXTS = ["3", "2.7", "abc", "", " 1e2 ", "-4.9", "nan", "1f", "inf", "1_000", "+5", ".5"]
_TEXTS_SQL = "[" + ", ".join(map(_quoted, _TEXTS)) + f"][(l_partkey + l_linenumber) % {len(_TEXTS)} + 1]"


@query(f"""WITH {t.LINES}, x AS (SELECT item_id, {_TEXTS_SQL} AS txt FROM bom)
SELECT item_id, txt, CASE WHEN isfinite(n) THEN trunc(n)::INTEGER END AS quantity FROM (SELECT *, try_cast(replace(trim(txt), '+', '') AS DOUBLE) AS n FROM x)""")
def quantity_parse(spark, sf):
    txt = F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), ((F.col("l_partkey") + F.col("l_linenumber")) % len(_TEXTS) + 1).cast("int"))
    return t.lines(spark, sf).select("item_id", txt.alias("txt")).withColumn("quantity", text.quantity(F.col("txt")))


@query(f"""WITH {t.LINES} SELECT item_id, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber || '.5%' WHEN l_linenumber % 3 = 1 THEN l_linenumber || '%' END AS tolerance FROM bom""")
def tolerance_extract(spark, sf):
    n = F.col("l_linenumber")
    notes = F.when(n % 3 == 0, F.concat(F.lit("x; Tolerance: "), n, F.lit(".5% max"))).when(n % 3 == 1, F.concat(F.lit("TOLERANCE "), n, F.lit("%"))).otherwise(F.concat(F.lit("tolerance of "), n, F.lit("%")))
    return t.lines(spark, sf).select("item_id", text.tolerance(notes).alias("tolerance"))


@query(f"""WITH {t.LINES}, x AS (SELECT item_id, l_linenumber AS n, qty::BIGINT AS q FROM bom)
SELECT item_id, 'D' || n || ', D' || (n + 1) || ', ' || 'R' || LEAST(q, n) || ', R' || GREATEST(q, n) || ', X?, C1-6' AS refdes FROM x""")
def refdes_expand(spark, sf):
    n, q = F.col("l_linenumber"), F.col("qty").cast("long")
    raw = F.concat(F.lit("X?,R0"), n, F.lit(" , D"), n, F.lit("-D"), n + 1, F.lit(",C1-6, R"), q, F.lit(", Z9-Z2,"))
    return t.lines(spark, sf).select("item_id", refdes.expand(raw).alias("refdes"))


@query(f"WITH {t.LINES} SELECT item_id, name || ' ' || pkg || ' end' AS txt FROM bom")
def ws_canonical(spark, sf):
    return t.lines(spark, sf).select("item_id", text.squeeze(F.concat(F.lit(" \t"), "name", F.lit(" \n "), "pkg", F.lit("\t\tend \r\n"))).alias("txt"))


@query(f"WITH {t.STATES} SELECT item_id AS bom_item_id, checksum FROM b")
def checksum(spark, sf):
    return t.snapshot_b(spark, sf).select("bom_item_id", "checksum")


@query(f"WITH {t.STATES} SELECT item_id AS bom_item_id, skey AS semantic_key, pkey AS part_key FROM b")
def semantic_key(spark, sf):
    return t.snapshot_b(spark, sf).select("bom_item_id", text.semantic_key(F.col("part_id"), F.col("quantity"), F.col("attributes")).alias("semantic_key"), text.part_key(F.col("part_id")).alias("part_key"))


@query(f"""WITH {t.LINES} SELECT item_id, 'manufacturer=' || maker || ';manufacturer_part_number=' || mpn || ';package=' || pkg || ';value=' || val AS part_attributes, 'install_notes=' || name AS usage_context,
  'manufacturer,manufacturer_part_number,package,reference_designator,value' AS semantic_keys, refdes AS snapshot_refdes FROM bom""")
def attribute_projections(spark, sf):
    kv = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    attrs = t.attributes()
    context = F.create_map(F.lit("install_notes"), F.col("name"), F.lit("torque"), F.lit(""), F.lit("reference_designator"), F.col("refdes"))
    return t.lines(spark, sf).select(
        "item_id", kv(normalize.part_attributes(attrs)).alias("part_attributes"), kv(normalize.usage_context(context)).alias("usage_context"),
        F.array_join(F.array_sort(F.map_keys(text.semantic(attrs))), ",").alias("semantic_keys"), normalize.snapshot_attributes(context)["reference_designator"].alias("snapshot_refdes"),
    )


@query("SELECT l_orderkey, l_partkey, max(l_linenumber) AS row_index, arg_max(l_quantity, (l_linenumber, l_extendedprice, l_suppkey, l_shipdate)) AS quantity FROM lineitem GROUP BY ALL")
def snapshot_dedup_last_wins(spark, sf):
    li = t.table(spark, sf, "lineitem").withColumn("_o", F.struct("l_linenumber", "l_extendedprice", "l_suppkey", "l_shipdate"))
    items = li.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("row_index"), F.col("l_quantity").alias("quantity"), "_o")
    return resolve.last_wins(items, ["l_orderkey", "l_partkey"], "_o").drop("_o")


@query("SELECT l_orderkey, l_partkey, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def duplicate_items(spark, sf):
    return resolve.duplicates(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


def _store(spark, sf):
    """bom_items, assemblies, parts and snapshots made from lineitem, orders and part."""
    li = t.lines(spark, sf)
    items = li.select(F.col("item_id").alias("id"), F.col("assembly").alias("assembly_id"), F.concat(F.lit("P"), "l_partkey").alias("part_id"))
    orders = t.table(spark, sf, "orders")
    assemblies = orders.select(F.concat(F.lit("A"), "o_orderkey").alias("id"), F.concat(F.lit("O"), F.col("o_custkey") % 10).alias("org_id"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("asm "), "o_orderkey")).alias("name"))
    parts = t.table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"), F.create_map(F.lit("package"), F.col("p_type")).alias("attributes"))
    return items, assemblies, parts, orders


@query(f"""WITH {t.LINES} SELECT item_id AS bom_item_id, 'P' || l_partkey AS part_id, CASE WHEN l_partkey % 5 <> 0 THEN name ELSE 'Unknown' END AS part_name, pkg AS package, CASE WHEN l_orderkey % 7 <> 0 THEN 'asm ' || l_orderkey ELSE 'Unknown' END AS assembly_name
  FROM bom JOIN orders ON o_orderkey = l_orderkey""")
def item_details_join(spark, sf):
    items, assemblies, parts, _ = _store(spark, sf)
    ids = t.lines(spark, sf).select(F.col("item_id").alias("bom_item_id"))  # a snapshot asks for all of its items
    return store.item_details(items, assemblies, parts, ids).select("bom_item_id", "part_id", "part_name", F.col("part_attributes")["package"].alias("package"), "assembly_name")


@query("SELECT 'S' || o_orderkey AS id, 'A' || o_orderkey AS assembly_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'asm ' || o_orderkey ELSE 'Unknown' END AS assembly_name, o_orderpriority AS source FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def snapshot_info_join(spark, sf):
    _, assemblies, _, orders = _store(spark, sf)
    snapshots = orders.select(F.concat(F.lit("S"), "o_orderkey").alias("id"), F.concat(F.lit("A"), "o_orderkey").alias("assembly_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("created_at"))
    last = orders.agg(F.max("o_orderkey")).first()[0]
    return store.snapshot_info(snapshots, assemblies, f"S{last}").select("id", "assembly_id", "assembly_name", "source")


@query("SELECT 'cust-' || c_custkey AS id, 'Organization ' || substr('cust-' || c_custkey, 1, 8) AS name FROM customer WHERE c_custkey % 4 <> 0")
def get_or_create_org(spark, sf):
    orgs = t.table(spark, sf, "customer").select(F.concat(F.lit("cust-"), "c_custkey").alias("id"), "c_custkey")
    known = orgs.where("c_custkey % 4 = 0").select("id")
    return resolve.missing(orgs.select("id"), known, ["id"]).withColumn("name", text.default_org_name(F.col("id")))


@query("SELECT DISTINCT o_custkey % 10 AS org, o_orderpriority AS name FROM orders EXCEPT SELECT DISTINCT o_custkey % 10, o_orderpriority FROM orders WHERE o_custkey % 10 < 5")
def get_or_create_assembly(spark, sf):
    wanted = t.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("org"), F.col("o_orderpriority").alias("name"))
    return resolve.missing(wanted, wanted.where("org < 5"), ["org", "name"])


@query("SELECT 'A' || o_orderkey AS id, 'O' || (o_custkey % 10) AS org_id FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def assembly_owner_check(spark, sf):
    _, assemblies, _, orders = _store(spark, sf)
    first = orders.orderBy("o_orderkey").select("o_orderkey", "o_custkey").first()
    return store.owned_assembly(assemblies, f"A{first.o_orderkey}", f"O{first.o_custkey % 10}").select("id", "org_id")


def _diff(spark, sf):
    return diff.diff(t.snapshot_a(spark, sf), t.snapshot_b(spark, sf))


def _statuses(spark, sf):
    return diff.statuses(t.snapshot_a(spark, sf), t.snapshot_b(spark, sf))


def _flat(c):
    return F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["field"], F.lit("")), F.lit(":"), F.coalesce(x["from_value"], F.lit("")), F.lit(">"), F.coalesce(x["to_value"], F.lit("")))), ";")


@query(f"WITH {t.MATCHED} SELECT bom_item_id, id_a, id_b, tier, status FROM diffed")
def diff_status(spark, sf):
    return _statuses(spark, sf)


def _tier(n: int):
    def run(spark, sf):
        if n == 1:
            return diff.match_by_id(t.snapshot_a(spark, sf), t.snapshot_b(spark, sf))
        return diff.match(t.snapshot_a(spark, sf), t.snapshot_b(spark, sf)).where(F.col("tier") == n).select("id_a", "id_b")

    return run


for _n, _name in ((1, "diff_identity"), (2, "diff_semantic_tier"), (3, "diff_part_tier")):
    QUERIES[_name] = _tier(_n)
    ORACLES[_name] = f"WITH {t.MATCHED} SELECT id_a, id_b FROM t{_n}" if _n > 1 else f"""WITH {t.LINES}, k AS (SELECT item_id AS a, l_partkey, CASE WHEN l_partkey % 23 IN (7, 8) THEN md5(item_id || 'x') ELSE item_id END AS b FROM bom)
SELECT x.a AS id_a, y.b AS id_b FROM k x JOIN k y ON x.a = y.b WHERE x.l_partkey % 11 <> 0 AND y.l_partkey % 13 <> 0"""


@query(f"WITH {t.MATCHED} SELECT bom_item_id, status FROM diffed WHERE status IN ('ADDED', 'REMOVED')")
def diff_added_removed(spark, sf):
    return _statuses(spark, sf).where(F.col("status").isin("ADDED", "REMOVED")).select("bom_item_id", "status")


@query(f"WITH {t.MATCHED} SELECT bom_item_id, array_to_string(ch, ';') AS changes FROM diffed WHERE status = 'MODIFIED'")
def diff_field_changes(spark, sf):
    return _diff(spark, sf).where("status = 'MODIFIED'").select("bom_item_id", _flat("changes").alias("changes"))


@query(f"WITH {t.MATCHED} SELECT COUNT(*) FILTER (status = 'ADDED') AS added_count, COUNT(*) FILTER (status = 'REMOVED') AS removed_count, COUNT(*) FILTER (status = 'MODIFIED') AS modified_count, COUNT(*) FILTER (status = 'UNCHANGED') AS unchanged_count FROM diffed")
def diff_counts(spark, sf):
    return diff.counts(_statuses(spark, sf))


@query(f"WITH {t.EVENTS} SELECT bom_item_id, added, removed, quantity_changed, manufacturer_changed, mpn_changed, refdes_changed, array_to_string(attrs, ',') AS changed_attributes, added OR removed OR len(ch) > 0 AS has_any_change FROM flags")
def delta_flags(spark, sf):
    return events.deltas(_diff(spark, sf)).select("bom_item_id", "added", "removed", "quantity_changed", "manufacturer_changed", "mpn_changed", "refdes_changed", F.array_join("changed_attributes", ",").alias("changed_attributes"), events.has_any_change().alias("has_any_change"))


def _events(df):
    return df.select("bom_item_id", "event_type", "severity", F.array_join("affected_domains", ",").alias("domains"), "summary", F.size("evidence").cast("long").alias("n_evidence"))


def _event_query(name: str, pick, where: str) -> None:
    QUERIES[name] = lambda spark, sf: _events(pick(_diff(spark, sf)))
    ORACLES[name] = f"WITH {t.EVENTS} SELECT bom_item_id, event_type, severity, domains, summary, n_evidence FROM events_ WHERE {where}"


_event_query("classify_events", events.classify, "true")
_event_query("events_by_type", lambda d: events.by_type(events.classify(d), "MANUFACTURER_CHANGED"), "event_type = 'MANUFACTURER_CHANGED'")
_event_query("events_by_severity", lambda d: events.by_severity(events.classify(d), "LOW"), "severity = 'LOW'")
_event_query("events_by_domain", lambda d: events.by_domain(events.classify(d), "ENGINEERING"), "contains(domains, 'ENGINEERING')")
_event_query("high_priority_events", events.high_priority, "severity = 'HIGH'")
_event_query("procurement_events", events.procurement, "contains(domains, 'PROCUREMENT')")


@query(f"WITH {t.EVENTS} SELECT 'type' AS kind, event_type AS name, COUNT(*) AS n FROM events_ GROUP BY event_type UNION ALL SELECT 'severity', severity, COUNT(*) FROM events_ GROUP BY severity UNION ALL SELECT 'total', 'all', COUNT(*) FROM events_")
def event_summary(spark, sf):
    return events.summary(events.classify(_diff(spark, sf)))


@query(f"""WITH {t.EVENTS} SELECT bom_item_id, '{{"bom_item_id":"' || bom_item_id || '","part_id":null,"event_type":"' || event_type || '","severity":"' || severity || '","affected_domains":[' || CASE WHEN domains = '' THEN '' ELSE '"' || replace(domains, ',', '","') || '"' END
  || '],"evidence":[' || COALESCE(array_to_string(list_transform(ch, lambda x: '{{"type":"' || split_part(x, ':', 1) || '","field":' || CASE WHEN split_part(x, ':', 2) = '' THEN 'null' ELSE '"' || split_part(x, ':', 2) || '"' END
    || ',"from_value":"' || split_part(substr(x, length(split_part(x, ':', 1)) + length(split_part(x, ':', 2)) + 3), '>', 1) || '","to_value":"' || split_part(x, '>', 2) || '"}}'), ','), '') || '],"summary":"' || summary || '"}}' AS event FROM events_""")
def event_json(spark, sf):
    return events.to_json(events.classify(_diff(spark, sf)))


_RE2 = {u: p.replace("(?![a-zA-Z])", "($|[^a-zA-Z])") for u, p in catalog.UNIT_PATTERNS}
_UNIT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p.replace('(?![a-zA-Z])', '($|[^a-zA-Z])')}') THEN '{u}'" for u, p in catalog.UNIT_PATTERNS) + " END"
_ANY = lambda ps: "(" + " OR ".join(f"regexp_matches(v, '{p}')" for p in ps) + ")"
_CHARS = "COALESCE(SUM(length(regexp_replace(v, '{0}', '', 'g'))) * 100.0 / SUM(length(v)), 0)::DOUBLE"
_PUNCT, _LETTER, _SPACE = r"""[^.,;:!?\-''"/()\[\]{}_]""", r"[^\p{L}]", r"\S"


def _share(drop: str) -> str:
    return f"COALESCE(SUM(length(regexp_replace(v, '{drop}', '', 'g'))) * 100.0 / SUM(length(v)), 0)::DOUBLE"


_PROFILE_SQL = rf"""{t.CELLS},
vals AS (SELECT col_name, v, COUNT(*) AS n FROM firsts GROUP BY ALL),
card AS (SELECT col_name, COUNT(*) AS unique_count, SUM(n)::BIGINT AS total_count, COUNT(*) / SUM(n) AS unique_ratio, COUNT(*) FILTER (n > 1) / COUNT(*) AS repeated_ratio FROM vals GROUP BY col_name),
stat AS (SELECT col_name, COUNT(*) AS sample_size, avg((try_cast(v AS DOUBLE) IS NOT NULL)::INT) AS numeric, avg((try_cast(v AS DOUBLE) IS NULL)::INT) AS text, avg({_ANY(catalog.MPN_PATTERNS)}::INT) AS mpn_like, avg({_ANY(catalog.REFDES_PATTERNS)}::INT) AS ref_des_like,
  avg(length(v)) AS len_mean, median(length(v)) AS len_median, min(length(v))::INTEGER AS len_min, max(length(v))::INTEGER AS len_max,
  {_share('[^0-9]')} AS pct_digits, {_share(_PUNCT)} AS pct_punctuation, {_share(_LETTER)} AS pct_letters, {_share(_SPACE)} AS pct_whitespace FROM firsts GROUP BY col_name),
nul AS (SELECT col_name, COUNT(*) FILTER (value IS NULL OR value = '') AS null_count FROM cells GROUP BY col_name),
unit AS (SELECT col_name, u, COUNT(*) AS k FROM (SELECT col_name, {_UNIT_SQL} AS u FROM firsts) GROUP BY ALL),
uni AS (SELECT col_name, u, k / SUM(k) OVER (PARTITION BY col_name) AS share FROM unit)"""


def _profile(spark, sf):
    return profile.profile(t.cells(spark, sf))


@query(f"WITH {_PROFILE_SQL} SELECT nul.col_name, COALESCE(sample_size, 0) AS sample_size, null_count, CASE WHEN sample_size IS NULL THEN 'No non-null values found' END AS error FROM nul LEFT JOIN stat USING (col_name)")
def profile_nulls(spark, sf):
    return _profile(spark, sf).select("col_name", "sample_size", "null_count", "error")


@query(f"WITH {_PROFILE_SQL} SELECT col_name, numeric, text, (numeric > 0 AND text > 0)::INT::DOUBLE AS mixed FROM stat")
def profile_types(spark, sf):
    return _profile(spark, sf).where("error IS NULL").select("col_name", "numeric", "text", "mixed")


@query(f"WITH {_PROFILE_SQL} SELECT col_name, mpn_like, ref_des_like FROM stat")
def profile_regex(spark, sf):
    return _profile(spark, sf).where("error IS NULL").select("col_name", "mpn_like", "ref_des_like")


@query(f"WITH {_PROFILE_SQL} SELECT col_name, u AS unit, round(share, 9) AS share FROM uni WHERE u IS NOT NULL")
def profile_units(spark, sf):
    return _profile(spark, sf).where("error IS NULL").select("col_name", F.explode("unit_presence").alias("unit", "share")).withColumn("share", F.round("share", 9))


@query(f"WITH {_PROFILE_SQL} SELECT col_name, unique_count, total_count, round(unique_ratio, 9) AS unique_ratio, round(repeated_ratio, 9) AS repeated_ratio FROM card")
def profile_cardinality(spark, sf):
    return _profile(spark, sf).where("error IS NULL").select("col_name", "unique_count", "total_count", F.round("unique_ratio", 9).alias("unique_ratio"), F.round("repeated_ratio", 9).alias("repeated_ratio"))


@query(f"WITH {_PROFILE_SQL} SELECT col_name, round(len_mean, 9) AS len_mean, len_median, len_min, len_max FROM stat")
def profile_length(spark, sf):
    return _profile(spark, sf).where("error IS NULL").select("col_name", F.round("len_mean", 9).alias("len_mean"), "len_median", "len_min", "len_max")


@query(f"WITH {_PROFILE_SQL} SELECT col_name, round(pct_digits, 6) AS pct_digits, round(pct_punctuation, 6) AS pct_punctuation, round(pct_letters, 6) AS pct_letters, round(pct_whitespace, 6) AS pct_whitespace FROM stat")
def profile_charclass(spark, sf):
    return _profile(spark, sf).where("error IS NULL").select("col_name", *[F.round(c, 6).alias(c) for c in ("pct_digits", "pct_punctuation", "pct_letters", "pct_whitespace")])


@query(f"WITH {t.CELLS} SELECT col_name, row_index, value FROM (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY row_index) AS rn FROM cells WHERE value IS NOT NULL AND value <> '') WHERE rn <= 200")
def profile_sample(spark, sf):
    return profile.sample(t.cells(spark, sf))


_NEAR = "CASE WHEN x = 0 AND y = 0 THEN 1 WHEN x = 0 OR y = 0 THEN 0 ELSE 1 - LEAST(abs(x - y) / GREATEST(abs(x), abs(y)), 1) END"


@query(f"""WITH {_PROFILE_SQL},
feat AS (SELECT col_name, 'types' AS g, 'n' AS k, numeric AS x FROM stat UNION ALL SELECT col_name, 'types', 't', text FROM stat UNION ALL SELECT col_name, 'types', 'm', (numeric > 0 AND text > 0)::INT FROM stat
  UNION ALL SELECT col_name, 'hits', 'm', mpn_like FROM stat UNION ALL SELECT col_name, 'hits', 'r', ref_des_like FROM stat UNION ALL SELECT col_name, 'units', u, share FROM uni WHERE u IS NOT NULL
  UNION ALL SELECT col_name, 'chars', 'd', pct_digits FROM stat UNION ALL SELECT col_name, 'chars', 'p', pct_punctuation FROM stat UNION ALL SELECT col_name, 'chars', 'l', pct_letters FROM stat UNION ALL SELECT col_name, 'chars', 'w', pct_whitespace FROM stat),
prs AS (SELECT a.col_name AS column_a, b.col_name AS column_b FROM nul a, nul b),
keys AS (SELECT DISTINCT column_a, column_b, g, k FROM prs JOIN feat ON feat.col_name IN (column_a, column_b)),
kv AS (SELECT keys.*, COALESCE(fa.x, 0) AS x, COALESCE(fb.x, 0) AS y FROM keys LEFT JOIN feat fa ON fa.col_name = column_a AND fa.g = keys.g AND fa.k = keys.k LEFT JOIN feat fb ON fb.col_name = column_b AND fb.g = keys.g AND fb.k = keys.k),
gs AS (SELECT column_a, column_b, g, avg({_NEAR}) AS s FROM kv GROUP BY ALL),
sc AS (SELECT column_a, column_b, max(s) FILTER (g = 'types') AS s1, max(s) FILTER (g = 'hits') AS s2, COALESCE(max(s) FILTER (g = 'units'), 1) AS s3, max(s) FILTER (g = 'chars') AS s4 FROM gs GROUP BY ALL)
SELECT prs.column_a, prs.column_b, round(CASE WHEN sa.col_name IS NULL OR sb.col_name IS NULL THEN 0 ELSE (s1 + s2 + s3 + s4 + 1 - LEAST(abs(ca.unique_ratio - cb.unique_ratio), 1) + 1 - abs(sa.len_mean - sb.len_mean) / GREATEST(sa.len_mean, sb.len_mean)) / 6 END, 9) AS similarity
FROM prs LEFT JOIN sc USING (column_a, column_b) LEFT JOIN stat sa ON sa.col_name = column_a LEFT JOIN stat sb ON sb.col_name = column_b LEFT JOIN card ca ON ca.col_name = column_a LEFT JOIN card cb ON cb.col_name = column_b""")
def profile_compare(spark, sf):
    p = _profile(spark, sf)
    return profile.compare(p, p).withColumn("similarity", F.round("similarity", 9))


_VALUES = {"42": (42, None), "0805": (805, None), "10n": (1e-8, "F"), "100k": (1e5, "ohm"), "470R": (470, "R"), "3.3V": (3.3, "V"), "100kΩ": (1e5, "kΩ"), "5mm": (5, "m"), "4k7": (4000, "ohm"), "1N4148": (1e-9, "F"), "10nF": (1e-8, "nF"), "2.2uF": (2.2e-6, "uF"),
           "RC0603FR-0710KL": (603, "F"), "n/a": (None, None), "3 kg": (3, "kg"), "16MHz": (16e6, "MHz"), "10ms": (10, "m")}
_VALUES_SQL = ", ".join(f"({i}, {_quoted(k)}, {'NULL' if v is None else repr(float(v))})" for i, (k, (v, _)) in enumerate(_VALUES.items()))


@query(f"WITH v(i, txt, num) AS (VALUES {_VALUES_SQL}) SELECT p_partkey, txt, round(num * 1e12) AS pico, CASE WHEN num IS NULL THEN txt END AS kept FROM part JOIN v ON i = p_partkey % {len(_VALUES)}")
def unit_normalize(spark, sf):
    txt = F.element_at(F.array(*[F.lit(k) for k in _VALUES]), (F.col("p_partkey") % len(_VALUES) + 1).cast("int"))
    rows = t.table(spark, sf, "part").select("p_partkey", txt.alias("txt")).withColumn("_u", units.normalize_unit(F.col("txt")))
    return rows.select("p_partkey", "txt", F.round(F.col("_u.num") * 1e12).alias("pico"), F.col("_u.text").alias("kept"))


@query("""WITH x AS (SELECT p_partkey, p_size, ['p', 'n', 'u', 'k', 'm', 'G'][p_partkey % 6 + 1] AS u FROM part)
SELECT p_partkey, round(p_size * CASE u WHEN 'p' THEN 1e-12 WHEN 'n' THEN 1e-9 WHEN 'u' THEN 1e-6 WHEN 'k' THEN 1e3 WHEN 'm' THEN 1 END * 1e12) AS pico, CASE WHEN u IN ('p', 'n', 'u') THEN 'F' WHEN u = 'k' THEN 'ohm' END AS unit FROM x""")
def engineering_notation(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in "pnukmG"]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = t.table(spark, sf, "part").select("p_partkey", units.engineering(F.concat("p_size", unit)).alias("_e"))
    return rows.select("p_partkey", F.round(F.col("_e.num") * 1e12).alias("pico"), F.col("_e.unit").alias("unit"))


def _part_rows(spark, sf):
    part = t.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("O"), F.col("p_partkey") % 50).alias("org_id"), F.col("p_name").alias("name"), F.create_map(F.lit("package"), F.col("p_type"), F.lit("value"), F.col("p_size").cast("string")).alias("attributes"))
    key = F.concat(F.lit("P"), "ord")
    return part.where("ord % 4 = 0").withColumn("part_id", key), part.where("ord % 4 != 0").withColumns({"row_id": key, "new_id": key, "row_index": F.col("ord")})


@query()
def part_similarity_top1(spark, sf):
    parts, incoming = _part_rows(spark, sf)
    return resolve.best_parts(incoming, parts)


@query()
def part_resolution(spark, sf):
    parts, incoming = _part_rows(spark, sf)
    return resolve.resolve_parts(incoming, parts)


def _usage_rows(spark, sf):
    li = t.lines(spark, sf).select(F.col("item_id").alias("row_id"), F.col("assembly").alias("assembly_id"), F.concat(F.lit("P"), "l_partkey").alias("part_id"), F.col("l_linenumber").alias("row_index"), F.create_map(F.lit("notes"), F.concat("name", F.lit(" "), F.col("l_linenumber") % 2)).alias("context"))
    known = li.where("row_index % 2 = 1").withColumns({"bom_item_id": F.col("row_id"), "ord": F.col("row_index")})
    return known, li.withColumn("new_id", F.col("row_id"))


@query()
def context_similarity_top1(spark, sf):
    known, incoming = _usage_rows(spark, sf)
    return resolve.best(resolve.similar_usages(incoming, known), "bom_item_id")


@query(f"""WITH {t.LINES}, x AS (SELECT item_id AS row_id, assembly AS assembly_id, 'P' || l_partkey AS part_id, l_linenumber AS n FROM bom)
SELECT row_id, assembly_id, part_id, first_value(row_id) OVER (PARTITION BY assembly_id, part_id ORDER BY n, row_id) AS bom_item_id, row_number() OVER (PARTITION BY assembly_id, part_id ORDER BY n, row_id) = 1 AS created FROM x""")
def usage_resolution_empty_context(spark, sf):
    _, incoming = _usage_rows(spark, sf)
    bare = incoming.withColumns({"context": F.create_map().cast("map<string,string>"), "row_index": F.struct("row_index", "row_id")})
    none = spark.createDataFrame([], "assembly_id string, part_id string, bom_item_id string, context map<string,string>, ord long")
    return resolve.resolve_usages(bare.withColumn("row_index", F.row_number().over(Window.partitionBy("assembly_id", "part_id").orderBy("row_index"))), none)


def _folder(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey::VARCHAR AS part_number, p_name AS description, p_type AS package, p_size::VARCHAR AS quantity FROM part")
def csv_scan(spark, sf):
    folder = _folder(spark, "csv")
    part = t.table(spark, sf, "part").select(F.col("p_partkey").alias("Item#"), F.col("p_name").alias("Description"), F.col("p_type").alias("Footprint"), F.col("p_size").alias("Qty"))
    files.write_many(part, folder)
    cells = files.read_cells(spark, f"{folder}/*.csv")
    return normalize.normalize_cells(cells, ["file", "row_index"]).select("part_number", "description", "package", "quantity")


@query("SELECT n_name AS description, n_nationkey::VARCHAR AS quantity FROM nation")
def export_roundtrip(spark, sf):
    folder = _folder(spark, "export").removeprefix("file://")  # one file, written by the driver
    os.makedirs(folder)
    rows = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("row_index"), F.col("n_name").alias("description"), F.col("n_nationkey").cast("string").alias("quantity"))
    path = files.export(rows, f"{folder}/bom.xlsx")
    return files.parse(spark, path).select("description", "quantity")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: two snapshots, their diff, and its events by type."""
    return events.classify(_diff(spark, sf_dir)).groupBy("event_type", "severity").agg(F.count("*").alias("n"))
