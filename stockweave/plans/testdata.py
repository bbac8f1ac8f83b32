"""The driver's synthetic tables as BOM data: lines, two snapshots and cells to profile; with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions import text
from stockweave.operators.staging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One BOM line per lineitem: six columns make its id."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    key += [F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.col("l_shipdate").cast("date").cast("string")]
    first = F.col("l_linenumber") * 3
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.md5(F.concat_ws("|", *key)).alias("item_id"), "l_orderkey", "l_partkey", "l_linenumber", F.concat(F.lit("A"), "l_orderkey").alias("assembly"),
        F.when(F.col("l_partkey") % 29 != 0, F.concat(F.lit("P"), "l_partkey")).alias("part_id"), F.col("l_quantity").alias("qty"),
        F.concat(F.lit("R"), first, F.lit("-R"), first + 2).alias("refdes"), F.col("s_name").alias("maker"), F.concat("p_brand", F.lit("-"), "l_partkey").alias("mpn"),
        F.col("p_type").alias("pkg"), F.concat("p_size", F.lit("k")).alias("val"), F.col("p_name").alias("name"),
    )


LINES = """
bom AS (SELECT md5(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR, strftime(l_shipdate, '%Y-%m-%d'))) AS item_id,
  l_orderkey, l_partkey, l_linenumber, 'A' || l_orderkey AS assembly, CASE WHEN l_partkey % 29 <> 0 THEN 'P' || l_partkey END AS part_id, l_quantity AS qty,
  'R' || (l_linenumber * 3) || '-R' || (l_linenumber * 3 + 2) AS refdes, s_name AS maker, p_brand || '-' || l_partkey AS mpn, p_type AS pkg, p_size || 'k' AS val, p_name AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def attributes() -> Column:
    cols = {"reference_designator": "refdes", "manufacturer": "maker", "manufacturer_part_number": "mpn", "package": "pkg", "value": "val", "row_index": "l_linenumber"}
    return F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), F.col(c).cast("string"))])


def _state(df: DataFrame) -> DataFrame:
    out = df.select(F.col("item_id").alias("bom_item_id"), "part_id", F.col("qty").alias("quantity"), attributes().alias("attributes"))
    return out.withColumn("checksum", text.checksum(F.col("quantity"), F.col("attributes")))


def snapshot_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(lines(spark, sf_dir).where(F.col("l_partkey") % 11 != 0))


def snapshot_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot A's lines with rule-based edits by part: some go, some come, fields change, ids change."""
    k = F.col("l_partkey") % 23
    out = lines(spark, sf_dir).where(F.col("l_partkey") % 13 != 0).withColumns({
        "qty": F.col("qty") + F.when(k == 1, 1.0).when(k == 8, 2.0).otherwise(0.0),
        "refdes": F.when(k == 2, F.split("refdes", "-")[0]).otherwise(F.col("refdes")),
        "maker": F.when(k.isin(3, 4), F.lit("ACME")).otherwise(F.col("maker")),
        "mpn": F.when(k.isin(4, 6), F.concat("mpn", F.lit("-X"))).otherwise(F.col("mpn")),
        "val": F.when(k == 5, F.concat("val", F.lit("5"))).otherwise(F.col("val")),
        "pkg": F.when(k == 9, F.concat(F.lit(" "), F.replace(F.col("pkg"), F.lit(" "), F.lit("  ")))).otherwise(F.col("pkg")),
        "l_linenumber": F.when(k == 10, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")),
        "item_id": F.when(k.isin(7, 8), F.md5(F.concat("item_id", F.lit("x")))).otherwise(F.col("item_id")),
    })
    return _state(out)


_JSON = """'{"manufacturer": "' || {f}maker{g} || '", "manufacturer_part_number": "' || {f}mpn{g} || '", "package": "' || {f}pkg{g} || '", "reference_designator": "' || {f}refdes{g} || '", "value": "' || {f}val{g} || '"}'"""
RAW_JSON = _JSON.replace("{f}", "").replace("{g}", "")
CLEAN_JSON = _JSON.replace("{f}", r"trim(regexp_replace(").replace("{g}", r", '\s+', ' ', 'g'))")
STATES = f"""{LINES},
raw_b AS (SELECT * REPLACE (
  qty + CASE l_partkey % 23 WHEN 1 THEN 1 WHEN 8 THEN 2 ELSE 0 END AS qty, CASE WHEN l_partkey % 23 = 2 THEN split_part(refdes, '-', 1) ELSE refdes END AS refdes,
  CASE WHEN l_partkey % 23 IN (3, 4) THEN 'ACME' ELSE maker END AS maker, CASE WHEN l_partkey % 23 IN (4, 6) THEN mpn || '-X' ELSE mpn END AS mpn,
  CASE WHEN l_partkey % 23 = 5 THEN val || '5' ELSE val END AS val, CASE WHEN l_partkey % 23 = 9 THEN ' ' || replace(pkg, ' ', '  ') ELSE pkg END AS pkg,
  CASE WHEN l_partkey % 23 IN (7, 8) THEN md5(item_id || 'x') ELSE item_id END AS item_id) FROM bom WHERE l_partkey % 13 <> 0),
raw_ab AS (SELECT 'a' AS side, * FROM bom WHERE l_partkey % 11 <> 0 UNION ALL BY NAME SELECT 'b' AS side, * FROM raw_b),
states AS (SELECT *, sha256('{{"attributes": ' || {CLEAN_JSON} || ', "quantity": ' || qty::BIGINT || '}}') AS checksum,
  md5(COALESCE(part_id, 'NO_PART') || '|' || qty::DOUBLE::VARCHAR || '|' || {RAW_JSON}) AS skey, COALESCE(part_id, 'NO_PART') AS pkey FROM raw_ab),
a AS (SELECT * FROM states WHERE side = 'a'), b AS (SELECT * FROM states WHERE side = 'b')"""
MATCHED = f"""{STATES},
t1 AS (SELECT item_id AS id_a, item_id AS id_b FROM a JOIN b USING (item_id)),
a1 AS (SELECT * FROM a ANTI JOIN t1 ON item_id = id_a), b1 AS (SELECT * FROM b ANTI JOIN t1 ON item_id = id_b),
t2 AS (SELECT x.item_id AS id_a, y.item_id AS id_b FROM (SELECT *, row_number() OVER (PARTITION BY skey, checksum ORDER BY item_id) AS r FROM a1) x
  JOIN (SELECT *, row_number() OVER (PARTITION BY skey, checksum ORDER BY item_id) AS r FROM b1) y USING (skey, checksum, r)),
a2 AS (SELECT * FROM a1 ANTI JOIN t2 ON item_id = id_a), b2 AS (SELECT * FROM b1 ANTI JOIN t2 ON item_id = id_b),
t3 AS (SELECT x.item_id AS id_a, y.item_id AS id_b FROM (SELECT *, row_number() OVER (PARTITION BY pkey ORDER BY item_id) AS r FROM a2) x
  JOIN (SELECT *, row_number() OVER (PARTITION BY pkey ORDER BY item_id) AS r FROM b2) y USING (pkey, r)),
pairs AS (SELECT *, 1 AS tier FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3),
chg AS (SELECT id_a, id_b, tier, a.checksum = b.checksum AS same, a.qty AS qa, b.qty AS qb,
  list_filter([CASE WHEN a.qty <> b.qty THEN 'QUANTITY_CHANGED::' || a.qty::DOUBLE || '>' || b.qty::DOUBLE END,
    CASE WHEN a.maker <> b.maker THEN 'ATTRIBUTE_CHANGED:manufacturer:' || a.maker || '>' || b.maker END, CASE WHEN a.mpn <> b.mpn THEN 'ATTRIBUTE_CHANGED:manufacturer_part_number:' || a.mpn || '>' || b.mpn END,
    CASE WHEN a.pkg <> b.pkg THEN 'ATTRIBUTE_CHANGED:package:' || a.pkg || '>' || b.pkg END, CASE WHEN a.refdes <> b.refdes THEN 'ATTRIBUTE_CHANGED:reference_designator:' || a.refdes || '>' || b.refdes END,
    CASE WHEN a.val <> b.val THEN 'ATTRIBUTE_CHANGED:value:' || a.val || '>' || b.val END], lambda x: x IS NOT NULL) AS ch
  FROM pairs JOIN a ON a.item_id = id_a JOIN b ON b.item_id = id_b),
diffed AS (SELECT id_b AS bom_item_id, id_a, id_b, tier, CASE WHEN same THEN 'UNCHANGED' WHEN len(ch) > 0 THEN 'MODIFIED' ELSE 'NOOP' END AS status, CASE WHEN same THEN [] ELSE ch END AS ch, qa, qb FROM chg
  UNION ALL SELECT item_id, NULL, item_id, NULL, 'ADDED', [], NULL, NULL FROM b ANTI JOIN pairs ON item_id = id_b
  UNION ALL SELECT item_id, item_id, NULL, NULL, 'REMOVED', [], NULL, NULL FROM a ANTI JOIN pairs ON item_id = id_a)"""
_HAS = "len(list_filter(ch, lambda x: starts_with(x, '{0}'))) > 0"
EVENTS = f"""{MATCHED},
flags AS (SELECT *, status = 'ADDED' AS added, status = 'REMOVED' AS removed, {_HAS.format('QUANTITY_CHANGED')} AS quantity_changed, {_HAS.format('ATTRIBUTE_CHANGED:manufacturer:')} AS manufacturer_changed,
  {_HAS.format('ATTRIBUTE_CHANGED:manufacturer_part_number:')} AS mpn_changed, {_HAS.format('ATTRIBUTE_CHANGED:reference_designator:')} AS refdes_changed,
  list_filter([CASE WHEN {_HAS.format('ATTRIBUTE_CHANGED:package:')} THEN 'package' END, CASE WHEN {_HAS.format('ATTRIBUTE_CHANGED:value:')} THEN 'value' END], lambda x: x IS NOT NULL) AS attrs
  FROM diffed WHERE status IN ('ADDED', 'REMOVED', 'MODIFIED')),
typed AS (SELECT *, CASE WHEN added THEN 'PART_ADDED' WHEN removed THEN 'PART_REMOVED' WHEN manufacturer_changed AND mpn_changed THEN 'PART_SUBSTITUTED' WHEN manufacturer_changed THEN 'MANUFACTURER_CHANGED'
  WHEN quantity_changed THEN 'QUANTITY_CHANGED' WHEN refdes_changed THEN 'REFERENCE_DESIGNATOR_CHANGED' WHEN len(attrs) > 0 THEN 'SPEC_ATTRIBUTE_CHANGED' WHEN mpn_changed THEN 'UNCLASSIFIED_CHANGE' END AS event_type FROM flags),
events_ AS (SELECT bom_item_id, event_type, len(ch) AS n_evidence, ch,
  CASE event_type WHEN 'PART_ADDED' THEN 'HIGH' WHEN 'PART_REMOVED' THEN 'HIGH' WHEN 'PART_SUBSTITUTED' THEN 'HIGH' WHEN 'REFERENCE_DESIGNATOR_CHANGED' THEN 'LOW' WHEN 'UNCLASSIFIED_CHANGE' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
  CASE event_type WHEN 'PART_ADDED' THEN 'ENGINEERING,PROCUREMENT' WHEN 'PART_REMOVED' THEN 'ENGINEERING,PROCUREMENT' WHEN 'PART_SUBSTITUTED' THEN 'PROCUREMENT,ENGINEERING' WHEN 'MANUFACTURER_CHANGED' THEN 'PROCUREMENT'
    WHEN 'QUANTITY_CHANGED' THEN 'PROCUREMENT,MANUFACTURING' WHEN 'REFERENCE_DESIGNATOR_CHANGED' THEN 'MANUFACTURING' WHEN 'SPEC_ATTRIBUTE_CHANGED' THEN 'ENGINEERING' ELSE '' END AS domains,
  CASE event_type WHEN 'PART_ADDED' THEN 'New part added to BOM' WHEN 'PART_REMOVED' THEN 'Part removed from BOM' WHEN 'PART_SUBSTITUTED' THEN 'Part substituted (different manufacturer and MPN)' WHEN 'MANUFACTURER_CHANGED' THEN 'Manufacturer changed'
    WHEN 'QUANTITY_CHANGED' THEN 'Quantity changed: ' || qa::BIGINT || ' → ' || qb::BIGINT WHEN 'REFERENCE_DESIGNATOR_CHANGED' THEN 'Reference designator changed'
    WHEN 'SPEC_ATTRIBUTE_CHANGED' THEN 'Specification changed: ' || array_to_string(attrs, ', ') ELSE 'Unclassified change: MPN' END AS summary FROM typed WHERE event_type IS NOT NULL)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """col_name, row_index, value: seven text columns of the table part."""
    key = F.col("p_partkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("nF", "Ω", "R", "V", "pF", "mm")]), (key % 6 + 1).cast("int"))
    wide = table(spark, sf_dir, "part").select(
        key.alias("row_index"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("-"), "p_partkey").alias("mpn"), F.col("p_size").cast("string").alias("size"),
        F.concat(F.lit("R"), "p_partkey").alias("refdes"), F.concat("p_size", unit).alias("val"),
        F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, F.lit("")).otherwise(F.concat(F.lit(" "), "p_size", F.lit(" "))).alias("mixed"), F.lit(None).cast("string").alias("blank"),
    )
    from stockweave.operators.profile import long_rows

    return long_rows(wide, "row_index")


CELLS = """
wide AS (SELECT p_partkey AS row_index, p_name AS name, p_brand || '-' || p_partkey AS mpn, p_size::VARCHAR AS size, 'R' || p_partkey AS refdes,
  p_size || ['nF', 'Ω', 'R', 'V', 'pF', 'mm'][p_partkey % 6 + 1] AS val, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE ' ' || p_size || ' ' END AS mixed, NULL::VARCHAR AS blank FROM part),
cells AS (SELECT u.col_name, row_index, u.value FROM (SELECT row_index, unnest([{'col_name': 'name', 'value': name}, {'col_name': 'mpn', 'value': mpn}, {'col_name': 'size', 'value': size}, {'col_name': 'refdes', 'value': refdes},
  {'col_name': 'val', 'value': val}, {'col_name': 'mixed', 'value': mixed}, {'col_name': 'blank', 'value': blank}]) AS u FROM wide)),
firsts AS (SELECT col_name, row_index, trim(value) AS v FROM (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY row_index) AS rn FROM cells WHERE value IS NOT NULL AND value <> '') WHERE rn <= 200 AND trim(value) <> '')"""
