"""Immutable snapshots as Parquet tables, one transaction a folder.

A transaction writes its rows of every table under <table>/tx=<id> and becomes visible by one marker file in _commits;
what failed before that leaves nothing that a reader sees. A snapshot's id is its transaction's, so reading its items
opens one folder.
"""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave import catalog
from stockweave.functions import text
from stockweave.operators import diff, normalize, resolve

SCHEMAS = {
    "organizations": "id string, name string, created_at timestamp",
    "assemblies": "id string, org_id string, name string, created_at timestamp",
    "parts": "id string, org_id string, name string, attributes map<string,string>, ord long, created_at timestamp",
    "bom_items": "id string, assembly_id string, part_id string, context map<string,string>, ord long, created_at timestamp",
    "snapshots": "id string, org_id string, assembly_id string, source string, parent_snapshot_id string, created_at timestamp",
    "snapshot_items": "snapshot_id string, bom_item_id string, quantity double, attributes map<string,string>, row_index int, checksum string",
}


class SnapshotStore(Protocol):
    """What an ingest, a diff and a report need of a store. Writes need an open transaction; rows come as DataFrames."""

    def table(self, name: str, tx: str | None = None) -> DataFrame: ...
    def begin(self, tx: str | None = None) -> str: ...
    def commit(self) -> None: ...
    def rollback(self) -> None: ...
    def get_or_create_organization(self, org_id: str, org_name: str | None = None) -> str: ...
    def get_assembly(self, org_id: str, assembly_id: str) -> str: ...
    def get_or_create_assembly(self, org_id: str, assembly_name: str) -> str: ...
    def find_similar_parts(self, rows: DataFrame, threshold: float = ...) -> DataFrame: ...
    def create_parts(self, rows: DataFrame) -> None: ...
    def find_similar_items(self, rows: DataFrame, threshold: float = ...) -> DataFrame: ...
    def create_items(self, rows: DataFrame) -> None: ...
    def create_snapshot(self, org_id: str, assembly_id: str, source: str, parent_snapshot_id: str | None = None) -> str: ...
    def insert_snapshot_items(self, rows: DataFrame) -> None: ...
    def get_snapshot_items(self, snapshot_id: str) -> DataFrame: ...
    def get_item_details(self, ids: DataFrame) -> DataFrame: ...
    def get_snapshot_info(self, snapshot_id: str) -> DataFrame: ...


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.tx = spark, root.rstrip("/"), None

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def committed(self) -> list[str]:
        return self._list(f"{self.root}/_commits")

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def table(self, name: str, tx: str | None = None) -> DataFrame:
        """Committed rows of a table, or of one transaction: that opens one folder and lists nothing."""
        if tx is not None:
            path = f"{self.root}/{name}/tx={tx}"
            found = self._exists(f"{self.root}/_commits/{tx}") and self._exists(path)
            return self.spark.read.schema(SCHEMAS[name]).parquet(path) if found else self.spark.createDataFrame([], SCHEMAS[name])
        have = {x.removeprefix("tx=") for x in self._list(f"{self.root}/{name}")}
        paths = [f"{self.root}/{name}/tx={tx}" for tx in self.committed() if tx in have]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def begin(self, tx: str | None = None) -> str:
        if self.tx:
            raise RuntimeError("a transaction is open")
        self.tx = tx or str(uuid.uuid4())
        return self.tx

    def append(self, name: str, rows: DataFrame) -> None:
        if not self.tx:
            raise RuntimeError("no transaction is open")
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        rows.withColumn("created_at", F.current_timestamp()).select(*names).write.mode("append").parquet(f"{self.root}/{name}/tx={self.tx}")

    def written(self, name: str) -> DataFrame:
        """Rows that the open transaction has appended."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/tx={self.tx}")

    def commit(self) -> None:
        if not self.tx:
            raise RuntimeError("no transaction is open")
        fs, p = self._fs(f"{self.root}/_commits/{self.tx}")
        fs.create(p, False).close()
        self._clean()
        self.tx = None

    def _clean(self) -> None:
        """Matches that the transaction kept while it ran."""
        fs, p = self._fs(f"{self.root}/_work/{self.tx}")
        fs.delete(p, True)

    def rollback(self) -> None:
        if self.tx:
            for name in SCHEMAS:
                fs, p = self._fs(f"{self.root}/{name}/tx={self.tx}")
                fs.delete(p, True)
            self._clean()
        self.tx = None

    def _seen(self, name: str) -> DataFrame:
        """Committed rows, and those of the open transaction."""
        rows = self.table(name)
        return rows.unionByName(self.written(name)) if self.tx and self._exists(f"{self.root}/{name}/tx={self.tx}") else rows

    def get_or_create_organization(self, org_id: str, org_name: str | None = None) -> str:
        one = self.spark.range(1).select(F.lit(org_id).alias("id"), (F.lit(org_name) if org_name else text.default_org_name(F.lit(org_id))).alias("name"))
        self.append("organizations", resolve.missing(one, self._seen("organizations"), ["id"]))
        return org_id

    def get_assembly(self, org_id: str, assembly_id: str) -> str:
        if owned_assembly(self._seen("assemblies"), assembly_id, org_id).isEmpty():
            raise ValueError("the organization has no such assembly")
        return assembly_id

    def get_or_create_assembly(self, org_id: str, assembly_name: str) -> str:
        """The oldest one of that name, or a new one."""
        named = self._seen("assemblies").where((F.col("org_id") == org_id) & (F.col("name") == assembly_name))
        found = named.orderBy("created_at", "id").limit(1).collect()
        if found:
            return found[0].id
        new = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{org_id}|{assembly_name}"))
        self.append("assemblies", self.spark.range(1).select(F.lit(new).alias("id"), F.lit(org_id).alias("org_id"), F.lit(assembly_name).alias("name")))
        return new

    def find_similar_parts(self, rows: DataFrame, threshold: float = catalog.NAME_THRESHOLD) -> DataFrame:
        """row_id, part_id, score, ord of rows (row_id, org_id, name, attributes)."""
        return resolve.similar_parts(rows, self._seen("parts").withColumnRenamed("id", "part_id"), threshold)

    def create_parts(self, rows: DataFrame) -> None:
        """rows: id, org_id, name, attributes and ord, their order among those of this call."""
        self._create("parts", rows)

    def find_similar_items(self, rows: DataFrame, threshold: float = catalog.CONTEXT_THRESHOLD) -> DataFrame:
        """row_id, bom_item_id, score, ord of rows (row_id, assembly_id, part_id, context)."""
        return resolve.similar_usages(rows, self._seen("bom_items").withColumnRenamed("id", "bom_item_id"), threshold)

    def create_items(self, rows: DataFrame) -> None:
        """rows: id, assembly_id, part_id, context and ord, their order among those of this call."""
        self._create("bom_items", rows)

    def _create(self, name: str, rows: DataFrame) -> None:
        """What is there goes before: ord counts on from the largest."""
        top = self._seen(name).agg(F.max("ord")).first()[0]
        self.append(name, rows.withColumn("ord", F.col("ord").cast("long") + F.lit(0 if top is None else top + 1)))

    def create_snapshot(self, org_id: str, assembly_id: str, source: str, parent_snapshot_id: str | None = None) -> str:
        """The open transaction's snapshot: its id is the transaction's."""
        given = {"id": self.tx, "org_id": org_id, "assembly_id": assembly_id, "source": source, "parent_snapshot_id": parent_snapshot_id}
        self.append("snapshots", self.spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in given.items()]))
        return self.tx

    def insert_snapshot_items(self, rows: DataFrame) -> None:
        """rows: bom_item_id, quantity, attributes, row_index; of equal items the last counts. Checksums are computed here."""
        held = rows.withColumns({"snapshot_id": F.lit(self.tx), "checksum": text.checksum(F.col("quantity"), F.col("attributes"))})
        self.append("snapshot_items", resolve.last_wins(held, ["snapshot_id", "bom_item_id"]))

    def get_snapshot_items(self, snapshot_id: str) -> DataFrame:
        return snapshot_items(self, snapshot_id)

    def get_item_details(self, ids: DataFrame) -> DataFrame:
        return item_details(self.table("bom_items"), self.table("assemblies"), self.table("parts"), ids)

    def get_snapshot_info(self, snapshot_id: str) -> DataFrame:
        return snapshot_info(self.table("snapshots"), self.table("assemblies"), snapshot_id)


def snapshot_items(store: SnapshotStore, snapshot_id: str) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return store.table("snapshot_items", tx=snapshot_id).where(F.col("snapshot_id") == snapshot_id).select("bom_item_id", "quantity", F.coalesce("attributes", none).alias("attributes"), "checksum")


def item_details(bom_items: DataFrame, assemblies: DataFrame, parts: DataFrame, ids: DataFrame) -> DataFrame:
    """bom_item_id, assembly_id, assembly_name, part_id, part_name, part_attributes, context of the wanted ids (bom_item_id)."""
    none = F.create_map().cast("map<string,string>")
    context = F.coalesce("b.context", none) if "context" in bom_items.columns else F.lit(None).cast("map<string,string>")
    wanted = bom_items.join(ids.select(F.col("bom_item_id").alias("id")), "id", "left_semi").alias("b")
    return (
        wanted.join(assemblies.alias("s"), F.col("b.assembly_id") == F.col("s.id"))
        .join(parts.alias("p"), F.col("b.part_id") == F.col("p.id"))
        .select(
            F.col("b.id").alias("bom_item_id"), "b.assembly_id", F.col("p.id").alias("part_id"), F.coalesce("p.name", F.lit("Unknown")).alias("part_name"),
            F.coalesce("p.attributes", none).alias("part_attributes"), F.coalesce("s.name", F.lit("Unknown")).alias("assembly_name"), context.alias("context"),
        )
    )


def snapshot_info(snapshots: DataFrame, assemblies: DataFrame, snapshot_id: str) -> DataFrame:
    """The snapshot's row with assembly_name."""
    one = snapshots.where(F.col("id") == snapshot_id).alias("s")
    return one.join(assemblies.alias("a"), F.col("s.assembly_id") == F.col("a.id")).select("s.*", F.coalesce("a.name", F.lit("Unknown")).alias("assembly_name"))


def owned_assembly(assemblies: DataFrame, assembly_id: str, org_id: str) -> DataFrame:
    return assemblies.where((F.col("id") == assembly_id) & (F.col("org_id") == org_id)).limit(1)


def ingest(store: ParquetStore, rows: DataFrame, org_id: str, assembly_id: str | None = None, assembly_name: str | None = None,
           parent_snapshot_id: str | None = None, org_name: str | None = None, source: str = "csv") -> str:
    """Store template rows (with row_index) as a snapshot of an assembly; all or nothing. Returns the snapshot's id."""
    if bool(assembly_id) == bool(assembly_name):
        raise ValueError("give either assembly_id or assembly_name")
    if rows.isEmpty():
        raise ValueError("no rows")
    tx = store.begin()
    try:
        store.get_or_create_organization(org_id, org_name)
        assembly_id = store.get_assembly(org_id, assembly_id) if assembly_id else store.get_or_create_assembly(org_id, assembly_name)
        parsed = normalize.parsed(rows).withColumns({"row_id": F.col("row_index").cast("string"), "org_id": F.lit(org_id), "assembly_id": F.lit(assembly_id)})
        incoming = parsed.select("row_id", "org_id", "row_index", F.col("part_name").alias("name"), normalize.part_attributes(F.col("attributes")).alias("attributes"), F.md5(F.concat(F.lit(f"{tx}|part|"), "row_id")).alias("new_id"))
        parts = store.table("parts").where(F.col("org_id") == org_id).withColumnRenamed("id", "part_id")
        matched = _kept(store, "matched-parts", resolve.resolve_parts(incoming, parts))
        new = matched.where("created").join(incoming, "row_id").select(F.col("part_id").alias("id"), incoming.org_id, "name", "attributes", F.col("row_index").alias("ord"))
        store.create_parts(new)
        usage = parsed.select("row_id", "assembly_id", "row_index", normalize.usage_context(F.col("context")).alias("context")).join(matched.select("row_id", "part_id"), "row_id")
        usage = usage.withColumn("new_id", F.md5(F.concat(F.lit(f"{tx}|item|"), "row_id")))
        items = store.table("bom_items").where(F.col("assembly_id") == assembly_id).withColumnRenamed("id", "bom_item_id")
        used = _kept(store, "matched-items", resolve.resolve_usages(usage, items))
        store.create_items(used.where("created").join(usage.select("row_id", "row_index", "context"), "row_id").select(F.col("bom_item_id").alias("id"), "assembly_id", "part_id", "context", F.col("row_index").alias("ord")))
        store.create_snapshot(org_id, assembly_id, source, parent_snapshot_id)
        held = parsed.select("row_id", "row_index", F.col("quantity").cast("double").alias("quantity"), normalize.snapshot_attributes(F.col("context")).alias("attributes"))
        store.insert_snapshot_items(held.join(used.select("row_id", "bom_item_id"), "row_id").drop("row_id"))
        store.commit()
        return tx
    except BaseException:
        store.rollback()
        raise


def _kept(store: ParquetStore, name: str, df: DataFrame) -> DataFrame:
    """Matches as a table beside the store's: they are read more than once and Python must not run again."""
    path = f"{store.root}/_work/{store.tx}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def diff_snapshots(store: SnapshotStore, a: str, b: str) -> DataFrame:
    """The diff of two stored snapshots; see operators.diff."""
    items = [snapshot_items(store, s) for s in (a, b)]
    owners = store.table("bom_items").select(F.col("id").alias("bom_item_id"), "part_id")
    return diff.diff(*[diff.state(i, owners) for i in items])


def explain_diff(store: SnapshotStore, diffed: DataFrame) -> DataFrame:
    """A diff with the part's and assembly's names, for reports."""
    details = item_details(store.table("bom_items"), store.table("assemblies"), store.table("parts"), diffed.select("bom_item_id"))
    return diffed.join(details.select("bom_item_id", "part_name", "assembly_name"), "bom_item_id", "left")
