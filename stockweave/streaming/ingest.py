"""Streams of template rows into snapshots: every micro-batch becomes one snapshot of each assembly in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockweave.operators.store import ParquetStore, ingest


def ingest_stream(rows: DataFrame, store: ParquetStore, org_id: str, checkpoint: str, assembly: str = "assembly") -> StreamingQuery:
    """rows: a stream of template rows with row_index and an assembly's name. A batch that comes again after a failure
    commits anew only what it had not: the source names batch and assembly."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            for r in df.select(assembly).distinct().orderBy(assembly).toLocalIterator():
                name = r[0]
                done = store.table("snapshots").where(F.col("source") == f"stream:{epoch}:{name}")
                if done.isEmpty():
                    ingest(store, df.where(F.col(assembly) == name).drop(assembly), org_id, assembly_name=name, source=f"stream:{epoch}:{name}")
        finally:
            df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
