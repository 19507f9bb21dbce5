"""Orphan references from streams of references and of parent changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.buckets import Buckets
from claimloom.operators import orphans


class OrphanStore:
    """Orphan state in bucketed tables, one version per batch.

    A batch rewrites the buckets it has keys in. One that is repeated after a failure finds its version and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.tables = Buckets(spark, path, buckets)

    def done(self, batch: int) -> bool:
        return self.tables.exists(batch)

    def read(self, before: int) -> orphans.OrphanState:
        """The newest state before a batch."""
        found = self.tables.open(before)
        return orphans.OrphanState(found.read("refs", orphans.REFS), found.read("stays", orphans.STAYS), orphans.episodes(found))

    def apply(self, batch: int, refs: DataFrame, stays: DataFrame) -> list[int]:
        """The buckets that the batch changed."""
        if self.done(batch):
            return []
        tables = self.tables.open(batch)
        changed = orphans.advance(tables, refs, stays)
        tables.commit(batch)
        return changed


def start(
    changes: DataFrame, store: OrphanStore, ref_table: str, checkpoint: str, on_snapshot: Callable[[int, DataFrame], None] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the incremental operator on a stream ``kind, row_id, key, at, loaded_at, deleted_at``.

    ``kind`` is ``ref`` for references (row_id, key, at) and ``stay`` for parent changes (key, loaded_at,
    deleted_at). After each batch ``on_snapshot`` gets the counts per month.
    """

    def batch(rows: DataFrame, number: int) -> None:
        refs = orphans.references(rows.filter(F.col("kind") == "ref"), "row_id", "key", "at")
        stays = orphans.parent_stays(rows.filter(F.col("kind") == "stay"), "key")
        store.apply(number, refs, stays)
        if on_snapshot is not None:
            on_snapshot(number, orphans.snapshots(store.read(number + 1).episodes, ref_table))

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


CHANGES = "kind string, row_id bigint, key bigint, at timestamp, loaded_at timestamp, deleted_at timestamp"


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of parquet files of changes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return spark.readStream.schema(CHANGES).parquet(folder)
