"""Tables kept hash-bucketed by key in a shared folder, changed bucket by bucket.

A table is a set of folders per bucket. A change appends a folder to the buckets it has rows for, or
replaces the folders of the buckets it names; the other buckets keep the folders they had. Which folders
make up a version is a manifest of a few entries a bucket, written when the version is complete: a version
without a manifest does not exist, so a batch that is lost half way leaves the one before it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.session import ensure_checkpoint_dir

BUCKET = "_bucket"
#: A bucket that has been appended to this often is worth merging.
MERGE_AFTER = 16


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def years(rows: DataFrame, time: str) -> list[str | None]:
    """Bounds of the batches, a calendar year each, in which a whole table is replayed; the outer ones are open (null)."""
    ends = rows.agg(F.year(F.min(time)).alias("a"), F.year(F.max(time)).alias("z")).head()
    between = [] if ends.a is None else [f"{y:04d}-01-01 00:00:00" for y in range(ends.a + 1, ends.z + 1)]
    return [None, *between, None]


def within(time: str, kind: T.DataType, lower: str | None, upper: str | None) -> Column:
    """Whether a time lies in ``[lower, upper)``; a null bound is open."""
    after = F.lit(True) if lower is None else F.col(time) >= F.lit(lower).cast(kind)
    return after & (F.lit(True) if upper is None else F.col(time) < F.lit(upper).cast(kind))


class Buckets:
    """One version of the tables of a folder, open for changes; ``commit`` makes it readable under its number."""

    def __init__(self, spark: SparkSession, path: str, n: int | None = None):
        self.spark, self.path = spark, path
        #: as many as a shuffle has partitions: then an aggregation by the same keys leaves each bucket in one task
        self.n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, dict] = {}
        self.values: dict = {}
        self._gone: list[str] = []

    @staticmethod
    def scratch(spark: SparkSession, n: int | None = None) -> Buckets:
        """Tables in a folder of their own in the shared checkpoint folder."""
        return Buckets(spark, f"{ensure_checkpoint_dir(spark)}/claimloom-{uuid.uuid4().hex}", n)

    # ---- versions

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifest/{number}.json"

    def exists(self, number: int) -> bool:
        where, fs = _path(self.spark, self._manifest(number))
        return fs.exists(where)

    def commit(self, number: int) -> None:
        text = json.dumps({"n": self.n, "tables": self.tables, "values": self.values})
        target, fs = _path(self.spark, self._manifest(number))
        part, _ = _path(self.spark, f"{self._manifest(number)}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(part, target)
        self._gone = []

    def open(self, before: int) -> Buckets:
        """The newest complete version below ``before``; an empty one if there is none."""
        folder, fs = _path(self.spark, f"{self.path}/manifest")
        found = Buckets(self.spark, self.path, self.n)
        if fs.exists(folder):
            names = [s.getPath().getName() for s in fs.listStatus(folder)]
            numbers = [int(x[:-5]) for x in names if x.endswith(".json") and int(x[:-5]) < before]
            if numbers:
                source = fs.open(_path(self.spark, self._manifest(max(numbers)))[0])
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
                source.close()
                known = json.loads(text)
                found.n, found.tables, found.values = known["n"], known["tables"], known["values"]
        return found

    # ---- tables

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.hash(*keys), F.lit(self.n))

    def touched(self, rows: DataFrame, *keys: str) -> list[int]:
        """The buckets of some rows: at most ``n`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket(*keys).alias(BUCKET)).distinct().collect())

    def read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets; one that was never written is empty and has ``schema``."""
        table = self.tables.get(name)
        if table is None:
            return self.spark.createDataFrame([], schema)
        kind = T.StructType.fromJson(table["schema"])
        chosen = sorted(table["parts"]) if buckets is None else [str(b) for b in buckets]
        folders = [f"{self.path}/{p}" for b in chosen for p in table["parts"].get(b, [])]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def _write(self, name: str, rows: DataFrame, keys: tuple[str, ...], spread: bool) -> dict[str, str]:
        written = f"{name}/{uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, self.bucket(*keys))
        # a bucket's rows come together, and adaptive execution splits a bucket that holds far more than the others
        placed = placed.hint("rebalance", BUCKET) if spread else placed
        placed.write.partitionBy(BUCKET).parquet(f"{self.path}/{written}")
        folder, fs = _path(self.spark, f"{self.path}/{written}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        self.tables.setdefault(name, {"schema": json.loads(rows.schema.json()), "parts": {}})
        return {x.split("=")[1]: f"{written}/{x}" for x in names if x.startswith(f"{BUCKET}=")}

    def append(self, name: str, rows: DataFrame, *keys: str, spread: bool = True) -> list[int]:
        """Add rows; the buckets that got some. ``spread=False``: rows of a bucket are in one partition already."""
        written = self._write(name, rows, keys, spread)
        for b, folder in written.items():
            self.tables[name]["parts"].setdefault(b, []).append(folder)
        return sorted(map(int, written))

    def replace(self, name: str, rows: DataFrame, buckets: list[int], *keys: str, spread: bool = True) -> None:
        """Put ``rows`` in the place of all rows of ``buckets``; ``rows`` has none of other buckets."""
        written = self._write(name, rows, keys, spread)
        parts = self.tables[name]["parts"]
        for b in map(str, buckets):
            self._gone += parts.pop(b, [])
            if b in written:
                parts[b] = [written[b]]

    def pieces(self, name: str) -> dict[int, int]:
        """How often each bucket was appended to since it was last replaced."""
        return {int(b): len(p) for b, p in self.tables.get(name, {"parts": {}})["parts"].items()}

    def sweep(self) -> None:
        """Remove the folders that were replaced; for a folder of which only the newest version is wanted."""
        for folder in self._gone:
            where, fs = _path(self.spark, f"{self.path}/{folder}")
            fs.delete(where, True)
        self._gone = []
