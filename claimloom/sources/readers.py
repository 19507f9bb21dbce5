"""Readers of sources, assertion edges, claims and their values: CSV bundles, parquet, JDBC and literals."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import schema
from claimloom.operators import agreement


@dataclass
class CredibilityGraph:
    """``sources``: source_id, domain; ``edges``: distinct source_id, claim_id; ``weights``: source_id, claim_id, weight or None."""

    sources: DataFrame
    edges: DataFrame
    weights: DataFrame | None = None


def _csv(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """A CSV file with a header, read by an explicit schema; a malformed number fails the read."""
    return spark.read.schema(columns).csv(path, header=True, mode="FAILFAST")


def distinct_edges(rows: DataFrame) -> DataFrame:
    """Assertion edges have set semantics: repeats and rows with a missing end are dropped."""
    return rows.select(F.col("source_id").cast("bigint").alias("source_id"), F.col("claim_id").cast("bigint").alias("claim_id")).dropna().distinct()


def last_by(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (ties: the greatest values)."""
    picked = F.max(F.struct(F.col(order).alias("_order"), *columns)).alias("_last")
    return rows.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def read_sources_csv(spark: SparkSession, folder: str) -> DataFrame:
    """``id,domain``; the later line of a repeated id counts."""
    columns = T.StructType([T.StructField("id", T.LongType()), T.StructField("domain", T.StringType())])
    rows = _csv(spark, os.path.join(folder, "sources.csv"), columns).withColumn("_line", F.monotonically_increasing_id())
    return last_by(rows.withColumnRenamed("id", "source_id"), ["source_id"], ["domain"], "_line")


def read_assertions_csv(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_edges(_csv(spark, os.path.join(folder, "assertions.csv"), schema.EDGES))


def read_weights_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement weights from ``claims.csv`` and ``source_claims.csv``."""
    claims = _csv(spark, os.path.join(folder, "claims.csv"), schema.CLAIMS).withColumn("_line", F.monotonically_increasing_id())
    values = _csv(spark, os.path.join(folder, "source_claims.csv"), schema.VALUES).withColumn("_line", F.monotonically_increasing_id())
    claims = last_by(claims, ["claim_id"], ["product_id", "attribute"], "_line")
    return agreement.agreement_weights(values, claims, order="_line")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load_csv_bundle(spark: SparkSession, folder: str) -> CredibilityGraph:
    """Sources, edges and, where both files for them are there, weights."""
    weighted = all(_exists(spark, os.path.join(folder, n)) for n in ("claims.csv", "source_claims.csv"))
    return CredibilityGraph(
        read_sources_csv(spark, folder), read_assertions_csv(spark, folder), read_weights_csv(spark, folder) if weighted else None
    )


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_jdbc(spark: SparkSession, url: str, dbtable: str, columns: list[str], where: str | None = None, **options: str) -> DataFrame:
    """Selected columns of a database table; the predicate is pushed into the database."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
    return (rows.filter(where) if where else rows).select(*columns)


def literal_graph(spark: SparkSession, claims_of: dict[int, list[int]]) -> CredibilityGraph:
    """A graph written out in code, for fixtures."""
    edges = [(s, c) for s, claims in claims_of.items() for c in claims]
    sources = [(s, f"source-{s}") for s in claims_of]
    return CredibilityGraph(spark.createDataFrame(sources, schema.SOURCES), distinct_edges(spark.createDataFrame(edges, schema.EDGES)))


def lookup_source(sources: DataFrame, domain: str) -> int:
    """The id of a domain; an unknown domain is a ``ValueError``. Of several ids the smallest."""
    row = sources.filter(F.col("domain") == domain).agg(F.min("source_id").alias("id")).head()
    if row is None or row.id is None:
        raise ValueError(f"no source has the domain {domain!r}")
    return row.id


def source_rows(rows: DataFrame, source_id: int) -> DataFrame:
    """All value rows of one source."""
    return rows.filter(F.col("source_id") == F.lit(source_id))
