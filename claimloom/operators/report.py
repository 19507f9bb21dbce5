"""Reports as DataFrames; printing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_names(rows: DataFrame, sources: DataFrame, key: str = "source_id", name: str = "name") -> DataFrame:
    """Adds the domain of a source; the id as text where it has none."""
    names = sources.select(F.col("source_id").alias(key), F.col("domain").alias("_domain"))
    return rows.join(names, key, "left").withColumn(name, F.coalesce("_domain", F.col(key).cast("string"))).drop("_domain")


def one_name_each(sources: DataFrame) -> DataFrame:
    """One domain per source id: the one loaded last, ties to the greatest."""
    order = F.struct(F.col("loaded_at"), F.col("domain"))
    return sources.groupBy("source_id").agg(F.max_by("domain", order).alias("domain"))


def top_sources(scores: DataFrame, n: int = 20, digits: int = 10) -> DataFrame:
    """Highest scores first; equal ones by id. Scores are compared as rounded, so that engines agree on ties."""
    return scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "source_id").limit(n)


def top_sources_with_claims(scores: DataFrame, edges: DataFrame, n: int = 20, digits: int = 10) -> DataFrame:
    """``top_sources`` with the number of claims of each."""
    counts = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("claims"))
    return top_sources(scores, n, digits).join(counts, "source_id", "left")


def visit_totals(visits: DataFrame) -> DataFrame:
    """How many sources were visited, and all visits."""
    return visits.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"))


def bottom_sources(scores: DataFrame, n: int = 20, digits: int = 10) -> DataFrame:
    return scores.withColumn("score", F.round("score", digits)).orderBy("score", "source_id").limit(n)


def ranking_changes(baseline: DataFrame, weighted: DataFrame, n: int | None = 20, digits: int = 10) -> DataFrame:
    """The largest changes from baseline to weighted scores; a source missing in the baseline counts as 0 there."""
    before = baseline.select("source_id", F.round("score", digits).alias("before"))
    joined = weighted.select("source_id", F.round("score", digits).alias("after")).join(before, "source_id", "left")
    changed = joined.withColumn("before", F.coalesce("before", F.lit(0.0))).withColumn("change", F.round(F.col("after") - F.col("before"), digits))
    ordered = changed.orderBy(F.desc(F.abs("change")), F.desc("change"), F.desc("source_id"))
    return ordered if n is None else ordered.limit(n)


def top_by(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """A report of a few rows in its order, which no join behind it can lose: ``position`` from 1."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order))).orderBy("position")


def share(rows: DataFrame, count: str, percent: str = "percent") -> DataFrame:
    """Each count as a percentage of their sum."""
    total = rows.agg(F.sum(count).alias("_t"))  # one row
    return rows.join(F.broadcast(total)).withColumn(percent, F.col(count) / F.col("_t") * 100).drop("_t")


def formatted_scores(scores: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id, domain, score`` with 12 decimals, highest first."""
    named = with_names(scores, sources, name="domain")
    ordered = named.orderBy(F.desc("score"), "source_id")
    return ordered.select("source_id", "domain", F.format_string("%.12f", "score").alias("score"))


def save_scores(scores: DataFrame, sources: DataFrame, path: str) -> None:
    """One CSV file with a header; a row per source."""
    formatted_scores(scores, sources).coalesce(1).write.mode("overwrite").csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
