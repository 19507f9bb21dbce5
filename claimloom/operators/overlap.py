"""Structure of the source-claim graph and dependence between pairs of sources.

Pairs come from one equi-join on the shared claim or property with ``a < b``, never from a cross join, so
only pairs that share something appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.sources import readers

PROPERTY = ["product_id", "attribute"]


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.countDistinct("source_id").alias("n_sources"), F.countDistinct("claim_id").alias("n_claims"), F.count(F.lit(1)).alias("n_assertions")
    )


def source_sizes(edges: DataFrame) -> DataFrame:
    """Distinct claims per source, most first."""
    return edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("degree"))


def claim_support(edges: DataFrame) -> DataFrame:
    """Distinct sources per claim."""
    return edges.groupBy("claim_id").agg(F.count(F.lit(1)).alias("support"))


def support_breakdown(edges: DataFrame) -> DataFrame:
    """How many claims have how many sources."""
    return claim_support(edges).groupBy("support").agg(F.count(F.lit(1)).alias("claims"))


def source_overlap(edges: DataFrame) -> DataFrame:
    """Per source its claims, those that no other source makes, and their share."""
    joined = edges.join(claim_support(edges), "claim_id")
    counted = joined.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("support") == 1).alias("unique_claims"))
    return counted.withColumn("ratio", F.col("unique_claims") / F.col("total"))


def last_values(rows: DataFrame, order: str, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """One value per (source, property): the last by ``order``; rows without a value are dropped first."""
    kept = rows.filter(F.col("value").isNotNull())
    picked = F.max(F.struct(F.col(order).alias("_o"), *columns)).alias("_last")
    return kept.groupBy("source_id", *PROPERTY).agg(picked).select("source_id", *PROPERTY, *[F.col(f"_last.{c}").alias(c) for c in columns])


def _compared(assertions: DataFrame, *measures: Column) -> DataFrame:
    """Per pair of sources that share a property: matches, disagreements, sizes and further sums over the shared properties.

    ``measures`` may use ``_va``, ``_vb`` and the columns of the first source's row.
    """
    sizes = assertions.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    a = assertions.withColumnsRenamed({"source_id": "source_a", "value": "_va"})
    b = assertions.select(F.col("source_id").alias("source_b"), *PROPERTY, F.col("value").alias("_vb"))
    pairs = a.join(b, PROPERTY).filter(F.col("source_a") < F.col("source_b")).groupBy("source_a", "source_b")
    same, other = F.count_if(F.col("_va") == F.col("_vb")), F.count_if(F.col("_va") != F.col("_vb"))
    counted = pairs.agg(same.alias("matches"), other.alias("disagreements"), *measures)
    return counted.join(sizes.select(F.col("source_id").alias("source_a"), F.col("n").alias("size_a")), "source_a").join(
        sizes.select(F.col("source_id").alias("source_b"), F.col("n").alias("size_b")), "source_b"
    )


def directional_inclusion(assertions: DataFrame) -> DataFrame:
    """All pairs of sources that share a property, ``source_a < source_b``.

    ``score_ab = matches / size_b`` is how much of b is found in a, ``score_ba = matches / size_a`` the
    reverse; ``agreement = matches / shared``; ``asymmetry`` is their absolute difference. ``assertions``
    has one value per source and property.
    """
    scored = _compared(assertions.select("source_id", *PROPERTY, "value"))
    scored = scored.withColumn("score_ab", F.col("matches") / F.col("size_b")).withColumn("score_ba", F.col("matches") / F.col("size_a"))
    shared = F.col("matches") + F.col("disagreements")
    return scored.withColumn("agreement", F.when(shared == 0, 0.0).otherwise(F.col("matches") / shared)).withColumn(
        "asymmetry", F.abs(F.col("score_ab") - F.col("score_ba"))
    )


def shared_claims(edges: DataFrame) -> DataFrame:
    """``source_a < source_b, claim_id`` for every claim that two sources share."""
    a = edges.select(F.col("source_id").alias("source_a"), "claim_id")
    b = edges.select(F.col("source_id").alias("source_b"), "claim_id")
    return a.join(b, "claim_id").filter(F.col("source_a") < F.col("source_b"))


def rarity(edges: DataFrame) -> DataFrame:
    """``1 / sources`` of each claim."""
    return claim_support(edges).select("claim_id", (1.0 / F.col("support")).alias("rarity"))


def rarity_overlap(edges: DataFrame) -> DataFrame:
    """Per pair of sources the sum of rarities over their common claims, and their number."""
    rare = edges.join(rarity(edges), "claim_id")
    a = rare.select(F.col("source_id").alias("source_a"), "claim_id", "rarity")
    b = edges.select(F.col("source_id").alias("source_b"), "claim_id")
    pairs = a.join(b, "claim_id").filter(F.col("source_a") < F.col("source_b"))
    return pairs.groupBy("source_a", "source_b").agg(F.sum("rarity").alias("score"), F.count(F.lit(1)).alias("shared"))


def source_graph(edges: DataFrame) -> DataFrame:
    """The projection on sources: an edge per pair that shares claims, weighted by their number."""
    return shared_claims(edges).groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("weight"))


def dependence_scores(inclusion: Column, average_rarity: Column) -> tuple[Column, Column]:
    """Redundancy and structural independence of a pair."""
    redundancy = inclusion * average_rarity
    return redundancy, 1 - redundancy


def structural_independence(assertions: DataFrame) -> DataFrame:
    """Per pair: inclusion (the larger direction), mean rarity of matching values, redundancy, independence.

    The rarity of a value is one over the sources that give it for its property. Pairs without a match
    have mean rarity 0.
    """
    asserters = assertions.groupBy(*PROPERTY, "value").agg(F.count(F.lit(1)).alias("_n"))
    rare = assertions.select("source_id", *PROPERTY, "value").join(asserters, [*PROPERTY, "value"])
    pairs = _compared(rare, F.sum(F.when(F.col("_va") == F.col("_vb"), 1.0 / F.col("_n")).otherwise(0.0)).alias("_rarity"))
    mean = F.when(F.col("matches") > 0, F.col("_rarity") / F.col("matches")).otherwise(0.0)
    pairs = pairs.withColumn("average_rarity", mean).withColumn("inclusion", F.col("matches") / F.least("size_a", "size_b"))
    redundancy, independence = dependence_scores(F.col("inclusion"), F.col("average_rarity"))
    return pairs.withColumn("redundancy", redundancy).withColumn("independence", independence).select(
        "source_a", "source_b", "matches", "disagreements", "inclusion", "average_rarity", "redundancy", "independence"
    )


def inspect_pair(first: DataFrame, second: DataFrame) -> DataFrame:
    """Property by property, the values of two sources: ``MATCH`` if value and unit are equal (no unit equals no unit), else ``DISAGREE``.

    Inputs hold one ``value, unit`` per property; properties of one side only are left out. ``text_a`` and
    ``text_b`` show the value with its unit, if it has one.
    """
    a = first.select(*PROPERTY, F.col("value").alias("value_a"), F.col("unit").alias("unit_a"))
    b = second.select(*PROPERTY, F.col("value").alias("value_b"), F.col("unit").alias("unit_b"))
    same = (F.col("value_a") == F.col("value_b")) & F.col("unit_a").eqNullSafe(F.col("unit_b"))
    shown = lambda s: F.concat_ws(" ", f"value_{s}", F.nullif(F.col(f"unit_{s}"), F.lit(""))).alias(f"text_{s}")
    joined = a.join(b, PROPERTY)
    return joined.select(*PROPERTY, F.when(same, "MATCH").otherwise("DISAGREE").alias("verdict"), shown("a"), shown("b"))


def inspect_domains(sources: DataFrame, assertions: DataFrame, domain_a: str, domain_b: str) -> DataFrame:
    """``inspect_pair`` of two sources by domain, in order of product and attribute; an unknown domain is a ``ValueError``.

    ``assertions`` has one ``value, unit`` per source and property.
    """
    first, second = (readers.source_rows(assertions, readers.lookup_source(sources, d)) for d in (domain_a, domain_b))
    return inspect_pair(first, second).orderBy(*PROPERTY)


def inspect_totals(listing: DataFrame) -> DataFrame:
    return listing.agg(
        F.count_if(F.col("verdict") == "MATCH").alias("matches"), F.count_if(F.col("verdict") == "DISAGREE").alias("disagreements")
    )
