"""How many rows agree on the value of a property (product, attribute).

Group counts come from aggregation with map-side combine and are joined back to rows, so that a
property of very many rows is never one task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPERTY = ("product_id", "attribute")


def value_counts(rows: DataFrame) -> DataFrame:
    """``product_id, attribute, value, support, total`` per value of a property; rows are counted with repeats."""
    per_value = rows.groupBy(*PROPERTY, "value").agg(F.count(F.lit(1)).alias("support"))
    totals = per_value.groupBy(*PROPERTY).agg(F.sum("support").alias("total"))
    return _join(per_value, totals, list(PROPERTY))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys in which null equals null."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"_{k}"))
        condition = equal if condition is None else condition & equal
    return left.join(renamed, condition).drop(*[f"_{k}" for k in keys])


def agreement_edges(rows: DataFrame) -> DataFrame:
    """One row per input row with the support of its value, the property's total and the share ``weight``."""
    joined = _join(rows, value_counts(rows), [*PROPERTY, "value"])
    return joined.withColumn("weight", F.col("support") / F.col("total"))


def agreement_weights(values: DataFrame, claims: DataFrame, order: str) -> DataFrame:
    """``source_id, claim_id, weight``: the share of rows of the claim's property that hold the same value.

    ``values`` has source_id, claim_id, value; ``claims`` one row per claim_id with its property. Rows of
    unknown claims are left out. Of several rows of one source and claim the last by ``order`` counts.
    """
    rows = values.join(claims.select("claim_id", *PROPERTY), "claim_id")
    edges = agreement_edges(rows)
    picked = F.max(F.struct(F.col(order).alias("o"), F.col("weight").alias("w"))).alias("_last")
    return edges.groupBy("source_id", "claim_id").agg(picked).select("source_id", "claim_id", F.col("_last.w").alias("weight"))


def property_agreement(rows: DataFrame, min_support: int = 2) -> DataFrame:
    """Per property of at least ``min_support`` rows: ``support``, ``largest``, ``agreement`` and the ``counts`` by value, largest first, then by value."""
    per_value = rows.groupBy(*PROPERTY, "value").agg(F.count(F.lit(1)).alias("n"))
    grouped = per_value.groupBy(*PROPERTY).agg(
        F.sum("n").alias("support"),
        F.max("n").alias("largest"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value"))).alias("_by_count"),  # one entry per distinct value
    )
    kept = grouped.filter(F.col("support") >= min_support)
    counts = F.map_from_entries(F.transform("_by_count", lambda x: F.struct(x["value"], -x["o"])))  # a map keeps the order of its entries
    return kept.select(*PROPERTY, "support", "largest", counts.alias("counts"), (F.col("largest") / F.col("support")).alias("agreement"))


def agreement_summary(properties: DataFrame) -> DataFrame:
    """Counts of properties in full agreement, in part, and in all."""
    perfect = F.col("largest") == F.col("support")
    return properties.agg(
        F.count_if(perfect).alias("perfect"), F.count_if(~perfect).alias("partial"), F.count(F.lit(1)).alias("total")
    )


def tenth(part: Column, whole: Column) -> Column:
    """``part / whole`` rounded to tenths as a double's shortest repr rounds: ties are decided by the double, not by the fraction.

    Only odd twentieths can tie; their doubles lie above or below the fraction, which fixes each result.
    """
    twentieths = part * 20
    odd = (twentieths % whole == 0) & ((twentieths / whole).cast("bigint") % 2 == 1)
    up = {1: 0.1, 3: 0.1, 5: 0.2, 7: 0.3, 9: 0.5, 11: 0.6, 13: 0.7, 15: 0.8, 17: 0.8, 19: 0.9}
    ties = F.try_element_at(F.create_map(*[F.lit(x) for k, v in up.items() for x in (k, v)]), (twentieths / whole).cast("int"))
    return F.when(odd, ties).otherwise(F.bround(part / whole, 1))


def distribution(rows: DataFrame, part: str, whole: str, bucket: str) -> DataFrame:
    """Rows per tenth of ``part / whole``."""
    return rows.groupBy(tenth(F.col(part), F.col(whole)).alias(bucket)).agg(F.count(F.lit(1)).alias("n"))


def remove_ambiguous(rows: DataFrame) -> DataFrame:
    """Rows of keys (source, product, attribute) that hold exactly one distinct value; null values in such keys stay.

    One distinct value means that the least equals the greatest, so no set is collected.
    """
    keys = ["source_id", *PROPERTY]
    single = rows.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).filter(F.col("_lo") == F.col("_hi"))
    return _join(rows, single.select(*keys), keys)


def ambiguous_count(rows: DataFrame) -> DataFrame:
    """Keys kept and keys removed by ``remove_ambiguous``."""
    single = rows.groupBy("source_id", *PROPERTY).agg((F.min("value") == F.max("value")).alias("_one"))
    return single.agg(F.count_if(F.coalesce("_one", F.lit(False))).alias("kept"), F.count_if(~F.coalesce("_one", F.lit(False))).alias("removed"))


def worst_agreement(properties: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` properties of least agreement; full agreement is left out."""
    partial = properties.filter(F.col("largest") != F.col("support"))
    return partial.orderBy("agreement", F.desc("support"), *PROPERTY).limit(n)


def weakest_edges(edges: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` rows of least weight; weight 1 is left out."""
    partial = edges.filter(F.col("support") != F.col("total"))
    return partial.orderBy("weight", F.desc("total"), *PROPERTY, "source_id", "value", *[c for c in ("row_id",) if c in edges.columns]).limit(n)
