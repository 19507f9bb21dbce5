"""Raw source claims to canonical claim nodes: vocabulary, value, canonical form, hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import attributes as A

#: The attributes of the claim graph.
VOCABULARY = (
    "ram_gb", "storage_gb", "cpu_model", "cpu_cores", "gpu_model", "wifi_standard", "bluetooth_version",
    "display_resolution", "screen_size", "battery_life_hr", "weight_lb", "operating_system", "touchscreen",
)

Rule = Callable[[Column], Column]


def bluetooth_version(value: Column) -> Column:
    """``Bluetooth 5.3``, ``BT 5.3`` and ``Version 5.3`` are one value."""
    return F.nullif(F.regexp_extract(value, "(\\d+(?:\\.\\d+)?)", 1), F.lit(""))


def folded(value: Column) -> Column:
    return F.lower(A.trimmed(value))


#: A sample registry. A rule gives null for a value it rejects; attributes without a rule keep their value as it is.
RULES: dict[str, Rule] = {"bluetooth_version": bluetooth_version, "wifi_standard": folded, "touchscreen": folded}


def filter_vocabulary(rows: DataFrame, vocabulary: tuple[str, ...] = VOCABULARY, attribute: str = "canonical_attribute") -> DataFrame:
    """Rows of the given attributes, by exact name; rows without an attribute are dropped. The filter reaches the scan."""
    return rows.filter(F.col(attribute).isin(*vocabulary))


def raw_value(numeric: str = "value_numeric", text: str = "value_string") -> Column:
    """The number as text where there is one, else the text."""
    return F.coalesce(F.col(numeric).cast("string"), F.col(text))


def canonical_value(attribute: Column, value: Column, rules: dict[str, Rule] | None = None, reject_stand_ins: bool = True) -> Column:
    """One CASE over the registry; stand-ins for "no answer" are rejected (null) unless told otherwise."""
    expression: Column | None = None
    for name, rule in (RULES if rules is None else rules).items():
        branch = (attribute == name, rule(value))
        expression = F.when(*branch) if expression is None else expression.when(*branch)
    chosen = value if expression is None else expression.otherwise(value)
    return F.when(~A.is_stand_in(value), chosen) if reject_stand_ins else chosen


def canonicalise(rows: DataFrame, rules: dict[str, Rule] | None = None, reject_stand_ins: bool = True) -> DataFrame:
    """Adds ``raw_value`` and ``value``; ``value`` is null for rows to be skipped."""
    valued = rows.withColumn("raw_value", raw_value())
    return valued.withColumn("value", canonical_value(F.col("canonical_attribute"), F.col("raw_value"), rules, reject_stand_ins))


def claim_hash() -> Column:
    """SHA-256 of ``product|attribute|value|unit`` with ``None`` for a missing part."""
    parts = [F.coalesce(F.col(c), F.lit("None")) for c in ("product_id", "canonical_attribute", "value", "unit")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def claim_nodes(canonical: DataFrame) -> DataFrame:
    """Distinct (claim_hash, source_id) of the rows with a value."""
    kept = canonical.filter(F.col("value").isNotNull() & F.col("source_id").isNotNull())
    return kept.select(claim_hash().alias("claim_hash"), "source_id").distinct()


def skipped_claims(canonical: DataFrame) -> DataFrame:
    """Rejected rows per attribute."""
    return canonical.filter(F.col("value").isNull()).groupBy("canonical_attribute").agg(F.count(F.lit(1)).alias("skipped"))


def skipped_examples(canonical: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` distinct rejected raw values per attribute, in order."""
    rejected = canonical.filter(F.col("value").isNull() & F.col("raw_value").isNotNull())
    distinct = rejected.select("canonical_attribute", "raw_value").distinct()
    rank = F.row_number().over(Window.partitionBy("canonical_attribute").orderBy("raw_value"))
    return distinct.withColumn("rank", rank).filter(F.col("rank") <= n)


def raw_claims(rows: DataFrame) -> DataFrame:
    """Distinct claims per source as told, where the number 16 is another value than the text 16."""
    text = F.when(F.col("value_numeric").isNull(), F.col("value_string")).alias("value_string")
    return rows.select("source_id", "product_id", "canonical_attribute", "value_numeric", text, "unit").distinct()
