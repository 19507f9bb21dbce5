"""The general record-preparation queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.buckets import Buckets
from claimloom.functions import attributes
from claimloom.operators import orphans, units, widen
from claimloom.session import table

REFERENCES = (
    ("source_claims", "claim_id", "claims", "claim_id"),
    ("assertions", "source_id", "sources", "source_id"),
)


def _orphan_tables(spark: SparkSession, sf: str) -> list[tuple[str, Buckets]]:
    """The orphan state of both tables, from batches by year of arrival; the two are worked on side by side."""

    def state(name: str, key: str, parent: str, parent_key: str) -> tuple[str, Buckets]:
        refs = orphans.references(table(spark, sf, name), "row_id", key, "ingested_at")
        stays = orphans.parent_stays(table(spark, sf, parent), parent_key)
        return name, orphans.replay(Buckets.scratch(spark), refs, stays)

    with ThreadPoolExecutor(len(REFERENCES)) as pool:
        return [f.result() for f in [pool.submit(state, *r) for r in REFERENCES]]


def _arrived(spark: SparkSession, sf: str) -> DataFrame:
    """``ref_table, row_id, opened_at`` of the references that found no parent when they arrived."""
    parts = [
        orphans.episodes(t).filter("on_arrival").select(F.lit(n).alias("ref_table"), "row_id", "opened_at") for n, t in _orphan_tables(spark, sf)
    ]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _arrived(spark, sf).select("ref_table", "row_id")


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """References that pointed nowhere on arrival, by table and month."""
    monthly = _arrived(spark, sf).groupBy("ref_table", F.date_trunc("month", "opened_at").alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
    return monthly.select("ref_table", F.date_format("month", "yyyy-MM").alias("month"), "orphans")


def p1_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes opened, closed and pending at each month's end, by table."""
    parts = [orphans.snapshots(orphans.episodes(t), n) for n, t in _orphan_tables(spark, sf)]
    return parts[0].unionByName(parts[1]).withColumn("month", F.date_format("month", "yyyy-MM"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "source_claims").select("row_id", "product_id", "canonical_attribute", "value_string", "value_numeric")
    return widen.empty_cells(widen.widen(rows, table(spark, sf, "attribute_defs")))


def p2_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One typed row per product, measured attributes in their common units."""
    columns = ("row_id", "product_id", "canonical_attribute", "value_string", "value_numeric")
    defs = table(spark, sf, "attribute_defs")
    rows = table(spark, sf, "source_claims").select(*columns, "unit")
    measured = [d["key"] for d in attributes.read_definitions(defs) if d["unit"] is not None]
    is_measured = F.coalesce(attributes.attribute_key(F.col("canonical_attribute")).isin(*measured), F.lit(False))
    named = rows.withColumn("value_string", F.when(~is_measured, F.col("value_string"))).withColumn(
        "value_numeric", F.when(~is_measured, F.col("value_numeric"))
    )
    converted = units.normalise(rows, defs).select(
        "row_id", "product_id", "canonical_attribute", F.lit(None).cast("string").alias("value_string"),
        F.round("common_value", 6).alias("value_numeric"),
    )
    wide = widen.widen(named.select(*columns).unionByName(converted), defs)
    return wide.withColumn("empty_columns", F.array_join("empty_columns", ","))


def _quantities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "source_claims").select("row_id", "canonical_attribute", "value_string", "value_numeric", "unit")
    return units.normalise(rows, table(spark, sf, "attribute_defs"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _quantities(spark, sf).filter("converted").select("row_id")


def p3_common(spark: SparkSession, sf: str) -> DataFrame:
    """Every quantity in its attribute's common unit, with how its unit was known."""
    return _quantities(spark, sf).select(
        "row_id", "attribute", "number", "unit_key", "common_unit", "common_value", "converted", "assigned", "posterior", "uncertain"
    )


_ORPHANS = """
SELECT 'source_claims' AS ref_table, r.row_id, r.ingested_at FROM source_claims r
WHERE r.claim_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claims p WHERE p.claim_id = r.claim_id
  AND p.loaded_at <= r.ingested_at AND (p.deleted_at IS NULL OR p.deleted_at > r.ingested_at))
UNION ALL
SELECT 'assertions', r.row_id, r.ingested_at FROM assertions r
WHERE r.source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sources p WHERE p.source_id = r.source_id
  AND p.loaded_at <= r.ingested_at AND (p.deleted_at IS NULL OR p.deleted_at > r.ingested_at))
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_snapshots, p2_found, p2_wide, p3_found, p3_common)}

_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_STAND_INS = ", ".join("'" + w.replace("'", "''") + "'" for w in attributes.STAND_INS)
_NUMBER_TEXT = "regexp_extract(value_string, '[0-9]([0-9.,]*[0-9])?')"
_USABLE = f"""CASE WHEN d.value_type = 'number' THEN coalesce(value_numeric > 0 AND NOT isnan(value_numeric) AND NOT isinf(value_numeric), false)
  OR coalesce(regexp_matches({_NUMBER_TEXT}, '[1-9]') AND NOT regexp_matches(value_string, '^[^a-zA-Z0-9]*[-−] ?[0-9]'), false)
ELSE coalesce(regexp_matches(value_string, '[\\p{{L}}\\p{{N}}]') AND lower(trim(value_string)) NOT IN ({_STAND_INS}), false) END"""



def _snapshots(name: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{name}' AS ref_table, strftime(month, '%Y-%m') AS month, opened, closed, (sum(opened - closed) OVER (ORDER BY month))::BIGINT AS pending FROM (
WITH st AS (SELECT {parent_key} AS k, loaded_at AS l, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS e FROM {parent}
  WHERE {parent_key} IS NOT NULL AND loaded_at IS NOT NULL AND (deleted_at IS NULL OR deleted_at > loaded_at)),
sn AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM st),
gp AS (SELECT k, b AS f, l AS t FROM sn WHERE b IS NULL OR b < l UNION ALL SELECT k, max(e), NULL FROM st GROUP BY k HAVING max(e) < TIMESTAMP '9999-12-31'),
rf AS (SELECT {key} AS k, ingested_at AS t FROM {name} WHERE {key} IS NOT NULL AND ingested_at IS NOT NULL),
ep AS (SELECT rf.t AS o, gp.t AS c FROM rf LEFT JOIN gp ON gp.k = rf.k AND (gp.f IS NULL OR gp.f <= rf.t) AND (gp.t IS NULL OR gp.t > rf.t)
  WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.k = rf.k AND st.l <= rf.t AND st.e > rf.t)
  UNION ALL SELECT gp.f, gp.t FROM rf JOIN gp ON gp.k = rf.k AND gp.f > rf.t)
SELECT month, sum(a)::BIGINT AS opened, sum(z)::BIGINT AS closed FROM (SELECT date_trunc('month', o) AS month, 1 AS a, 0 AS z FROM ep
  UNION ALL SELECT date_trunc('month', c), 0, 1 FROM ep WHERE c IS NOT NULL) GROUP BY month)"""


#: Rows whose quantity is not in the common unit: units by spelling, unstated ones by size bounds read off these tables.
_CONVERTED = f"""WITH r AS (SELECT row_id, {_KEY.format("canonical_attribute")} AS a, lower(value_string) AS x, unit,
  CASE WHEN value_numeric > 0 AND NOT isnan(value_numeric) AND NOT isinf(value_numeric) THEN value_numeric END AS v FROM source_claims),
q AS (SELECT *, regexp_extract(x, '[0-9]([0-9.,]*[0-9])?') AS tok, regexp_extract(x, '[0-9]([0-9.,]*[0-9])? *-? *([a-z]+|"|″)', 2) AS w,
  regexp_replace(lower(unit), '[. ]', '', 'g') AS u FROM r WHERE a IN ('ramgb', 'storagegb', 'screensize', 'batterylifehr', 'weightlb')),
n AS (SELECT *, coalesce(v > 0, regexp_matches(tok, '[1-9]') AND NOT regexp_matches(x, '^[^a-z0-9]*[-−] ?[0-9]')) AS usable,
  CASE WHEN w IN ('mb', 'mbyte', 'megabytes', 'tb', 'tbyte', 'terabyte', 'cm', 'centimetres', 'mm', 'millimeter', 'min', 'mins', 'minutes', 's', 'kg', 'kgs', 'kilo',
    'kilograms', 'g', 'gramm', 'grams', 'oz', 'ounces') THEN 'other'
  WHEN w IN ('gb', 'gbyte', 'gigabyte', 'gigabytes', 'in', 'inch', 'inches', 'zoll', '"', '″', 'h', 'hr', 'hrs', 'hours', 'std', 'heures', 'lb', 'lbs', 'pounds') THEN 'common'
  WHEN u IN ('mb', 'mbyte', 'megabytes', 'tb', 'tbyte', 'terabyte', 'cm', 'centimetres', 'mm', 'millimeter', 'min', 'mins', 'minutes', 's', 'kg', 'kgs', 'kilo',
    'kilograms', 'g', 'gramm', 'grams', 'oz', 'ounces') THEN 'other' WHEN u IS NOT NULL THEN 'common' END AS k FROM q)
SELECT row_id FROM n WHERE usable AND (k = 'other' OR (v IS NULL AND regexp_matches(x, '[0-9]:[0-9]+ *h:min'))
  OR (v IS NULL AND regexp_matches(x, '(lbs?|h|hours?)[., ]*[1-9][0-9]* *(oz|ounces|min|minutes)'))
  OR (k IS NULL AND CASE a WHEN 'ramgb' THEN v >= 1024 WHEN 'storagegb' THEN v <= 16 OR v >= 65536 WHEN 'screensize' THEN v > 25 WHEN 'batterylifehr' THEN v > 60 ELSE v > 50 END))"""

SQL = {
    "p1_snapshots": " UNION ALL ".join(f"(SELECT * FROM ({_snapshots(*r)}))" for r in REFERENCES),
    "p3_found": _CONVERTED,
    "p2_found": f"""SELECT product_id, d.attribute FROM source_claims s JOIN attribute_defs d
ON {_KEY.format("s.canonical_attribute")} = {_KEY.format("d.attribute")} WHERE product_id IS NOT NULL
GROUP BY ALL HAVING NOT bool_or({_USABLE})""",
    "p1_found": f"SELECT ref_table, row_id FROM ({_ORPHANS})",
    "p1_counts": f"SELECT ref_table, strftime(ingested_at, '%Y-%m') AS month, count(*) AS orphans FROM ({_ORPHANS}) GROUP BY ALL",
}
