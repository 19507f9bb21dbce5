"""The queries of this subpackage over the test tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.buckets import Buckets
from claimloom.functions import attributes as A
from claimloom.llm import consensus, leaks, mapping, packing, sentences, similar, together
from claimloom.session import spread, table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "source_claims").select("row_id", "canonical_attribute", "value_string")
    return mapping.map_rows(rows, table(spark, sf, "value_list"))


LABELLED = ("wifi_standard", "bluetooth_version", "touchscreen")


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "source_claims").select("source_id", "product_id", "canonical_attribute", "value_string")
    key = A.attribute_key(F.col("canonical_attribute"))
    names = {"".join(c for c in a if c.isalnum()): a for a in LABELLED}
    return rows.withColumn("_key", key).filter(F.col("_key").isin(*names)).select(
        F.col("source_id").alias("source"), A.by_key(F.col("_key"), names, "string").alias("task"), F.col("product_id").alias("item"),
        F.lower(A.usable_text(F.col("value_string"))).alias("label"),
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    labels = consensus.consensus_labels(consensus.estimate(_votes(spark, sf)))
    return labels.filter("n_sources >= 3 AND n_labels >= 2").select(F.col("item").alias("product_id"), F.col("task").alias("attribute"), "label")


def p5_reliability(spark: SparkSession, sf: str) -> DataFrame:
    result = consensus.estimate(_votes(spark, sf))
    return result.annotators.select(F.col("source").alias("source_id"), "skill", "reliability", "n_labels")


def p5_agreement(spark: SparkSession, sf: str) -> DataFrame:
    votes = _votes(spark, sf).dropna().distinct()
    return consensus.agreement(votes).select("task", "n_votes", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")])


def _claim_sets(spark: SparkSession, sf: str) -> DataFrame:
    return similar.distinct_elements(table(spark, sf, "assertions"), "source_id", "claim_id")


def _similar_sources(spark: SparkSession, sf: str) -> similar.SimilarSets:
    return similar.similar_sets(_claim_sets(spark, sf), threshold=0.7, min_size=5)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = similar.pairs(_similar_sources(spark, sf))
    return found.select(F.col("set_a").alias("source_id_a"), F.col("set_b").alias("source_id_b"))


def p6_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One row per source of at least 5 claims: its class of equal sets and its number of similar sources."""
    return similar.memberships(_similar_sources(spark, sf)).select(F.col("set_id").alias("source_id"), "class_id", "size", "n_links")


def _claim_pairs(spark: SparkSession, sf: str, starts: list[str] | None = None) -> Buckets:
    """Claims of one source, from batches by year of arrival (or cut at ``starts``)."""
    rows = table(spark, sf, "assertions").select(F.col("source_id").alias("basket"), F.col("claim_id").alias("item"), "ingested_at")
    return together.replay(together.state(spark, min_support=6), rows, "ingested_at", starts)


def _strong(tables: Buckets) -> DataFrame:
    return together.associations(tables).filter(F.col("n_ab") * F.col("n_baskets") >= 4 * F.col("n_a") * F.col("n_b"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _strong(_claim_pairs(spark, sf))
    return found.select(F.col("item_a").alias("claim_id_a"), F.col("item_b").alias("claim_id_b"))


def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of claims with at least 6 common sources, with its counts and lift."""
    found = together.associations(_claim_pairs(spark, sf))
    return found.select(
        F.col("item_a").alias("claim_id_a"), F.col("item_b").alias("claim_id_b"), "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 9).alias("lift")
    )


def p7_two_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same from two batches: what was ingested before 2024, then the rest as deltas."""
    found = together.associations(_claim_pairs(spark, sf, ["2024-01-01 00:00:00"]))
    return found.select(F.col("item_a").alias("claim_id_a"), F.col("item_b").alias("claim_id_b"), "n_ab", "n_a", "n_b", "n_baskets")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every post or piece, in tokens of a public tokenizer."""
    return packing.pack_documents(spread(table(spark, sf, "documents").select("doc_id", "text", "source")))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """How each leak was found and how long it is."""
    return _leaks(spark, sf)


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that stay once affected ones are removed."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return leaks.remove_leaks(docs, _leaks(spark, sf))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(spread(table(spark, sf, "documents").select("doc_id", "text")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).select("doc_id", "start_char")


def p10_units(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf)


_SETS = "e AS (SELECT DISTINCT source_id AS s, claim_id AS c FROM assertions WHERE source_id IS NOT NULL AND claim_id IS NOT NULL)"
_SIMILAR = f"""WITH {_SETS}, n AS (SELECT s, count(*) AS n FROM e GROUP BY s HAVING count(*) >= 5),
p AS (SELECT x.s AS a, y.s AS b, count(*) AS m FROM e x JOIN e y ON x.c = y.c AND x.s < y.s GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.s = p.a JOIN n y ON y.s = p.b WHERE p.m * 10 >= 7 * (x.n + y.n - p.m))"""
_PAIRS = f"""WITH {_SETS}, i AS (SELECT c, count(*) AS n FROM e GROUP BY c HAVING count(*) >= 6), f AS (SELECT e.* FROM e JOIN i USING (c)),
big AS (SELECT s FROM f GROUP BY s HAVING count(*) > 1000),
lo AS (SELECT x.c AS a, y.c AS b, count(*) AS m FROM f x JOIN f y ON x.s = y.s AND x.c < y.c WHERE x.s NOT IN (FROM big) GROUP BY ALL),
hi AS (SELECT a, b, (SELECT count(*) FROM big) AS k, m FROM lo),
t AS (SELECT a, b, m + (SELECT count(*) FROM f x JOIN f y ON x.s = y.s WHERE x.s IN (FROM big) AND x.c = hi.a AND y.c = hi.b) AS m FROM hi WHERE m + k >= 6),
r AS (SELECT a AS claim_id_a, b AS claim_id_b, m AS n_ab, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT s) FROM e) AS n_baskets
      FROM t JOIN i x ON x.c = a JOIN i y ON y.c = b WHERE m >= 6)"""

QUERIES = {
    f.__name__: f
    for f in (p4_found, p5_found, p5_reliability, p5_agreement, p6_found, p6_sources, p7_found, p7_pairs, p7_two_batches, p8_containers, p8_fill, p9_found, p9_leaks, p9_clean, p10_found, p10_units)
}

_VOTES = f"""v AS (SELECT DISTINCT source_id AS s, CASE regexp_replace(lower(canonical_attribute), '[^a-z0-9]', '', 'g') WHEN 'wifistandard' THEN 'wifi_standard'
  WHEN 'bluetoothversion' THEN 'bluetooth_version' WHEN 'touchscreen' THEN 'touchscreen' END AS t, product_id AS i, lower(trim(value_string)) AS l FROM source_claims
  WHERE regexp_matches(value_string, '[\\p{{L}}\\p{{N}}]') AND lower(trim(value_string)) NOT IN ({", ".join("'" + w + "'" for w in A.STAND_INS)})),
d AS (SELECT * FROM v WHERE s IS NOT NULL AND t IS NOT NULL AND i IS NOT NULL)"""

SQL: dict[str, str] = {
    "p5_agreement": f"""WITH {_VOTES}, c AS (SELECT t, i, l, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY t, i) AS m FROM c),
        b AS (SELECT t, l, sum(n) AS n, sum(n * (n - 1) / (m - 1)::DOUBLE) AS g FROM p WHERE m > 1 GROUP BY ALL),
        z AS (SELECT t, sum(n)::BIGINT AS n, sum(g) AS g, sum(n * (n - 1)) AS e FROM b GROUP BY t)
        SELECT t AS task, n AS n_votes, round(g / n, 9) AS observed, round(e / (n * (n - 1))::DOUBLE, 9) AS expected,
        round(1 - (1 - g / n) / (1 - e / (n * (n - 1))::DOUBLE), 9) AS alpha FROM z""",
    "p6_sources": f"""{_SIMILAR}, k AS (SELECT s, count(*) AS size, string_agg(c, ',' ORDER BY c) AS f FROM e GROUP BY s HAVING count(*) >= 5),
        m AS (SELECT s, min(s) OVER (PARTITION BY f) AS class_id, size FROM k), w AS (SELECT a AS s FROM l UNION ALL SELECT b FROM l)
        SELECT s AS source_id, class_id, size, (SELECT count(*) FROM w WHERE w.s = m.s) AS n_links FROM m""",
    "p6_found": f"{_SIMILAR} SELECT a AS source_id_a, b AS source_id_b FROM l",
    "p7_found": f"{_PAIRS} SELECT claim_id_a, claim_id_b FROM r WHERE n_ab * n_baskets >= 4 * n_a * n_b",
    "p7_pairs": f"{_PAIRS} SELECT *, round(n_ab * n_baskets / (n_a * n_b)::DOUBLE, 9) AS lift FROM r",
    "p7_two_batches": f"{_PAIRS} SELECT * FROM r",
}
