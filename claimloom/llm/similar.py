"""All similar pairs between set-valued records: minwise signatures, bands, exact verification.

Sets that are equal are one class (a 128-bit order-free fingerprint and the size), so copies cost one
signature and no candidates among themselves. Each class gets ``bands * rows`` minwise hashes; classes
that share the hashes of any band are candidates, unless two bits of each hash tell that they are far
below the threshold; the exact Jaccard of the candidates, once each, is then counted.
A pair at the threshold is missed with probability ``(1 - threshold ** rows) ** bands``: below 2e-6
for 20 bands of 2 at 0.7. A set that holds a large share of all elements is split by element before
hashing, and the partial minima are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut

BANDS = 20
ROWS = 2
#: A set larger than this is split by element into parts of about this size.
PART = 50_000


@dataclass
class SimilarSets:
    """``classes``: set_id, class_id, size; ``links``: class_a < class_b, common, jaccard (between classes only)."""

    classes: DataFrame
    links: DataFrame


def distinct_elements(rows: DataFrame, set_id: str, element: str) -> DataFrame:
    return rows.select(F.col(set_id).alias("set_id"), F.col(element).alias("element")).dropna().distinct()


def _classes(elements: DataFrame, min_size: int) -> DataFrame:
    """Sets of at least ``min_size`` elements with their class: the smallest id among equal sets."""
    # partial sums are merged, so a set of any size is never in one task
    prints = elements.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("element").cast("decimal(20,0)")).alias("f1"),
        F.bit_xor(F.xxhash64(F.lit(7), F.col("element"))).alias("f2"),
    )
    kept = prints.filter(F.col("size") >= min_size)
    named = kept.groupBy("size", "f1", "f2").agg(F.min("set_id").alias("class_id"))
    return kept.join(named, ["size", "f1", "f2"]).select("set_id", "class_id", "size")


def _signatures(elements: DataFrame, heads: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per class and band: ``class_id, size, low, high, band, bucket``; ``low`` and ``high`` hold two bits of up to 64 hashes."""
    parts = F.when(F.col("size") > PART, F.pmod(F.hash("element"), F.ceil(F.col("size") / PART).cast("int"))).otherwise(0)
    placed = elements.join(heads, "set_id").withColumn("part", parts).repartition("set_id", "part")
    minima = [F.min(F.hash(F.lit(i), F.col("element"))).alias(f"m{i}") for i in range(bands * rows)]
    partial = placed.groupBy("set_id", "part").agg(F.max("size").alias("size"), *minima)  # on the partitioning just made
    whole = partial.groupBy("set_id").agg(F.max("size").alias("size"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(bands * rows)])
    banded = F.array(*[F.xxhash64(*[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)])
    n = min(bands * rows, 64)
    bits = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.shiftright(f"m{i}", b).bitwiseAND(F.lit(1)).cast("bigint"), i) for i in range(n)]) for b in (0, 1)]
    named = whole.select(F.col("set_id").alias("class_id"), "size", bits[0].alias("low"), bits[1].alias("high"), banded.alias("_b"))
    return named.select("class_id", "size", "low", "high", F.posexplode("_b").alias("band", "bucket"))


def fewest_alike(n: int, threshold: float, miss: float = 1e-7) -> int:
    """The most bit pairs, of ``n``, that a pair at the threshold falls short of with probability under ``miss``.

    Two bits agree where the hashes do, and by chance in a quarter of the other cases.
    """
    p, below = threshold + (1 - threshold) / 4, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > miss:
            return k
    return n


def candidate_pairs(banded: DataFrame, hashes: int, threshold: float) -> DataFrame:
    """``class_a < class_b, size_a, size_b``, once each, of classes that share a bucket of a band and may reach the threshold.

    ``banded`` is ``class_id, size, low, high, band, bucket``. Sizes too far apart and bits that agree too seldom rule a pair out.
    """
    side = lambda s: banded.select(*[F.col(c).alias(f"{c.removesuffix('_id')}_{s}") for c in ("class_id", "size", "low", "high")], "band", "bucket")
    n = min(hashes, 64)
    unlike = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b")).bitwiseOR(F.col("high_a").bitwiseXOR(F.col("high_b"))))
    near = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * (threshold - 1e-9)
    met = side("a").join(side("b"), ["band", "bucket"]).filter((F.col("class_a") < F.col("class_b")) & near & (unlike <= n - fewest_alike(n, threshold)))
    return met.select("class_a", "class_b", "size_a", "size_b").distinct()


def similar_sets(
    elements: DataFrame, threshold: float = 0.7, min_size: int = 1, bands: int = BANDS, rows: int = ROWS
) -> SimilarSets:
    """Link all sets whose Jaccard similarity is at least ``threshold``.

    ``elements`` holds ``set_id, element`` (see ``distinct_elements``; nulls and repeats already gone).
    Sets below ``min_size`` take no part. Every set of a class is equal, hence similar to the others
    at 1.0; links join different classes only. An empty table gives empty results.
    """
    elements = cut(elements)
    classes = cut(_classes(elements, min_size))
    heads = classes.filter(F.col("set_id") == F.col("class_id")).select("set_id", "size")
    banded = cut(_signatures(elements, heads, bands, rows))
    candidates = cut(candidate_pairs(banded, bands * rows, threshold))
    asked = candidates.select(F.col("class_a").alias("set_id")).unionByName(candidates.select(F.col("class_b").alias("set_id"))).distinct()
    members = elements.join(asked, "set_id", "left_semi")
    first = members.select(F.col("set_id").alias("class_a"), "element")
    second = members.select(F.col("set_id").alias("class_b"), "element")
    common = candidates.join(first, "class_a").join(second, ["class_b", "element"]).groupBy("class_a", "class_b", "size_a", "size_b")
    links = common.agg(F.count(F.lit(1)).alias("common")).withColumn("union", F.col("size_a") + F.col("size_b") - F.col("common"))
    links = links.withColumn("jaccard", F.col("common") / F.col("union")).filter(F.col("common") >= F.col("union") * F.lit(threshold) - 1e-9)
    return SimilarSets(classes, links.select("class_a", "class_b", "common", "jaccard"))


def pairs(result: SimilarSets) -> DataFrame:
    """Every similar pair of sets, ``set_a < set_b``: equal sets, and the members of linked classes."""
    m = result.classes.select("set_id", "class_id")
    one, two = m.select(F.col("set_id").alias("x"), "class_id"), m.select(F.col("set_id").alias("y"), "class_id")
    equal = one.join(two, "class_id").filter("x < y").select("x", "y")
    first = one.withColumnRenamed("class_id", "class_a")
    second = two.withColumnRenamed("class_id", "class_b")
    linked = result.links.join(first, "class_a").join(second, "class_b").select("x", "y")
    every = equal.unionByName(linked)
    return every.select(F.least("x", "y").alias("set_a"), F.greatest("x", "y").alias("set_b"))


def memberships(result: SimilarSets) -> DataFrame:
    """One row per set: ``set_id, class_id, size, n_links`` where links count similar sets, equal ones included."""
    sizes = result.classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    both = result.links.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(
        result.links.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other"))
    )
    others = both.join(sizes.select(F.col("class_id").alias("other"), F.col("n").alias("n_other")), "other")
    linked = others.groupBy("class_id").agg(F.sum("n_other").alias("linked"))
    joined = result.classes.join(sizes, "class_id").join(linked, "class_id", "left")
    return joined.select("set_id", "class_id", "size", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
