"""Random walks source -> claim -> source: exact expected visits, and many seeded walkers at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators import propagate
from claimloom.session import cut, discard

STEPS_A_PLAN = 8
_PRIME, _FACTOR = 2147483647, 48271


def expected_visits(edges: DataFrame, start: int, steps: int) -> DataFrame:
    """``source_id, visits``: expected visits within ``steps`` steps from ``start``, the start included.

    A walker picks a claim of its source, then a source of that claim, each with equal chance, and may
    come back to where it was. A walk from a source without claims ends at once: its start is its one visit.
    """
    rounds = propagate.ready(propagate.prepare(edges, source_combine="claim_split"))
    now = edges.sparkSession.range(1).select(F.lit(start).cast("bigint").alias("source_id"), F.lit(1.0).alias("score"))
    seen = [now]
    for k in range(steps):
        now = propagate.source_step(rounds, propagate.claim_step(rounds, now))
        if (k + 1) % STEPS_A_PLAN == 0 and k + 1 < steps:
            now = cut(now)
            seen = [_folded(seen, F.sum("score"), "score")]
        seen.append(now)
    return _together(seen, F.sum("score"), "visits")


def _together(seen: list[DataFrame], count: Column, name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, seen).groupBy("source_id").agg(count.alias(name))


def _folded(seen: list[DataFrame], count: Column, name: str) -> DataFrame:
    """The visits so far, written, so that the plan does not grow with the walk."""
    after = cut(_together(seen, count, name))
    discard(seen[0])
    return after


def _draw(walker, step: int, seed: int):
    """A number from (walker, step, seed), the same in every engine and under any partitioning."""
    mixed = walker
    for add in (seed, step, 7919):
        mixed = ((mixed + add) * _FACTOR) % _PRIME
    return mixed


def random_walks(edges: DataFrame, start: int, walkers: int, steps: int, seed: int = 1) -> DataFrame:
    """``source_id, visits`` counted over ``walkers`` independent walks, each visit and every start counted.

    Every step is two equi-joins of all walkers with the numbered edges, so no task holds the graph.
    """
    numbered = cut(
        edges.select(
            "source_id",
            "claim_id",
            (F.row_number().over(Window.partitionBy("source_id").orderBy("claim_id")) - 1).cast("bigint").alias("at_source"),
            (F.row_number().over(Window.partitionBy("claim_id").orderBy("source_id")) - 1).cast("bigint").alias("at_claim"),
        )
    )
    source_n = cut(edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("_d")))
    claim_n = cut(edges.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_a")))
    spark = edges.sparkSession
    at = spark.range(walkers).select(F.col("id").alias("walker"), F.lit(start).cast("bigint").alias("source_id"))
    one = lambda rows: rows.select("source_id", F.lit(1).cast("bigint").alias("n"))
    seen = [one(at)]
    for step in range(steps):
        out = at.join(source_n, "source_id").select("walker", "source_id", (_draw(F.col("walker"), 2 * step, seed) % F.col("_d")).alias("at_source"))
        claim = out.join(numbered.select("source_id", "at_source", "claim_id"), ["source_id", "at_source"]).join(claim_n, "claim_id")
        back = claim.select("walker", "claim_id", (_draw(F.col("walker"), 2 * step + 1, seed) % F.col("_a")).alias("at_claim"))
        at = back.join(numbered.select("claim_id", "at_claim", "source_id"), ["claim_id", "at_claim"]).select("walker", "source_id")
        if (step + 1) % STEPS_A_PLAN == 0 and step + 1 < steps:
            at = cut(at)
            seen = [_folded(seen, F.sum("n"), "n")]
        seen.append(one(at))
    return _together(seen, F.sum("n"), "visits")


def unvisited(sources: DataFrame, visits: DataFrame) -> DataFrame:
    return sources.join(visits.select("source_id"), "source_id", "left_anti")
