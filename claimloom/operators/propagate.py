"""Credibility propagation between sources and claims.

One parameterised operator covers the family of rules. Per round a claim gets the sum of
``score * coefficient`` over its sources, where the coefficient holds everything that does not change
(edge weight, split by source degree) and is computed once; a source then gets the sum, the mean or the
claim-split sum over its claims. Scores are scaled to sum 1.

More than ``SMALL_EDGES`` edges are partitioned by claim once and kept (memory, then disk; lost parts are
made again from the written table), and scores of up to ``BROADCAST_SOURCES`` sources are sent to them.
The claim step and its join back then need no exchange, and a round moves only one partial score per source
and partition, whatever the number of edges. Fewer edges are quicker read again than kept.

Both steps are linear, so a fixed number of rounds is one lazy plan that is scaled once at the end.

Runs until convergence take hundreds of rounds. Their edges are packed by claim into blocks of numpy arrays
that stay with the executors, and the driver keeps the vector: a round is one job that sends the scores to
the blocks and brings back a partial score per source and task. With more than ``BROADCAST_SOURCES`` sources
they are rounds of joins, each vector written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut, discard

#: Rounds in one lazy plan; the vector is written in between, so plans stay small and sums stay finite.
ROUNDS_A_PLAN = 10
SMALL_EDGES = 20_000_000
#: A score row takes some 50 bytes in a broadcast table.
BROADCAST_SOURCES = 1_000_000
#: Edges in a block, on average.
BLOCK_EDGES = 1_000_000


@dataclass
class Propagation:
    """``scores``: source_id, score; ``support``: claim_id, support, from the scores before the last source step."""

    scores: DataFrame
    support: DataFrame
    iterations: int
    deltas: list[float] = field(default_factory=list)
    converged: bool = False

    def history(self) -> DataFrame:
        rows = [(i + 1, d) for i, d in enumerate(self.deltas)]
        return self.scores.sparkSession.createDataFrame(rows, "iteration int, delta double")


def prepare(edges: DataFrame, *, weights: DataFrame | None = None, split_by_source_degree: bool = True, source_combine: str = "sum") -> DataFrame:
    """Edges with what stays the same in all rounds: ``down`` for the claim step, ``up`` for the source step.

    A missing weight counts as 1. ``source_combine`` is ``sum``, ``mean`` or ``claim_split``.
    """
    if source_combine not in ("sum", "mean", "claim_split"):
        raise ValueError(f"unknown source step {source_combine!r}")
    degrees = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("_d"))
    joined = edges.select("source_id", "claim_id").join(degrees, "source_id")
    if weights is not None:
        joined = joined.join(weights.select("source_id", "claim_id", "weight"), ["source_id", "claim_id"], "left")
        weight = F.coalesce("weight", F.lit(1.0))
    else:
        weight = F.lit(1.0)
    down = weight / F.col("_d") if split_by_source_degree else weight
    if source_combine == "claim_split":
        claims = edges.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_a"))
        joined, up = joined.join(claims, "claim_id"), 1.0 / F.col("_a")
    else:
        up = 1.0 / F.col("_d") if source_combine == "mean" else F.lit(1.0)
    return joined.select("source_id", "claim_id", down.cast("double").alias("down"), up.cast("double").alias("up"))


def uniform(edges: DataFrame) -> DataFrame:
    """Equal scores for the sources with at least one assertion."""
    ids = edges.select("source_id").distinct()
    n = ids.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return ids.join(F.broadcast(n)).select("source_id", (1.0 / F.col("_n")).alias("score"))


def seeded(edges: DataFrame, seed: int = 1) -> DataFrame:
    """Scores drawn by a generator on the id, the same under any partitioning, scaled to sum 1."""
    prime = F.lit(2147483647)
    drawn = ((F.pmod("source_id", prime) * 48271 + seed * 69621) % prime * 48271) % prime + 1
    return normalise(edges.select("source_id").distinct().withColumn("score", drawn.cast("double")))


def normalise(scores: DataFrame) -> DataFrame:
    """Scores divided by their sum; unchanged where the sum is 0."""
    total = scores.agg(F.sum("score").alias("_t"))  # one row
    scaled = F.when(F.col("_t") == 0, F.col("score")).otherwise(F.col("score") / F.col("_t"))
    return scores.join(F.broadcast(total)).select("source_id", scaled.alias("score"))


@dataclass
class Rounds:
    """Prepared edges, written and ready for many rounds, and how scores get to them."""

    edges: DataFrame
    send: Callable[[DataFrame], DataFrame]
    written: DataFrame


def ready(prepared: DataFrame, small: int | None = None, broadcast_limit: int = BROADCAST_SOURCES) -> Rounds:
    written = cut(prepared)
    if written.count() <= (SMALL_EDGES if small is None else small):
        return Rounds(written, lambda scores: scores, written)
    n = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = written.repartition(n, "claim_id").persist(StorageLevel.MEMORY_AND_DISK)
    few = written.select("source_id").distinct().limit(broadcast_limit + 1).count() <= broadcast_limit
    return Rounds(kept, F.broadcast if few else lambda scores: scores, written)


def claim_step(rounds: Rounds, scores: DataFrame) -> DataFrame:
    joined = rounds.edges.select("source_id", "claim_id", "down").join(rounds.send(scores), "source_id")
    return joined.groupBy("claim_id").agg(F.sum(F.col("score") * F.col("down")).alias("support"))


def source_step(rounds: Rounds, support: DataFrame) -> DataFrame:
    joined = rounds.edges.select("source_id", "claim_id", "up").join(support, "claim_id")
    return joined.groupBy("source_id").agg(F.sum(F.col("support") * F.col("up")).alias("score"))


def max_difference(first: DataFrame, second: DataFrame) -> float:
    """The largest absolute difference of two vectors over the same sources; 0.0 if both are empty."""
    a, b = first.select("source_id", F.col("score").alias("_a")), second.select("source_id", F.col("score").alias("_b"))
    both = a.join(b, "source_id", "full")
    found = both.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("d"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n")).head()
    if found.n:
        raise ValueError("the vectors are over different sources")
    return found.d or 0.0


def run_fixed(rounds: Rounds, scores: DataFrame, iterations: int) -> Propagation:
    """A fixed number of rounds, lazily, scaled after each plan's worth of them."""
    support = claim_step(rounds, scores)
    for k in range(iterations):
        if k and k % ROUNDS_A_PLAN == 0:
            scores = cut(normalise(scores))
        support = claim_step(rounds, scores)
        scores = source_step(rounds, support)
    return Propagation(normalise(scores) if iterations else scores, support, iterations)


def _packed(edges: DataFrame, ids: np.ndarray) -> DataFrame:
    """Prepared edges in blocks, a claim in one block only: places of sources in ``ids``, first edges of claims, coefficients."""
    names = ["source", "first", "down", "up"]

    def pack(batches):
        parts = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for batch in batches if batch.num_rows]
        if not parts:
            return
        source, claim, down, up = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        order = np.lexsort((source, claim))
        claim = claim[order]
        first = np.flatnonzero(np.r_[True, claim[1:] != claim[:-1]])
        arrays = (np.searchsorted(ids, source[order]).astype(np.int32), first.astype(np.int64), down[order], up[order])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names)

    tasks = edges.sparkSession.sparkContext.defaultParallelism
    parts = max(tasks, -(-edges.count() // BLOCK_EDGES))
    packed = edges.select("source_id", "claim_id", "down", "up").repartition(parts, "claim_id")
    return packed.mapInArrow(pack, ", ".join(f"{c} binary" for c in names)).persist(StorageLevel.MEMORY_AND_DISK)


def _next(blocks: DataFrame, x: np.ndarray) -> np.ndarray:
    """Scores after one round, scaled to sum 1 unless the sum is 0."""

    def add(batches):
        found = np.zeros(len(x))
        for batch in batches:
            for i in range(batch.num_rows):
                source, first, down, up = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in enumerate((np.int32, np.int64, np.float64, np.float64)))
                support = np.add.reduceat(x[source] * down, first)
                found += np.bincount(source, np.repeat(support, np.diff(first, append=len(source))) * up, len(x))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["found"])

    after = np.zeros(len(x))
    blocks = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)  # a task brings back one vector for all its blocks
    for part in blocks.mapInArrow(add, "found binary").toArrow()["found"]:
        after += np.frombuffer(part.as_buffer())
    total = after.sum()
    return after if total == 0 else after / total


def _converged_blocks(rounds: Rounds, scores: DataFrame, tolerance: float, max_iterations: int) -> Propagation:
    spark = scores.sparkSession
    found = scores.select(F.col("source_id").cast("bigint"), F.col("score").cast("double")).toArrow()
    ids, x = found["source_id"].to_numpy(), found["score"].to_numpy()
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    known = np.sort(rounds.written.select("source_id").distinct().toArrow()["source_id"].to_numpy())
    if max_iterations and (not np.array_equal(ids, known) or found["score"].null_count):
        raise ValueError("the vectors are over different sources")
    blocks = _packed(rounds.written, ids)
    deltas: list[float] = []
    previous = x
    for _ in range(max_iterations):
        previous, x = x, _next(blocks, x)
        deltas.append(float(np.abs(x - previous).max(initial=0.0)))
        if deltas[-1] < tolerance:
            break
    blocks.unpersist()
    rounds.edges.unpersist()
    current, before = (spark.createDataFrame(pa.table({"source_id": ids, "score": v})) for v in (x, previous))
    return Propagation(current, claim_step(rounds, before), len(deltas), deltas, bool(deltas) and deltas[-1] < tolerance)


def run_until_convergence(
    rounds: Rounds, scores: DataFrame, tolerance: float = 1e-8, max_iterations: int = 1000, broadcast_limit: int | None = None
) -> Propagation:
    """Rounds until the largest change after scaling is below ``tolerance``; at the cap the last vector is returned."""
    current = cut(scores)
    most = BROADCAST_SOURCES if broadcast_limit is None else broadcast_limit
    if current.limit(most + 1).count() <= most:
        return _converged_blocks(rounds, current, tolerance, max_iterations)
    deltas: list[float] = []
    support = claim_step(rounds, current)
    previous = None
    for _ in range(max_iterations):
        support = claim_step(rounds, current)
        after = cut(normalise(source_step(rounds, support)))
        deltas.append(max_difference(current, after))
        if previous is not None:
            discard(previous)
        previous, current = current, after
        if deltas[-1] < tolerance:
            break
    rounds.edges.unpersist()  # what still reads them finds the written table
    return Propagation(current, support, len(deltas), deltas, bool(deltas) and deltas[-1] < tolerance)


#: The rules by name: whether scores are split by source degree, and the source step.
RULES = {
    "v0": (False, "mean"),
    "v1": (False, "mean"),
    "v2": (True, "mean"),
    "v3": (True, "mean"),
    "v4": (True, "sum"),
    "v7": (True, "sum"),
    "paper": (True, "claim_split"),
}


def propagate(
    edges: DataFrame, init: DataFrame | None = None, *, rule: str = "v7", weights: DataFrame | None = None,
    fixed_iterations: int | None = None, tolerance: float = 1e-8, max_iterations: int = 1000,
) -> Propagation:
    """Propagate over distinct edges by a named rule, from ``init`` or equal scores.

    With ``fixed_iterations`` the plan is lazy. An empty graph converges in one round to an empty vector.
    """
    split, combine = RULES[rule]
    rounds = ready(prepare(edges, weights=weights, split_by_source_degree=split, source_combine=combine))
    scores = uniform(edges) if init is None else init
    if fixed_iterations is not None:
        return run_fixed(rounds, scores, fixed_iterations)
    return run_until_convergence(rounds, scores, tolerance, max_iterations)
