"""Credibility kept up to date from a stream of assertions, each batch from the scores of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators import propagate
from claimloom.session import cut
from claimloom.sources.readers import distinct_edges


class CredibilityStream:
    """Distinct edges so far and their scores; a new source starts at the mean score."""

    def __init__(self, rule: str = "v4", tolerance: float = 1e-6, max_iterations: int = 100):
        self.rule, self.tolerance, self.max_iterations = rule, tolerance, max_iterations
        self.edges: DataFrame | None = None
        self.scores: DataFrame | None = None
        self.iterations: list[int] = []

    def add(self, rows: DataFrame) -> None:
        fresh = distinct_edges(rows)
        self.edges = cut(fresh if self.edges is None else self.edges.unionByName(fresh).distinct())
        start = None
        if self.scores is not None:
            known = self.edges.select("source_id").distinct().join(self.scores, "source_id", "left")
            mean = self.scores.agg(F.avg("score").alias("_m"))  # one row
            start = propagate.normalise(known.join(F.broadcast(mean)).select("source_id", F.coalesce("score", "_m").alias("score")))
        found = propagate.propagate(self.edges, start, rule=self.rule, tolerance=self.tolerance, max_iterations=self.max_iterations)
        self.scores = found.scores
        self.iterations.append(found.iterations)

    def start(self, assertions: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = assertions.writeStream.foreachBatch(lambda rows, _: self.add(rows)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
