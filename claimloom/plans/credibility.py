"""The whole credibility run: weighted, unweighted and from another start, with their comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from claimloom.operators import propagate, report
from claimloom.session import cut
from claimloom.sources.readers import CredibilityGraph

SAME_FIXED_POINT = 1e-8


@dataclass
class RunResult:
    """``credibility`` and ``baseline`` are weighted and unweighted scores; ``difference`` is between the two starts."""

    credibility: propagate.Propagation
    baseline: propagate.Propagation
    from_seed: propagate.Propagation
    changes: DataFrame
    difference: float

    @property
    def same_fixed_point(self) -> bool:
        return self.difference < SAME_FIXED_POINT


def run(
    graph: CredibilityGraph, *, save_to: str | None = None, tolerance: float = 1e-8, max_iterations: int = 1000, seed: int = 1, n: int = 20
) -> RunResult:
    """Score all sources by the weighted rule, compare with weights of 1 and with a seeded start, optionally save the scores."""
    edges = cut(graph.edges)
    split, combine = propagate.RULES["v7"]

    def ready(weights: DataFrame | None) -> propagate.Rounds:
        return propagate.ready(propagate.prepare(edges, weights=weights, split_by_source_degree=split, source_combine=combine))

    rounds = ready(graph.weights)  # prepared once for both starts
    weighted = propagate.run_until_convergence(rounds, propagate.uniform(edges), tolerance, max_iterations)
    if save_to is not None:
        report.save_scores(weighted.scores, graph.sources, save_to)
    baseline = propagate.run_until_convergence(ready(None), propagate.uniform(edges), tolerance, max_iterations)
    seeded = propagate.run_until_convergence(rounds, propagate.seeded(edges, seed), tolerance, max_iterations)
    changes = report.with_names(report.ranking_changes(baseline.scores, weighted.scores, n), graph.sources)
    return RunResult(weighted, baseline, seeded, changes, propagate.max_difference(weighted.scores, seeded.scores))
