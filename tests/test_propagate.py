import pytest
from pyspark.sql import functions as F

from claimloom.operators import propagate, report
from claimloom.plans import core_queries, credibility
from claimloom.sources import readers

TOY = {1: [1, 2], 2: [1, 2], 4: [3, 4]}


@pytest.fixture(scope="module")
def toy(spark):
    return readers.literal_graph(spark, TOY).edges


def scores_of(vector):
    return {r.source_id: r.score for r in vector.collect()}


def scores(p):
    return scores_of(p.scores)


@pytest.mark.parametrize("rule", ["v0", "v2", "v4", "v7"])
def test_toy_rounds(toy, rule):
    one, two = scores(propagate.propagate(toy, rule=rule, fixed_iterations=1)), scores(propagate.propagate(toy, rule=rule, fixed_iterations=2))
    assert one == pytest.approx({1: 0.4, 2: 0.4, 4: 0.2})
    assert two == pytest.approx({1: 4 / 9, 2: 4 / 9, 4: 1 / 9})


def test_toy_converges_in_26_rounds(toy):
    found = propagate.propagate(toy, rule="v4")
    assert found.converged and found.iterations == 26
    got = scores(found)
    assert got[1] == pytest.approx(0.5, abs=1e-7) and got[4] == pytest.approx(7.45e-9, rel=0.01)
    assert found.history().count() == 26


def test_paper_form_stays_at_thirds(toy):
    found = propagate.propagate(toy, rule="paper")
    assert found.iterations == 1 and scores(found) == pytest.approx({1: 1 / 3, 2: 1 / 3, 4: 1 / 3})


def test_cap_and_zero_rounds(toy):
    assert not propagate.propagate(toy, rule="v4", max_iterations=2).converged
    assert scores(propagate.propagate(toy, rule="v4", max_iterations=0)) == pytest.approx({1: 1 / 3, 2: 1 / 3, 4: 1 / 3})


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "source_id bigint, claim_id bigint")
    found = propagate.propagate(empty, rule="v4")
    assert found.converged and found.iterations == 1 and found.scores.count() == 0


def test_single_source_and_many_rounds(spark):
    one = readers.literal_graph(spark, {5: [1, 2, 3]}).edges
    assert scores(propagate.propagate(one, rule="v0", fixed_iterations=25)) == pytest.approx({5: 1.0})


def test_weights_default_to_one(toy, spark):
    half = spark.createDataFrame([(4, 3, 0.5), (4, 4, 0.5), (9, 9, 0.1)], "source_id bigint, claim_id bigint, weight double")
    got = scores(propagate.propagate(toy, rule="v7", weights=half, fixed_iterations=1))
    assert got == pytest.approx({1: 4 / 9, 2: 4 / 9, 4: 1 / 9})


def test_order_and_partitions_do_not_matter(toy):
    a = scores(propagate.propagate(toy, rule="v4", fixed_iterations=3))
    b = scores(propagate.propagate(toy.repartition(7).orderBy(F.desc("claim_id")), rule="v4", fixed_iterations=3))
    assert a == pytest.approx(b)


def test_fixed_point_does_not_depend_on_the_start(spark):
    connected = readers.literal_graph(spark, {1: [1, 2, 3], 2: [2, 3, 4], 3: [4, 5], 4: [1, 5]})
    result = credibility.run(connected)
    assert result.same_fixed_point and result.difference < 1e-8
    assert sum(scores(result.credibility).values()) == pytest.approx(1.0)
    assert all(abs(r.change) < 1e-9 for r in result.changes.collect())


def test_a_run_prepares_weighted_edges_once(spark, monkeypatch):
    prepared, prepare = [], propagate.prepare
    monkeypatch.setattr(propagate, "prepare", lambda *a, **k: prepared.append(k["weights"]) or prepare(*a, **k))
    graph = readers.literal_graph(spark, {1: [1, 2, 3], 2: [2, 3, 4], 3: [4, 5], 4: [1, 5]})
    graph.weights = graph.edges.withColumn("weight", F.lit(0.5))
    assert credibility.run(graph).same_fixed_point and len(prepared) == 2


def test_seeded_start(spark):
    ids = readers.literal_graph(spark, {-5: [1], 0: [1], 7: [2], 2**62: [2]}).edges
    first, other = (scores_of(propagate.seeded(ids.repartition(n), s)) for n, s in ((1, 1), (5, 2)))
    assert all(v > 0 for v in first.values()) and sum(first.values()) == pytest.approx(1.0)
    assert first == scores_of(propagate.seeded(ids.repartition(3), 1)) and first != other


def test_two_tied_components_depend_on_the_start(spark):
    tied = readers.literal_graph(spark, {1: [1, 2], 2: [3, 4]}).edges
    start = spark.createDataFrame([(1, 0.9), (2, 0.1)], "source_id bigint, score double")
    assert scores(propagate.propagate(tied, start, rule="v4")) == pytest.approx({1: 0.9, 2: 0.1})


@pytest.mark.parametrize("rule", list(propagate.RULES))
def test_kept_edges_give_the_same(toy, rule, monkeypatch):
    plain = scores(propagate.propagate(toy, rule=rule, fixed_iterations=3))
    monkeypatch.setattr(propagate, "SMALL_EDGES", 0)
    assert scores(propagate.propagate(toy, rule=rule, fixed_iterations=3)) == pytest.approx(plain)
    split, combine = propagate.RULES[rule]
    shuffled = propagate.ready(propagate.prepare(toy, split_by_source_degree=split, source_combine=combine), broadcast_limit=1)
    assert scores(propagate.run_fixed(shuffled, propagate.uniform(toy), 3)) == pytest.approx(plain)


@pytest.mark.parametrize("rule", list(propagate.RULES))
def test_blocks_give_the_same_as_joins(spark, rule, monkeypatch):
    monkeypatch.setattr(propagate, "BLOCK_EDGES", 3)
    edges = readers.literal_graph(spark, {-1: [1, 2, 3], 2: [2, 3, 4], 3: [4, 5], 2**40: [1, 5, 9], 7: [9]}).edges
    weights = spark.createDataFrame([(2, 3, 0.5), (7, 9, 0.25)], "source_id bigint, claim_id bigint, weight double")
    split, combine = propagate.RULES[rule]
    rounds = propagate.ready(propagate.prepare(edges, weights=weights, split_by_source_degree=split, source_combine=combine))
    joins, blocks = (propagate.run_until_convergence(rounds, propagate.seeded(edges), 1e-4, 30, limit) for limit in (0, None))
    assert scores(joins) == pytest.approx(scores(blocks)) and joins.deltas == pytest.approx(blocks.deltas, abs=1e-12) and joins.converged == blocks.converged
    assert {r.claim_id: r.support for r in joins.support.collect()} == pytest.approx({r.claim_id: r.support for r in blocks.support.collect()})


def test_one_job_a_round(spark, toy):
    spark.sparkContext.setJobGroup("rounds", "")
    found = propagate.propagate(toy, rule="v4", tolerance=0.0, max_iterations=40)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.iterations == 40 and jobs < 80
    with pytest.raises(ValueError):
        propagate.propagate(toy, propagate.uniform(toy.filter("source_id < 4")), rule="v4")


def test_unknown_rule(toy):
    with pytest.raises(ValueError):
        propagate.prepare(toy, source_combine="median")
    with pytest.raises(ValueError):
        propagate.max_difference(propagate.uniform(toy), propagate.uniform(toy.filter("source_id < 4")))


def test_reports(spark, toy, tmp_path):
    graph = readers.literal_graph(spark, TOY)
    vector = propagate.propagate(toy, rule="v4", fixed_iterations=1).scores
    assert [r.source_id for r in report.top_sources(vector, 2).collect()] == [1, 2]
    assert [r.source_id for r in report.bottom_sources(vector, 1).collect()] == [4]
    named = report.with_names(vector, graph.sources.filter("source_id <> 4"))
    assert {r.name for r in named.collect()} == {"source-1", "source-2", "4"}
    report.save_scores(vector, graph.sources, str(tmp_path / "scores"))
    lines = sorted(spark.read.text(str(tmp_path / "scores")).toPandas().value)
    assert "1,source-1,0.400000000000" in lines and "source_id,domain,score" in lines
    assert sum(r.percent for r in report.share(vector.withColumnRenamed("score", "n"), "n").collect()) == pytest.approx(100)


def test_registered_runs_reach_the_fixed_point(spark, tmp_path):
    rows = [(1, 1), (1, 2), (2, 1), (2, 2), (4, 3), (4, 4), (4, 2)]
    spark.createDataFrame(rows, "source_id bigint, claim_id bigint").write.parquet(str(tmp_path / "assertions.parquet"))
    found = core_queries.QUERIES["fixed_point_v3"](spark, str(tmp_path))
    edges = core_queries.edges(spark, str(tmp_path))
    once_more = propagate.propagate(edges, found, rule="v3", fixed_iterations=1).scores
    assert propagate.max_difference(found, once_more) < 1e-8
    capped = propagate.propagate(edges, rule="v3", max_iterations=core_queries.K)
    assert not capped.converged and propagate.max_difference(found, capped.scores) > 1e-8
    twenty = scores(propagate.propagate(edges, rule="v0", fixed_iterations=20))
    assert scores_of(core_queries.QUERIES["full_v0"](spark, str(tmp_path))) == pytest.approx(twenty)
