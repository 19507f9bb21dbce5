import pytest

from claimloom import session
from claimloom.operators import community, overlap, walk
from claimloom.sources import readers


def values(spark, sets):
    data = [(s, "p", str(k), "v") for s, keys in sets.items() for k in keys]
    return spark.createDataFrame(data, "source_id bigint, product_id string, attribute string, value string")


COPIES = [
    ({1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5]}, 1.0, 1.0),
    ({1: [1, 2, 3, 4, 5], 2: [1, 2, 3]}, 1.0, 0.6),
    ({1: [1, 2, 3, 4, 5], 2: [2, 4, 6, 8]}, 0.5, 0.4),
    ({1: [1, 2, 3], 2: [1, 2, 4]}, 2 / 3, 2 / 3),
]


@pytest.mark.parametrize("sets,ab,ba", COPIES)
def test_directional_inclusion(spark, sets, ab, ba):
    r = overlap.directional_inclusion(values(spark, sets)).head()
    assert (r.score_ab, r.score_ba) == pytest.approx((ab, ba))
    assert r.asymmetry == pytest.approx(abs(ab - ba))
    assert r.score_ab * r.size_b == pytest.approx(r.score_ba * r.size_a)


def test_dependence_arithmetic(spark):
    inclusion, rarity = 198 / 314, 0.421633
    redundancy, independence = overlap.dependence_scores(inclusion, rarity)
    assert (round(inclusion, 6), round(redundancy, 6), round(independence, 6)) == (0.630573, 0.265870, 0.734130)


def test_inspect_pair_and_null_units(spark):
    schema = "product_id string, attribute string, value string, unit string"
    a = spark.createDataFrame([("p", "w", "1", None), ("p", "x", "2", "GB"), ("p", "y", "3", ""), ("q", "z", "4", None)], schema)
    b = spark.createDataFrame([("p", "w", "1", None), ("p", "x", "2", None), ("p", "y", "5", ""), ("r", "z", "4", None)], schema)
    rows = overlap.inspect_pair(a, b).orderBy("attribute").collect()
    assert [(r.attribute, r.verdict, r.text_a) for r in rows] == [("w", "MATCH", "1"), ("x", "DISAGREE", "2 GB"), ("y", "DISAGREE", "3")]
    assert tuple(overlap.inspect_totals(overlap.inspect_pair(a, b)).head()) == (1, 2)


def test_last_values(spark):
    data = [(1, "p", "a", "x", "u", 1), (1, "p", "a", "y", None, 2), (1, "p", "a", None, "u", 3)]
    rows = spark.createDataFrame(data, "source_id bigint, product_id string, attribute string, value string, unit string, row_id bigint")
    r = overlap.last_values(rows, "row_id", ("value", "unit")).head()
    assert (r.value, r.unit) == ("y", None)


@pytest.fixture(scope="module")
def cliques(spark):
    sets = {i: [100 + j for j in range(4)] + [i] for i in (1, 2, 3)} | {i: [200 + j for j in range(4)] + [i] for i in (7, 8, 9)}
    sets[3].append(999)
    sets[7].append(999)
    return readers.literal_graph(spark, sets).edges


@pytest.mark.parametrize("limit", [10**6, 0])
def test_two_cliques(spark, cliques, limit):
    graph = overlap.source_graph(cliques)
    found = community.find_communities(graph, one_task_edges=limit)
    assert {r.source_id: r.community for r in found.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    whole = found.selectExpr("source_id", "cast(1 as bigint) as community")
    assert community.modularity(graph, found) > community.modularity(graph, whole)
    bridge = community.bridge_edges(graph, found).collect()
    assert [(r.source_a, r.source_b, r.weight) for r in bridge] == [(3, 7, 1)]
    assert community.members(found).filter("position = 1").count() == 2


def test_rounds_at_every_size_until_no_node_gains(spark, monkeypatch):
    ring = [(i, (i + 1) % 60, 1) for i in range(60)] + [(i, (i + 7) % 60, 1) for i in range(0, 60, 3)]
    graph = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in ring], "source_a bigint, source_b bigint, weight bigint")
    both = graph.selectExpr("source_a a", "source_b b", "double(weight) w").union(graph.selectExpr("source_b", "source_a", "double(weight)"))
    total = 2.0 * graph.count()
    of = {r.a: r.c for r in community._settled(both, total)[0].collect()}
    near, degree = {}, {}
    for a, b, _ in ring:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, []).append(y)
            degree[x] = degree.get(x, 0) + 1
    for n, home in of.items():
        gain = {c: sum(of[m] == c for m in near[n]) - sum(d for x, d in degree.items() if of[x] == c and x != n) * degree[n] / total for c in {home, *(of[m] for m in near[n])}}
        assert max(gain.values()) <= gain[home] + 1e-9

    def unused(pairs):
        raise AssertionError("the size of the graph chose another algorithm")

    monkeypatch.setattr(community, "_louvain", unused)
    assert community.find_communities(graph).count() == 60


def _ring(spark):
    ring = [(i, (i + 1) % 60, 1.0) for i in range(60)] + [(i, (i + 7) % 60, 2.5) for i in range(0, 60, 3)]
    return spark.createDataFrame([(-a, 2**40 - b, w) for a, b, w in ring] + [(2**40 - i, -i, 4.0) for i in range(60)], "source_a bigint, source_b bigint, weight double")


def _communities(graph):
    return {r.source_id: r.community for r in community.find_communities(graph).collect()}


def test_few_jobs_a_round(spark):
    spark.sparkContext.setJobGroup("communities", "")
    found = _communities(_ring(spark))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 120 and jobs < 120


def test_a_written_graph_is_not_written_again(spark, monkeypatch):
    written = session.cut(_ring(spark))

    def unused(df):
        assert df.count() != written.count(), "the whole graph was written twice"
        return session.cut(df)

    monkeypatch.setattr(community, "cut", unused)
    found = community.find_communities(written)
    assert 0 < community.bridge_edges(written, found).count() < written.count()


def test_blocks_and_kinds_of_sums_do_not_matter(spark, monkeypatch):
    graph = _ring(spark)
    plain = _communities(graph)
    assert 1 < len(set(plain.values())) < 60 and all(c == min(x for x in plain if plain[x] == c) for c in plain.values())
    for cells, edges in ((0, 7), (10**6, 7), (10**6, 10**6)):
        monkeypatch.setattr(community, "DENSE_CELLS", cells)
        monkeypatch.setattr(community, "BLOCK_EDGES", edges)
        assert _communities(graph) == plain
    halves = graph.selectExpr("source_a", "source_b", "weight / 2 weight")
    missing = spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0)], graph.schema)
    assert _communities(halves.union(halves.selectExpr("source_b", "source_a", "weight")).union(missing)) == plain


def test_loops_count_for_degrees_only(spark):
    schema = "source_a bigint, source_b bigint, weight bigint"
    pairs = [(1, 2, 3), (2, 3, 3), (1, 3, 3), (3, 4, 1), (4, 5, 3), (5, 6, 3), (4, 6, 3)]
    assert _communities(spark.createDataFrame([*pairs, (7, 7, 2)], schema)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}


def test_components_and_empty_graphs(spark, cliques):
    apart = readers.literal_graph(spark, {1: [1, 2], 2: [2], 4: [3], 9: [3, 4]}).edges
    assert {r.source_id: r.component for r in community.connected_components(apart).collect()} == {1: 1, 2: 1, 4: 4, 9: 4}
    empty = apart.filter("source_id < 0")
    assert community.find_communities(overlap.source_graph(empty)).count() == 0
    assert community.connected_components(empty).count() == 0


def test_rarity_and_unique_share(spark):
    graph = readers.literal_graph(spark, {1: [1, 2, 3], 2: [1, 2], 3: [1]}).edges
    r = {(x.source_a, x.source_b): (round(x.score, 6), x.shared) for x in overlap.rarity_overlap(graph).collect()}
    assert r == {(1, 2): (round(1 / 3 + 1 / 2, 6), 2), (1, 3): (round(1 / 3, 6), 1), (2, 3): (round(1 / 3, 6), 1)}
    unique = {x.source_id: x.ratio for x in overlap.source_overlap(graph).collect()}
    assert unique == pytest.approx({1: 1 / 3, 2: 0.0, 3: 0.0})


def test_walks_stay_in_their_component(spark):
    toy = readers.literal_graph(spark, {1: [1, 2], 2: [1, 2], 4: [3, 4]}).edges
    expected = {r.source_id: r.visits for r in walk.expected_visits(toy, 1, 9).collect()}
    assert set(expected) == {1, 2} and sum(expected.values()) == pytest.approx(10) and expected[1] == pytest.approx(5.5)
    assert {r.source_id: r.visits for r in walk.expected_visits(toy, 4, 3).collect()} == {4: pytest.approx(4)}
    counted = {r.source_id: r.visits for r in walk.random_walks(toy, 1, walkers=2000, steps=9).collect()}
    assert sum(counted.values()) == 20000 and counted[1] / 20000 == pytest.approx(0.55, abs=0.02)
    # a walk from a source without claims ends at once
    assert [tuple(r) for r in walk.expected_visits(toy, 77, 3).collect()] == [(77, 1.0)]
    assert [tuple(r) for r in walk.random_walks(toy, 77, 10, 2).collect()] == [(77, 10)]


def test_inspect_domains(spark):
    sources = spark.createDataFrame([(1, "a.example"), (2, "b.example")], "source_id bigint, domain string")
    rows = [(1, "p", "x", "2", None), (2, "p", "x", "2", None), (2, "p", "y", "2", None)]
    values = spark.createDataFrame(rows, "source_id bigint, product_id string, attribute string, value string, unit string")
    assert [r.verdict for r in overlap.inspect_domains(sources, values, "a.example", "b.example").collect()] == ["MATCH"]
    with pytest.raises(ValueError):
        overlap.inspect_domains(sources, values, "a.example", "c.example")
