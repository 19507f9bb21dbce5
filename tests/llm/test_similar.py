import random

import pytest

from claimloom.llm import similar


def brute(sets, threshold, least):
    kept = {k: v for k, v in sets.items() if len(v) >= least}
    ids = sorted(kept)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(kept[a] & kept[b]) >= threshold * len(kept[a] | kept[b]) - 1e-9}


def elements(spark, sets, extra=()):
    rows = [(s, e, "x") for s, es in sets.items() for e in es] + list(extra)
    return similar.distinct_elements(spark.createDataFrame(rows, "who bigint, what bigint, set_id string"), "who", "what")


@pytest.mark.parametrize("seed,part", [(1, 50_000), (2, 7)])
def test_all_similar_pairs(spark, seed, part, monkeypatch):
    monkeypatch.setattr(similar, "PART", part)
    rng = random.Random(seed)
    sets = {}
    for s in range(120):
        if sets and rng.random() < 0.5:
            base = set(rng.choice(list(sets.values())))
            for _ in range(rng.randrange(6)):
                base.discard(rng.choice(sorted(base)) if base else 0)
                base.add(rng.randrange(500))
            sets[s] = base
        else:
            sets[s] = {rng.randrange(500) for _ in range(rng.randrange(1, 40))}
    result = similar.similar_sets(elements(spark, sets, [(None, 1, "x"), (1, None, "x"), (0, min(sets[0]), "x")]), 0.7, 5)
    want = brute(sets, 0.7, 5)
    assert {tuple(r) for r in similar.pairs(result).collect()} == want
    links = {r.set_id: r.n_links for r in similar.memberships(result).collect()}
    assert links == {s: sum(s in p for p in want) for s in sets if len(sets[s]) >= 5}


def test_copies_and_one_large_set(spark):
    sets = {i: {1, 2, 3, 4, 5} for i in range(40)} | {50: {1, 2, 3, 4, 5, 6}, 60: set(range(5000)), 61: set(range(4990))}
    result = similar.similar_sets(elements(spark, sets), 0.7, 5)
    assert result.classes.select("class_id").distinct().count() == 4
    assert {(r.class_a, r.class_b) for r in result.links.collect()} == {(0, 50), (60, 61)}
    assert similar.pairs(result).count() == 40 * 39 // 2 + 40 + 1


def test_empty_and_threshold_tie(spark):
    assert similar.pairs(similar.similar_sets(elements(spark, {}), 0.7)).count() == 0
    tie = {1: set(range(10)), 2: set(range(3, 10)), 3: set(range(4, 10))}  # 7 of 10 is a pair, 6 of 10 is none
    assert {tuple(r) for r in similar.pairs(similar.similar_sets(elements(spark, tie), 0.7)).collect()} == {(1, 2), (2, 3)}
