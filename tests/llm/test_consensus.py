import random

import pytest

from claimloom.llm import consensus


def votes(spark, data):
    return spark.createDataFrame([(*d, "x", 0.5) for d in data], "source bigint, task string, item string, label string, p string, skill double")


def planted(seed=5):
    """Good sources, guessers, and sources that always give one label."""
    rng = random.Random(seed)
    labels = ["a", "b", "c", "d"]
    truth = {f"i{k}": rng.choice(labels) for k in range(150)}
    data = []
    for s in range(30):
        for item, t in truth.items():
            if rng.random() < 0.2:
                if s < 12:
                    label = t if rng.random() < 0.93 else rng.choice(labels)
                elif s < 20:
                    label = "a"
                else:
                    label = rng.choice(labels)
                data.append((s, "t", item, label))
    return truth, data


def test_reliable_sources_outweigh_the_rest(spark):
    truth, data = planted()
    result = consensus.estimate(votes(spark, data))
    found = {r.item: r for r in consensus.consensus_labels(result).collect()}
    right = sum(found[i].label == truth[i] for i in found) / len(found)
    majority = {}
    for _, _, i, label in data:
        majority.setdefault(i, []).append(label)
    by_count = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in majority.items()) / len(majority)
    assert right > 0.85 and right > by_count + 0.1
    assert all(0 <= r.posterior <= 1 for r in found.values())
    skill = {r.source: r for r in result.annotators.collect()}
    assert min(skill[s].skill for s in range(12)) > max(skill[s].skill for s in range(20, 30)) - 0.5
    good = sum(skill[s].reliability for s in range(12)) / 12
    assert good > 0.85 and good > sum(skill[s].reliability for s in range(20, 30)) / 10 + 0.3


def test_shuffle_joins_give_the_same(spark):
    _, data = planted(6)
    a, b = (consensus.estimate(votes(spark, data), rounds=2, broadcast_limit=n) for n in (10**6, 0))
    key = lambda r: {(x.item, x.label): pytest.approx(x.p, abs=1e-9) for x in r.posteriors.collect()}
    assert key(a) == {k: v.expected for k, v in key(b).items()}


def test_nulls_repeats_and_ties(spark):
    data = [(1, "t", "i", "a"), (1, "t", "i", "a"), (2, "t", "i", "b"), (None, "t", "i", "b"), (3, None, "i", "b"), (3, "t", None, "b"), (3, "t", "j", None), (4, "t", "k", "a")]
    found = {r.item: r for r in consensus.consensus_labels(consensus.estimate(votes(spark, data), rounds=3)).collect()}
    assert set(found) == {"i", "k"} and found["i"].label == "a" and (found["i"].n_sources, found["i"].n_labels) == (2, 2)
    assert found["k"].label == "a" and found["k"].posterior > 0.5


def test_empty(spark):
    result = consensus.estimate(votes(spark, []), rounds=2)
    assert consensus.consensus_labels(result).count() == 0 and result.annotators.count() == 0
    assert consensus.agreement(votes(spark, [])).count() == 0


def test_agreement(spark):
    alike = [(s, "t", i, "a") for s in (1, 2) for i in "xy"]
    assert consensus.agreement(votes(spark, alike)).head().alpha is None
    data = [(1, "t", "x", "a"), (2, "t", "x", "a"), (1, "t", "y", "b"), (2, "t", "y", "b"), (1, "t", "z", "a"), (2, "t", "z", "b"), (3, "t", "w", "a")]
    r = consensus.agreement(votes(spark, data)).head()
    # coincidences: aa 2, bb 2, ab 2 of 6 values, 3 of each
    assert (r.observed, r.expected, r.alpha) == pytest.approx((4 / 6, 12 / 30, 1 - (2 / 6) / (18 / 30)))


def test_rounds_go_on_until_skills_settle(spark):
    rng = random.Random(8)
    data = [(s, "t", f"i{i}", "yes" if rng.random() < (0.9 if s < 4 else 0.6) else "no") for i in range(60) for s in range(6)]
    loose, strict = (consensus.estimate(votes(spark, data), tolerance=t) for t in (0.5, 1e-4))
    assert loose.changes == strict.changes[: len(loose.changes)] and len(loose.changes) < len(strict.changes) < consensus.MOST_ROUNDS
    assert strict.changes[-1] <= 1e-4 < strict.changes[-2]
    assert consensus.estimate(votes(spark, [])).changes == [0.0]
