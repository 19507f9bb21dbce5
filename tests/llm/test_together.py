import random
from collections import Counter
from itertools import combinations

import pytest

from claimloom.buckets import Buckets
from claimloom.llm import together


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "basket bigint, item bigint, n int")


def brute(rows, m):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = Counter(i for items in baskets.values() for i in items)
    ab = Counter(p for items in baskets.values() for p in combinations(sorted(items), 2))
    return {(*p, k, n[p[0]], n[p[1]], len(baskets)) for p, k in ab.items() if k >= m}


def found(tables):
    return {tuple(r)[:6] for r in together.associations(tables).collect()}


def begin(spark, m, heavy=1000, buckets=4):
    return together.state(spark, m, heavy, Buckets.scratch(spark, buckets))


@pytest.mark.parametrize("heavy", [5, 1000])
def test_batches_of_changes(spark, heavy, tmp_path):
    rng = random.Random(heavy)
    draw = lambda n: [(rng.choice([1, 2] + list(range(40))), min(rng.randrange(30), rng.randrange(30))) for _ in range(n)]
    rows = set(draw(500))
    tables = together.state(spark, 4, heavy, Buckets(spark, str(tmp_path / "pairs"), 4))
    together.update(tables, frame(spark, [*rows, (None, 1), (1, None), *list(rows)[:5]]))
    assert found(tables) == brute(rows, 4)
    for k in range(3):
        added, removed = set(draw(60)), set(rng.sample(sorted(rows), 80)) | set(draw(5))
        rows = (rows - removed) | added
        together.update(tables, frame(spark, added), frame(spark, removed))
        tables.commit(k)
        tables = tables.open(k + 1)
        assert found(tables) == brute(rows, 4)


def test_a_basket_that_turns_heavy_and_back(spark):
    base = [(b, i) for b in range(5) for i in range(4)]
    tables = begin(spark, 3, heavy=6)
    together.update(tables, frame(spark, base))
    grown = [(0, i) for i in range(100, 110)]
    together.update(tables, frame(spark, grown))
    assert tables.values["slots"] == [[0, 0]] and found(tables) == brute(base + grown, 3)
    together.update(tables, frame(spark, []), frame(spark, grown))
    assert tables.values["slots"] == [] and found(tables) == brute(base, 3)


def test_more_heavy_baskets_than_a_mask_has_bits(spark):
    rows = [(b, i) for b in range(80) for i in range(b % 3, 8)]
    tables = begin(spark, 72, heavy=2)
    together.update(tables, frame(spark, rows))
    assert len(tables.values["slots"]) == together.SLOTS and found(tables) == brute(rows, 72) != set()


def test_a_small_batch_writes_few_buckets(spark):
    rows = [(b, i) for b in range(200) for i in (b % 50, (b + 1) % 50, 60)]
    tables = begin(spark, 2, buckets=16)
    assert together.update(tables, frame(spark, rows)) == {"edges": 16, "baskets": 16, "pairs": 16}
    wrote = together.update(tables, frame(spark, [(7, 33), *rows[:3]]), frame(spark, [(9, 999)]))
    assert wrote["edges"] == wrote["baskets"] == 1 and wrote["pairs"] <= 3
    assert found(tables) == brute([*rows, (7, 33)], 2)
    assert together.update(tables, frame(spark, rows[:5])) == {"edges": 0, "baskets": 0}


def test_empty_and_lift(spark):
    tables = begin(spark, 2)
    together.update(tables, frame(spark, []))
    assert found(tables) == set()
    together.update(tables, frame(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 3)]))
    row = together.associations(tables).head()
    assert (row.n_ab, row.lift) == (2, pytest.approx(2 * 4 / (2 * 2)))
