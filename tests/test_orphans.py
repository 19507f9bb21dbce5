import datetime as dt
import random

import pytest

from claimloom.buckets import Buckets
from claimloom.operators import orphans
from claimloom.streaming.orphan_stream import OrphanStore

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def refs(spark, data):
    rows = spark.createDataFrame([(i, k, day(t), "x") for i, k, t in data], "id bigint, parent bigint, seen timestamp, key string")
    return orphans.references(rows, "id", "parent", "seen")


def stays(spark, data):
    rows = spark.createDataFrame([(k, day(a), day(b), 1) for k, a, b in data], "parent bigint, loaded_at timestamp, deleted_at timestamp, row_id int")
    return orphans.parent_stays(rows, "parent")


def orphan_ids(state):
    return sorted(r.row_id for r in orphans.on_arrival(state).collect())


def spans(state):
    return sorted((r.row_id, (r.opened_at - T0).days, None if r.closed_at is None else (r.closed_at - T0).days) for r in state.episodes.collect())


def brute(ref_rows, stay_rows):
    """Orphan spans by looking at every day."""
    out = []
    for i, k, t in ref_rows:
        if k is None or t is None:
            continue
        there = lambda d: any(p == k and a is not None and a <= d and (b is None or b > d) for p, a, b in stay_rows)  # noqa: E731, B023
        opened = None
        for d in range(t, 120):
            if there(d) and opened is not None:
                out.append((i, opened, d))
                opened = None
            elif not there(d) and opened is None:
                opened = d
        if opened is not None:
            out.append((i, opened, None))
    return sorted(out)


def test_spans(spark):
    r = [(1, 5, 0), (2, 5, 10), (3, 5, 30), (4, None, 0), (5, 9, 0), (6, 5, None), (2, 5, 10)]
    s = [(5, 5, 20), (5, 40, None), (5, 40, None), (None, 0, None), (6, 9, 3)]
    state = orphans.update(orphans.OrphanState.empty(spark), refs(spark, r), stays(spark, s))
    assert orphan_ids(state) == [1, 3, 5]
    assert spans(state) == brute(r, s)
    months = {r.month.strftime("%m"): (r.opened, r.closed, r.pending) for r in orphans.snapshots(state.episodes, "t").collect()}
    assert months == {"01": (6, 1, 5), "02": (0, 4, 1)}


def test_batches_give_the_same_state_as_one(spark, tmp_path):
    rng = random.Random(3)
    r = [(i, rng.choice([1, 2, 3, 7, 7, 7, None]), rng.randrange(60)) for i in range(60)]
    s = [(1, 5, 20), (1, 30, None), (2, 0, 50), (3, 25, None), (7, 10, 15), (7, 15, 40), (7, 38, 45)]
    whole = orphans.update(orphans.OrphanState.empty(spark), refs(spark, r), stays(spark, s))
    assert spans(whole) == brute(r, s)
    state = orphans.OrphanState.empty(spark)
    for part in range(3):
        state = orphans.update_and_cut(state, refs(spark, r[part::3]), stays(spark, s[part::3]))
    assert spans(state) == spans(whole) and orphan_ids(state) == orphan_ids(whole)
    state.write(str(tmp_path / "state"))
    assert spans(orphans.OrphanState.read(spark, str(tmp_path / "state"))) == spans(whole)


def test_periods_give_the_same_state_as_one_batch(spark):
    rng = random.Random(5)
    r = [(i, rng.choice([1, 2, 3, 7, 7, 7, 8, None]), rng.randrange(90)) for i in range(120)] + [(3, 7, 40)]
    s = [(1, 5, 20), (1, 30, None), (2, 0, 50), (2, 0, 70), (3, 25, None), (7, 10, 15), (7, 15, 40), (7, 38, 45), (8, 3, 80), (8, 3, None)]
    for starts in ([], ["2024-02-01 00:00:00"], ["2024-01-12 00:00:00", "2024-01-20 00:00:00", "2024-02-15 00:00:00", "2024-05-01 00:00:00"], None):
        tables = orphans.replay(Buckets.scratch(spark, 5), refs(spark, r), stays(spark, s), starts)
        found = orphans.OrphanState(None, None, orphans.episodes(tables))
        assert spans(found) == brute(r, s)
        assert orphan_ids(found) == sorted(i for i, k, t in r if k is not None and (i, t) in {x[:2] for x in brute([(i, k, t)], s)})


def test_a_small_batch_rewrites_its_own_buckets(spark, tmp_path):
    store = OrphanStore(spark, str(tmp_path / "state"), 16)
    r, s = [(i, i % 100, i % 50) for i in range(1000)], [(k, k, None) for k in range(0, 100, 2)]
    assert len(store.apply(0, refs(spark, r), stays(spark, s))) == 16
    folders = lambda: {f for f in (tmp_path / "state" / "episodes").glob("*/*") if f.name.startswith("_bucket=")}
    before = folders()
    changed = store.apply(1, refs(spark, [(5000, 7, 60)]), stays(spark, [(7, 55, None)]))
    assert len(changed) == 1 and len(folders() - before) == 1
    assert store.apply(1, refs(spark, r), stays(spark, s)) == []
    assert spans(store.read(2)) == brute([*r, (5000, 7, 60)], [*s, (7, 55, None)]) and spans(store.read(1)) == brute(r, s)


def test_a_deletion_in_a_later_batch_reopens(spark):
    state = orphans.update(orphans.OrphanState.empty(spark), refs(spark, [(1, 5, 3)]), stays(spark, [(5, 0, None)]))
    assert spans(state) == []
    state = orphans.update(state, refs(spark, []), stays(spark, [(5, 0, 8)]))
    assert spans(state) == [(1, 8, None)]
    state = orphans.update(state, refs(spark, []), stays(spark, [(5, 12, None)]))
    assert spans(state) == [(1, 8, 12)] and orphan_ids(state) == []


@pytest.mark.parametrize("r,s,expected", [([], [], []), ([(1, 4, 0)], [], [1]), ([], [(4, 0, None)], [])])
def test_empty_tables(spark, r, s, expected):
    assert orphan_ids(orphans.update(orphans.OrphanState.empty(spark), refs(spark, r), stays(spark, s))) == expected
