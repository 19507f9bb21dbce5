import datetime as dt

import pytest

from claimloom import schema
from claimloom.operators import propagate
from claimloom.sources import readers
from claimloom.streaming import edge_stream, orphan_stream

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def test_orphan_stream(spark, tmp_path):
    folder, snapshots = str(tmp_path / "in"), []
    store = orphan_stream.OrphanStore(spark, str(tmp_path / "state"))
    batches = [
        [("ref", 1, 5, day(0), None, None), ("ref", 2, 6, day(3), None, None), ("stay", None, 6, None, day(1), None)],
        [("stay", None, 5, None, day(10), None), ("stay", None, 6, None, day(1), day(20))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, orphan_stream.CHANGES).coalesce(1).write.mode("append").parquet(folder)
        stream = orphan_stream.read_changes(spark, folder)
        query = orphan_stream.start(stream, store, "t", str(tmp_path / "checkpoint"), lambda n, s: snapshots.append((n, [tuple(r)[2:] for r in s.collect()])), True)
        query.awaitTermination(120)
    state = store.read(2)
    assert sorted((r.row_id, r.opened_at, r.closed_at) for r in state.episodes.collect()) == [(1, day(0), day(10)), (2, day(20), None)]
    assert snapshots == [(0, [(1, 0, 1)]), (1, [(2, 1, 1)])]
    store.apply(1, state.refs.limit(0), state.stays.limit(0))  # a repeated batch changes nothing
    assert store.read(2).episodes.count() == 2


def test_edge_stream_reaches_the_batch_fixed_point(spark, tmp_path):
    first, second = {1: [1, 2, 3], 2: [2, 3]}, {3: [3, 4], 2: [4]}
    live = edge_stream.CredibilityStream(tolerance=1e-9, max_iterations=1000)
    folder = str(tmp_path / "edges")
    for part in (first, second):
        readers.literal_graph(spark, part).edges.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema.EDGES).parquet(folder)
        live.start(stream, str(tmp_path / "checkpoint"), True).awaitTermination(120)
    whole = readers.literal_graph(spark, {1: [1, 2, 3], 2: [2, 3, 4], 3: [3, 4]}).edges
    want = {r.source_id: r.score for r in propagate.propagate(whole, rule="v4", tolerance=1e-9).scores.collect()}
    assert {r.source_id: r.score for r in live.scores.collect()} == pytest.approx(want, abs=1e-6)
