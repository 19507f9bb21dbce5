"""Communities of the weighted source graph, their bridges, and connected components.

Louvain, deterministic: ties go to the smallest community. Edges of a graph of any size are packed by node into
blocks of numpy arrays that stay with the executors; the driver keeps a few numbers a node. A round is one job
over the blocks, in which every second node (by a hash of node and round) may move, so that two neighbours do
not swap for ever; rounds go on until no node gains by a move. Only a caller that asks for it has a small graph
worked on by one task, with the nodes looked at in ascending order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut, discard

#: Edge ends in a block, on average.
BLOCK_EDGES = 2_000_000
#: Sums of a node's weights by community are a dense table where it has at most so many cells per edge end.
DENSE_CELLS = 4
_BLOCK = "nodes binary, counts binary, loops binary, near binary, weights binary, kind string"


def _louvain(pairs: list[tuple[int, int, float]]) -> dict[int, int]:
    """Community of each node, named by its smallest node."""
    members: dict[int, list[int]] = {}
    adjacent: dict[int, dict[int, float]] = {}
    loops: dict[int, float] = {}
    for a, b, w in sorted(pairs):
        adjacent.setdefault(a, {})[b] = adjacent.get(a, {}).get(b, 0.0) + w
        adjacent.setdefault(b, {})[a] = adjacent.get(b, {}).get(a, 0.0) + w
    for n in adjacent:
        members[n] = [n]
    total = sum(w for _, _, w in pairs)
    while True:
        degree = {n: sum(adjacent[n].values()) + 2 * loops.get(n, 0.0) for n in adjacent}
        of = {n: n for n in adjacent}
        volume = dict(degree)
        moved_any = False
        while True:
            moved = False
            for n in sorted(adjacent):
                links: dict[int, float] = {}
                for m, w in adjacent[n].items():
                    links[of[m]] = links.get(of[m], 0.0) + w
                home = of[n]
                volume[home] -= degree[n]
                gain = lambda c: links.get(c, 0.0) - volume[c] * degree[n] / (2 * total)  # noqa: E731, B023
                best, best_gain = home, gain(home)
                for c in sorted(links):
                    if gain(c) > best_gain + 1e-12:
                        best, best_gain = c, gain(c)
                volume[best] += degree[n]
                if best != home:
                    of[n], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            return {x: min(members[n]) for n in members for x in members[n]}
        merged: dict[int, dict[int, float]] = {}
        new_loops: dict[int, float] = {}
        new_members: dict[int, list[int]] = {}
        for n in adjacent:
            c = of[n]
            new_members.setdefault(c, []).extend(members[n])
            new_loops[c] = new_loops.get(c, 0.0) + loops.get(n, 0.0)
            merged.setdefault(c, {})
            for m, w in adjacent[n].items():
                if of[m] == c:
                    new_loops[c] += w / 2
                else:
                    merged[c][of[m]] = merged[c].get(of[m], 0.0) + w
        adjacent, loops, members = merged, new_loops, new_members


def _packed(graph: DataFrame, ids: np.ndarray) -> DataFrame:
    """Edge ends ``a, b, w`` in blocks, a node in one block only: places of nodes in ``ids``, neighbours and weights; loops apart."""

    def pack(batches):
        ends = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for batch in batches if batch.num_rows]
        if not ends:
            return
        n = len(ids)
        key = np.concatenate([np.searchsorted(ids, a) * n + np.searchsorted(ids, b) for a, b, _ in ends])
        w = np.concatenate([e[2] for e in ends])
        del ends
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        w, key = np.add.reduceat(w[order], first), key[first]
        a, b = key // n, key % n
        nodes, row = np.unique(a, return_inverse=True)
        loop = a == b
        loops = np.bincount(row[loop], w[loop], len(nodes))
        row, b, w = row[~loop], b[~loop], w[~loop]
        if len(w) and w.min() >= 0 and w.max() < 65536 and (w == np.floor(w)).all():
            w = w.astype(np.uint16)
        arrays = (nodes.astype(np.int32), np.bincount(row, minlength=len(nodes)).astype(np.int32), loops, b.astype(np.int32), w)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays] + [pa.array([w.dtype.str])], _BLOCK_NAMES)

    ends = graph.count()
    parts = max(graph.sparkSession.sparkContext.defaultParallelism, -(-ends // BLOCK_EDGES))
    return graph.select("a", "b", "w").repartition(parts, "a").mapInArrow(pack, _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)


_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


def _blocks(batches):
    """The arrays of each block: nodes, counts, loops, near, weights."""
    for batch in batches:
        for i in range(batch.num_rows):
            kinds = (np.int32, np.int32, np.float64, np.int32, np.dtype(batch.column(5)[i].as_py()))
            yield [np.frombuffer(batch.column(j)[i].as_buffer() or b"", kind) for j, kind in enumerate(kinds)]


def _best(home: np.ndarray, d: np.ndarray, counts: np.ndarray, near: np.ndarray, w: np.ndarray, volume: np.ndarray, total: float) -> tuple:
    """Per node the weight to its own community, the community it gains most in (ties: the smallest) and how much more than at home.

    ``home`` and ``d`` are communities and degrees of the nodes, ``counts`` the lengths of their shares of ``near``, the
    communities at the other ends, and of ``w``.
    """
    k, m = len(volume), len(counts)
    inside, to, more = np.zeros(m), home.copy(), np.zeros(m)
    ends = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    dense = k * m <= DENSE_CELLS * len(near)
    step = max(1, 4_000_000 // k) if dense else m
    for lo in range(0, m, step):
        hi = min(m, lo + step)
        at, h, dd = slice(ends[lo], ends[hi]), home[lo:hi], d[lo:hi]
        rows = np.arange(hi - lo)
        key = np.repeat(rows, counts[lo:hi]) * k + near[at]
        alone = (dd - volume[h]) * dd / total
        if dense:
            links = np.bincount(key, w[at], (hi - lo) * k).reshape(hi - lo, k)
            own = links[rows, h]
            gain = np.where(links > 0, links - volume * dd[:, None] / total, -np.inf)
            gain[rows, h] = own + alone
            to[lo:hi] = gain.argmax(axis=1)
            more[lo:hi] = gain.max(axis=1) - gain[rows, h]
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
            links, key = np.add.reduceat(w[at][order].astype(np.float64), first) if len(key) else np.zeros(0), key[first]
            row, found = key // k, key % k
            at_home = found == h[row]
            own = np.bincount(row[at_home], links[at_home], hi - lo)
            gain = np.where(at_home, links + alone[row], links - volume[found] * dd[row] / total)
            top = own + alone
            np.maximum.at(top, row, gain)
            is_top = np.flatnonzero(gain == top[row])
            which, where = np.unique(row[is_top], return_index=True)
            to[lo + which] = found[is_top[where]]
            more[lo:hi] = top - (own + alone)
        inside[lo:hi] = own
    return inside, to, more


def _look(blocks: DataFrame, of: np.ndarray, degree: np.ndarray, total: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Modularity of a state but for loops, which no move changes; per node the community it gains most in, and how much."""
    communities, c = np.unique(of, return_inverse=True)  # in order, so the first of equals is the smallest
    volume = np.bincount(c, degree)

    def look(batches):
        for nodes, counts, _, near, w in _blocks(batches):
            inside, to, more = _best(c[nodes], degree[nodes], counts, c[near], w, volume, total)
            arrays = [pa.array([x.tobytes()], pa.binary()) for x in (nodes, to, more)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([float(inside.sum())])], ["nodes", "to", "more", "inside"])

    to, more, inside = np.zeros(len(of), np.int64), np.zeros(len(of)), []
    for r in blocks.mapInArrow(look, "nodes binary, to binary, more binary, inside double").toArrow().to_pylist():
        nodes = np.frombuffer(r["nodes"], np.int32)
        to[nodes], more[nodes] = np.frombuffer(r["to"], np.int64), np.frombuffer(r["more"])
        inside.append((int(nodes[0]), r["inside"]))
    return sum(i for _, i in sorted(inside)) / total - float(np.square(volume / total).sum()), communities[to], more


def _turn(ids: np.ndarray, r: int, share: int) -> np.ndarray:
    """Whether it is a node's turn in a round, by a hash of both."""
    x = ids.astype(np.uint64) + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) % np.uint64(share) == 0


def _rounds(blocks: DataFrame, ids: np.ndarray, degree: np.ndarray, total: float) -> tuple[np.ndarray, bool]:
    """The community of each node, as a place in ``ids``, once no node gains by a move, and whether any moved.

    A round of which modularity does not rise, as moves at the same time can spoil each other, is undone
    and tried with half as many nodes, at last with the one of the largest gain, so the loop ends.
    """
    of = np.arange(len(ids))
    quality, to, more = _look(blocks, of, degree, total)
    moved_any, share, r = False, 2, 0
    while True:
        wished = more > 1e-12
        n = int(wished.sum())
        if n == 0:
            break
        single = share > n
        moves = np.arange(len(ids)) == more.argmax() if single else wished & _turn(ids, r, share)
        r += 1
        if not moves.any():
            continue
        after = np.where(moves, to, of)
        quality_after, to_after, more_after = _look(blocks, after, degree, total)
        if quality_after > quality:
            of, quality, to, more, moved_any, share = after, quality_after, to_after, more_after, True, max(2, share // 2)
        elif single:  # its gain is below what numbers of this size tell apart
            break
        else:
            share *= 2
    return of, moved_any


def _degrees(blocks: DataFrame, n: int) -> np.ndarray:
    def degrees(batches):
        for nodes, counts, loops, _, w in _blocks(batches):
            d = loops + np.bincount(np.repeat(np.arange(len(nodes)), counts), w, len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (nodes, d)], ["nodes", "d"])

    found = np.zeros(n)
    for r in blocks.mapInArrow(degrees, "nodes binary, d binary").toArrow().to_pylist():
        found[np.frombuffer(r["nodes"], np.int32)] = np.frombuffer(r["d"])
    return found


def _merged(blocks: DataFrame, ids: np.ndarray, of: np.ndarray) -> DataFrame:
    """The graph of the communities, a loop for what is inside."""
    communities, c = np.unique(of, return_inverse=True)
    names, k = ids[communities], len(communities)

    def merge(batches):
        for nodes, counts, loops, near, w in _blocks(batches):
            home = c[nodes]
            key = np.r_[np.repeat(home, counts) * k + c[near], home * (k + 1)]
            key, row = np.unique(key, return_inverse=True)
            sums = np.bincount(row, np.r_[w.astype(np.float64), loops], len(key))
            yield pa.RecordBatch.from_arrays([pa.array(names[key // k]), pa.array(names[key % k]), pa.array(sums)], ["a", "b", "w"])

    return blocks.mapInArrow(merge, "a bigint, b bigint, w double").groupBy("a", "b").agg(F.sum("w").alias("w")).filter("w <> 0")


def _ids(graph: DataFrame, *columns: str) -> np.ndarray:
    ends = graph.select(F.explode(F.array(*columns)).alias("a")).distinct().toArrow()
    return np.sort(ends["a"].to_numpy().astype(np.int64))


def _settled(graph: DataFrame, total: float) -> tuple[DataFrame, bool]:
    """``a, c`` of a graph with both directions of each edge: one level, and whether any node moved."""
    ids = _ids(graph, "a")
    blocks = _packed(graph, ids)
    of, moved_any = _rounds(blocks, ids, _degrees(blocks, len(ids)), total)
    blocks.unpersist()
    return graph.sparkSession.createDataFrame(pa.table({"a": ids, "c": ids[of]})), moved_any


def _distributed(pairs: DataFrame) -> DataFrame:
    """The same objective by rounds over blocks of edges, at every level until no node moves."""
    pairs = pairs.dropna()
    sources = ids = _ids(pairs, "a", "b")
    community = sources
    both = F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))).alias("e")
    graph = pairs.select(both).select("e.*")
    while len(ids):
        blocks = _packed(graph, ids)
        degree = _degrees(blocks, len(ids))
        of, moved_any = _rounds(blocks, ids, degree, float(degree.sum()))  # both directions: twice the weight
        if moved_any:
            community = ids[of][np.searchsorted(ids, community)]
            merged = cut(_merged(blocks, ids, of))
        blocks.unpersist()
        if not moved_any:
            break
        discard(graph)
        ids, graph = np.unique(community), merged
    _, place = np.unique(community, return_inverse=True)
    smallest = np.full(len(sources), np.iinfo(np.int64).max)
    np.minimum.at(smallest, place, sources)
    return pairs.sparkSession.createDataFrame(pa.table({"source_id": sources, "community": smallest[place]}))


def find_communities(graph: DataFrame, one_task_edges: int = 0) -> DataFrame:
    """``source_id, community`` of a graph ``source_a, source_b, weight``; a community bears its smallest source id.

    Only sources with an edge take part. An empty graph has no communities.
    """
    pairs = graph.select(F.col("source_a").alias("a"), F.col("source_b").alias("b"), F.col("weight").cast("double").alias("w"))
    if not hasattr(graph, "_claimloom_path"):  # else it is written already
        pairs = cut(pairs)
    if pairs.limit(one_task_edges + 1).count() > one_task_edges:
        return _distributed(pairs)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = _louvain(list(zip(group["a"].tolist(), group["b"].tolist(), group["w"].tolist())))
        return pd.DataFrame({"source_id": list(found), "community": list(found.values())}, dtype="int64")

    return pairs.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "source_id bigint, community bigint")


def modularity(graph: DataFrame, communities: DataFrame) -> float:
    """Modularity of a partition: share of weight within communities less what chance gives."""
    a = communities.select(F.col("source_id").alias("source_a"), F.col("community").alias("ca"))
    b = communities.select(F.col("source_id").alias("source_b"), F.col("community").alias("cb"))
    placed = graph.join(a, "source_a").join(b, "source_b")
    inside = placed.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("i")).head()
    ends = placed.select(F.col("ca").alias("c"), "weight").unionByName(placed.select(F.col("cb").alias("c"), "weight"))
    volumes = ends.groupBy("c").agg(F.sum("weight").alias("v")).agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("s")).head()
    return inside.i / inside.m - volumes.s / (4.0 * inside.m * inside.m)


def members(communities: DataFrame) -> DataFrame:
    """Communities with their members in order, as text pieces of one row each: ``community, position, source_id``."""
    from pyspark.sql import Window

    return communities.withColumn("position", F.row_number().over(Window.partitionBy("community").orderBy("source_id")))


def bridge_edges(graph: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges between communities, with both."""
    a = communities.select(F.col("source_id").alias("source_a"), F.col("community").alias("community_a"))
    b = communities.select(F.col("source_id").alias("source_b"), F.col("community").alias("community_b"))
    return graph.join(a, "source_a").join(b, "source_b").filter(F.col("community_a") != F.col("community_b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``source_id, component`` of the source-claim graph, named by the smallest source id; minima spread until none changes."""
    edges = cut(edges.select("source_id", "claim_id"))
    labels = cut(edges.select("source_id").distinct().withColumn("component", F.col("source_id")))
    while True:
        claim = edges.join(labels, "source_id").groupBy("claim_id").agg(F.min("component").alias("m"))
        spread = edges.join(claim, "claim_id").groupBy("source_id").agg(F.min("m").alias("near"))
        jump = labels.select(F.col("source_id").alias("near"), F.col("component").alias("far"))
        after = cut(labels.join(spread, "source_id").join(jump, "near").select("source_id", "component", F.least("near", "far").alias("next")))
        changed = after.filter(F.col("next") < F.col("component")).limit(1).count()
        discard(labels)
        labels = after.select("source_id", F.col("next").alias("component"))
        labels._claimloom_path = after._claimloom_path
        if not changed:
            return labels
