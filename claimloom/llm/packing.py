"""Items of varying length into containers of fixed capacity: conflict-constrained best-fit.

Items are spread over shards of bounded token volume; each shard is packed by itself, members of
duplicate clusters first, then the others, each largest first. Bins are kept by residual, and every bin carries
a bitmap of the sources and one of the duplicate clusters it holds. For an item of size s the search starts at
residual s and goes on to the next larger residual until it meets a bin with neither the item's source nor its
cluster. Where no open bin is without the source, the tightest without the cluster takes the item
(flagged ``same_source``): sources are few and large, and keeping them apart at any price would leave most of a
container empty. Clusters are never put together; a new bin is opened instead. An item above the capacity is
cut into full pieces and a rest.

Only where a caller gives a ``slack`` may members of a cluster share a container (flagged ``conflict``): once
keeping them apart would take more than ``1 + slack`` times the least possible number of bins.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import shingles, similar
from claimloom.session import cut, discard

CAPACITY = 2048
#: Tokens per shard: about 2,000 bins of the default capacity. More bins fill little better; memory is a few dozen bytes a piece.
SHARD_TOKENS = 4_000_000
SLACK = 0.02
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEAR = 0.8
#: Bands of 3 rows: a pair at 0.8 is missed with probability (1 - 0.512) ** 18 < 3e-6.
BANDS, ROWS = 18, 3

PLACED = "doc_id bigint, piece int, start_token bigint, n_tokens int, container_id bigint, conflict boolean, same_source boolean"


def _counter(tokenizer: str, pattern: str):
    """Token counts of a list of texts: by ``tiktoken`` for rank files, by ``tokenizers`` for JSON files."""
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(model.encode_ordinary(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True

    def count(texts: list[str]) -> list[int]:
        sizes: list[int] = []
        for k in range(0, len(texts), 64):  # encodings hold offsets too, so a few texts at a time
            sizes += [len(e.ids) for e in model.encode_batch(texts[k : k + 64], add_special_tokens=False)]
        return sizes

    return count


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens`` of every document with text, by a public tokenizer file; its special strings count as text.

    ``pattern`` splits text before the merges of a rank file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer, pattern)
        for batch in batches:
            sizes = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int64())], names=["doc_id", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").dropna()
    return texts.mapInArrow(run, "doc_id bigint, n_tokens bigint")


def near_duplicates(docs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """``doc_id, cluster``: documents linked through similar ones share the cluster named by the smallest id.

    Documents of their own get themselves. Links join classes of equal shingle sets only, so copies add none.
    Labels spread by minimum until none changes; every round is written and read back.
    """
    signed = cut(shingles.signatures(docs, BANDS, ROWS))
    named = signed.groupBy("size", "f1", "f2").agg(F.min("doc_id").alias("class_id"))
    classes = cut(signed.select("doc_id", "size", "f1", "f2").join(named, ["size", "f1", "f2"]).select("doc_id", "class_id"))
    heads = classes.filter("doc_id = class_id").select("class_id").distinct()
    banded = signed.withColumnRenamed("doc_id", "class_id").join(heads, "class_id", "left_semi")
    banded = banded.select("class_id", "size", "low", "high", F.posexplode("buckets").alias("band", "bucket"))
    pairs = cut(similar.candidate_pairs(banded, BANDS * ROWS, threshold))
    asked = pairs.select(F.col("class_a").alias("doc_id")).unionByName(pairs.select(F.col("class_b").alias("doc_id"))).distinct()
    members = cut(shingles.shingle_sets(docs.join(asked, "doc_id", "left_semi")))
    side = lambda s: members.select(F.col("doc_id").alias(f"class_{s}"), F.col("elements").alias(f"elements_{s}"))
    common = F.size(F.array_intersect("elements_a", "elements_b"))
    met = pairs.join(side("a"), "class_a").join(side("b"), "class_b").select("class_a", "class_b", "size_a", "size_b", common.alias("common"))
    links = met.filter(F.col("common") >= (F.col("size_a") + F.col("size_b") - F.col("common")) * F.lit(threshold) - 1e-9)
    links = cut(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    for used_up in (signed, pairs, members):
        discard(used_up)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        spread = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        # the label's own label: paths halve, so the rounds grow with the logarithm of the longest chain
        own = labels.join(spread, "a").select("a", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("a").alias("near"), F.col("label").alias("far"))
        after = cut(own.join(jump, "near", "left").select("a", "label", F.least("near", F.coalesce("far", "near")).alias("next")))
        changed = after.filter(F.col("next") < F.col("label")).limit(1).count()
        discard(labels)
        labels = after.select("a", F.col("next").alias("label"))
        labels._claimloom_path = after._claimloom_path
        if not changed:
            break
    heads = labels.select(F.col("a").alias("class_id"), "label")
    placed = classes.join(heads, "class_id", "left").select("doc_id", F.coalesce("label", "class_id").alias("cluster"))
    return placed.groupBy("doc_id").agg(F.min("cluster").alias("cluster"))


def pack_shard(items: list[tuple], capacity: int, slack: float | None = SLACK) -> list[tuple[int, bool, bool]]:
    """The bin of each item, and whether it had to share one with its cluster or its source. Items: (size, id, source, cluster)."""
    seen: dict = {}
    for it in items:
        seen[it[3]] = seen.get(it[3], 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    # members of clusters first, while most bins are still without them
    order = sorted(range(len(items)), key=lambda k: (items[k][3] not in cluster_bit, -items[k][0], items[k][1:2]))
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(it[2] for it in items if it[2] is not None))}
    enough = None if slack is None else (1 + slack) * -(-sum(it[0] for it in items) // capacity)
    # bins by residual, then by the bitmaps of clusters and sources they hold
    by_residual: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
    n_at = [0] * (capacity + 1)
    with_source: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # bins of a residual that hold a source
    filled = 0  # bit r: some bin has residual r
    n_bins = 0
    placed: list = [None] * len(items)

    def count(residual: int, sources: int, by: int) -> None:
        n_at[residual] += by
        held = with_source[residual]
        while sources:
            s = sources & -sources
            held[s] = held.get(s, 0) + by
            sources ^= s

    def put(bin_: int, residual: int, key: tuple[int, int]) -> None:
        nonlocal filled
        by_residual[residual].setdefault(key, []).append(bin_)
        count(residual, key[1], 1)
        filled |= 1 << residual

    def take(residual: int, key: tuple[int, int]) -> int:
        nonlocal filled
        bins = by_residual[residual]
        bin_ = bins[key].pop()
        count(residual, key[1], -1)
        if not bins[key]:
            del bins[key]
            if not bins:
                filled &= ~(1 << residual)
        return bin_

    def successor(size: int, c: int, s: int) -> tuple[int, tuple[int, int] | None]:
        """The tightest bin that takes ``size`` and holds neither."""
        fits = filled >> size
        while fits:
            residual = size + (fits & -fits).bit_length() - 1
            if not s or n_at[residual] > with_source[residual].get(s, 0):
                for key in by_residual[residual]:
                    if not key[0] & c and not key[1] & s:
                        return residual, key
            fits &= fits - 1
        return -1, None

    for k in order:
        size, _, source, cluster = items[k]
        c, s = cluster_bit.get(cluster, 0), source_bit.get(source, 0)
        residual, key = successor(size, c, s)
        if key is None and s:
            residual, key = successor(size, c, 0)
        conflict = False
        if key is None and enough is not None and n_bins + 1 > enough:
            residual, key = successor(size, 0, 0)
            conflict = key is not None
        if key is None:
            put(n_bins, capacity - size, (c, s))
            placed[k] = (n_bins, False, False)
            n_bins += 1
        else:
            bin_ = take(residual, key)
            put(bin_, residual - size, (key[0] | c, key[1] | s))
            placed[k] = (bin_, conflict, bool(key[1] & s))
    return placed


def pack(items: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, slack: float | None = SLACK) -> DataFrame:
    """The container of every item or piece: ``doc_id, piece, start_token, n_tokens, container_id, conflict, same_source``.

    ``items`` has ``doc_id, n_tokens, source, cluster``; source and cluster may be null (then no
    conflict); ``slack`` null keeps clusters apart at any price. Items of no tokens or null size need no container and are left out. Pieces of one item
    are numbered from 0. Repeated items are packed as often as they occur. No rows give no rows.
    """
    items = cut(items.select("doc_id", "n_tokens", "source", "cluster").filter("doc_id IS NOT NULL AND n_tokens > 0"))
    total = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).collect()[0].n
    shards = max(1, -(-int(total) // shard_tokens))
    pieces = items.select(
        "doc_id", "source", "cluster", "n_tokens", F.posexplode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece", "_")
    ).select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start_token"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * F.lit(capacity)).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("bigint").alias("shard"),
    )

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece"], kind="stable")
        clean = [[None if v is pd.NA or v != v else v for v in group[c]] for c in ("source", "cluster")]
        rows = list(zip(group["n_tokens"].tolist(), zip(group["doc_id"].tolist(), group["piece"].tolist()), *clean))
        placed = pack_shard(rows, capacity, slack)
        out = group[["doc_id", "piece", "start_token", "n_tokens"]].copy()
        out["container_id"] = [(int(key[0]) << 32) + b for b, _, _ in placed]
        out["conflict"] = [c for _, c, _ in placed]
        out["same_source"] = [s for _, _, s in placed]
        return out

    return pieces.groupBy("shard").applyInPandas(run, PLACED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, slack: float | None = None) -> DataFrame:
    """Pack documents by their tokens, near-duplicates of one cluster apart (see ``pack``). ``docs`` has ``doc_id, text, source``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lower(F.regexp_replace("source", "[^\\p{L}\\p{N}]", "")).alias("source"))
    clusters = near_duplicates(docs)
    sized = count_tokens(docs, tokenizer).join(docs.select("doc_id", "source"), "doc_id").join(clusters, "doc_id", "left")
    return pack(sized, capacity, slack=slack)


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, mean fill, pieces beside their cluster and beside their source."""
    flags = [F.sum(F.col(c).cast("int")).alias(n) for c, n in (("conflict", "conflicts"), ("same_source", "same_sources"))]
    bins = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), *flags)
    return bins.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("mean_fill"), F.sum("conflicts").alias("conflicts"),
        F.sum("same_sources").alias("same_sources"),
    )
