"""Word shingles of texts and their minwise signatures, by whole Arrow batches.

Words are runs of letters, marks and digits in lower case; each letter of a script without spaces is a word.
A text's set holds the hashes of all its runs of ``SHINGLE`` words; a shorter text is one element as a whole.
Only fixed-size signatures leave the batch, so no shingle is shuffled to find candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
_LETTER = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, text after text in ascending order, and how many each text has."""
    plain = pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(texts), _LETTER, r" \1 "), r"[^\p{L}\p{N}\p{M}]+", " ")
    plain = pc.utf8_trim(plain, " ")
    lists = pc.split_pattern(plain, " ")
    n = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, dtype=np.uint64)
    padded = np.where(n > 0, np.maximum(n, SHINGLE), 0)
    begins = np.cumsum(padded) - padded
    row = np.zeros(padded.sum() + SHINGLE, dtype=np.uint64)
    row[np.repeat(begins, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = words
    runs = np.where(n > 0, padded - SHINGLE + 1, 0)
    starts = np.repeat(begins, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    value = np.zeros(len(starts), dtype=np.uint64)
    for k, factor in enumerate(_seeds(SHINGLE) | np.uint64(1)):
        value += row[starts + k] * factor
    value, owner = _mixed(value), np.repeat(np.arange(len(n)), runs)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=len(n)) if len(n) else n


SIGNED = "doc_id bigint, size int, f1 bigint, f2 bigint, low bigint, high bigint, buckets array<bigint>"


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, size, f1, f2, low, high, buckets`` of every text with a word.

    ``f1, f2`` tell sets apart, ``buckets`` is a hash per band of ``rows`` minwise hashes, ``low`` and ``high``
    hold two bits of up to 64 of these.
    """
    count = bands * rows
    masks, factors = _seeds(2 * count)[:count], _seeds(2 * count)[count:] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = sets_of(batch.column(1))
            some = np.flatnonzero(sizes)
            offsets = (np.cumsum(sizes) - sizes)[some]
            low, high = np.zeros(len(some), dtype=np.uint64), np.zeros(len(some), dtype=np.uint64)
            buckets = np.zeros((len(some), bands), dtype=np.uint64)
            if len(some):
                for i in range(count):
                    hashed = (values ^ masks[i]) * factors[i]
                    least = np.minimum.reduceat(hashed ^ (hashed >> np.uint64(29)), offsets)
                    buckets[:, i // rows] = _mixed(buckets[:, i // rows] ^ least)
                    if i < 64:
                        bits = _mixed(least)
                        low |= (bits & np.uint64(1)) << np.uint64(i)
                        high |= ((bits >> np.uint64(1)) & np.uint64(1)) << np.uint64(i)
                first, second = np.add.reduceat(values, offsets), np.bitwise_xor.reduceat(_mixed(values ^ masks[0]), offsets)
            else:
                first = second = low
            long = lambda a: pa.array(a.view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), long(buckets.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(sizes[some].astype(np.int32)), long(first), long(second), long(low), long(high), listed],
                names=["doc_id", "size", "f1", "f2", "low", "high", "buckets"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").dropna().mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, elements``: the distinct shingle hashes of each text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = sets_of(batch.column(1))
            some = np.flatnonzero(sizes)
            ends = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), listed], names=["doc_id", "elements"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").dropna().mapInArrow(run, "doc_id bigint, elements array<bigint>")
