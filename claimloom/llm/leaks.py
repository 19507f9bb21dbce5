"""Evaluation texts inside a training corpus, by suffix arrays of the corpus shards.

Each shard of documents becomes one sequence of word numbers (letters and digits for scripts without
spaces) of the words that the test items use. The suffix array of its stretches of such words is built by
prefix doubling, and every suffix of every test item is searched in it by binary search, all suffixes at
once, one word deeper at a time. That gives each suffix's longest verbatim match and all its places. A
place of ``RUN`` words (characters: ``RUN_CHARS``) is a leak.

A sentence with words changed need not hold any long run. Of its n words at most ``n - need`` may be
missing, so one of its ``n - need + 1`` rarest words must stand in the document: their places (from the
same shard's word index) are the candidates, whatever the length of the sentence or the kind of change.
Around them, windows with too few of its words are left out, and the longest common subsequence of sentence
and window decides exactly: at least ``KEPT`` of the words in order within ``SPAN`` times the sentence's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.sentences import split_sentences

RUN, RUN_CHARS = 10, 20
KEPT = 0.8
#: The kept words lie within so many times the sentence's length: up to half as many words again may be put in between.
SPAN = 1.5
#: Words of documents per suffix array: bounds a task's memory to some 100 bytes a word. A longer document is a shard by itself.
SHARD = 400_000
#: Pairs of test suffix and place that are looked at together.
CHUNK = 2_000_000
#: The test items are the stated query set; a block of them of this size is sent to every task, more blocks take more passes.
BLOCK_CHARS = 10_000_000
CHAR_LANGS = ("zh", "ja", "th")

_TAG = r"""</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z:-]+(?:\s*=\s*(?:"[^"\n]*"|'[^'\n]*'|[^\s"'<>]+))?)*\s*/?>"""
_MARKUP = _TAG + r"|\[/?(?:quote|b|i|u|s|code|url)(?:=[^\]\n]*)?\]|&(?:[a-z]{2,8}|#\d{1,6});"
_SCRIPT = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"


def _normal(texts: pa.Array) -> pa.Array:
    """Lower case, compatibility forms, no markup and no invisible marks."""
    seen = pc.replace_substring_regex(texts, r"[\x{200B}-\x{200F}\x{00AD}\x{FEFF}]", "")
    seen = pc.utf8_lower(pc.utf8_normalize(pc.replace_substring_regex(seen, _MARKUP, " "), "NFKC"))
    return pc.replace_substring(pc.replace_substring(seen, "ß", "ss"), "ς", "σ")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts without regard to case, punctuation, markup, quote marks and line breaks; the number of each text."""
    plain = pc.utf8_trim(pc.replace_substring_regex(_normal(texts), r"[^\p{L}\p{N}\p{M}]+", " "), " ")
    lists = pc.split_pattern(plain, " ")
    sizes = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    return flat.filter(pc.not_equal(flat, "")), sizes.astype(np.int64)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters and digits as code points; the number of each text."""
    plain = pc.replace_substring_regex(_normal(texts), r"[^\p{L}\p{N}]+", "")
    sizes = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le"), dtype=np.uint32), sizes


class TestSet:
    """Test items as one sequence of word numbers (``chars``: of characters).

    ``parts`` are ``(item, sentences)`` with sentences that follow one another in the item; a part is searched over
    its sentence bounds, parts of one item are not joined.
    """

    def __init__(self, parts: list[tuple[int, list[str]]], chars: bool):
        self.chars = chars
        texts = pa.array([t for _, sentences in parts for t in sentences], type=pa.string())
        flat, sizes = characters(texts) if chars else words(texts)
        if chars:
            known, ids = np.unique(flat, return_inverse=True)
            self.lookup = np.full(0x110000, -1, dtype=np.int32)
            self.lookup[known] = np.arange(len(known))
            self.n_words = len(known)
        else:
            coded = flat.dictionary_encode()
            self.lookup, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            self.n_words = len(self.lookup)
        self.tokens = np.append(ids.astype(np.int64), -2)  # the last matches nothing
        item_of, part_end, within, self.sentences = [], [], [], []
        at = k = 0
        counted: dict[int, int] = {}
        for item, sentences in parts:
            begin = at
            for _ in sentences:
                if sizes[k]:
                    self.sentences.append((at, int(sizes[k]), item))
                at += int(sizes[k])
                k += 1
            item_of += [item] * (at - begin)
            part_end += [at] * (at - begin)
            within += range(counted.get(item, 0), counted.get(item, 0) + at - begin)
            counted[item] = counted.get(item, 0) + at - begin
        self.item_of, self.part_end = np.array(item_of, dtype=np.int64), np.array(part_end, dtype=np.int64)
        self.within = np.array(within, dtype=np.int64)
        self.longest = int((self.part_end - np.arange(len(item_of))).max()) if item_of else 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, -1 for words that no item uses; the number of words of each text."""
        flat, sizes = characters(texts) if self.chars else words(texts)
        if self.chars:
            return self.lookup[flat].astype(np.int64), sizes
        return pc.fill_null(pc.index_in(flat, value_set=self.lookup), -1).to_numpy(zero_copy_only=False).astype(np.int64), sizes


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of known words, in the order of their first ``depth`` words or more."""
    n = len(sequence)
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    starts = np.flatnonzero(sequence >= 0)
    span = 1
    while span < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: n - span] = rank[span:] + 1 if span < n else 0
        values, new = np.unique(rank * (n + 1) + after, return_inverse=True)
        rank = new.astype(np.int64)
        span *= 2
        if len(values) == n:
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def search(sequence: np.ndarray, order: np.ndarray, test: TestSet, mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest match of every test suffix; the suffixes that match ``mark`` words, with their ranges of ``order`` there."""
    padded = np.concatenate([sequence, np.full(test.longest + 1, -1, dtype=np.int64)])
    count = len(test.item_of)
    length = np.zeros(count, dtype=np.int64)
    active = np.arange(count)
    low, high = np.zeros(count, dtype=np.int64), np.full(count, len(order), dtype=np.int64)
    marked = (active[:0], low[:0], low[:0])

    def bound(lo: np.ndarray, hi: np.ndarray, want: np.ndarray, depth: int, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            seen = padded[order[np.minimum(mid, len(order) - 1)] + depth]
            go = open_ & ((seen <= want) if right else (seen < want))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)

    depth = 0
    while len(active) and len(order):
        active = active[test.part_end[active] - active > depth]
        want = test.tokens[active + depth]
        lo = bound(low[active], high[active], want, depth, False)
        hi = bound(lo, high[active], want, depth, True)
        found = lo < hi
        active = active[found]
        low[active], high[active] = lo[found], hi[found]
        depth += 1
        length[active] = depth
        if depth == mark:
            marked = (active.copy(), low[active].copy(), high[active].copy())
    return (length, *marked)


class InOrder:
    """Length of the longest common subsequence of one sequence with others, bit-parallel."""

    def __init__(self, target: np.ndarray):
        self.n, self.masks = len(target), {}
        for k, x in enumerate(target.tolist()):
            self.masks[x] = self.masks.get(x, 0) | (1 << k)

    def common(self, other: np.ndarray) -> int:
        full = (1 << self.n) - 1
        v = full
        for y in other.tolist():
            m = self.masks.get(y)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return self.n - v.bit_count()


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    return InOrder(a).common(b)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its index repeated, and all positions in the ranges."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of ranges that hold about ``CHUNK`` positions together (one range at least)."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, side="right")))
        yield slice(begin, end)
        begin = end


def _extend(sequence: np.ndarray, where: np.ndarray, test: TestSet, suffix: np.ndarray, known: int) -> np.ndarray:
    """How far the place and the test suffix of each pair go on alike, given that ``known`` words do."""
    shared = np.full(len(where), known, dtype=np.int64)
    active = np.arange(len(where))
    while len(active):
        there, item = where[active] + shared[active], suffix[active] + shared[active]
        inside = (there < len(sequence)) & (item < test.part_end[suffix[active]])
        active, there, item = active[inside], there[inside], item[inside]
        active = active[sequence[there] == test.tokens[item]]
        shared[active] += 1
    return shared


def _verbatim(sequence: np.ndarray, owner: np.ndarray, test: TestSet, run: int, found: dict) -> None:
    """Adds ``(document, item): (kind, length, place, test position)`` of the longest run of each pair, from the suffix array."""
    known = sequence >= 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= run  # a run of known words only can hold one
    if not long.any():
        return
    _, places = _ranges(begin[long], end[long] + 1)  # each stretch with the unknown word behind it
    places = np.minimum(places, len(sequence) - 1)
    stretch = sequence[places]
    order = suffix_array(stretch, test.longest)
    _, suffix, lo, hi = search(stretch, order, test, run)
    for part in _chunks(hi - lo):
        which, at = _ranges(lo[part], hi[part])
        where, s = places[order[at]], suffix[part][which]
        shared = _extend(sequence, where, test, s, run)
        rows = np.lexsort((s, where, -shared, test.item_of[s], owner[where]))
        d, i = owner[where][rows], test.item_of[s][rows]
        best = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])])) if len(rows) else rows
        for doc, item, r in zip(d[best].tolist(), i[best].tolist(), rows[best].tolist()):
            if found.get((doc, item), ("", 0))[1] < shared[r]:
                found[doc, item] = ("verbatim", int(shared[r]), int(where[r]), int(s[r]))


def _sentences(sequence: np.ndarray, owner: np.ndarray, ends: np.ndarray, begins: np.ndarray, test: TestSet, found: dict) -> None:
    """Adds the documents that keep a whole sentence of an item but for some words."""
    index = np.argsort(sequence, kind="stable")
    index = index[np.searchsorted(sequence[index], 0) :]  # places of known words, by word
    first = np.searchsorted(sequence[index], np.arange(test.n_words + 1))
    times = np.diff(first)
    for begin, n, item in test.sentences:
        target = test.tokens[begin : begin + n]
        need, span = math.ceil(n * KEPT - 1e-9), math.ceil(SPAN * n)
        rare = np.unique(target[np.argsort(times[target], kind="stable")[: n - need + 1]])
        _, at = _ranges(first[rare], first[rare + 1])
        if not len(at):
            continue
        at = np.sort(index[at])
        lo, hi = np.maximum(at - span + 1, begins[owner[at]]), np.minimum(at + span, ends[owner[at]])
        fresh = np.concatenate([[True], lo[1:] > hi[:-1]])  # overlapping surroundings are one
        lo, hi = lo[fresh], hi[np.concatenate([fresh[1:], [True]])]
        mine = np.zeros(test.n_words + 1, dtype=bool)
        mine[target] = True
        order = InOrder(target)
        for part in _chunks(hi - lo):
            _, near = _ranges(lo[part], hi[part])
            near = near[mine[sequence[near]]]  # an unknown word is number -1: the last entry, false
            until = np.searchsorted(near, np.minimum(near + span, ends[owner[near]]))
            rich = np.flatnonzero(until - np.arange(len(near)) >= need)  # windows with enough of the words in any order
            if not len(rich):
                continue
            breaks = np.flatnonzero(rich[1:] >= until[rich[:-1]]) + 1  # windows that overlap are first looked at as one
            for group in np.split(rich, breaks):
                a, z = int(group[0]), int(until[group[-1]])
                d, words_near = int(owner[near[a]]), sequence[near[a:z]]
                have = found.get((d, item), ("", 0))
                if have[0] == "verbatim" or have[1] >= n:
                    continue
                most = order.common(words_near)
                if most < need or most <= have[1]:
                    continue
                kept, start = (most, a) if near[z - 1] - near[a] < span else (0, a)
                for k in group.tolist():
                    if kept == most:
                        break
                    here = order.common(words_near[k - a : int(until[k]) - a])
                    kept, start = (here, k) if here > kept else (kept, start)
                if kept >= need and kept > have[1]:
                    found[d, item] = ("sentence", kept, int(near[start]), begin)


def find_in_shard(docs: list[int], tokens: list[np.ndarray], test: TestSet) -> list[tuple]:
    """``(document, item, kind, length, doc_start, item_start)`` of one shard: ``verbatim`` (run length) or ``sentence`` (words kept).

    Starts count words (characters) from 0.
    """
    if not docs or not len(test.item_of):
        return []
    sizes = np.array([len(t) + 1 for t in tokens])
    begins = np.cumsum(sizes) - sizes
    ends = begins + sizes - 1
    sequence = np.full(sizes.sum(), -1, dtype=np.int64)
    for b, t in zip(begins.tolist(), tokens):
        sequence[b : b + len(t)] = t
    owner = np.repeat(np.arange(len(docs)), sizes)
    found: dict[tuple[int, int], tuple] = {}
    _verbatim(sequence, owner, test, RUN_CHARS if test.chars else RUN, found)
    _sentences(sequence, owner, ends, begins, test, found)
    return [(docs[d], i, kind, n, int(place - begins[d]), int(test.within[s])) for (d, i), (kind, n, place, s) in found.items()]


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("length", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64())]
)
_DDL = "doc_id bigint, item_id bigint, kind string, length bigint, doc_start bigint, item_start bigint"


def _search_batches(batches: Iterator[pa.RecordBatch], by_words: list, by_chars: list) -> Iterator[pa.RecordBatch]:
    tests = [TestSet(by_words, False), TestSet(by_chars, True)]
    docs: list[list] = [[], []]
    tokens: list[list] = [[], []]
    sizes = [0, 0]

    def emit(k: int) -> pa.RecordBatch:
        rows = find_in_shard(docs[k], tokens[k], tests[k])
        docs[k], tokens[k], sizes[k] = [], [], 0
        columns = list(zip(*rows)) if rows else [()] * len(RESULT)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, RESULT)], schema=RESULT)

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for k, test in enumerate(tests):
            if not len(test.item_of):
                continue
            some = pc.match_substring_regex(texts, _SCRIPT) if test.chars else pc.is_valid(texts)
            coded, lengths = test.encode(texts.filter(some))
            for doc, part in zip(ids.filter(some).to_pylist(), np.split(coded, np.cumsum(lengths)[:-1])):
                if (part >= 0).any():
                    docs[k].append(doc)
                    tokens[k].append(part)
                    sizes[k] += len(part)
                    if sizes[k] >= SHARD:
                        yield emit(k)
    for k in (0, 1):
        if docs[k]:
            yield emit(k)


def _parts(rows: list) -> tuple[list, list]:
    """The sentences of items (``item_id, start_char, sentence, in_chars``) as parts compared by words and parts compared by characters."""
    parts: tuple[list, list] = ([], [])
    last = None
    for item, _, text, in_chars in sorted(set(rows)):
        if (item, in_chars) != last:
            parts[in_chars].append((item, []))
        parts[in_chars][-1][1].append(text)
        last = (item, in_chars)
    return parts


def find_leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that leaked into it: ``doc_id, item_id, kind, length, doc_start, item_start``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, lang, text``. ``kind`` is ``verbatim`` with the
    length of the longest run, or ``sentence`` with the words kept; the starts are where it begins in document
    and item, in words. Sentences of items in scripts without spaces (by ``lang``, or if most of their letters are)
    are compared by letters and digits. Null and empty texts and ids match nothing; repeated documents give
    one row under each id. Documents are searched whole. Items of more than ``block_chars`` characters are
    searched for in several passes.
    """
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower("lang").alias("lang"), "text").dropna(subset=["item_id", "text"])
    size = known.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("n")).collect()[0].n
    blocks = max(1, -(-int(size) // block_chars))
    letters = F.length(F.regexp_replace("sentence", "[^\\p{L}]", ""))
    script = F.length(F.regexp_replace("sentence", "[^\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}]", ""))
    in_chars = F.coalesce(F.substring("lang", 1, 2).isin(*CHAR_LANGS), F.lit(False)) | (script * 2 > letters)
    asked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").dropna()
    passes = []
    for b in range(blocks):
        mine = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else known
        sentences = split_sentences(mine).select("item_id", "start_char", "sentence", in_chars.alias("in_chars"))
        by_words, by_chars = _parts([tuple(r) for r in sentences.collect()])  # about block_chars characters
        passes.append(asked.mapInArrow(lambda batches, w=by_words, c=by_chars: _search_batches(batches, w, c), _DDL))
    best = F.max(F.struct((F.col("kind") == "verbatim").alias("v"), "length", (-F.col("doc_start")).alias("d"), "kind", "item_start"))
    found = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "item_id", "b.kind", "b.length", (-F.col("b.d")).alias("doc_start"), "b.item_start")


def remove_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents in which nothing leaked; documents without an id stay."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
