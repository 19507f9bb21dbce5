import os
import random

import pytest

from claimloom.llm import packing, shingles, similar


def items(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, n_tokens bigint, source string, cluster bigint")


def check(rows, data, capacity):
    used, got = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        got.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.n_tokens))
    assert all(u <= capacity for u in used.values())
    for doc, n, _, _ in data:
        if not n or n < 0 or doc is None:
            continue
        pieces = sorted(got[doc])
        assert [p for p, _, _ in pieces] == list(range(-(-n // capacity))) and sum(t for _, _, t in pieces) == n
        assert [s for _, s, _ in pieces] == [p * capacity for p, _, _ in pieces]
    return used


@pytest.mark.parametrize("shard_tokens", [4_000_000, 3000])
def test_whole_items_in_bounds(spark, shard_tokens):
    rng = random.Random(1)
    data = [(i, rng.choice([1, 5, 20, 60, 99, 100, 101, 350]), rng.choice(["a", "b", None]), None) for i in range(400)] + [(900, 0, "a", 1), (901, None, "a", 1), (None, 5, "a", 1)]
    rows = packing.pack(items(spark, data), 100, shard_tokens).collect()
    used = check(rows, data, 100)
    assert not any(r.conflict for r in rows)
    assert sum(used.values()) / (100 * len(used)) > 0.9
    f = packing.fill(packing.pack(items(spark, data), 100, shard_tokens), 100).head()
    assert f.tokens == sum(used.values()) and f.containers >= f.least_containers


def test_members_of_a_cluster_stay_apart(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(1, 40), rng.choice("abc"), i % 25 if i < 200 else i) for i in range(600)]
    rows = packing.pack(items(spark, data), 100).collect()
    check(rows, data, 100)
    cluster = {d[0]: d[3] for d in data}
    seen = [(r.container_id, cluster[r.doc_id]) for r in rows if not r.conflict]
    assert len(seen) == len(set(seen)) and not any(r.conflict for r in rows)


def test_a_cluster_larger_than_the_bins_shares_rather_than_wastes(spark):
    data = [(i, 10, "a", 7) for i in range(300)]
    rows = packing.pack(items(spark, data), 100).collect()
    used = check(rows, data, 100)
    assert len(used) <= 31 and any(r.conflict for r in rows)


def test_one_task_goes_to_the_tightest_bin():
    placed = packing.pack_shard([(60, 1, None, None), (50, 2, None, None), (40, 3, None, None), (45, 4, None, None)], 100)
    assert placed[0][0] == placed[2][0] and placed[1][0] == placed[3][0]
    # the tightest bin holds the cluster already: the next one that fits is taken
    placed = packing.pack_shard([(60, 1, None, 9), (50, 2, None, None), (40, 3, None, 9)], 100, slack=1.0)
    assert placed[2][0] == placed[1][0] != placed[0][0]


def test_empty(spark):
    assert packing.pack(items(spark, []), 100).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")
def test_documents(spark):
    spam = "LIMITED OFFER!!! Genuine cells for every model, 83% off. Write to sales now! Stock is low."
    texts = [spam, spam + " ref 1", spam.lower(), None, "", "short", "<|endoftext|> is plain text here", "word " * 5000, "这是一个句子。" * 30] + [f"note {i} about the {i * i} th unit of this long list of units" for i in range(40)]
    docs = spark.createDataFrame([(i, t, "Board-A", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, n_tokens int")
    clusters = {r.doc_id: r.cluster for r in packing.near_duplicates(docs).collect()}
    assert clusters[0] == clusters[1] == clusters[2] == 0 and clusters[5] == 5 and 3 not in clusters
    rows = packing.pack_documents(docs, 256).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts))) - {3, 4}
    sizes = {r.doc_id: r.n_tokens for r in packing.count_tokens(docs).collect()}
    other = packing.TOKENIZER.replace(".tiktoken", ".json")
    if os.path.exists(other):
        assert {r.doc_id: r.n_tokens for r in packing.count_tokens(docs, other).collect()} == sizes
    assert sizes[4] == 0 and sizes[6] > 5 and sizes[7] >= 5000
    check(rows, [(i, sizes.get(i), None, None) for i in range(len(texts))], 256)
    homes = [r.container_id for r in rows if r.doc_id in (0, 1, 2)]
    assert len(set(homes)) == 3


def test_sources_share_only_where_no_bin_is_free_of_them(spark):
    rng = random.Random(4)
    data = [(i, rng.randrange(5, 40), rng.choice("abcdefgh"), None) for i in range(400)]
    rows = packing.pack(items(spark, data), 100, slack=None).collect()
    used = check(rows, data, 100)
    assert sum(used.values()) / (100 * len(used)) > 0.95 and not any(r.conflict for r in rows)
    source = {d[0]: d[2] for d in data}
    shared = sum(r.same_source for r in rows)
    plain = packing.pack_shard([(n, (i, 0), None, None) for i, n, _, _ in data], 100)
    beside = sum(1 for b in set(p[0] for p in plain) for held in [[data[k][2] for k, p in enumerate(plain) if p[0] == b]] for _ in range(len(held) - len(set(held))))
    assert shared < beside
    assert sum(1 for c in used for h in [[source[r.doc_id] for r in rows if r.container_id == c]] for _ in range(len(h) - len(set(h)))) <= shared


def test_clusters_are_kept_apart_at_any_price_without_slack(spark):
    rows = packing.pack(items(spark, [(i, 10, "a", 7) for i in range(50)]), 100, slack=None).collect()
    assert len({r.container_id for r in rows}) == 50 and not any(r.conflict for r in rows)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))] for _ in range(25)]
    texts = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        texts.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    docs = spark.createDataFrame([*texts, (900, None), (901, "?!"), (0, texts[0][1])], "doc_id bigint, text string")
    sets = {}
    for i, t in texts:
        w = t.lower().replace(",", "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {r.doc_id: r.cluster for r in packing.near_duplicates(docs).collect()} == root
    found = {r.doc_id: len(r.elements) for r in shingles.shingle_sets(docs).collect()}
    assert found == {i: len(s) for i, s in sets.items()}
    assert similar.fewest_alike(54, 0.8) > 20
