import math
import random

import numpy as np
import pyarrow as pa
import pytest

from claimloom.llm import leaks

ITEM = "Halfway along the amber road the porter loses 459 barrels to Amwick, while the autumn bell near Fatoram counts 3 hours backwards. Every clerk of Lemok asks Torokgus for a tally of salt before noon today."
CHINESE = "一艘渡船从萨多米出发，载着七百箱铜纽扣，每到一站奇贝洛就卸下九分之一。请指出谁在萨多米上空看见灯。"


def find(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    t = spark.createDataFrame([(i, lang, x, 2) for i, lang, x in items], "item_id bigint, lang string, text string, doc_id int")
    return {(r.doc_id, r.item_id): (r.kind, r.length) for r in leaks.find_leaks(d, t, **options).collect()}


def test_kinds_of_leaks(spark):
    w = ITEM.split()
    changed = [x if k % 8 else "grey" for k, x in enumerate(w[:22])]
    docs = [
        (1, "intro. " + ITEM + " end"), (2, " ".join(w[3:13])), (3, " ".join(w[3:12])),
        (4, "> PORTER loses **459**\n> barrels to “Amwick” while <b>the</b> autumn\n> bell near"),
        (5, "so, " + " ".join(changed) + " and on"), (6, "nothing of the kind"), (7, None), (8, ""), (9, " ".join(w[:5] + ["x"] * 30 + w[5:9])),
        (10, CHINESE[3:25]), (11, CHINESE[3:20]), (12, "filler words here " * 30000 + " ".join(w[:12])), (None, ITEM),
        (13, " ".join(w[6:20] + w[20:26])),
    ]
    found = find(spark, docs, [(100, "en", ITEM), (200, "zh", CHINESE), (300, "en", None), (None, "en", ITEM), (400, None, "")])
    assert set(found) == {(1, 100), (2, 100), (4, 100), (5, 100), (10, 200), (12, 100), (13, 100)}
    assert found[2, 100] == ("verbatim", 10) and found[5, 100][0] == "sentence" and found[1, 100][0] == "verbatim"


def test_empty(spark):
    assert find(spark, [], [(1, "en", ITEM)]) == {} and find(spark, [(1, ITEM)], []) == {}


def test_clean_documents(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "clean")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, "en", ITEM)], "item_id bigint, lang string, text string")
    assert [r.doc_id for r in leaks.remove_leaks(docs, leaks.find_leaks(docs, items)).collect()] == [2]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_longest_matches_against_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(6)]
    docs = [(d, " ".join(rng.choice(vocabulary + ["zz"]) for _ in range(rng.randrange(1, 60)))) for d in range(30)]
    test = leaks.TestSet([(i, [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))]) for i in range(8)], False)
    coded, sizes = test.encode(pa.array([t for _, t in docs]))
    parts = np.split(coded, np.cumsum(sizes)[:-1])
    sequence = np.concatenate([x for t in parts for x in (t, np.array([-1]))])
    order = leaks.suffix_array(sequence, test.longest)
    length, _, _, _ = leaks.search(sequence, order, test, 3)
    text = sequence.tolist()
    for s, n in enumerate(length.tolist()):
        rest = test.tokens[s : test.part_end[s]].tolist()
        best = max((k for k in range(len(rest) + 1) for p in range(len(text)) if text[p : p + k] == rest[:k]), default=0)
        assert n == best


def test_common_subsequence():
    assert leaks.common_in_order(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 2, 4])) == 3
    assert leaks.common_in_order(np.array([1, 1, 2]), np.array([2, 1])) == 1


def test_short_and_heavily_changed_sentences(spark):
    short, eight = "Copper gulls seldom sing loudly.", "Seven grey tortoises quietly guard the northern gate."
    mixed, words = "The lighthouse keeper of Pellmore counts eleven lanterns before the tide returns tonight.", "lighthouse keeper of Pellmore counts eleven lanterns before the tide returns"
    docs = [
        (1, "They said copper gulls often sing loudly here."), (2, "copper gulls often whistle loudly"),
        (3, "seven old grey tortoises very quietly guard all the northern gate"), (4, f"so {words} it is"),
        (5, CHINESE), (6, "loudly sing seldom gulls copper"),
    ]
    items = [(1, "en", short), (2, "en", eight), (3, "en", mixed + " " + CHINESE), (4, "en", CHINESE + " " + mixed)]
    found = find(spark, docs, items)
    assert set(found) == {(1, 1), (3, 2), (4, 3), (4, 4), (5, 3), (5, 4)}
    assert found[1, 1] == ("sentence", 4) and found[3, 2] == ("sentence", 8) and found[4, 3] == ("verbatim", 11)
    assert find(spark, docs, items, block_chars=60) == found


def kept_in_order(sentence, doc):
    """The most words of the sentence in order within half as much again as its length, by the plain recurrence."""
    best = 0
    for start in range(len(doc)):
        row = [0] * (len(sentence) + 1)
        for y in doc[start : start + math.ceil(leaks.SPAN * len(sentence))]:
            row = [0] + [max(row[k + 1], row[k] + 1 if x == y else 0, 0) for k, x in enumerate(sentence)]
            for k in range(len(sentence)):
                row[k + 1] = max(row[k + 1], row[k])
        best = max(best, row[-1])
    return best


@pytest.mark.parametrize("seed,chars", [(1, False), (2, False), (3, True)])
def test_no_changed_sentence_is_lost(seed, chars):
    """Against brute force, for sentences of any length and changes of any kind."""
    rng = random.Random(seed)
    vocabulary = [chr(0x4E00 + k) if chars else f"w{k}" for k in range(40)]
    join = "".join if chars else " ".join
    sentences = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 18))] for _ in range(12)]
    docs = []
    for _ in range(300):
        w = list(rng.choice(sentences))
        for _ in range(rng.randrange(1 + len(w) // 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(3)] = [rng.choice(vocabulary + ["\u9fa0" if chars else "zz"]) for _ in range(rng.randrange(3))]
        docs.append([rng.choice(vocabulary) for _ in range(rng.randrange(6))] + w + [rng.choice(vocabulary) for _ in range(rng.randrange(6))])
    test = leaks.TestSet([(i, [join(s)]) for i, s in enumerate(sentences)], chars)
    coded, sizes = test.encode(pa.array([join(d) for d in docs]))
    run = leaks.RUN_CHARS if chars else leaks.RUN
    found = {(d, i): (kind, n) for d, i, kind, n, _, _ in leaks.find_in_shard(list(range(len(docs))), np.split(coded, np.cumsum(sizes)[:-1]), test)}
    for d, doc in enumerate(docs):
        for i, s in enumerate(sentences):
            kept = kept_in_order(s, doc)
            verbatim = any(doc[p : p + run] == s[q : q + run] for q in range(len(s) - run + 1) for p in range(len(doc)))
            assert ((d, i) in found) == (verbatim or kept * 5 >= len(s) * 4), (doc, s)
            if found.get((d, i), ("",))[0] == "sentence":
                assert found[d, i][1] == kept
