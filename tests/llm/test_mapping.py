import random

import pytest

from claimloom.llm import mapping

ENTRIES = [
    (1, "cpu_model", "Korvex Quill 79682"), (2, "cpu_model", "Korvex Quill 68776"), (3, "cpu_model", "Tarnis Ember 54583H"),
    (4, "operating_system", "Lumora 10 Home"), (5, "operating_system", "Lumora 11 Home"), (6, "operating_system", "Lumora 10 Pro"),
    (7, "operating_system", "Fennix 22 LTS"), (8, "display", "1920 x 1080 (FHD)"), (9, "display", "2560 x 1440 (QHD)"), (9, "display", "2560 x 1440 (QHD)"),
    (10, None, "x"), (11, "display", None),
]


def entries(spark):
    return spark.createDataFrame([(*e, "clash") for e in ENTRIES], "entry_id bigint, attribute string, entry string, value string")


def mapped(spark, data):
    rows = spark.createDataFrame([(i, a, v, "k", 3) for i, (a, v) in enumerate(data)], "row_id bigint, canonical_attribute string, value_string string, key string, entry_id int")
    return {r.row_id: r.entry_id for r in mapping.map_rows(rows, entries(spark)).collect()}


CASES = [
    ("CPU-Model", "korvex quill 79682", 1), ("cpu_model", "Quill 79682", 1), ("cpu_model", "Kor. Quill 68776", 2), ("cpu_model", "Quill 79682, Korvex", 1),
    ("cpu_model", "KorvexQuill68776", 2), ("cpu_model", "krovex quilll 68776", 2), ("cpu_model", "Кorvех Quill 79682", 1), ("cpu_model", "Körvéx Qüïll 79682", 1),
    ("cpu_model", "Korvex(R) Quill 79682 (8 cores, 3.1 GHz boost)", 1), ("cpu_model", "Tarnis Ember 54583H @ 2.4GHz", 3), ("cpu_model", "Korvex Quill 79683", -1),
    ("cpu_model", "Zephra Nine 49", -1), ("cpu_model", "n/a", -1), ("cpu_model", "—", -1), ("cpu_model", "x" * 30000, -1),
    ("operating system", "lumora 10 hme", 4), ("operating_system", "Lum. 11 Home", 5), ("operating_system", "Lumora 10 Professional", 6), ("operating_system", "Lumora v10 Pro x64", 6),
    ("operating_system", "Fennix 22 long term support", 7), ("operating_system", "OS: Lumora 10 Home Edition", 4), ("operating_system", "Harrow 3", -1), ("operating_system", "dual boot on request", -1),
    ("display", "1080 x 1920", 8), ("display", "fhd", 8), ("display", "256O x 1440", 9), ("display", "2,560 x 1,440", 9), ("display", "QHD(2560x1440) IPS", 9),
    ("display", "1920×1080@120Hz", 8), ("display", "5120 x 1440", -1), ("display", "UHD", -1),
]


def test_forms(spark):
    found = mapped(spark, [(a, v) for a, v, _ in CASES])
    wrong = [(v, found.get(i), e) for i, (_, v, e) in enumerate(CASES) if found.get(i) != e]
    assert not wrong


def test_what_is_no_case(spark):
    rows = [("cpu_model", "Korvex Quill 79682"), ("cpu_model", None), ("cpu_model", "  "), ("colour", "red"), (None, "Korvex"), ("cpu_model", "korvex quill 79682"), ("cpu_model", "korvex quill 79682")]
    assert mapped(spark, rows) == {5: 1, 6: 1}
    assert mapped(spark, []) == {}


def test_no_entries(spark):
    rows = spark.createDataFrame([("cpumodel", "anything")], "key string, value string")
    found = mapping.map_values(rows, entries(spark).limit(0)).collect()
    assert [(r.value, r.entry_id, r.edits) for r in found] == [("anything", -1, None)]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_pigeonhole_join_loses_no_pair(spark, seed):
    """Against the edit distance of every value to every form."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(6, 14))) for _ in range(12)]
    listed = spark.createDataFrame([(i, "w", w) for i, w in enumerate(words)], "entry_id bigint, attribute string, entry string")
    typed = set()
    for _ in range(250):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "cd"])
        typed.add("".join(w))
    typed.discard("")
    values = spark.createDataFrame([("w", t) for t in typed], "key string, value string")
    found = {r.value: (r.entry_id, r.edits) for r in mapping.map_values(values, listed).collect()}
    for t in typed:
        # a one-word form stands for itself and for its first three letters
        forms = [(w, i) for i, w in enumerate(words)] + [(w[:3], i) for i, w in enumerate(words)]
        near = [(lev(t, f), i) for f, i in forms if lev(t, f) <= (0 if len(f) < mapping.SHORT else min(4, int(0.45 * len(f))))]
        assert found[t][0] == (min(near)[1] if near else -1), t


def test_what_is_noise_is_decided_by_the_list(spark):
    listed = spark.createDataFrame(
        [(1, "module", "Orin 64 GB"), (2, "module", "Orin 128 GB"), (3, "city", "Rome"), (4, "city", "Paris"), (5, "city", "Bonn"), (6, "city", "Born"), (7, "cpu", "Korvex Quill 79682"), (8, "cpu", "Vantor Gleam 4827")],
        "entry_id bigint, attribute string, entry string",
    )
    cases = [
        ("module", "orin 128gb", 2), ("module", "ORIN 64GB", 1), ("module", "Orin 32 GB", -1), ("module", "orin", -1), ("city", "Rme", 3), ("city", "rome", 3), ("city", "Pariis", 4),
        ("city", "Bonm", -1), ("city", "Boon", -1), ("cpu", "Korvex Quill 7968", 7), ("cpu", "Korvex Quill 796822", 7), ("cpu", "Korvex Quill 79683", -1), ("cpu", "Quill 79682 64 GB", 7),
        ("cpu", "Vantor Gleam 4827 w/ 115W", 8), ("cpu", "Korvex Quill 79682 tray", 7), ("cpu", "Quill boxed tray retail", -1),
    ]
    values = spark.createDataFrame([(k, v) for k, v, _ in cases], "key string, value string")
    found = {(r.key, r.value): r.entry_id for r in mapping.map_values(values, listed).collect()}
    assert {(k, v): found[k, v] for k, v, _ in cases} == {(k, v): e for k, v, e in cases}
