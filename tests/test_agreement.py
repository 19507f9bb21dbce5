import pytest

from claimloom.operators import agreement, canonical
from hypothesis import given, settings
from hypothesis import strategies as st


def rows(spark, data):
    return spark.createDataFrame(data, "source_id bigint, product_id string, attribute string, value string, row_id bigint")


def group(values):
    return [(i, "p", "a", v, i) for i, v in enumerate(values)]


@pytest.mark.parametrize("values,expected", [(["5.3"] * 3, 1.0), (["5.3", "5.3", "5.2"], 2 / 3), (["5.3", "5.2", "5.1"], 1 / 3)])
def test_property_agreement(spark, values, expected):
    found = agreement.property_agreement(rows(spark, group(values))).head()
    assert found.agreement == pytest.approx(expected) and found.support == 3
    assert sum(found.counts.values()) == 3


def test_edge_weights_sum_to_one_over_values(spark):
    found = agreement.agreement_edges(rows(spark, group(["8", "8", "8", "2"]))).collect()
    assert sorted(r.weight for r in found) == [0.25, 0.75, 0.75, 0.75]
    assert sum({r.value: r.weight for r in found}.values()) == pytest.approx(1.0)


def test_remove_ambiguous(spark):
    data = [
        (1, "p", "a", "x", 1), (1, "p", "a", "x", 2), (1, "p", "a", None, 3),  # one value, a repeat and a null: all stay
        (2, "p", "a", "x", 4), (2, "p", "a", "y", 5),  # two values: gone
        (3, "p", "a", None, 6),  # only nulls: gone
        (None, "p", "a", "z", 7),  # a null key part is a key like any other
    ]
    found = agreement.remove_ambiguous(rows(spark, data))
    assert sorted(r.row_id for r in found.collect()) == [1, 2, 3, 7]
    assert tuple(agreement.ambiguous_count(rows(spark, data)).head()) == (2, 2)


def test_summary_and_empty(spark):
    data = group(["a", "a"]) + [(i, "q", "a", v, i) for i, v in enumerate("ab")] + [(1, "r", "a", "a", 1)]
    assert tuple(agreement.agreement_summary(agreement.property_agreement(rows(spark, data))).head()) == (1, 1, 2)
    empty = rows(spark, [])
    assert agreement.agreement_edges(empty).count() == 0 and agreement.property_agreement(empty).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 1000))
def test_tenths_round_like_doubles(spark, salt):
    pairs = [(n, d) for d in range(1, 61) for n in range(1, d + 1) if (n * 31 + d + salt) % 3 == 0]
    found = spark.createDataFrame(pairs, "n bigint, d bigint").withColumn("t", agreement.tenth(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "nd")))
    assert all(r.t == round(r.n / r.d, 1) for r in found.collect())


def test_canonical_forms(spark):
    data = [
        (1, "p", "bluetooth_version", "Bluetooth 5.3", None, None), (2, "p", "bluetooth_version", "BT 5.3", None, None),
        (3, "p", "bluetooth_version", "Version 5.3", None, None), (4, "p", "bluetooth_version", "n/a", None, None),
        (5, "p", "ram_gb", "16", 16.0, "GB"), (6, "p", "ram_gb", None, None, None), (7, "p", "colour", "red", None, None), (8, "p", None, "x", None, None),
    ]
    raw = spark.createDataFrame(data, "source_id bigint, product_id string, canonical_attribute string, value_string string, value_numeric double, unit string")
    found = canonical.canonicalise(canonical.filter_vocabulary(raw))
    assert {r.source_id: r.value for r in found.collect()} == {1: "5.3", 2: "5.3", 3: "5.3", 4: None, 5: "16.0", 6: None}
    nodes = canonical.claim_nodes(found)
    assert nodes.select("claim_hash").distinct().count() == 2 and nodes.count() == 4
    import hashlib

    assert hashlib.sha256(b"p|bluetooth_version|5.3|None").hexdigest() in {r.claim_hash for r in nodes.collect()}
    assert {(r.canonical_attribute, r.skipped) for r in canonical.skipped_claims(found).collect()} == {("bluetooth_version", 1), ("ram_gb", 1)}
    assert [r.raw_value for r in canonical.skipped_examples(found).collect()] == ["n/a"]
    assert canonical.raw_claims(raw).count() == 8
