import pytest

from claimloom.operators import widen

DEFS = [("ram_gb", "number", "GB"), ("cpu model", "text", None), ("wifi", "label", None), ("touch", "flag", None)]


def defs(spark):
    return spark.createDataFrame(DEFS, "attribute string, value_type string, common_unit string")


def claims(spark, data):
    rows = [(i, *r, 1.5, "e") for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "row_id bigint, product_id string, canonical_attribute string, value_string string, value_numeric double, num double, entity string")


DATA = [
    ("p1", "RAM_GB", "16 GB", None), ("p1", "ram gb", None, 16.0), ("p1", "ram-gb", "32", None),
    ("p1", "CPU_Model", " Quill 7 ", None), ("p1", "wifi", "AX", None), ("p1", "wifi", "n/a", None), ("p1", "Touch", "YES", None),
    ("p2", "ram_gb", "ask seller", -1.0), ("p2", "touch", "perhaps", None), ("p2", "wifi", "", None),
    ("p3", "colour", "red", None), (None, "ram_gb", "8", None), ("p4", None, "8", None), ("p4", "ram_gb", None, None),
    ("", "ram_gb", "4", None),
]


def test_wide_rows(spark):
    found = {r.product_id: r for r in widen.widen(claims(spark, DATA), defs(spark)).collect()}
    assert set(found) == {"p1", "p2", "p4", ""}
    one = found["p1"]
    assert (one.ram_gb, one["cpu model"], one.wifi, one.touch, one.empty_columns) == (16.0, "Quill 7", "ax", True, [])
    assert sorted(found["p2"].empty_columns) == ["ram_gb", "wifi"] and found["p2"].touch is None
    assert found["p4"].empty_columns == ["ram_gb"] and found[""].ram_gb == 4.0


def test_ties_go_to_the_last_row(spark):
    found = widen.widen(claims(spark, [("p", "wifi", "ax", None), ("p", "wifi", "be", None)]), defs(spark)).head()
    assert found.wifi == "be"


def test_empty_cells(spark):
    cells = {tuple(r) for r in widen.empty_cells(widen.widen(claims(spark, DATA), defs(spark))).collect()}
    assert cells == {("p2", "ram_gb"), ("p2", "wifi"), ("p4", "ram_gb")}


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_entities_across_arrow_batches(spark, batch):
    data = [(f"p{i % 40}", a, f"{i % 9 + 1}", None) for i in range(400) for a in ("ram_gb", "wifi")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = widen.widen(claims(spark, data), defs(spark)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len({r.product_id for r in found}) == 40
    assert all(r.ram_gb is not None and r.wifi is not None for r in found)


def test_empty_input_and_no_definitions(spark):
    empty = widen.widen(claims(spark, []), defs(spark))
    assert empty.count() == 0 and empty.columns == ["product_id", "cpu model", "ram_gb", "touch", "wifi", "empty_columns"]
    none = widen.widen(claims(spark, DATA), defs(spark).limit(0))
    assert none.count() == 0 and none.columns == ["product_id", "empty_columns"] and widen.empty_cells(none).count() == 0


def test_long_values_and_one_hot_product(spark):
    long = "word " * 50000
    data = [("hot", "cpu model", long, None)] + [("hot", "ram_gb", str(k % 5 + 1), None) for k in range(3000)]
    row = widen.widen(claims(spark, data), defs(spark)).head()
    assert row["cpu model"] == long.strip() and row.ram_gb in (1.0, 2.0, 3.0, 4.0, 5.0)
