import pytest

from claimloom.functions import quantities as Q
from claimloom.operators import units
from pyspark.sql import functions as F

DEFS = [("ram_gb", "number", "GB"), ("screen_size", "number", "in"), ("battery_life_hr", "number", "hr"), ("weight_lb", "number", "lb"),
        ("cpu_cores", "number", None), (None, "number", "GB"), ("odd", None, None)]


def defs(spark):
    return spark.createDataFrame(DEFS, "attribute string, value_type string, common_unit string")


def claims(spark, data):
    """Rows with columns whose names clash with those that the operator makes or uses within."""
    rows = [(i, *r, f"n{i}", 9, "row", "k") for i, r in enumerate(data)]
    return spark.createDataFrame(
        rows, "row_id bigint, canonical_attribute string, value_string string, value_numeric double, unit string, number string, factor int, row string, _key string"
    )


STATED = [  # attribute, text, number, unit -> value in the common unit (None: no quantity), converted
    (("RAM-GB", "up to 16 GB DDR5", None, None), 16, False),
    (("ram_gb", "16,384 MByte", None, None), 16, True),
    (("ram gb", "131072 mb", 131072.0, None), 128, True),
    (("ram_gb", None, 0.5, "TB"), 512, True),
    (("ram_gb", "8", None, "gigabytes"), 8, False),
    (("ram_gb", "8 GB", -1.0, None), 8, False),
    (("ram_gb", None, -9.0, "MB"), None, None),
    (("ram_gb", "-9 GB", None, None), None, None),
    (("ram_gb", "ask seller", None, "GB"), None, None),
    (("ram_gb", "   ", None, None), None, None),
    (("ram_gb", None, float("nan"), "GB"), None, None),
    (("ram_gb", None, float("inf"), "GB"), None, None),
    (("Screen_Size", '13,3"', None, None), 13.3, False),
    (("screen_size", "ca. 14.5-Zoll 16:10", None, None), 14.5, False),
    (("screen_size", "33,782 CM", None, None), 13.3, True),
    (("battery_life_hr", "7:45 h:min", None, None), 7.75, True),
    (("battery_life_hr", "about 9.5 heures of video", None, None), 9.5, False),
    (("battery_life_hr", "61,200", None, "s"), 17, True),
    (("weight_lb", "6 lb 8 oz", None, None), 6.5, True),
    (("weight_lb", "6 lbs., 4 ounces", None, None), 6.25, True),
    (("weight_lb", "2,499", None, "kilo"), 2.499 * 2.2046226218487757, True),
    (("weight_lb", "4.48lb net", None, None), 4.48, False),
    (("cpu_cores", "8 cores", None, None), None, None),
    ((None, "8 GB", None, None), None, None),
]
#: Rows that give each attribute its scale.
PLAIN = [("ram_gb", None, float(v), "GB") for v in (4, 8, 16, 32, 64, 128)] + [("screen_size", None, v, "in") for v in (11.6, 13.3, 14.0, 16.0)] + [
    ("battery_life_hr", None, v, "h") for v in (5.0, 9.0, 12.0, 20.0)] + [("weight_lb", None, v, "lb") for v in (2.0, 3.5, 5.0, 7.5)]


def test_stated_units(spark):
    rows = claims(spark, [r for r, _, _ in STATED] + PLAIN)
    found = {r.row_id: r for r in units.normalise(rows, defs(spark)).collect()}
    for i, (row, value, converted) in enumerate(STATED):
        if value is None:
            assert i not in found, row
        else:
            assert found[i].common_value == pytest.approx(value) and found[i].converted == converted, row
            assert not found[i].assigned and found[i].row == "row" and found[i]._key == "k"


def test_missing_units_by_size(spark):
    bare = [("ram_gb", None, v, None) for v in (16.0, 16384.0, 8192.0, 64.0)] + [("weight_lb", None, v, "furlong") for v in (3.3, 1500.0)]
    found = {r.row_id: r for r in units.normalise(claims(spark, bare + PLAIN * 5), defs(spark)).collect()}
    assert [found[i].unit_key for i in range(6)] == ["gb", "mb", "mb", "gb", "lb", "g"]
    assert [found[i].converted for i in range(6)] == [False, True, True, False, False, True]
    assert all(found[i].assigned and found[i].posterior > 0.9 and not found[i].uncertain for i in range(6))


def test_a_value_between_two_units_is_flagged(spark):
    # 11 kg and 25 lb overlap: what is stated spans more than the factor between the units
    spread = [("weight_lb", None, float(v), "lb") for v in (2, 3, 4, 5, 6, 7, 8)]
    bare = [("weight_lb", None, v, None) for v in (1.1, 1.3, 1.6, 2.2, 3.3, 4.4)]
    found = [r for r in units.normalise(claims(spark, spread + bare), defs(spark)).collect() if r.assigned]
    assert any(r.uncertain for r in found) and all(0 < r.posterior <= 1 for r in found)


def test_empty_and_attribute_without_stated_units(spark):
    assert units.normalise(claims(spark, []), defs(spark)).count() == 0
    found = units.normalise(claims(spark, [("ram_gb", None, 16.0, None)] * 3), defs(spark)).collect()
    assert [r.unit_key for r in found] == ["gb"] * 3
    assert units.normalise(claims(spark, PLAIN), defs(spark).filter("common_unit is null")).count() == 0


def test_long_text(spark):
    found = units.normalise(claims(spark, [("ram_gb", "16 GB " + "very long " * 20000, None, None)] + PLAIN), defs(spark))
    assert found.filter("row_id = 0").head().common_value == 16


@pytest.mark.parametrize(
    "text,expected", [("1,048,576", 1048576), ("1.299,00", 1299), ("0,125", 0.125), ("2.048", 2.048), ("4.194.304", 4194304), ("61'200", 61200), ("7", 7), ("1,048,576.5", 1048576.5)]
)
def test_written_numbers(spark, text, expected):
    assert spark.range(1).select(Q.read_number(F.lit(text)).alias("v")).head().v == expected
