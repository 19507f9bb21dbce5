"""Quantities recorded in different units, brought to one unit per attribute.

Stated units are read by expression. Where a row states none, the unit comes from a mixture on the
log scale: one component per known unit, all of the same shape (that of the rows with stated units,
in the common unit), shifted by the log of the conversion factor. Expectation-maximisation fits the
component weights; each row gets the unit of highest posterior, and a flag where that is not clear.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import attributes as A
from claimloom.functions import quantities as Q
from claimloom.session import cut

#: Width of a bin of ln(value). Doubles span about 1,500 of ln, so an attribute has at most 75,000 bins whatever the rows.
BIN = 0.02
#: Assigned bins up to this many are broadcast (some 50 bytes each); those of very many attributes are joined by shuffle.
BROADCAST_BINS = 1_000_000
EM_ROUNDS = 200
#: Who writes no unit mostly means the common one: it starts with this share of the unstated rows on top of what they show.
COMMON_PRIOR = 0.5


def parse(rows: DataFrame, definitions: list[dict]) -> DataFrame:
    """What each row of a measured attribute states: ``row`` (all its columns), ``attribute, common_key, number, unit_key, factor, rest, number_alt``.

    Rows of other attributes are left out. ``number`` is null where nothing usable is stated (null,
    blank, zero, negative, NaN, infinite or a stand-in). ``factor`` is null where no known unit is
    stated; ``rest`` is what a second part (``6 lb 8 oz``) adds in the common unit; ``number_alt`` is
    the other reading of ``d,ddd``. The steps stay separate projections so that each pattern runs once a row.
    """
    measured = [d for d in definitions if d["unit"] is not None]
    kept = ("row",)
    stated_in = ("value_string", "value_numeric", "unit")
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *stated_in, A.attribute_key(F.col("canonical_attribute")).alias("_key"))
    keyed = keyed.filter(F.col("_key").isin(*[d["key"] for d in measured])) if measured else keyed.filter(F.lit(False))
    low, names = F.col("_low"), {d["key"]: d["attribute"] for d in measured}
    units = {d["key"]: _common_key(d["unit"]) for d in measured}
    captured = keyed.withColumn("_low", F.lower("value_string")).select(
        *kept,
        A.by_key(F.col("_key"), names, "string").alias("attribute"),
        A.by_key(F.col("_key"), units, "string").alias("common_key"),
        "unit",
        Q.positive(F.col("value_numeric")).alias("_numeric"),
        Q.number_token(low).alias("_token"),
        low.rlike(Q.NEGATIVE).alias("_negative"),
        F.regexp_extract(low, Q.UNIT_AFTER, 1).alias("_word"),
        F.regexp_extract(low, Q.SECOND, 1).alias("_token2"),
        F.regexp_extract(low, Q.SECOND, 2).alias("_word2"),
        F.regexp_extract(low, Q.CLOCK, 1).try_cast("double").alias("_hours"),
        F.regexp_extract(low, Q.CLOCK, 2).try_cast("double").alias("_minutes"),
    )
    in_text = F.col("_numeric").isNull()
    read = captured.select(
        *kept, "attribute", "common_key", "_numeric",
        F.when(~F.col("_negative"), Q.read_number(F.col("_token"))).alias("_read"),
        F.when(in_text, Q.decimal_comma_reading(F.col("_token"))).alias("number_alt"),
        Q.spelled(F.col("_word")).alias("_unit_text"),
        Q.unit_of(F.col("unit")).alias("_unit_column"),
        F.when(in_text, F.regexp_replace("_token2", ",", ".").try_cast("double")).alias("_number2"),
        F.when(in_text, Q.spelled(F.col("_word2"))).alias("_unit2"),
        F.when(in_text & (F.col("common_key") == "hr"), F.col("_hours") + F.col("_minutes") / 60).alias("_clock"),
    )
    stated = read.withColumn("_text_number", Q.positive(F.col("_read"))).select(
        *kept, "attribute", "common_key", "number_alt",
        F.coalesce("_clock", "_numeric", "_text_number").alias("number"),
        F.coalesce("_unit_text", "_unit_column").alias("_unit"),
        F.when(F.col("_unit2") != F.col("_unit_text"), F.col("_number2") * Q.factor_into(F.col("common_key"), F.col("_unit2"))).alias("_rest"),
        F.col("_clock").isNotNull().alias("_is_clock"),
    ).withColumn("_factor", Q.factor_into(F.col("common_key"), F.col("_unit")))
    return stated.select(
        *kept, "attribute", "common_key", "number",
        F.when(F.col("_is_clock"), F.lit("h:min")).when(F.col("_factor").isNotNull(), F.col("_unit")).alias("unit_key"),
        F.when(F.col("_is_clock"), F.lit(1.0)).otherwise(F.col("_factor")).alias("factor"),
        F.when(~F.col("_is_clock") & (F.col("_rest") > 0) & F.col("_factor").isNotNull(), F.col("_rest")).otherwise(F.lit(0.0)).alias("rest"),
        "number_alt",
    )


def _common_key(unit: str) -> str:
    plain = unit.lower().replace(".", "").strip()
    return next((k for k, names in Q.SPELLINGS.items() if plain in names), plain)


def histogram(parsed: DataFrame) -> list:
    """Counts by (attribute, stated or not, bin of ln(value)): statistics of all rows, bounded by the bins."""
    stated = F.col("factor").isNotNull()
    value = F.when(stated, F.col("number") * F.col("factor") + F.col("rest")).otherwise(F.col("number"))
    counts = (
        parsed.filter(F.col("number").isNotNull() & ~(stated & F.col("number_alt").isNotNull()))
        .groupBy("attribute", "common_key", stated.alias("stated"), F.floor(F.log(value) / BIN).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return list(counts.toLocalIterator())  # a partition at a time


def _shape(bins: np.ndarray, n: np.ndarray):
    """A density of ln(value): a kernel estimate with a broad floor, as a function of x."""
    x = (bins + 0.5) * BIN
    mean = np.average(x, weights=n)
    spread = max(math.sqrt(np.average((x - mean) ** 2, weights=n)), 0.05)
    width = max(0.06, 0.15 * spread * n.sum() ** -0.2)
    total = n.sum()

    def density(at: np.ndarray) -> np.ndarray:
        kernel = np.zeros(len(at))
        for lo in range(0, len(at), 2048):  # bounded memory: blocks of bins against bins
            z = (at[lo : lo + 2048, None] - x[None, :]) / width
            kernel[lo : lo + 2048] = (np.exp(-0.5 * z * z) * n).sum(1) / (total * width * math.sqrt(2 * math.pi))
        wide = np.exp(-0.5 * ((at - mean) / (4 * spread)) ** 2) / (4 * spread * math.sqrt(2 * math.pi))
        return 0.999 * kernel + 0.001 * wide

    return density, mean


def centres(counts: list) -> dict[str, float]:
    """Mean ln(value in the common unit) of the rows with a stated unit, by attribute."""
    total: dict[str, list[float]] = {}
    for r in counts:
        if r.stated:
            t = total.setdefault(r.attribute, [0.0, 0.0])
            t[0] += (r.bin + 0.5) * BIN * r.n
            t[1] += r.n
    return {k: s / n for k, (s, n) in total.items()}


def fit(counts: list) -> list[tuple]:
    """Posterior unit of every bin of the rows without a unit: ``(attribute, bin, unit, factor, posterior)``.

    An attribute without any stated unit takes its shape from the unstated rows themselves, which
    leaves them in the common unit unless a second cluster lies a conversion factor away.
    """
    table = []
    by_attribute: dict[tuple, dict[bool, list]] = {}
    for r in counts:
        by_attribute.setdefault((r.attribute, r.common_key), {True: [], False: []})[r.stated].append((r.bin, r.n))
    for (attribute, common), sides in sorted(by_attribute.items()):
        if not sides[False]:
            continue
        units = Q.FACTORS.get(common, {common: 1.0})
        names, logs = list(units), np.log(np.array(list(units.values())))
        bins, n = (np.array(v, dtype=float) for v in zip(*sorted(sides[False])))
        known = sides[True] or sides[False]
        density, _ = _shape(*(np.array(v, dtype=float) for v in zip(*sorted(known))))
        x = (bins + 0.5) * BIN
        like = np.stack([density(x + shift) for shift in logs])
        weight = np.full(len(names), 1 / len(names))
        prior = np.array([COMMON_PRIOR if name == common else 0.0 for name in names]) * n.sum()
        for _ in range(EM_ROUNDS):
            joint = weight[:, None] * like
            new = (joint / joint.sum(0) * n).sum(1) + prior
            new /= new.sum()
            if np.abs(new - weight).max() < 1e-10:
                break
            weight = new
        joint = weight[:, None] * like
        posterior = joint / joint.sum(0)
        best = posterior.argmax(0)
        for b, k, p in zip(bins, best, posterior.max(0)):
            table.append((attribute, int(b), names[k], float(np.exp(logs[k])), float(p)))
    return table


def normalise(rows: DataFrame, defs: DataFrame, certain: float = 0.9) -> DataFrame:
    """Every quantity of the measured attributes in its common unit.

    Result: the columns of ``rows`` (own names win over equal ones there) plus ``attribute``,
    ``number`` as stated, ``unit_key`` (stated or assigned), ``common_unit``, ``common_value``,
    ``converted`` (another unit or scale was stated or found), ``assigned`` (the unit came from the
    mixture), ``posterior`` and ``uncertain`` (posterior below ``certain``). One row per row with a
    usable number; repeated rows stay repeated. Empty input gives an empty result.
    A common unit without known conversions is a ``ValueError``.
    """
    definitions = A.read_definitions(defs)
    parsed = cut(parse(rows, definitions))  # read twice: for the statistics and for the result
    counts = histogram(parsed)
    table = fit(counts)
    centre = A.by_key(F.col("attribute"), centres(counts), "double")
    off = lambda number: F.abs(F.log(number * F.coalesce("factor", F.lit(1.0))) - centre)
    unknown = sorted({d["unit"] for d in definitions if d["unit"] is not None} - {d["unit"] for d in definitions if d["unit"] is not None and _common_key(d["unit"]) in Q.FACTORS})
    if unknown:
        raise ValueError(f"no conversions into {', '.join(unknown)}: add them to FACTORS and SPELLINGS")
    spark = rows.sparkSession
    assigned = spark.createDataFrame(table, "_a string, _bin bigint, _unit string, _factor double, _p double")
    stated = F.col("factor").isNotNull()
    used = (
        parsed.filter(F.col("number").isNotNull())
        .withColumn("number", F.when(stated & (off(F.col("number_alt")) < off(F.col("number"))), F.col("number_alt")).otherwise(F.col("number")))
        .withColumn("_b", F.when(~stated, F.floor(F.log("number") / BIN)))
    )
    # one row per bin and attribute: bounded by the range of doubles, not by the rows
    assigned = F.broadcast(assigned) if len(table) <= BROADCAST_BINS else assigned
    joined = used.join(assigned, (F.col("attribute") == F.col("_a")) & (F.col("_b") == F.col("_bin")), "left")
    factor = F.coalesce("factor", "_factor", F.lit(1.0))
    unit = F.coalesce("unit_key", "_unit")
    own = ("attribute", "number", "unit_key", "common_unit", "common_value", "converted", "assigned", "posterior", "uncertain")
    common_unit = A.by_key(
        A.attribute_key(F.col("attribute")), {d["key"]: d["unit"] for d in definitions if d["unit"] is not None}, "string"
    )
    return joined.select(
        *[F.col(f"row.`{c}`") for c in rows.columns if c.lower() not in own],
        "attribute",
        "number",
        unit.alias("unit_key"),
        common_unit.alias("common_unit"),
        (F.col("number") * factor + F.col("rest")).alias("common_value"),
        ((unit != F.col("common_key")) | (F.col("rest") > 0)).alias("converted"),
        (~stated).alias("assigned"),
        F.when(~stated, F.coalesce("_p", F.lit(0.0))).alias("posterior"),
        (~stated & (F.coalesce("_p", F.lit(0.0)) < certain)).alias("uncertain"),
    )
