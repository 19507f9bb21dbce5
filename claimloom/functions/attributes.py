"""Attribute names and stand-ins for "no answer"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing answer, after trimming and lower-casing (fixed values, to be extended by callers).
STAND_INS = (
    "n/a", "na", "n.a.", "none", "none given", "null", "nil", "nan", "unknown", "undefined", "unspecified",
    "not specified", "not listed", "not given", "not available", "not applicable", "no data", "no answer",
    "blank", "(blank)", "empty", "(empty)", "(none)", "tbd", "tba", "tbc", "to be confirmed", "to be announced",
    "to be determined", "ask seller", "see box", "see description", "s/o", "k. a.", "k.a.", "keine angabe",
    "unbekannt", "inconnu", "desconocido", "sin datos", "missing", "pending",
)

#: A definitions table is schema metadata: one output column each. More rows than this is not a column list.
MAX_ATTRIBUTES = 5000


def attribute_key(name: Column) -> Column:
    """The spelling-free form of an attribute name: lower case, letters and digits only (null stays null)."""
    return F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]", "")


def trimmed(text: Column) -> Column:
    """Text without white space (Unicode too) at either end."""
    return F.regexp_replace(text, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def is_stand_in(text: Column, stand_ins: tuple[str, ...] = STAND_INS) -> Column:
    """True for blank text, for text without any letter or digit, and for the listed stand-ins. Null gives null."""
    plain = F.lower(trimmed(text))
    return plain.isin(*stand_ins) | ~plain.rlike("[\\p{L}\\p{N}]")


def usable_text(text: Column) -> Column:
    """Trimmed text, or null where it is blank or stands for no answer."""
    return F.when(~is_stand_in(text), trimmed(text))


def read_definitions(defs: DataFrame) -> list[dict]:
    """The attribute definitions as schema metadata: name, key, type, common unit, in name order.

    Names that differ only in spelling count once (the first in order wins); rows without a name or
    type are left out. The table is a column list, so its size is checked, never cut.
    """
    rows = defs.select("attribute", "value_type", "common_unit").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"attribute definitions exceed {MAX_ATTRIBUTES} rows; they are a list of columns")
    found: dict[str, dict] = {}
    for r in sorted((r for r in rows if r.attribute is not None and r.value_type is not None), key=lambda r: r.attribute):
        key = "".join(c for c in r.attribute.lower() if c.isalnum())
        found.setdefault(key, {"attribute": r.attribute, "key": key, "type": r.value_type, "unit": r.common_unit})
    return list(found.values())


def by_key(key: Column, values: dict[str, object], kind: str) -> Column:
    """A constant per attribute key, as a literal map (codegen, no join); null for other keys."""
    if not values:
        return F.lit(None).cast(kind)
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind)
