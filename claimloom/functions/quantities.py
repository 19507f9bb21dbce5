"""Numbers and units out of free text, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit spellings by unit, and units by the common unit with the factor into it.
SPELLINGS = {
    "mb": ("mb", "mbyte", "mbytes", "megabyte", "megabytes", "mib", "megaoctet", "mo"),
    "gb": ("gb", "gbyte", "gbytes", "gigabyte", "gigabytes", "gib", "gigaoctet", "go"),
    "tb": ("tb", "tbyte", "tbytes", "terabyte", "terabytes", "tib", "teraoctet", "to"),
    "kb": ("kb", "kbyte", "kbytes", "kilobyte", "kilobytes", "kib"),
    "in": ("in", "inch", "inches", "zoll", "pouce", "pouces", "pulgada", "pulgadas", '"', "″", "”", "''"),
    "cm": ("cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter"),
    "mm": ("mm", "millimetre", "millimetres", "millimeter", "millimeters"),
    "hr": ("hr", "hrs", "h", "hour", "hours", "std", "stunde", "stunden", "heure", "heures", "hora", "horas"),
    "min": ("min", "mins", "minute", "minutes", "minuten", "minutos"),
    "s": ("s", "sec", "secs", "second", "seconds", "sekunden", "secondes", "segundos"),
    "lb": ("lb", "lbs", "pound", "pounds", "pfund", "livre", "livres", "libra", "libras"),
    "oz": ("oz", "ounce", "ounces", "unze", "unzen"),
    "kg": ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramm", "kilogramme", "kilogrammes"),
    "g": ("g", "gr", "gram", "grams", "gramm", "gramme", "grammes", "gramos"),
}
FACTORS = {
    "gb": {"gb": 1.0, "mb": 1 / 1024, "tb": 1024.0, "kb": 1 / 1048576},
    "in": {"in": 1.0, "cm": 1 / 2.54, "mm": 1 / 25.4},
    "hr": {"hr": 1.0, "min": 1 / 60, "s": 1 / 3600},
    "lb": {"lb": 1.0, "kg": 2.2046226218487757, "g": 2.2046226218487757 / 1000, "oz": 1 / 16},
}

#: Marks that only group digits: spaces and quotes, any mark with three digits and another mark behind it, a comma before
#: three last digits unless the whole part is 0, and a dot there if another dot came before.
GROUPING = "['\\u00a0\\u202f]|[.,](?=\\d{3}[.,])|(?<!^0),(?=\\d{3}$)|(?<=\\.\\d{3})\\.(?=\\d{3}$)"
NEGATIVE = "^[^\\p{L}\\p{N}]*[-\\u2212]\\s?\\d"
_NUMBER = "\\d(?:[\\d.,'\\u00a0\\u202f]*\\d)?"


def _spelling_map() -> Column:
    return F.create_map(*[F.lit(x) for unit, names in SPELLINGS.items() for name in names for x in (name, unit)])


def unit_of(text: Column) -> Column:
    """The unit that a spelling means (case, dots and space aside), or null."""
    return F.try_element_at(_spelling_map(), F.regexp_replace(F.lower(text), "[.\\s\\p{Z}]", ""))


def number_token(text: Column, nth: int = 1) -> Column:
    """The nth number in a text as written; null where there is none."""
    pattern = f"({_NUMBER})" if nth == 1 else f"{_NUMBER}(?:\\D+)({_NUMBER})"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def read_number(token: Column) -> Column:
    """A written number as DOUBLE.

    With both marks, or with one mark repeated, the grouping mark is the one that comes first or
    repeats. A single comma before exactly three digits is read as decimal if the whole part is 0 and
    as a grouping mark otherwise; a single dot is a decimal point.
    """
    ungrouped = F.regexp_replace(token, GROUPING, "")
    return F.translate(ungrouped, ",", ".").try_cast("double")


def decimal_comma_reading(token: Column) -> Column:
    """The other reading of the one doubtful form, ``d,ddd``: the comma as decimal mark. Null for any other form."""
    return F.when(token.rlike("^[1-9]\\d{0,2},\\d{3}$"), F.regexp_replace(token, ",", ".").try_cast("double"))


def positive(number: Column) -> Column:
    """A finite number above zero, else null (NaN and the infinities are no quantities)."""
    return F.when((number > 0) & (number < F.lit(float("inf"))), number)  # NaN sorts above infinity


def text_number(text: Column) -> Column:
    """The first number of a text if it is above zero and not written as negative; else null."""
    token = number_token(text)
    negative = text.rlike(NEGATIVE)
    return F.when(~negative, positive(read_number(token)))


def usable_number(numeric: Column, text: Column) -> Column:
    """The number that a row states: ``numeric`` if above zero, else the one readable in ``text``, else null."""
    return F.coalesce(positive(numeric), text_number(text))


def spelled(word: Column) -> Column:
    """``unit_of`` for a captured word, where the empty capture means no unit."""
    return unit_of(F.nullif(word, F.lit("")))


#: A number, then its unit (a hyphen or space between is allowed); a second number with its unit; a clock form with its legend.
UNIT_AFTER = f"{_NUMBER}[\\s\\p{{Z}}]*-?[\\s\\p{{Z}}]*(\\p{{L}}+|\"|″|”|'')"
SECOND = f"{_NUMBER}[\\s\\p{{Z}}]*-?(?:\\p{{L}}+|\"|″|'')[.,]?[\\s\\p{{Z}}]*,?[\\s\\p{{Z}}]*({_NUMBER})[\\s\\p{{Z}}]*(\\p{{L}}+)"
CLOCK = "(\\d+):(\\d{1,2})\\s*(?:h:min|h:mm|hh:mm|hrs?:mins?|h\\b|std)"


def factor_into(common: Column, unit: Column) -> Column:
    """What a number in ``unit`` is multiplied by to be in ``common`` (both as unit keys); null if unrelated."""
    pairs = [F.lit(x) for c, units in FACTORS.items() for u, f in units.items() for x in (f"{c}|{u}", f)]
    return F.try_element_at(F.create_map(*pairs), F.concat(common, F.lit("|"), unit))
