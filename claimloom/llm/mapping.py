"""Free-entered values mapped to the closest entry of a reference list, in SQL only.

Partition-based pigeonhole join. Every entry is written in the forms people use (brand moved to the
end, left out or cut short; the bracketed name alone; common synonyms). Each form is cut into k + 1
segments. A value with at most k edits keeps at least one segment whole, shifted by at most k, so an
equality join on (attribute, digits, form length, segment, substring) finds every such pair. The
built-in ``levenshtein`` verifies; an anti join reports the values that no entry matches.

Letters may have ``least(k, 0.45 * length)`` edits. In forms under ``short`` letters one edit is allowed
where no other entry of the attribute is written within two edits of the form, and none in forms that are
cut short. Digits name a model: another digit is another model, but a number of four digits or more with
one digit too few or too many is a slip, counted as one edit.

What to ignore is decided by the list. A phrase of ``NOISE`` is dropped from the values of an attribute only
if none of its entries holds such a phrase, so ``64 GB`` is noise behind a processor and a difference between
modules. A value that still matches nothing is looked at once more without the words that no entry of the
attribute uses, if at least two thirds of it are left; it must then match without an edit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimloom.session import cut, discard, spread

#: Letters of other scripts that look Latin, and letters with marks, by the letter they are typed for.
LOOKALIKE_FROM = "аеорсухіјѕвкмнтԁɡ" + "àáâãäåāçèéêëēìíîïīñòóôõöøōùúûüūýÿß"
LOOKALIKE_TO = "aeopcyxijsbkmhtdg" + "aaaaaaaceeeeeiiiiinooooooouuuuuyys"

#: Phrases that add nothing to what is named where no entry of the attribute has them, and words used for one
#: another. No braces: the texts are format strings.
NOISE = (
    r"@?\s*\d+([.,]\d+)?\s*ghz(\s+boost)?", r"\b\d+\s*cores?\b", r"\bw/\s*\d+\s*w\b|\b\d+\s*w\b(?!/)", r"\b\d+\s*[gtm]b\b", r"@?\s*\b\d+\s*hz\b",
    r"\bprocessor\b", r"\b[cg]pu\b", r"\bgraphics card\b", r"\bmobile chip\b", r"\bdedicated\b", r"\bedition(?!\pL)", r"\bpreinstalled(?!\pL)",
    r"\b(x64|64[- ]?bit)(?!\pL)", r"\ben/de(?!\pL)", r"\bos:", r"\b(pixels?|px)(?!\pL)", r"\bips(?!\pL)", r"\bdisplay(?!\pL)", r"\bv(?=\d)",
)
SYNONYMS = (("pro", "professional"), ("lts", "long term support"), ("lite", "light"), ("desktop", "desk"))

#: The most edits that count as a slip, and the form length below which at most one does.
MAX_EDITS = 4
SHORT = 6


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, r'{pattern}', '{by}')"


def _folded(text: str) -> str:
    seen = _replace(text, "[​-‏­﻿]", "")
    return _replace(f"translate(lower({seen}), '{LOOKALIKE_FROM}', '{LOOKALIKE_TO}')", r"\((r|tm|c)\)|[®™©]", "")


def _ungrouped(text: str) -> str:
    """Folded text without number grouping; an O among digits is a zero."""
    whole = _replace(_folded(text), r"(?<=\d)o(?=[\dox\s*@(.,/×]|hz|$)", "0")
    return _replace(whole, r"(?<=\d),(?=\d\d\d(?!\d))", "")


def _spaced(text: str) -> str:
    """Words with single spaces, without the marks between two sides."""
    whole = _replace(text, r"(?<=\d)\s*(x|×|\*|/|by)\s*(?=\d)", " ")
    return f"trim({_replace(whole, '[^\\pL\\pN]+', ' ')})"


def _plain(text: str) -> str:
    return _spaced(_ungrouped(text))


def _without_noise(text: str) -> str:
    """``text`` without the phrases that no entry of the attribute has; ``used`` holds a flag per phrase."""
    for i, noise in enumerate(NOISE):
        text = f"regexp_replace({text}, CASE WHEN used[{i}] THEN '(?!)' ELSE r'{noise}' END, ' ')"
    return text


def _letters(text: str) -> str:
    return _replace(text, r"[^\pL]", "")


def _digits(text: str) -> str:
    return f"trim({_replace(text, '[^0-9]+', ' ')})"


def _key(text: str) -> str:
    return _replace(f"lower({text})", r"[^\pL\pN]", "")


_BRACKET = r"r'^([^(]*)[(]([^)]*)[)]'"
_REST = "concat_ws(' ', slice(t, 2, size(t) - 1))"
_SWAPS = ", ".join(f"struct('{a}' AS a, '{b}' AS b)" for a, b in SYNONYMS)

FORMS = rf"""
WITH listed AS (
  SELECT entry_id, {_key("attribute")} AS key, {_plain("entry")} AS plain,
         {_plain(f"regexp_extract(entry, {_BRACKET}, 1)")} AS outside, {_plain(f"regexp_extract(entry, {_BRACKET}, 2)")} AS inside
  FROM {{entries}} WHERE entry IS NOT NULL AND attribute IS NOT NULL
), cut AS (
  SELECT *, split(plain, ' ') AS t, split(outside, ' ') AS o FROM listed WHERE plain <> ''
), written AS (
  SELECT entry_id, key, explode(concat(
    transform(array(plain, outside, inside), f -> struct(f AS form, true AS whole)),
    transform(concat(
      CASE WHEN size(t) > 1 THEN array(
        concat_ws(' ', {_REST}, t[0]),
        CASE WHEN {_REST} RLIKE '[0-9][0-9][0-9]' THEN {_REST} END,
        CASE WHEN t[0] RLIKE r'^\pL\pL\pL\pL\pL+$' THEN concat_ws(' ', left(t[0], 3), {_REST}) END)
      ELSE array() END,
      CASE WHEN outside RLIKE '^[0-9]+ [0-9]+$' THEN array(concat_ws(' ', o[1], o[0]), concat_ws(' ', o[1], o[0], inside)) ELSE array() END,
      transform(array({_SWAPS}), s -> regexp_replace(plain, concat(r'\b', s.a, r'\b'), s.b))
    ), f -> struct(f AS form, false AS whole))
  )) AS w
  FROM cut
)
SELECT entry_id, key, w.form, {_letters("w.form")} AS letters, {_digits("w.form")} AS digits, bool_or(w.whole) AS whole
FROM written WHERE w.form <> '' GROUP BY ALL
"""

#: Which phrases of NOISE the entries of each attribute have.
USED = f"""
SELECT {_key("attribute")} AS key, array({", ".join(f"bool_or({_ungrouped('entry')} RLIKE r'{n}')" for n in NOISE)}) AS used
FROM {{entries}} WHERE entry IS NOT NULL AND attribute IS NOT NULL GROUP BY 1
"""

#: The values as words, with ``used`` of their attribute.
PLAIN = f"""
SELECT key, value, {_spaced("kept")} AS plain FROM (
  SELECT a.key, a.value, {_without_noise(_ungrouped("a.value"))} AS kept FROM {{asked}} a JOIN {{used}} u ON a.key = u.key)
"""

#: All ways to leave one digit out of a number of four or more.
_LEFT_OUT = """filter(transform(sequence(1, greatest(length(digits), 1)),
  p -> CASE WHEN substring(digits, p, 1) <> ' ' AND length(regexp_extract(substring(digits, 1, p), '[0-9]+$', 0)) + length(regexp_extract(substring(digits, p + 1), '^[0-9]+', 0)) >= {least}
            THEN concat(substring(digits, 1, p - 1), substring(digits, p + 1)) END), x -> x IS NOT NULL)"""
#: A short form and what is left of it without one or two letters.
_SHORTER = """array_distinct(flatten(transform(sequence(0, length(letters)), a -> transform(sequence(0, length(letters)), b -> concat(
  substring(letters, 1, least(a, b) - 1), substring(letters, least(a, b) + 1, greatest(a, b) - least(a, b) - 1), CASE WHEN a = b THEN substring(letters, a + 1) ELSE substring(letters, greatest(a, b) + 1) END)))))"""

#: Segment i (from 0) of the k + 1 that a form of n letters is cut into starts at ``start`` (from 1) and has ``len`` letters.
MATCH = f"""
WITH lettered AS (
  SELECT entry_id, key, letters, digits, bool_or(whole) AS whole FROM {{forms}} GROUP BY ALL
), brief AS (
  SELECT entry_id, key, letters, digits, explode({_SHORTER}) AS part FROM lettered WHERE length(letters) BETWEEN 1 AND :short + 1
), crowded AS (
  SELECT DISTINCT a.key, a.letters, a.digits FROM brief a JOIN brief b ON a.key = b.key AND a.digits = b.digits AND a.part = b.part
  WHERE a.entry_id <> b.entry_id AND length(a.letters) < :short AND levenshtein(a.letters, b.letters) <= 2
), forms AS (
  SELECT f.*, length(f.letters) AS n, CASE WHEN length(f.letters) >= :short THEN least(:k, CAST(floor(0.45 * length(f.letters)) AS INT))
         WHEN f.whole AND length(f.letters) >= 3 AND c.key IS NULL THEN least(:k, 1) ELSE 0 END AS k
  FROM lettered f LEFT JOIN crowded c ON f.key = c.key AND f.letters = c.letters AND f.digits = c.digits
), segments AS (
  SELECT *, n DIV (k + 1) + CASE WHEN i < n % (k + 1) THEN 1 ELSE 0 END AS len, i * (n DIV (k + 1)) + least(i, n % (k + 1)) + 1 AS start
  FROM forms LATERAL VIEW explode(sequence(0, k)) s AS i
), pieces AS (
  SELECT entry_id, key, digits, letters, n, k, i, substring(letters, CAST(start AS INT), CAST(len AS INT)) AS piece FROM segments
), cuts AS (
  SELECT DISTINCT key, digits, n, k, i, CAST(start AS INT) AS start, CAST(len AS INT) AS len FROM segments
), read AS (
  SELECT key, value, {_letters("plain")} AS typed, {_digits("plain")} AS digits FROM {{plain}}
), numbers AS (
  SELECT DISTINCT key, digits FROM forms
), asked_numbers AS (
  SELECT DISTINCT key, digits FROM read
), slips AS (
  SELECT n.key, n.digits AS asked, n.digits, 0 AS slip FROM numbers n
  UNION ALL SELECT DISTINCT key, asked, digits, 1 FROM (SELECT key, digits, explode({_LEFT_OUT.format(least=4)}) AS asked FROM numbers) WHERE :k > 0
  UNION ALL SELECT DISTINCT a.key, a.digits, n.digits, 1 FROM (SELECT key, digits, explode({_LEFT_OUT.format(least=5)}) AS x FROM asked_numbers) a
    JOIN numbers n ON a.key = n.key AND a.x = n.digits WHERE :k > 0
), typed AS (
  SELECT r.key, r.value, r.typed, s.digits, s.slip FROM read r JOIN slips s ON r.key = s.key AND r.digits = s.asked
), sized AS (
  SELECT key, value, typed, digits, slip, length(typed) + d AS n FROM typed LATERAL VIEW explode(sequence(-:k, :k)) x AS d
), shifted AS (
  SELECT z.key, z.value, z.typed, z.digits, z.slip, c.n, c.k, c.i, c.start, c.len
  FROM sized z JOIN cuts c ON z.key = c.key AND z.digits = c.digits AND z.n = c.n AND abs(length(z.typed) - c.n) <= c.k
), substrings AS (
  SELECT DISTINCT key, value, typed, digits, slip, n, i, substring(typed, start + d, len) AS piece
  FROM shifted LATERAL VIEW explode(sequence(-k, k)) y AS d WHERE start + d >= 1 AND start + d + len - 1 <= length(typed)
), candidates AS (
  SELECT DISTINCT s.key, s.value, s.typed, s.slip, p.entry_id, p.letters, p.k
  FROM substrings s JOIN pieces p ON s.key = p.key AND s.digits = p.digits AND s.n = p.n AND s.i = p.i AND s.piece = p.piece
), verified AS (
  SELECT key, value, entry_id, levenshtein(typed, letters) + slip AS edits FROM candidates WHERE levenshtein(typed, letters) <= k
)
SELECT key, value, min_by(entry_id, struct(edits, entry_id)) AS entry_id, min(edits) AS edits FROM verified GROUP BY key, value
"""

#: Values without a match as they are without the words that no entry of the attribute uses, where two thirds are left.
REDUCED = """
WITH rest AS (SELECT p.key, p.value, p.plain FROM {plain} p LEFT ANTI JOIN {matched} m ON p.key = m.key AND p.value = m.value),
known AS (SELECT DISTINCT key, explode(split(form, ' ')) AS word FROM {forms}),
words AS (SELECT key, value, plain, at, word FROM rest LATERAL VIEW posexplode(split(plain, ' ')) w AS at, word),
kept AS (SELECT w.key, w.value, w.plain, array_join(transform(array_sort(collect_list(struct(at, w.word AS word))), x -> x.word), ' ') AS less
  FROM words w LEFT SEMI JOIN known k ON w.key = k.key AND w.word = k.word GROUP BY w.key, w.value, w.plain)
SELECT key, value, less AS plain FROM kept WHERE less <> plain AND length(less) * 3 >= length(plain) * 2
"""

REPORT = """
SELECT key, value, entry_id, edits FROM {matched}
UNION ALL
SELECT v.key, v.value, CAST(-1 AS BIGINT), CAST(NULL AS INT) FROM {asked} v LEFT ANTI JOIN {matched} m ON v.key = m.key AND v.value = m.value
"""

ASKED = f"""
WITH typed AS (SELECT row_id, {_key("canonical_attribute")} AS key, value_string AS value FROM {{rows}} WHERE {_replace("value_string", r"[\s\pZ]", "")} <> ''),
named AS (SELECT DISTINCT {_key("attribute")} AS key, entry FROM {{entries}} WHERE entry IS NOT NULL)
SELECT r.row_id, r.key, r.value FROM typed r LEFT SEMI JOIN named n ON r.key = n.key LEFT ANTI JOIN named e ON r.key = e.key AND r.value = e.entry
"""


def map_values(values: DataFrame, entries: DataFrame, k: int = MAX_EDITS, short: int = SHORT) -> DataFrame:
    """Distinct ``(key, value)`` pairs with the entry each means: ``key, value, entry_id, edits``.

    ``entry_id`` is -1 and ``edits`` null where no entry is near enough; this covers blank values,
    stand-ins for "no answer" and values of attributes without entries. Of several near entries the
    one with the fewest edits wins, then the smallest id. Null values and keys are left out.
    ``entries`` has ``entry_id, attribute, entry``; repeated entries count once, other columns are ignored.
    """
    spark = values.sparkSession
    asked = cut(values.select("key", "value").filter("key IS NOT NULL AND value IS NOT NULL").distinct())
    forms = cut(spark.sql(FORMS, entries=entries))
    plain = cut(spark.sql(PLAIN, asked=spread(asked), used=spark.sql(USED, entries=entries)))
    exact = cut(spark.sql(MATCH, args={"k": k, "short": short}, forms=forms, plain=spread(plain)))
    reduced = cut(spark.sql(REDUCED, plain=plain, matched=exact, forms=forms))
    matched = cut(exact.unionByName(spark.sql(MATCH, args={"k": 0, "short": short}, forms=forms, plain=reduced)))
    for used_up in (forms, plain, exact, reduced):
        discard(used_up)
    return spark.sql(REPORT, matched=matched, asked=asked)


def map_rows(rows: DataFrame, entries: DataFrame, k: int = MAX_EDITS, short: int = SHORT) -> DataFrame:
    """Each row whose attribute has entries and whose value is neither null, blank nor an entry: ``row_id, entry_id``.

    ``rows`` has ``row_id, canonical_attribute, value_string``. Distinct values are matched once and
    joined back, so a popular slip costs one match. Repeated rows stay repeated.
    """
    spark = rows.sparkSession
    asked = spark.sql(ASKED, rows=rows, entries=entries)
    mapped = map_values(asked, entries, k, short)
    return spark.sql("SELECT r.row_id, m.entry_id FROM {asked} r JOIN {mapped} m ON r.key = m.key AND r.value = m.value", asked=asked, mapped=mapped)
