"""Sentence units of posts in many languages and scripts, in SQL expressions only.

Marks that end no sentence (in decimals, file names, URLs, initials, abbreviations, ordinals and
quotations) are replaced one for one by private-use placeholders, so every offset stays that of the
original text. Separators are then put in: first around lines and blocks that are units of their own
(quote headers, list lines, signature lines, tags, blank lines), then after the terminators of each
script. The pieces between separators, with placeholders turned back, are the units; a piece starts at
its first character that is neither white space, quote prefix, markup, bullet nor decoration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders: a full stop, the ASCII quote opening and closing, and the terminators within quotations.
DOT, OPEN, CLOSE = "\ue001", "\ue002", "\ue003"
INNER = {".": "\ue004", "!": "\ue005", "?": "\ue006", "…": "\ue007", "。": "\ue008", "！": "\ue009", "？": "\ue00a", "।": "\ue00b"}
SEP, SIGNED = "\ue010", "\ue011"
ENDS = ".!?…。！？।"
_INNER = "".join(INNER.values())

#: Abbreviations that never end a sentence, and those that end one only before a capital.
NEVER = (
    "Dr|Prof|St|Mr|Mrs|Ms|Sr|Sra|Jr|Fr|Hr|Mme|Mlle|No|Nr|núm|num|vs|ca|approx|aprox|abt|env|ver|vol|fig|cf|ex|ej|esp|incl|inkl|resp|bzw|"
    "e\ue001g|i\ue001e|c\ue001-à-d|c\\.-à-d|max|acc|pág|págs|pp|стр|ок|тыс|млн|रु|डॉ|श्री|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|zzgl|usw|evtl|ggf"
)
AT_CAPITAL = (
    "lb|lbs|oz|in|ft|min|hrs|hr|sec|Inc|Co|Corp|Ltd|etc|pls|p\ue001m|a\ue001m|U\ue001S|U\ue001K|r\ue001p\ue001m|руб|г|гг|д|Std|Min"
)
DOTTED = "e\ue001g|i\ue001e|z\ue001b|d\ue001h|u\ue001a|p\ue001ej|т\ue001е|c\ue001-à-d"
ORDINAL_AFTER = "am|dem|der|den|des|zum|vom|beim|im|seit|ab|bis"
EMOTICON = "(?::D|:P|:\\)|:\\(|:-\\)|:-\\(|;\\)|;-\\)|:/|xD|XD|\\^\\^|<3|[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]\\x{FE0F}?)"
HEADER = "(?:On\\s[^\\n]+,\\s)?[\\p{L}\\p{N}_.\\-]+\\s(?:wrote|schrieb|写道|escribió|a écrit|написала?|さんは書きました|ने लिखा|เขียนว่า):|quoting\\s[^\\s:]+:"
BLOCK_TAG = "</?(?:p|br|div|blockquote|ul|ol|li|hr|table|tr|td|h[1-6])\\b[^<>\\n]*+>|\\[/?quote(?:=[^\\]\\n]*+)?\\]"
INLINE_TAG = "</?(?:b|i|u|em|strong|a|span|code|s)\\b[^<>\\n]*+>|\\[/?(?:b|i|u|s|code|url)(?:=[^\\]\\n]*+)?\\]"
RULE = "(?:-{2,}|_{3,}|~{3,}|={3,})[ \\t]*"

_ONE = "[\\p{L}&&[^\\p{IsHan}\\p{IsThai}\\p{IsHiragana}\\p{IsKatakana}]]"
_START = "(?<![\\p{L}\\p{N}\\p{M}])"
_CLOSERS = f"(?:[\"'»”“’」』)\\]{CLOSE}]|{INLINE_TAG}|\\*\\*|(?<=[\\p{{L}}\\p{{N}}{ENDS}])__)*"
_JUNK = f"(?:[\\s\\p{{Z}}\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]|&nbsp;|{BLOCK_TAG}|{INLINE_TAG}|[>|*_~=#$•·‣◦+{SIGNED}-]|{EMOTICON})*+"
_GAP = "[\\s\\p{Z}>]"


def masked(text: Column) -> Column:
    """The text with placeholders for marks that end no sentence; as many code points as before."""
    t = F.translate(text, f"{DOT}{OPEN}{CLOSE}{_INNER}{SEP}{SIGNED}\r", "�" * (6 + len(INNER) - 1) + " ")
    r = F.regexp_replace
    # the mark comes first in each pattern, so that the look-behinds run at marks only
    # dots with letters or digits on both sides, but not a sentence end whose space is missing
    t = r(t, "\\.(?=[\\p{L}\\p{N}/])(?<=[\\p{L}\\p{N}\\p{M}]\\.)(?!(?<=\\p{Ll}\\p{Ll}\\.)\\p{Lu}[\\p{Ll}\\s'’])", DOT)
    t = r(t, "\\.(?=\\p{N})(?<![\\p{L}\\p{N}]\\.)", DOT)
    # initials and one-letter abbreviations; a unit letter behind a number is none
    t = r(t, f"\\.(?!\\.)(?<={_ONE}\\.)(?<![\\p{{L}}\\p{{N}}\\p{{M}}]{_ONE}\\.)(?<!\\p{{N}}[\\s\\u00a0>]{{1,4}}\\p{{Lu}}\\.)(?<!{DOT}{_ONE}\\.)", DOT)
    t = r(t, f"\\.(?!\\.)(?<={DOT}{_ONE}\\.)(?:(?={_GAP}+[\\p{{Ll}}\\p{{N}}(&]|[,;:)])|(?<={_START}(?i:{DOTTED})\\.))", DOT)
    t = r(t, f"\\.(?!\\.)(?={_GAP}*[\\p{{L}}\\p{{N}}(,;:)]|$)(?<={_START}(?i:{NEVER})\\.)", DOT)
    t = r(t, f"\\.(?!\\.)(?={_GAP}+[\\p{{Ll}}\\p{{N}}(&]|[,;:)])(?<={_START}(?:{AT_CAPITAL})\\.)", DOT)
    t = r(t, f"\\.(?={_GAP}+\\p{{L}})(?<=\\d\\.)(?<=\\b(?:{ORDINAL_AFTER})[ \\n]{{1,3}}\\d{{1,2}}\\.)", DOT)
    t = r(t, f"{DOT}(?={_GAP}+\\p{{L}})(?<={_START}[Nn]o{DOT})", ".")
    # ASCII quotes get a direction
    t = r(t, f"\"(?=[^\\s\\p{{Z}}])(?:(?<![^\\s\\p{{Z}}(\\[\\]>*{OPEN}«“„]\")|(?<=&nbsp;\"))", OPEN)
    t = r(t, "(?<=[^\\s\\p{Z}])\"(?=[\\s\\p{Z}).,;:!?\\]<*\\[]|$)", CLOSE)
    return t


def _nest(opening: str, closing: str, marks: str) -> str:
    """A quotation of any length, with quotations of its own kind inside."""
    return f"{opening}[^{marks}]*+(?:{opening}[^{marks}]*+{closing}[^{marks}]*+)*+{closing}"


#: A text as quotations and what is between them. “ ” „ follow one another, so that one range holds them.
_QUOTATIONS = (
    _nest("«", "»", "«»"), _nest("「", "」", "「」"), _nest(OPEN, CLOSE, OPEN + CLOSE), "„[^“-„]*+“", _nest("“", "”", "“-„"), "”[^“-„]*+”", "»[^«»]*+«",
)
_PARTS = f"{'|'.join(_QUOTATIONS)}|[^«「„“”»{OPEN}]++|."


def quoted(t: Column) -> Column:
    """Terminators within quotations as placeholders; a quotation that is not closed, or only after another opened, is none."""
    parts = F.regexp_extract_all(t, F.lit(f"(?s){_PARTS}"), F.lit(0))
    marked = F.transform(parts, lambda p: F.when(p.rlike(f"^[«「„“”»{OPEN}](?s:.)*[»」“”«{CLOSE}]$"), F.translate(p, ENDS, _INNER)).otherwise(p))
    return F.when(t.rlike(f"[»」”“«{CLOSE}]"), F.array_join(marked, "")).otherwise(t)


def _signed(t: Column) -> Column:
    """A mark behind the rule over a signature and behind each of its lines but the last."""
    # the line behind a rule and, as \\G is the end of the match before, every line that follows it
    rule = "(?<=[-_~= \\t])(?<=(?:^|\\n)[> ]{0,6}(?:-{2,8}|_{3,8}|~{3,8}|={3,8})[ \\t]{0,3})"
    marked = F.regexp_replace(t, f"((?!\\A)\\G[^\\n]+|{rule})\\n(?=[^\\n])", f"$1{SIGNED}")
    return F.when(t.rlike("(?:--|___|~~~|===)[ \\t]*\\n"), marked).otherwise(t)


def _lines(t: Column) -> Column:
    """Separators around blocks: blank lines, tags, headers, list lines, rules and signature lines, changes of quote depth."""
    r = F.regexp_replace
    signed = F.transform(
        F.split(t, SIGNED),
        lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.translate(F.substring_index(p, "\n", 1), ENDS, _INNER), F.regexp_replace(p, "^[^\n]*+", ""))),
    )
    t = F.when(F.contains(t, F.lit(SIGNED)), F.array_join(signed, f"{SIGNED}{SEP}")).otherwise(t)
    t = r(t, f"({BLOCK_TAG})", f"{SEP}$1{SEP}")
    t = r(t, "(\\n[>\\s\\p{Z}]*\\n)", f"$1{SEP}")
    t = r(t, f"(?m)^([> \\t]*)((?:{HEADER})[ \\t]*)$", f"{SEP}$1$2{SEP}")
    t = r(t, "(?m)^([> \\t]*(?:[-*•·‣◦+][ \\t]+|•)[^\\n]*)$", f"{SEP}$1{SEP}")
    t = r(t, f"(?m)^([> \\t]*{RULE})(?=$|{SIGNED})", f"{SEP}$1{SEP}")
    t = r(t, f"(?md)^({SEP}?>[^\\n]*+\\n)(?=[^>\\n{SEP}])", f"$1{SEP}")
    return r(t, f"(?md)^({SEP}?[^>\\n{SEP}][^\\n]*+\\n)(?=>)", f"$1{SEP}")


def _sentences(t: Column) -> Column:
    """Separators after terminators, by script."""
    r = F.regexp_replace
    emotion = f"(?:{_GAP}*{EMOTICON})*"
    # a bracket or quote that closes in mid-sentence goes on in lower case
    t = r(t, f"[.](?=[)\\]]+{_GAP}+\\p{{Ll}})", DOT)
    wide = f"[。！？।…]|(?<=[。！？।…])[.!?]|[!?](?=[!?]*[。！？])"
    t = r(t, f"((?:{wide})[{ENDS}]*{_CLOSERS}{emotion})(?=[^{ENDS}]|$)", f"$1{SEP}")
    t = r(t, f"([.!?][{ENDS}]*{_CLOSERS}{emotion})(?=[\\s\\p{{Z}}<{SEP}]|&nbsp;|$)", f"$1{SEP}")
    t = r(t, f"([!?]+|\\.\\.+|(?<=\\p{{Ll}})\\.)(?=[\\p{{L}}¿¡{OPEN}«„“])", f"$1{SEP}")
    quoted = f"([{_INNER}][\\s\\u00a0]?[»”“{CLOSE}]{_CLOSERS}{emotion})(?={_GAP}+(?:{INLINE_TAG}|\\*\\*)*[\\p{{Lu}}¿¡{OPEN}«„(])"
    t = r(t, quoted, f"$1{SEP}")
    t = r(t, f"((?<=[\\s\\p{{Z}}]){EMOTICON})(?={_GAP}|$)(?!{_GAP}+{EMOTICON})", f"$1{SEP}")
    return r(t, f"(\\p{{IsThai}}[^\\s\\p{{Z}}{SEP}]*+)(?=[\\s\\p{{Z}}])(?!{_GAP}*{EMOTICON})", f"$1{SEP}")


def _restored(piece: Column) -> Column:
    return F.translate(piece, f"{DOT}{OPEN}{CLOSE}{_INNER}{SIGNED}", '.""' + "".join(INNER) + "\n")


#: Offsets are summed in runs of this many pieces, then over runs, so that the cost stays near linear in the text.
RUN = 256


def split_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence unit: the columns of ``docs`` but ``text``, then ``start_char``, ``sentence``.

    ``start_char`` counts code points from 0. Null, empty and blank texts and texts without any letter
    or digit have no units. Units come trimmed at both ends. Columns of ``docs`` named like the results
    are replaced. Repeated documents give repeated rows.
    """
    own = ("start_char", "sentence", text.lower())
    kept = ("row",)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own], F.lit(True).alias("_")).alias("row")
    begun = docs.filter(F.col(text).isNotNull()).select(whole, masked(F.col(text)).alias("_m"))
    # separate projections, so that each pattern runs once
    quotes = begun.select(*kept, quoted(F.col("_m")).alias("_m")).select(*kept, _signed(F.col("_m")).alias("_m"))
    cut = quotes.select(*kept, _lines(F.col("_m")).alias("_m")).select(*kept, F.split(_sentences(F.col("_m")), SEP).alias("_p"))
    runs = F.transform(
        F.sequence(F.lit(0), ((F.size("_p") - 1) / RUN).cast("int")), lambda i: F.slice("_p", i * RUN + 1, F.lit(RUN))
    )
    totals = F.transform("_runs", lambda run: F.aggregate(run, F.lit(0), lambda s, p: s + F.length(p)))
    begins = F.aggregate("_t", F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    placed = cut.select(*kept, runs.alias("_runs")).select(*kept, "_runs", totals.alias("_t")).select(*kept, "_runs", begins.alias("_b"))
    exploded = placed.select(*kept, F.posexplode_outer("_runs").alias("_i", "_run"), "_b").select(
        *kept, "_run", F.element_at("_b", F.col("_i") + 1).alias("_from")
    )
    within = F.aggregate("_run", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    pieces = exploded.select(*kept, "_from", "_run", within.alias("_w")).select(
        *kept, "_from", "_w", F.posexplode_outer("_run").alias("_j", "_piece")
    )
    # the outer explode keeps the optimiser from computing the pieces twice to skip empty arrays
    led = pieces.filter(F.col("_piece").rlike(f"(?s)^{_JUNK}.*[\\p{{L}}\\p{{N}}]")).select(
        *kept, (F.col("_from") + F.element_at("_w", F.col("_j") + 1)).alias("_at"), "_piece",
        F.length(F.regexp_extract("_piece", f"^{_JUNK}", 0)).alias("_lead"),
    )
    body = F.regexp_replace(_restored(F.expr("substring(_piece, _lead + 1)")), f"(?:[\\s\\p{{Z}}]|(?<=[\\n >])>|&nbsp;|{BLOCK_TAG})+$", "")
    named = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in own]
    return led.select(*named, (F.col("_at") + F.col("_lead")).cast("bigint").alias("start_char"), body.alias("sentence"))
