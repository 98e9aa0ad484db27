"""Text functions for names and scraped cells, all built from Spark SQL
built-ins (no Python UDF)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotvalue.functions.rfuncs import r_paste

# Latin letters whose ASCII form is not their Unicode base
# letter (the rest of the Latin-1 Supplement and Latin Extended-A/B letters
# are mapped by stripping combining marks, see ``_transliteration``).
SPECIAL_LATIN = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ĳ": "ij", "Ĳ": "IJ",
    "þ": "th", "Þ": "TH", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D",
    "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "ŀ": "l", "Ŀ": "L",
    "ĸ": "q", "ſ": "s", "ŋ": "n", "Ŋ": "N", "ƒ": "f",
}


#: Latin-1 Supplement to Extended-B, Extended Additional, Extended-C, Extended-D,
#: the Latin ligatures, the fullwidth letters.
LATIN_BLOCKS = [(0x00C0, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06),
                (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)]
_FORM_OF = re.compile(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]|AA|AO|AU|AV|AY|OO|TZ|VY)( WITH .+)?")


def _transliteration() -> tuple[dict[str, str], dict[str, str]]:
    """(one-to-one map, one-to-many map) from Latin letters to ASCII.

    Rule: a letter of the Latin blocks (to Extended-D), the Latin ligatures and
    the fullwidth forms whose compatibility decomposition holds ASCII letters
    maps to those (é -> e, Ŕ -> R, ễ -> e, ﬃ -> ffi); one without such a
    decomposition to the letter that its Unicode name says it is a form of
    (ⱡ -> l, Ꜳ -> AA); the fixed table above covers the others.  Marks written
    as letters of their own (U+0300..U+036F, the decomposed form of an accent)
    are dropped by ``letters_only``."""
    single: dict[str, str] = {}
    multi: dict[str, str] = {}
    for cp in (cp for first, last in LATIN_BLOCKS for cp in range(first, last + 1)):
        ch = chr(cp)
        if ch in SPECIAL_LATIN or not ch.isalpha():
            continue
        to = "".join(c for c in unicodedata.normalize("NFKD", ch) if c.isascii() and c.isalpha())
        form = _FORM_OF.fullmatch(unicodedata.name(ch, ""))
        if not to and form:
            to = form[2].lower() if form[1] == "SMALL" else form[2]
        if to:
            (single if len(to) == 1 else multi)[ch] = to
    for ch, to in SPECIAL_LATIN.items():
        (single if len(to) == 1 else multi)[ch] = to
    return single, multi


SINGLE, MULTI = _transliteration()
SRC_CHARS = "".join(SINGLE)
DST_CHARS = "".join(SINGLE[c] for c in SRC_CHARS)


def latin_ascii(c: Column) -> Column:
    """Latin-to-ASCII transliteration: ASCII text stays as it is; else the
    letters that become several, where there are any, then one ``translate``."""
    several = c
    for src, dst in MULTI.items():
        several = F.replace(several, F.lit(src), F.lit(dst))
    several = F.when(c.rlike(f"[{''.join(MULTI)}]"), several).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(several, SRC_CHARS, DST_CHARS)).otherwise(c)


def latin_ascii_sql(expr: str) -> str:
    """The same transliteration as SQL text (DuckDB / ANSI ``replace`` and
    ``translate``)."""
    for src, dst in MULTI.items():
        expr = f"replace({expr}, '{src}', '{dst}')"
    return f"translate({expr}, '{SRC_CHARS}', '{DST_CHARS}')"


def letters_only(c: Column) -> Column:
    """Keep ASCII letters and spaces."""
    return F.regexp_replace(c, "[^A-Za-z ]", "")


def word(c: Column, n: int) -> Column:
    """n-th space-separated word (negative counts from the end); NULL when
    out of range.  Consecutive spaces give empty words, as a fixed-space
    split does.  The first and last words are cut with ``substring_index``
    (one scan, no array of every word of a long text)."""
    if n == 1:
        return F.substring_index(c, " ", 1)
    if n == -1:
        return F.substring_index(c, " ", -1)
    return F.try_element_at(F.split(c, " "), F.lit(n))


def base_key(first: Column, last: Column, last_len: int = 5, first_len: int = 2) -> Column:
    """lower(last)[1..5] + lower(first)[1..2]; a missing part is written NA."""
    return r_paste(F.substring(F.lower(last), 1, last_len), F.substring(F.lower(first), 1, first_len))


NUMERIC = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def parse_number(c: Column) -> Column:
    """Text to double: NULL for text that is not a plain decimal number (the
    pattern guard keeps Spark-only forms such as ``1.0d`` out)."""
    return F.when(c.rlike(NUMERIC), F.trim(c).try_cast("double"))


def empty_zero_number(c: Column) -> Column:
    """``""`` -> 0, otherwise ``parse_number``; NULL stays NULL."""
    return F.when(c == "", F.lit(0.0)).otherwise(parse_number(c))


def file_stem(path: Column) -> Column:
    """File name without directory and last extension; the whole name when
    it has no extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_extract(name, r"^(.+)\.[A-Za-z0-9]+$", 1)
    return F.when(stem == "", name).otherwise(stem)
