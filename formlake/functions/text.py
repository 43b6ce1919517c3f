"""Text helpers as column expressions that agree with Python's string methods and regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formlake.functions import fixed

#: Unicode classes, and line ends at line feeds only: as Python reads a pattern.
PLAIN, NO_CASE, NO_CASE_LINES = "(?dU)", "(?idU)(?u)", "(?imdU)(?u)"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def java(pattern: str, flags: str = PLAIN) -> str:
    return flags + pattern


def _name_lines(text: Column) -> Column:
    """The text with a colon for every line that no run of words of two letters or more can cover."""
    return F.regexp_replace(text, java(r"^(?:.*[^a-z\s].*|(?:.*[^\S\n])?[a-z](?:[^\S\n].*)?)$", NO_CASE_LINES), ":")


#: Equal to the fixed pattern on such a text, and without a step of the stack for each word.
_NAME_LINES = r"^([A-Z][a-z]++(?:\s++[A-Z][a-z]++)++)\s*$"


def first_group(text: Column, pattern: str) -> Column:
    """The first match's first group, as re.search with IGNORECASE and MULTILINE gives it; "" for none."""
    if pattern == fixed.NAME_LINES:
        return F.regexp_extract(_name_lines(text), java(_NAME_LINES, NO_CASE_LINES), 1)
    return F.regexp_extract(text, java(pattern, NO_CASE_LINES), 1)


def hits(text: Column, pattern: str) -> Column:
    if pattern == fixed.NAME_LINES:
        return _name_lines(text).rlike(java(_NAME_LINES, NO_CASE_LINES))
    return text.rlike(java(pattern, NO_CASE_LINES))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    """Lines at any Unicode line end, without an empty piece after the last end."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normal_key(label: Column, strip_marks: bool = True) -> Column:
    """Letters, digits and blanks in small letters, blanks as underscores; underscores at the ends go if asked for."""
    key = F.regexp_replace(F.lower(F.regexp_replace(label, r"(?U)[^\w\s]", "")), r"(?U)\s+", "_")
    return F.btrim(key, F.lit("_")) if strip_marks else key


def title(key: Column) -> Column:
    """Underscores as blanks, every word's first letter a capital, the rest unchanged."""
    words = F.split(F.replace(key, F.lit("_"), F.lit(" ")), " ", -1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def file_size(n: Column) -> Column:
    """Bytes as text in units of 1024, up to two decimals without trailing zeros."""
    power = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(3)).cast("int")
    unit = F.element_at(F.array(F.lit("Bytes"), F.lit("KB"), F.lit("MB"), F.lit("GB")), power + 1)
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    digits = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(n <= 0, F.lit("0 Bytes")).otherwise(F.concat_ws(" ", digits, unit))
