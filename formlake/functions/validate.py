"""Field validation: dates, e-mail addresses, phone and identity numbers, and the choice of rule by field name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formlake.functions.text import strip


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd of d/m/Y, d-m-Y, Y-m-d, d/m/y or d-m-y (in that order), else null. Two-digit years: 69-99 are 19xx, 00-68 are 20xx."""
    s = strip(text)
    four = [("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"), ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"), ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d")]
    found = [F.when(s.rlike(p), F.try_to_timestamp(s, F.lit(f))) for p, f in four]
    for mark in "/-":
        year = F.regexp_extract(s, f"^[0-9]{{1,2}}{mark}[0-9]{{1,2}}{mark}([0-9]{{2}})$", 1)
        full = F.concat(F.regexp_extract(s, f"^([0-9]{{1,2}}{mark}[0-9]{{1,2}}{mark})", 1), F.when(year >= "69", "19").otherwise("20"), year)
        found.append(F.when(year != "", F.try_to_timestamp(full, F.lit(f"d{mark}M{mark}yyyy"))))
    return F.date_format(F.coalesce(*found), "yyyy-MM-dd")


def is_email(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), F.lit(False))


def is_phone(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)[\s\-()]", "").rlike(r"(?U)^\d{10,15}$"), F.lit(False))


def is_aadhaar(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s", "").rlike(r"(?U)^\d{12}$"), F.lit(False))


def is_pan(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.upper(text), r"(?U)\s", "").rlike(r"(?U)^[A-Z]{5}\d{4}[A-Z]$"), F.lit(False))


def error(field: Column, value: Column) -> Column:
    """What is wrong with a value, null if nothing; the rule is chosen by parts of the field's name, dates before all others."""
    name = F.lower(field)

    def has(*parts: str) -> Column:
        out = name.contains(parts[0])
        for p in parts[1:]:
            out = out | name.contains(p)
        return out

    bad = F.when(F.coalesce(strip(value), F.lit("")) == "", "Field is empty")
    rules = [
        (has("date", "dob"), iso_date(value).isNotNull(), "Invalid date format"),
        (has("email"), is_email(value), "Invalid email format"),
        (has("phone", "mobile"), is_phone(value), "Invalid phone number format"),
        (has("aadhaar", "aadhar"), is_aadhaar(value), "Invalid Aadhaar number format"),
        (has("pan"), is_pan(value), "Invalid PAN format"),
    ]
    for applies, good, message in rules:
        bad = bad.when(applies, F.when(~good, message))
    return bad
