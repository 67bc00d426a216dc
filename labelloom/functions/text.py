"""Small text and number column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the characters that count as white space at the ends of a line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def fixed(value: Column, places: int) -> Column:
    """Fixed-point text, rounded half-even on the stored binary value, no separators."""
    pattern = "0" if places == 0 else "0." + "0" * places
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def fixed_sql(value: str, places: int) -> str:
    pattern = "0" if places == 0 else "0." + "0" * places
    return f"format_number(cast({value} as double), '{pattern}')"


def rounded_sql(value: str, places: int) -> str:
    return f"cast({fixed_sql(value, places)} as double)"


def rounded(value: Column, places: int) -> Column:
    """Rounding that agrees with ``fixed``; SQL round() moves exact halves up instead."""
    return fixed(value, places).cast("double")


def stripped(value: Column) -> Column:
    """Text without leading and trailing white space of any kind (plain trim leaves tabs)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def slug(name: Column, limit: int = 50, default: str = "model") -> Column:
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def contains_any(columns: list[Column], needle: str) -> Column:
    """Case-insensitive substring test over several columns; an empty needle matches."""
    wanted = F.lit(needle.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), wanted), F.lit(False))
    return F.lit(True) if needle == "" else hit


def first_number_in_parens(text: Column, label: str = "Valid:") -> Column:
    """Share from the first parsable ``<label> ... (P%)`` line, as a fraction.

    Lines that carry the label but no number are passed over.
    """
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    line = rf"(?m)^{label}(?=[^\n\r]*%\))[^\n\r(]*\(\s*({number})\s*%"
    hit = F.regexp_extract(text, line, 1)
    return F.nullif(hit, F.lit("")).cast("double") / F.lit(100.0)
