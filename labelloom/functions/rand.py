"""Reproducible draws as SQL expression text.

A draw is a pure function of (seed, row id, tag), so a retried task gives the same
row. MD5 is chosen because other SQL engines compute the same value. Arguments and
results are SQL text: ``row`` names the id column, ``tag`` is a string expression.
"""

from __future__ import annotations


def number(value: float) -> str:
    return f"{float(value)!r}D"


def key_text(seed: int | str, row: str, tag: str) -> str:
    return f"concat_ws(':', '{seed}', {row}, {tag})"


def unit(seed: int | str, row: str, tag: str) -> str:
    """Uniform draw in [0, 1) from the first 32 bits of an MD5 digest."""
    word = f"conv(substring(md5({key_text(seed, row, tag)}), 1, 8), 16, 10)"
    return f"(cast({word} as double) / 4294967296.0D)"


def between(low: float, high: float, u: str) -> str:
    return f"({number(low)} + {u} * {number(float(high) - float(low))})"


def integer(low: int, high: int, u: str) -> str:
    """Integer draw in [low, high], both ends included."""
    return f"({low} + cast(floor({u} * {number(high - low + 1)}) as int))"


def choice(options: str, u: str) -> str:
    """One element of a non-empty array."""
    return f"element_at({options}, cast(floor({u} * cast(size({options}) as double)) as int) + 1)"


def shuffled(values: str, seed: int | str, row: str) -> str:
    """Array of strings in an order fixed by the digest of each element."""
    return f"sort_array(transform({values}, v -> struct(md5({key_text(seed, row, 'v')}) as k, v as v))).v"
