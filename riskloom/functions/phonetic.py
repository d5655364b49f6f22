"""Codes of how a name sounds (F16) and whether two names share one.

A name is read by one regular expression that joins all rules; letters that no rule takes are silent.  Codes of the
catalogue's names are made once, when the plan is built; those of the rows in Arrow batches, once a distinct name.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (letters with what must stand beside them, codes to add in turn, codes of the second key if others).
RULES = (
    ("(?<!M)B", "P", ""), ("CIA", "X", "S"), ("C(?=[EIY]|$)", "S", ""), ("CH", "X", "S"), ("CC(?=[EIY]|$)", "KS", ""), ("C", "K", ""), ("DG(?=[EIY]|$)", "J", ""), ("D[DT]?", "T", ""), ("F", "F", ""),
    ("GH(?=[^AEIOUY])", "K", ""), ("(?<![^E])GN", "KN", ""), ("G(?=[EIY]|$)", "J", ""), ("(?<!G)G(?!H)", "K", ""), ("(?<![^AEOU])H(?=[^AEIOUY])", "H", ""), ("(?<![SKC])J(?=[EIY]|$)", "J J", ""), ("(?<![SKC])J|J(?=[JEIY]|$)", "J", ""),
    ("(?<!C)K", "K", ""), ("PH", "F", ""), ("P", "P", ""), ("Q", "K", ""), ("SH", "X", ""), ("SI(?:[AO]|$)", "X", "S"), ("SCH", "SK", ""), ("S", "S", ""), ("(?<=[^AEIOUY])TH", "T", ""), ("TH", "0", "T"), ("TI(?:[AO]|$)", "X", "S"), ("TCH", "K", ""), ("T", "T", ""),
    ("V", "F", ""), ("W(?=[AEIOUY]|$)", "A", ""), ("X", "KS", ""), ("Z", "S", "TS"),
)
LENGTH = 4
_SCAN = re.compile("|".join(f"({p})" for p, _, _ in RULES))


def keys(name: str | None) -> tuple[str, str]:
    """Both keys, four characters each, filled with zeros; empty for a name without letters A to Z.

    A rule with one code adds it to the second key only while that is the shorter one.
    """
    letters = re.sub("[^A-Z]", "", (name or "").upper())
    if not letters:
        return "", ""
    first = second = ""
    for m in _SCAN.finditer(letters):
        if min(len(first), len(second)) >= LENGTH:
            break
        _, codes, other = RULES[m.lastindex - 1]
        for code in codes.split():
            first += code if len(first) < LENGTH else ""
            if other:
                second += other if len(second) < LENGTH else ""
            elif len(second) < len(first):
                second += code
    return tuple(k[:LENGTH].ljust(LENGTH, "0") for k in (first, second))


def alike(a: str, b: str) -> bool:
    return bool(set(keys(a)) & set(keys(b)))


def codes(name: Column) -> Column:
    """The keys of a name as an array; null counts as empty."""

    @F.pandas_udf("array<string>")
    def read(names: pd.Series) -> pd.Series:
        known = {n: list(keys(n)) for n in names.dropna().unique()}
        return pd.Series([known.get(n, ["", ""]) for n in names], dtype=object)

    return read(name)
