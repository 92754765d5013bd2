"""Small Column helpers shared by the claim functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the claim functions see it: ASCII and Unicode spaces, and the byte-order mark.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def fold(c: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(c), f"{SPACE}+", " "))


def blank_as_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def first_match(rules: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    out: Column | None = None
    for condition, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    if out is None:
        raise ValueError("no rules")
    return out if otherwise is None else out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def quoted(text: str) -> str:
    """A literal text as a regular expression."""
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}" else c for c in text)
