"""Figures of any length as digits and places, for those that DECIMAL(38, 10) cannot hold.

A figure is a struct (negative, digits, places, precision): its value is digits / 10^places, and it was rounded
to `precision` places (below 0: to tens, hundreds, ...). Sums and comparisons align two figures to one
power of ten and go by decimals where these hold them, else by limbs of nine digits, with the carry folded from the last limb to the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.base import bound, null

FIGURE = "struct<negative:boolean,digits:string,places:int,precision:int>"
PLAIN = r"^([-+]?)([0-9]*)(?:\.([0-9]*))?$"
LIMB = 9
#: Digits that decimal arithmetic keeps for sure (sums are rounded to 34): figures of fewer, when aligned, are compared as decimals, others by limbs.
WHOLE = 34


def figure(text: Column, precision: Column | None = None) -> Column:
    """A plain decimal's figure, null for other texts; its precision is its number of places unless given."""
    whole, part = F.regexp_extract(text, PLAIN, 2), F.regexp_extract(text, PLAIN, 3)
    out = F.struct((F.regexp_extract(text, PLAIN, 1) == "-").alias("negative"), F.concat(whole, part).alias("digits"), F.length(part).alias("places"), (F.length(part) if precision is None else precision).alias("precision"))
    return F.when(text.rlike(PLAIN) & text.rlike("[0-9]"), out.cast(FIGURE))


def shifted(f: Column, power: Column) -> Column:
    """The figure times ten to a power."""
    places = f["places"] - power
    zeros = F.when(places < 0, F.repeat(F.lit("0"), -places)).otherwise("")
    return F.struct(f["negative"].alias("negative"), F.concat(f["digits"], zeros).alias("digits"), F.greatest(places, F.lit(0)).cast("int").alias("places"), (f["precision"] - power).cast("int").alias("precision")).cast(FIGURE)


def _text(negative: Column, digits: Column, places: Column) -> Column:
    padded = F.lpad(digits, F.greatest(F.length(digits), places + 1), "0")
    n = F.length(padded) - places
    text = F.concat(F.regexp_replace(F.substring(padded, F.lit(1), n), "^0+(?=[0-9])", ""), F.regexp_replace(F.concat(F.lit("."), F.substring(padded, n + 1, places)), r"\.?0*$", ""))
    return F.when(negative & text.rlike("[1-9]"), F.concat(F.lit("-"), text)).otherwise(text)


def as_text(f: Column) -> Column:
    """Plain decimal without needless zeros."""
    return _text(f["negative"], f["digits"], f["places"])


def as_size(f: Column) -> Column:
    """The nearest double to the figure without its sign."""
    return F.concat(f["digits"], F.lit("E"), (-f["places"]).cast("string")).cast("double")


def _limbs(digits: Column, zeros: Column, n: Column) -> Column:
    """Digits with zeros after them, as n limbs, the first of them the highest."""
    padded = F.lpad(F.concat(digits, F.repeat(F.lit("0"), zeros)), n * LIMB, "0")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(padded, i * LIMB + 1, F.lit(LIMB)).cast("long"))


def _not_negative(limbs: Column) -> Column:
    """Whether limbs with signs of their own add up to zero or more."""
    carry = F.aggregate(F.reverse(limbs), F.lit(0).cast("long"), lambda c, x: F.floor((c + x) / F.lit(10**LIMB)))
    return carry >= 0


def _digits(limbs: Column) -> Column:
    """Digits of limbs that add up to zero or more."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text"))

    def step(a: Column, x: Column) -> Column:
        return F.struct(F.floor((a["carry"] + x) / F.lit(10**LIMB)).alias("carry"), F.concat(F.lpad(F.pmod(a["carry"] + x, F.lit(10**LIMB)).cast("string"), LIMB, "0"), a["text"]).alias("text"))

    return F.aggregate(F.reverse(limbs), start, step)["text"]


def compare(a: Column, b: Column) -> Column:
    """Struct (meets, apart): whether the closed rounding intervals overlap, and |a - b| as text."""

    def aligned(x: Column) -> Column:
        a, b = x["a"], x["b"]
        unit = F.greatest(a["places"], b["places"], a["precision"] + 1, b["precision"] + 1, F.lit(0))
        width = lambda f: F.length(f["digits"]) + unit - f["places"]
        n = F.ceil((F.greatest(width(a), width(b), unit - a["precision"], unit - b["precision"]) + 1) / LIMB).cast("int")
        most = F.greatest(width(a), width(b), unit - a["precision"], unit - b["precision"])
        return bound(F.struct(a.alias("a"), b.alias("b"), unit.alias("unit"), n.alias("n"), most.alias("most")), lambda x: F.when(x["most"] < WHOLE, whole(x)).otherwise(limbs(x)))

    def whole(x: Column) -> Column:
        """Both figures in whole units as decimals: of fewer digits than sums keep."""
        unit = x["unit"]
        number = lambda digits, zeros: F.concat(digits, F.repeat(F.lit("0"), zeros)).cast("decimal(38,0)")
        value = lambda f: number(F.concat(F.when(f["negative"], "-").otherwise(""), f["digits"]), unit - f["places"])
        half = lambda f: number(F.lit("5"), unit - f["precision"] - 1)
        apart = F.abs(value(x["a"]) - value(x["b"]))
        told = lambda y: F.struct((y["d"] <= y["r"]).alias("meets"), _text(F.lit(False), y["d"].cast("string"), y["u"]).alias("apart"))
        return bound(F.struct(apart.alias("d"), (half(x["a"]) + half(x["b"])).alias("r"), unit.alias("u")), told)

    def limbs(x: Column) -> Column:
        a, b, unit, n = x["a"], x["b"], x["unit"], x["n"]
        value = lambda f: F.transform(_limbs(f["digits"], unit - f["places"], n), lambda v: F.when(f["negative"], -v).otherwise(v))
        half = lambda f: _limbs(F.lit("5"), unit - f["precision"] - 1, n)
        difference = F.zip_with(value(a), value(b), lambda p, q: p - q)
        room = F.zip_with(half(a), half(b), lambda p, q: p + q)
        return bound(F.struct(difference.alias("d"), room.alias("r"), unit.alias("unit")), result)

    def result(x: Column) -> Column:
        minus = F.transform(x["d"], lambda v: -v)
        add = lambda p, q: F.zip_with(p, q, lambda v, w: v + w)
        meets = _not_negative(add(x["r"], x["d"])) & _not_negative(add(x["r"], minus))
        apart = _text(F.lit(False), _digits(F.when(_not_negative(x["d"]), x["d"]).otherwise(minus)), x["unit"])
        return F.struct(meets.alias("meets"), apart.alias("apart"))

    return F.when(a.isNotNull() & b.isNotNull(), bound(F.struct(a.alias("a"), b.alias("b")), aligned)).otherwise(null("struct<meets:boolean,apart:string>"))
