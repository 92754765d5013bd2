"""Figures in claims: reading, normalising to a base unit, and comparing with rounding.

All functions take and return Columns. Values are DECIMAL(38, 10) (`DEC`), so nothing depends on
binary fractions; a figure's text is kept apart, as its trailing zeros tell its precision. Figures that do not fit, or
whose rounding does not, are kept and compared as digits of any length (`figures`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import figures
from factloom.functions.base import SPACE, blank_as_null, bound, col, first_match, fold, null, quoted

DEC = "decimal(38,10)"

# Scale words, currency signs and proportion units of financial reports.
SCALES = {
    "hundred": 100, "thousand": 1000, "k": 1000, "lakh": 100000, "lakhs": 100000, "lac": 100000, "lacs": 100000,
    "million": 1000000, "mn": 1000000, "mln": 1000000, "m": 1000000, "crore": 10000000, "crores": 10000000, "cr": 10000000,
    "billion": 1000000000, "bn": 1000000000, "trillion": 1000000000000, "tn": 1000000000000,
}
CURRENCIES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD",
    "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP",
}
PROPORTIONS = {
    "%": "percent", "percent": "percent", "pct": "percent", "percentage": "percent", "bps": "basis_point",
    "basis points": "basis_point", "pp": "percentage_point", "ppt": "percentage_point",
    "percentage point": "percentage_point", "percentage points": "percentage_point",
}
GOLD_SCALES = {"thousand": 1000, "lakh": 100000, "million": 1000000, "crore": 10000000, "billion": 1000000000}

NUMBER = r"-?[0-9]+(?:[.,][0-9]+)*(?:\.[0-9]+)?"


def _map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _longest_first(words) -> list[str]:
    return sorted(words, key=lambda w: -len(w))


def _found(text: Column | str, pattern: str, words: list[str]) -> Column:
    """The first of the words, in their order, among all that the pattern's group finds: one pass over the text for all words."""
    return F.get(F.array_intersect(F.array(*map(F.lit, words)), F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1))), F.lit(0))


def _any(words) -> str:
    """A pattern of the words, the longest that fits at a place."""
    return "|".join(quoted(w) for w in _longest_first(words))


def _covering(words) -> list[str]:
    """Few characters of which every word has one."""
    out, left = [], sorted(words)
    while left:
        out.append(max(sorted(set("".join(left))), key=lambda c: sum(c in w for w in left)))
        left = [w for w in left if out[-1] not in w]
    return out


def _if_some(text: Column | str, words, found: Column) -> Column:
    """What is found, looked for only where the text has a character that one of the words must have: many texts need no pattern."""
    some = [col(text).contains(c) for c in _covering(words)]
    return F.when(reduce(lambda a, b: a | b, some), found)


# A word's place is told by what stands before it, which no word begins with, and by a look at what follows, so no two finds overlap.
def currency_of(text: Column | str) -> Column:
    """Code of the first currency sign or word in a folded text."""
    words = [w for w in CURRENCIES if all(c.isascii() and (c.islower() or c in ".$") for c in w)]
    signs = _any(w for w in CURRENCIES if w not in words)
    return _if_some(text, CURRENCIES, F.try_element_at(_map(CURRENCIES), _found(text, f"((?<![^ ])(?:{_any(words)})(?=[ 0-9]|$)|{signs})", list(CURRENCIES))))


def proportion_of(text: Column | str) -> Column:
    """Unit of the longest proportion word in a folded text."""
    words = [w for w in PROPORTIONS if w != "%"]
    return _if_some(text, PROPORTIONS, F.try_element_at(_map(PROPORTIONS), _found(text, f"((?<![^ 0-9])(?:{_any(words)})(?= |$)|%)", _longest_first(PROPORTIONS))))


def scale_of(text: Column | str) -> Column:
    """The longest scale word in a folded text, after a space or a digit."""
    return _if_some(text, SCALES, _found(text, f"((?<![^ 0-9])(?:{_any(SCALES)})(?![0-9A-Za-z_]))", _longest_first(SCALES)))


def multiplier(scale: Column | str) -> Column:
    return F.try_element_at(_map(SCALES), F.lower(F.trim(col(scale)))).cast("decimal(20,0)")


def decimal_places(token: Column | str) -> Column:
    """Digits after the last point, counted on the text."""
    return F.length(F.regexp_extract(F.replace(col(token), F.lit(","), F.lit("")), r"\.([0-9]+)$", 1))


#: Places up to which half a unit of the last one fits `DEC`.
DEC_PLACES = 9


def half_width(places: Column) -> Column:
    """Half a unit of the last decimal place; null where `DEC` has no room for it."""
    return F.get(F.array(*[F.lit(f"{5 / 10 ** (k + 1):.{k + 1}f}").cast(DEC) for k in range(DEC_PLACES + 1)]), places)


def parse_numeric(raw: Column | str) -> Column:
    """Struct (value, kind, low, high, decimal_places, scale, currency, unit, negative), null without a number.

    A text wholly in parentheses is negative. Two numbers joined by a dash or "to" are a range with
    the mean as value. A leading minus also flips the sign that the number itself carries.
    """

    def read(text: Column) -> Column:
        wrapped = text.rlike(r"^\(.*\)$")
        return bound(F.struct(F.when(wrapped, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text).alias("body"), wrapped.alias("wrapped")), from_body)

    def from_body(x: Column) -> Column:
        body = x["body"]
        return bound(F.struct(body.alias("body"), x["wrapped"].alias("wrapped"), F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)).alias("n"), proportion_of(body).alias("unit")), result)

    def result(x: Column) -> Column:
        body, n = x["body"], x["n"]
        number = lambda i: F.replace(F.get(n, F.lit(i)), F.lit(","), F.lit("")).try_cast(DEC)
        sign = F.when(x["wrapped"] | F.trim(body).startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
        second = (number(1) * sign).cast(DEC)
        is_range = (F.size(n) >= 2) & F.replace(body, F.lit(","), F.lit("")).rlike(f"[0-9]{SPACE}*(-|to|–|—){SPACE}*[0-9]") & second.isNotNull()
        read = F.struct(x.alias("x"), (number(0) * sign).cast(DEC).alias("first"), F.when(is_range, second).alias("second"))
        return F.when(F.size(n) > 0, bound(read, told))

    def told(y: Column) -> Column:
        x, first, second = y["x"], y["first"], y["second"]
        body, is_range = x["body"], second.isNotNull()
        about = body.rlike(r"(?<![0-9A-Za-z_])(about|approx\.?|approximately|around|circa)(?![0-9A-Za-z_])|^~|[0-9A-Za-z_]~[0-9A-Za-z_]")
        out = F.struct(
            F.when(is_range, ((first + second) / 2).cast(DEC)).otherwise(first).alias("value"),
            F.when(is_range, "range").when(about, "approximate").otherwise("point").alias("kind"),
            F.when(is_range, first).alias("low"), second.alias("high"),
            decimal_places(F.get(x["n"], F.lit(0))).alias("decimal_places"), F.when(x["unit"].isNull(), scale_of(body)).alias("scale"),
            currency_of(body).alias("currency"), x["unit"].alias("unit"), (first < 0).alias("negative"),
        )
        return F.when(first.isNotNull(), out)

    text = fold(col(raw))
    return F.when(F.length(text) > 0, bound(text, read))


def plain(value: Column) -> Column:
    """A decimal as text without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def normalize_value(numeric: Column | str, scale: Column | str, unit: Column | str, currency: Column | str) -> Column:
    """Struct (value, unit, half_width, steps, precision, exact) in base units; null if the figure cannot be read.

    A proportion unit wins over scale and currency; basis points become percent. A scale word that is
    not known stays in the unit, unconverted. `precision` is the number of places that the figure is rounded to. Where value or
    half_width do not fit DECIMAL(38, 10), value is rounded (null if it has too many digits), half_width is null if it has no room,
    and `exact` holds the figure; comparisons go by it.
    """
    step = "array<struct<step:string,from:string,to:string,factor:string>>"
    kind = f"struct<value:{DEC},unit:string,half_width:{DEC},steps:{step},precision:int,exact:{figures.FIGURE}>"
    one = lambda name, a, b, f: F.array(F.struct(F.lit(name).alias("step"), a.alias("from"), b.alias("to"), f.alias("factor"))).cast(step)
    numeric, scale, unit, currency = map(col, (numeric, scale, unit, currency))
    given = F.struct(
        numeric.alias("numeric"), unit.alias("unit"), currency.alias("currency"), F.lower(F.trim(scale)).alias("word"), F.try_element_at(_map(PROPORTIONS), F.lower(F.trim(unit))).alias("proportion"),
        multiplier(scale).alias("factor"), decimal_places(numeric).alias("places"),
    )

    # Each step is bound, so that what it makes stands once in the expression however often it is used.
    def named(x: Column) -> Column:
        way = F.when(x["proportion"] == "basis_point", "points").when(x["proportion"].isNotNull(), "share").when(x["factor"].isNotNull(), "scaled").when(F.length(x["word"]) > 0, "word")
        plain_unit = F.coalesce(blank_as_null(x["currency"]), blank_as_null(x["unit"]), F.lit("count"))
        return bound(F.struct(x.alias("x"), F.coalesce(way, F.lit("plain")).alias("way"), plain_unit.alias("plain_unit"), F.when(x["places"] <= DEC_PLACES, x["numeric"].try_cast(DEC)).alias("value"), half_width(x["places"]).alias("wide")), based)

    def based(y: Column) -> Column:
        x, way, value, wide = y["x"], y["way"], y["value"], y["wide"]
        by = lambda points, scaled, other: F.when(way == "points", points).when(way == "scaled", scaled).otherwise(other)
        power = by(F.lit(-2), F.length(x["factor"].cast("string")) - 1, F.lit(0)).cast("int")
        name = by(F.lit("percent"), y["plain_unit"], F.when(way == "share", x["proportion"]).when(way == "word", F.concat(F.coalesce(x["currency"], x["unit"], F.lit("count")), F.lit("/"), x["word"])).otherwise(y["plain_unit"]))
        in_base = by((value / 100).cast(DEC), F.try_multiply(value, x["factor"]).try_cast(DEC), value)
        half = by((wide / 100).cast(DEC), (wide * x["factor"]).cast(DEC), wide)
        return bound(F.struct(x.alias("x"), way.alias("way"), value.alias("value"), name.alias("name"), in_base.alias("base"), half.alias("half"), power.alias("power"), (x["places"] - power).cast("int").alias("precision")), made)

    def made(z: Column) -> Column:
        short = z["value"].isNotNull() & (z["precision"] <= DEC_PLACES) & z["base"].isNotNull()
        none = null("struct<before:string,after:string,value:decimal(38,10),half:decimal(38,10),exact:" + figures.FIGURE + ">")
        found = F.when(short, F.struct(plain(z["value"]).alias("before"), plain(z["base"]).alias("after"), z["base"].alias("value"), z["half"].alias("half"), null(figures.FIGURE).alias("exact")))
        found = found.otherwise(bound(figures.figure(z["x"]["numeric"]), lambda f: F.when(f.isNotNull(), bound(figures.shifted(f, z["power"]), lambda e: long(f, e, z))).otherwise(none)))
        return bound(F.struct(z.alias("z"), found.alias("f")), told)

    def long(f: Column, e: Column, z: Column) -> Column:
        half = F.when(z["precision"] <= DEC_PLACES, F.concat(F.lit("5e"), (-z["precision"] - 1).cast("string")).try_cast(DEC))
        return bound(figures.as_text(e), lambda text: F.struct(figures.as_text(f).alias("before"), text.alias("after"), text.try_cast(DEC).alias("value"), half.alias("half"), e.alias("exact")))

    def told(w: Column) -> Column:
        z, f = w["z"], w["f"]
        steps = (
            F.when(z["way"] == "points", one("basis_points_to_percent", f["before"], f["after"], F.lit("0.01"))).when(z["way"] == "scaled", one("apply_scale", F.concat_ws(" ", f["before"], z["x"]["word"]), f["after"], z["x"]["factor"].cast("string")))
            .when(z["way"] == "word", one("unrecognised_scale", z["x"]["word"], F.lit("left unconverted"), null("string"))).otherwise(F.array().cast(step))
        )
        return F.when(f.isNotNull(), F.struct(f["value"].alias("value"), z["name"].alias("unit"), f["half"].alias("half_width"), steps.alias("steps"), z["precision"].alias("precision"), f["exact"].alias("exact")).cast(kind))

    return bound(given, named)


def _exact(x: Column) -> Column:
    """A normalised value's figure, whichever way it is kept."""
    return F.coalesce(x["exact"], figures.figure(x["value"].cast("string"), x["precision"]))


def compare_values(a: Column, b: Column) -> Column:
    """Struct (agreement, difference, relative, reason) of two normalised values.

    Other units: incomparable. Else the closed rounding intervals overlap (agree) or not (disagree). Of figures that do not fit
    DECIMAL(38, 10) the difference is rounded to it (null if too large), and the reason states it in full.
    """

    def compared(x: Column) -> Column:
        a, b = x["a"], x["b"]
        long = a["exact"].isNotNull() | b["exact"].isNotNull()
        exact = lambda v: F.when(long, _exact(v))
        return bound(F.struct(a.alias("a"), b.alias("b"), exact(a).alias("ea"), exact(b).alias("eb")), set_against)

    def set_against(x: Column) -> Column:
        return bound(F.struct(x["a"].alias("a"), x["b"].alias("b"), x["ea"].alias("ea"), x["eb"].alias("eb"), figures.compare(x["ea"], x["eb"]).alias("both")), result)

    def result(x: Column) -> Column:
        a, b, both = x["a"], x["b"], x["both"]
        apart = F.when(both.isNotNull(), both["apart"].try_cast(DEC)).otherwise(F.abs(a["value"] - b["value"]).cast(DEC))
        text = F.when(both.isNotNull(), both["apart"]).otherwise(plain(apart))
        most = F.greatest(F.abs(a["value"]), F.abs(b["value"]))
        relative = F.when(both.isNotNull(), (both["apart"].cast("double") / F.nullif(F.greatest(figures.as_size(x["ea"]), figures.as_size(x["eb"])), F.lit(0.0))).cast("decimal(38,12)")).when(most != 0, (apart.cast("double") / most.cast("double")).cast("decimal(38,12)"))  # a quotient of two such decimals has six places only
        same = a["unit"] == b["unit"]
        meets = F.when(both.isNotNull(), both["meets"]).otherwise((a["value"] - a["half_width"] <= b["value"] + b["half_width"]) & (b["value"] - b["half_width"] <= a["value"] + a["half_width"]))
        codes = sorted(set(CURRENCIES.values()))
        reason = first_match([
            (~same & a["unit"].isin(*codes) & b["unit"].isin(*codes), F.concat(F.lit("no exchange rate is given for "), a["unit"], F.lit(" and "), b["unit"])),
            (~same, F.concat(a["unit"], F.lit(" cannot be set against "), b["unit"])), (meets, F.lit("within rounding")),
        ], F.concat(text, F.lit(" "), a["unit"], F.lit(" apart, beyond rounding")))
        return F.struct(F.when(~same, "incomparable").when(meets, "agree").otherwise("disagree").alias("agreement"), F.when(same, apart).alias("difference"), F.when(same, relative).alias("relative"), reason.alias("reason"))

    return F.when(a.isNotNull() & b.isNotNull(), bound(F.struct(a.alias("a"), b.alias("b")), compared))


def scale_ratio(a: Column, b: Column) -> Column:
    """|a / b| if it is a power of ten other than 1, whatever the units and the power; null if either is 0.

    Such figures have the same digits; the power is the distance between their leading digits' places.
    """

    def text_of(x: Column) -> Column:
        return F.when(x["exact"].isNotNull(), F.ltrim(F.lit("-"), figures.as_text(x["exact"]))).otherwise(F.abs(x["value"]).cast("string"))

    def written(text: Column) -> Column:
        whole, part = F.regexp_extract(text, r"^0*([0-9]*)", 1), F.regexp_extract(text, r"\.([0-9]*)$", 1)
        place = F.when(F.length(whole) > 0, F.length(whole)).otherwise(-F.length(F.regexp_extract(part, "^(0*)", 1)))
        return F.struct(F.regexp_replace(F.concat(whole, part), "^0+|0+$", "").alias("digits"), place.alias("place"))

    def ratio(x: Column) -> Column:
        p = x["a"]["place"] - x["b"]["place"]
        return F.when((x["a"]["digits"] != "") & (x["a"]["digits"] == x["b"]["digits"]) & (p != 0), F.concat(F.lit("1e"), p.cast("string")).cast("double"))  # the nearest double; pow() may be the one beside it

    def both(x: Column) -> Column:
        return bound(F.struct(bound(text_of(x["a"]), written).alias("a"), bound(text_of(x["b"]), written).alias("b")), ratio)

    return bound(F.struct(a.alias("a"), b.alias("b")), both)


def significant_digits(numeric: Column | str) -> Column:
    """Digits without leading zeros."""
    return F.length(F.regexp_replace(F.regexp_replace(col(numeric), "[^0-9]", ""), "^0+", ""))


def base_units(numeric: Column | str, scale: Column | str) -> Column:
    """The scorer's own base value: five scale words; no scale leaves the figure, an unknown one gives null."""
    word = F.lower(F.trim(col(scale)))
    factor = F.when(F.coalesce(word, F.lit("")) == "", F.lit(1).cast("decimal(20,0)")).otherwise(F.try_element_at(_map(GOLD_SCALES), word).cast("decimal(20,0)"))
    return (col(numeric).try_cast(DEC) * factor).cast(DEC)
