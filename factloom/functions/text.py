"""Quotes, fingerprints, tokens and other text functions of claims, as Columns.

Only NFKC folding and name-based UUIDs need Python, as Arrow-batched pandas UDFs. Everything else runs in the JVM.
"""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.base import SPACE, blank_as_null, bound, col, first_match, null

# Characters that count as one another when a quote is looked for.
SAME_FROM, SAME_TO = "‘’“”–—−", "''\"\"---"
INVISIBLE = "\u00ad\u200b"


def normalize_for_match(text: Column | str) -> Column:
    """White space as single spaces, quotes and dashes unified, soft hyphens gone; case stays."""
    t = F.translate(F.translate(col(text), INVISIBLE, ""), SAME_FROM, SAME_TO)
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def contains_quote(quote: Column | str, content: Column | str) -> Column:
    """Whether the quote stands in the content, both in their form for matching; no UDF."""
    q = normalize_for_match(quote)
    return (F.length(q) > 0) & normalize_for_match(content).contains(q)


def quote_pattern(quote: Column | str) -> Column:
    """A regular expression for the places of a quote in an original text: every character as any of those that count as it, with invisible ones
    between, and a space as a run with at least one. Runs are possessive, so a search never goes back into them."""
    hidden, spaces = f"[{INVISIBLE}]*+", f"[{INVISIBLE}]*+{SPACE}[{INVISIBLE}{SPACE[1:-1]}]*+"
    alike = {c: "[" + ("\\" if c == "-" else "") + c + "".join(f for f, t in zip(SAME_FROM, SAME_TO, strict=True) if t == c) + "]" for c in sorted(set(SAME_TO))}
    one = lambda c: first_match([(c == " ", spaces), *((c == k, v) for k, v in alike.items()), (c.rlike("^[A-Za-z0-9]$"), c)], F.concat(F.lit("\\Q"), c, F.lit("\\E")))
    q = normalize_for_match(quote)
    return F.when(F.length(q) > 0, F.array_join(F.transform(F.split(q, ""), one), hidden))


def locate_quote(quote: Column | str, content: Column | str) -> Column:
    """Struct (start, end) of the quote's first place in the original content, in UTF-16 units, end exclusive; null if absent."""
    c = col(content)

    def place(pattern: Column) -> Column:
        return bound(F.regexp_instr(c, pattern), lambda at: F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + utf16_length(F.regexp_substr(c, pattern))).alias("end"))))

    return bound(quote_pattern(quote), place)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def quote_locates(quote: Column | str, content: Column | str) -> Column:
    """The scorer's own search: NFKC, dashes, quotes and spaces unified, case ignored."""

    def folded(c: Column | str) -> Column:
        t = F.translate(nfkc(col(c)), "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2018\u2019\u201b\u201c\u201d\u00a0", "-------'''\"\" ")
        return F.lower(F.trim(F.regexp_replace(t, f"{SPACE}+", " ")))

    q = folded(quote)
    return (F.length(q) > 0) & folded(content).contains(q)


def folded_subject(c: Column | str) -> Column:
    """The scorer's form of a subject: NFKC, lower case, without points and commas."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(col(c))), "[.,]", ""), f"{SPACE}+", " "))


def subjects_agree(a: Column | str, b: Column | str) -> Column:
    return folded_subject(a) == folded_subject(b)


def digits_of(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), "[^0-9.]", ""), r"\.+$", "")


def states_value(numeric: Column | str, raw: Column | str, quote: Column | str) -> Column:
    """Whether the digits of the claim's figure stand in those of the quote."""
    wanted = digits_of(F.coalesce(col(numeric), col(raw)))
    return F.coalesce((F.length(wanted) > 0) & digits_of(quote).contains(wanted), F.lit(False))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def overlaps_statement(statement: Column | str, quote: Column | str) -> Column:
    """Whether the quote holds at least 60 percent (rounded up) of the statement's distinct words."""

    def judge(x: Column) -> Column:
        n = F.size(x["s"])
        return (n > 0) & (F.size(F.array_intersect(x["s"], x["q"])) >= F.floor((6 * n + 9) / 10))

    return bound(F.struct(_words(col(statement)).alias("s"), _words(col(quote)).alias("q")), judge)


def _part(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), f"{SPACE}+", " "))


def assertion_fingerprint(claim: Column) -> Column:
    """sha256 of what a claim asserts; its quote and wording do not count."""
    qualifiers = F.array_join(F.array_sort(F.transform(claim["qualifiers"], lambda q: F.concat(_part(q["name"]), F.lit("="), _part(q["value"])))), "|")
    parts = [_part(claim["subject"]), claim["predicate"], _part(F.coalesce(claim["numeric_value"], claim["raw_value"]))]
    parts += [_part(claim[k]) for k in ("currency", "scale", "unit", "period_label")]
    parts += [F.coalesce(claim["period_type"], F.lit("")), _part(claim["scope"]), F.coalesce(claim["assertion_status"], F.lit("")), F.coalesce(qualifiers, F.lit(""))]
    return F.sha2(F.concat_ws(" ", *parts), 256)


def chunk_fingerprint(text: Column, heading: Column, refs: Column, vocabulary: Column, prompt_version: Column, model: Column) -> Column:
    """sha256 of a chunk and everything that decides what is read from it; refs: array of struct (ref, block_id)."""
    end = F.lit("\u001f")
    pairs = F.array_join(F.transform(refs, lambda r: F.concat(r["ref"], F.lit("="), r["block_id"], end)), "")
    return F.sha2(F.concat(text, end, F.coalesce(heading, F.lit("")), end, pairs, vocabulary, end, prompt_version, end, model, end), 256)


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    t = col(text)
    return F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def estimate_tokens(text: Column | str) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("int")


def describe_claim(claim: Column) -> Column:
    """The text to embed: what is measured, not its value."""
    named = F.transform(claim["qualifiers"], lambda q: F.concat(q["name"], F.lit(" "), q["value"]))
    unit = blank_as_null(claim["unit"])
    parts = F.array(claim["subject"], F.replace(claim["predicate"], F.lit("_"), F.lit(" ")), blank_as_null(claim["scope"]), blank_as_null(claim["period_label"]), F.concat(F.lit("measured in "), unit))
    return F.array_join(F.concat(F.filter(parts, lambda p: p.isNotNull()), F.coalesce(named, F.array().cast("array<string>"))), ", ")


def extract_json(text: Column | str) -> Column:
    """The JSON text in a reply: the whole, a fenced block, or from the first bracket to the last; else null."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    t = bare(col(text))
    fenced = bare(F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1))
    inner = F.regexp_extract(t, r"([\[{][\s\S]*[\]}])", 1)
    valid = lambda c: F.try_parse_json(c).isNotNull() & (F.length(c) > 0)
    return first_match([(valid(t), t), (valid(fenced), fenced), (valid(inner), inner)])


def apportion(total: Column, weights: Column) -> Column:
    """Whole shares of a total by weight; the last takes the rest. Without weight the shares are even."""

    def share(x: Column) -> Column:
        n, w = F.size(x["w"]), x["w"]
        floors = F.transform(w, lambda v: F.when(x["s"] > 0, F.floor(total * v / x["s"])).otherwise(F.floor(total / n)).cast("long"))
        return bound(floors, lambda f: F.transform(f, lambda v, i: F.when(i == n - 1, v + total - F.aggregate(f, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(v)))

    weights = F.transform(weights, lambda v: v.cast("double"))
    return bound(F.struct(weights.alias("w"), F.aggregate(weights, F.lit(0.0), lambda a, b: a + b).alias("s")), share)


def rewrite_handles(text: Column | str, prefix: str) -> Column:
    """[B1] alone on a line becomes [<prefix>B1]."""
    return F.regexp_replace(col(text), r"(?m)^\[(B[0-9]+)\]$", f"[{prefix}$1]")


def format_value(raw: Column, numeric: Column, currency: Column, scale: Column, unit: Column) -> Column:
    """The figure as stated, else built from its parts, else a dash."""
    parts = F.concat_ws(" ", *[blank_as_null(c) for c in (currency, numeric, scale, unit)])
    return F.coalesce(blank_as_null(raw), F.when(numeric.isNotNull(), parts), F.lit("—"))


def format_bytes(size: Column) -> Column:
    mb = size / (1024 * 1024)
    return F.when(size < 1024, F.format_string("%d B", size)).when(mb >= 1, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%.0f KB", size / 1024))


def page_label(physical_page: Column, printed: Column) -> Column:
    """Pages are shown from 1, with the printed label where there is one."""
    return F.when(printed.isNull(), F.format_string("page %d", physical_page + 1)).otherwise(F.format_string("page %d (printed %s)", physical_page + 1, printed))


#: Characters that are passed on: of a text to embed, a statement, a quote, its surroundings, and a page's native text.
LIMITS = {"embed": 1200, "statement": 600, "quote": 400, "context": 900, "native": 8000}


def cut_for(kind: str, text: Column | str) -> Column:
    return F.substring(col(text), 1, LIMITS[kind])


NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/factloom/fact-group")


def uuid5(name: Column) -> Column:
    """Name-based (version 5) UUID in this package's namespace, without a UDF."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    part = lambda i, n: F.substring(digest, i, n)
    variant = F.lower(F.hex((F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def fact_group_id(collection: Column, entity: Column, predicate: Column, context: Column) -> Column:
    """One id for all claims of a collection on one entity, measure and context; null without an entity."""
    return F.when(entity.isNotNull(), uuid5(F.concat_ws("\u001f", collection, entity, predicate, context)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays; null if a length is 0 or they differ in width."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), 1 - dot(a, b) / size).otherwise(null("double"))
