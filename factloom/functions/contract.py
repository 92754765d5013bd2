"""The strict form of a model's replies: presence, JSON type and limits of every member, as violations a row.

A number where a text is asked for, a null, and a member that is not there are told apart: Spark finds the JSON text and
says whether it is valid, and a claim's members are judged by Arrow batches in Python (verdicts: as VARIANT). Members that are not asked for are left out. A reply that breaks a rule anywhere gives
no claims; the first violations, claim by claim, are the feedback for one repair call (`seams.extract`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions.text import extract_json, utf16_length

CLAIM = (
    "struct<subject:string,predicate:string,original_statement:string,raw_value:string,numeric_value:string,currency:string,scale:string,unit:string,period_label:string,period_type:string,"
    "scope:string,assertion_status:string,qualifiers:array<struct<name:string,value:string>>,evidence_block_ids:array<string>,quote:string>"
)
# The longest texts, the largest numbers of members, the forms and the words that are allowed.
REQUIRED = {"subject": 300, "predicate": 120, "original_statement": 2000, "quote": 1200}
OPTIONAL = {"raw_value": 200, "currency": 20, "scale": 40, "unit": 60, "period_label": 80, "scope": 120}
PREDICATE, DECIMAL = r"^[a-z0-9]+(?:_[a-z0-9]+)*$", r"^-?[0-9]+(?:\.[0-9]+)?$"
PERIOD_TYPES = ("fiscal_year", "calendar_year", "quarter", "half_year", "month", "as_of_date", "range", "unknown")
STATUSES = ("reported", "restated", "estimate", "forecast", "pro_forma", "target", "unknown")
MOST_QUALIFIERS, QUALIFIER_NAME, QUALIFIER_VALUE, MOST_HANDLES, HANDLE, MOST_CLAIMS, SHOWN = 12, 80, 400, 8, 20, 60, 6
LABELS = ("corroborates", "contradicts", "likely_contradiction", "reconciled_by_context", "insufficient_context", "unrelated")
MOST_RATIONALE = 1200
# For each list of a verdict: the longest text and the most members.
VERDICT_LISTS = {"evidence_ids": (20, 10), "differing_context": (120, 10), "uncertainty_reasons": (300, 8)}


def kind(v: Column) -> Column:
    """JSON type of a VARIANT: STRING, BIGINT, DECIMAL, BOOLEAN, VOID (null), ARRAY or OBJECT; null if it is not there."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_text(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def _text(v: Column) -> Column:
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def _fits(v: Column, least: int, most: int) -> Column:
    return is_text(v) & F.coalesce(utf16_length(_text(v)).between(least, most), F.lit(False))


def _list(v: Column) -> Column:
    return F.when(F.coalesce(kind(v) == "ARRAY", F.lit(False)), F.try_variant_get(v, "$", "array<variant>"))


def _problems(said: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in said]), lambda x: x.isNotNull())


def _units(text: str) -> int:
    """UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _form(pattern: str) -> Callable[[str], bool]:
    """Whether a text has the form; as for Java's `$`, one line end may follow."""
    found = re.compile(pattern.removesuffix("$") + "(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z").match
    return lambda text: found(text) is not None


def _short(x: object, most: int) -> bool:
    return isinstance(x, str) and 1 <= _units(x) <= most


def _rules() -> list[tuple[str, bool, Callable[[str], bool], str]]:
    """(member, whether it is required, whether a text is fine, the rule) in the order of a claim's fields; a text is judged by all rules of its member."""
    fits = lambda name, least, most, rule: (name, least > 0, lambda t: least <= _units(t) <= most, rule)
    required = lambda name: fits(name, 1, REQUIRED[name], f"1 to {REQUIRED[name]} characters")
    limit = lambda name: fits(name, 0, OPTIONAL[name], f"{OPTIONAL[name]} characters at most")
    known = lambda name, words: (name, False, lambda t: t in words, "not one of the known ones")
    return [
        required("subject"), required("predicate"), ("predicate", True, _form(PREDICATE), "words in lower case joined by underscores"), required("original_statement"), limit("raw_value"),
        ("numeric_value", False, _form(DECIMAL), "a plain decimal"), *map(limit, ("currency", "scale", "unit", "period_label")), known("period_type", PERIOD_TYPES), limit("scope"), known("assertion_status", STATUSES),
    ]


RULES = _rules()
_QUOTE = ("quote", True, lambda t: 1 <= _units(t) <= REQUIRED["quote"], f"1 to {REQUIRED['quote']} characters")


def claim_violations(c: object) -> list[str]:
    """What is wrong with a claim, in the order of its fields."""
    if not isinstance(c, dict):
        return [": a claim is needed"]
    said: list[str] = []

    def judge(name: str, needed: bool, fine: Callable[[str], bool], rule: str, last: str | None) -> None:
        x = c.get(name, ...)
        if isinstance(x, str):
            if not fine(x):
                said.append(f".{name}: {rule}")
        elif name != last and (needed or x is not None):
            said.append(f".{name}: a text is needed" if needed else f".{name}: a text or null is needed")

    last = None
    for rule in RULES:
        judge(*rule, last)
        last = rule[0]
    q, e = c.get("qualifiers"), c.get("evidence_block_ids")
    pair = lambda x: isinstance(x, dict) and _short(x.get("name"), QUALIFIER_NAME) and _short(x.get("value"), QUALIFIER_VALUE)
    if not isinstance(q, list) or len(q) > MOST_QUALIFIERS or not all(map(pair, q)):
        said.append(f".qualifiers: {MOST_QUALIFIERS} at most, each with name and value")
    if not isinstance(e, list) or not 1 <= len(e) <= MOST_HANDLES or not all(_short(x, HANDLE) for x in e):
        said.append(f".evidence_block_ids: 1 to {MOST_HANDLES} handles")
    judge(*_QUOTE, None)
    return said


def reply_violations(text: str | None, read: Callable[[str], tuple] = json.JSONDecoder(strict=False, parse_int=lambda _: 0, parse_float=lambda _: 0.0).raw_decode) -> list[str]:
    """What is wrong with a reply's JSON text, which Spark has found valid (null if there is none). What a number is does not matter, nor what follows the text."""
    v = None if text is None else read(text.lstrip(" \t\r\n"))[0]
    if not isinstance(v, dict) or "claims" not in v:
        return ["claims: missing"]
    claims = v["claims"]
    if not isinstance(claims, list):
        return ["claims: a list is needed"]
    return [f"claims: {MOST_CLAIMS} at most"] * (len(claims) > MOST_CLAIMS) + [f"claims.{i}{x}" for i, c in enumerate(claims) for x in claim_violations(c)]


@F.arrow_udf(StringType())
def _feedback(texts: pa.Array) -> pa.Array:
    """The first violations of each reply; null if there is none."""
    return pa.array(["; ".join(wrong[:SHOWN]) if (wrong := reply_violations(t)) else None for t in texts.to_pylist()], pa.string())


def read_replies(replies: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Replies (reply_id, reply as text around JSON) with claims, ok, and feedback: the first six violations, claim by claim. `keep`: further columns that go along."""
    r = replies.select("reply_id", *keep, extract_json("reply").alias("__json")).withColumn("feedback", _feedback("__json"))
    ok = F.col("feedback").isNull()
    claims = F.from_json("__json", f"struct<claims:array<{CLAIM}>>")["claims"]
    return r.select("reply_id", *keep, ok.alias("ok"), F.when(ok, claims).alias("claims"), "feedback")


def read_verdicts(replies: DataFrame) -> DataFrame:
    """A classifier's replies (reply_id, reply, handles: array of (handle, evidence_id)), judged and with their handles resolved.

    label, rationale, supporting_evidence_ids (of known handles, each once, in order), differing_context, uncertainty_reasons;
    or null fields and the first violation as `problem`.
    """
    r = replies.withColumn("__v", F.try_parse_json(extract_json("reply")))
    v = F.col("__v")
    said = [(~F.coalesce(_text(member(v, "label")).isin(*LABELS), F.lit(False)), "label: not one of the known ones"), (~_fits(member(v, "rationale"), 1, MOST_RATIONALE), f"rationale: 1 to {MOST_RATIONALE} characters")]
    for name, (most, n) in VERDICT_LISTS.items():
        x = _list(member(v, name))
        said.append((x.isNull() | (F.size(x) > n) | F.exists(x, lambda t: ~_fits(t, 0, most)), f"{name}: a list of {n} texts at most"))  # noqa: B023
    r = r.withColumn("problem", F.get(_problems(said), F.lit(0)))
    texts = lambda name: F.transform(_list(member(v, name)), _text)
    known = F.map_from_entries("handles")
    found = F.array_distinct(F.filter(F.transform(texts("evidence_ids"), lambda h: F.try_element_at(known, h)), lambda x: x.isNotNull()))
    fine = lambda c, name: F.when(F.col("problem").isNull(), c).alias(name)
    return r.select("reply_id", fine(_text(member(v, "label")), "label"), fine(_text(member(v, "rationale")), "rationale"), fine(found, "supporting_evidence_ids"), fine(texts("differing_context"), "differing_context"), fine(texts("uncertainty_reasons"), "uncertainty_reasons"), "problem")
