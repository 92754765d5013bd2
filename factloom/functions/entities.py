"""Names of entities: normal form, generic subjects, and whether two claims speak of one subject."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.base import col, fold

# Legal forms at the end of a name, and subjects that name no entity.
LEGAL = ("limited", "ltd", "private", "pvt", "plc", "inc", "incorporated", "corp", "corporation", "llp", "llc", "gmbh", "sa", "nv", "bv", "co", "company")
GENERIC = (
    "document", "documents", "this document", "presentation", "this presentation", "the presentation", "report", "this report", "the report", "company",
    "the company", "issuer", "the issuer", "it", "they", "we", "us", "our company", "the group", "group",
)


def _clean(raw: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(raw), "[.,]", " "), r"[^a-z0-9&\s-]", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_entity_label(raw: Column | str) -> Column:
    """Lower-case name without punctuation and without legal forms at its end; one word always stays."""
    return F.regexp_replace(_clean(col(raw)), rf"(?: (?:{'|'.join(LEGAL)}))+$", "")


def stripped_suffixes(raw: Column | str) -> Column:
    """The legal forms that normalize_entity_label takes off, in order."""
    end = F.trim(F.regexp_extract(_clean(col(raw)), rf"((?: (?:{'|'.join(LEGAL)}))+)$", 1))
    return F.filter(F.split(end, " "), lambda w: w != "")


def is_generic_subject(subject: Column | str) -> Column:
    text = F.regexp_replace(fold(col(subject)), "[.,]$", "")
    return (text == "") | text.isin(*GENERIC)


def scoped_label(raw: Column | str, scope_key: Column | str) -> Column:
    """Normal form, tied to a scope (a document) where one is given."""
    return F.concat_ws("#", normalize_entity_label(raw), col(scope_key))


def same_subject(entity_a: Column, subject_a: Column, entity_b: Column, subject_b: Column) -> Column:
    """By entity if both are resolved, else by name."""
    return F.when(entity_a.isNotNull() & entity_b.isNotNull(), entity_a == entity_b).otherwise(normalize_entity_label(subject_a) == normalize_entity_label(subject_b))
