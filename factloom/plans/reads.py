"""The read layer: listings and summaries as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.checks import LABELS, run_checks
from factloom.operators.state import is_stalled, is_terminal, latest_runs

FACT_COLUMNS = (
    "id", "document_id", "filename", "subject", "predicate", "original_statement", "raw_value", "numeric_value", "normalized_value", "normalized_unit", "currency", "scale",
    "unit", "period_label", "period_type", "scope", "assertion_status", "status", "status_reason", "entity_id", "entity_label", "pages", "evidence_count", "created_at",
)
# The dimensions of a context.
DIMENSIONS = ("period", "period_type", "scope", "assertion_status", "unit", "currency", "qualifier")
LABEL_RANK = ("contradicts", "likely_contradiction", "reconciled_by_context", "corroborates", "insufficient_context", "unrelated")


def evidence_index(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """claim_id, pages (sorted, distinct), evidence_count, first_page."""
    j = evidence.join(blocks.select(F.col("block_id").alias("source_block_id"), "physical_page"), "source_block_id")
    g = j.groupBy("claim_id").agg(F.array_sort(F.collect_set("physical_page")).alias("pages"), F.count("*").alias("evidence_count"), F.min("physical_page").alias("first_page"))
    return g


def claim_base(claims: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims with filename and collection of their document, and the entity's label where there is one."""
    d = documents.select(F.col("id").alias("document_id"), "filename", "collection_id")
    e = entities.select(F.col("id").alias("entity_id"), F.col("canonical_label").alias("entity_label"))
    return claims.drop("collection_id", "filename").join(d, "document_id").join(e, "entity_id", "left")


def facts(claims: DataFrame, documents: DataFrame, entities: DataFrame, evidence: DataFrame, blocks: DataFrame, **equal: str) -> DataFrame:
    """Fact summaries that match all given columns (collection_id, document_id, entity_id, predicate, status)."""
    base = claim_base(claims, documents, entities)
    for name, value in equal.items():
        if value is not None:
            base = base.where(F.col(name) == value)
    out = base.join(evidence_index(evidence, blocks), base["id"] == F.col("claim_id"), "left")
    return out.withColumn("pages", F.coalesce("pages", F.array().cast("array<int>"))).withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))


def fact_page(facts_: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of facts by filename, first evidence page (none last) and id."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return facts_.orderBy("filename", F.col("first_page").asc_nulls_last(), "id").offset(offset).limit(limit).select(*FACT_COLUMNS)


def fact_details(facts_: DataFrame, evidence: DataFrame, blocks: DataFrame, relationships: DataFrame) -> DataFrame:
    """Facts with their evidence in reading order and the number of relationships they are in."""
    b = blocks.select(F.col("block_id").alias("source_block_id"), F.col("physical_page").alias("page"), "block_index", "printed_page_label", "block_type", "content", bounding_box().alias("bbox"))
    item = F.struct("page", "block_index", "evidence_id", "source_block_id", "quote", "verification", "entailment", "support_role", "printed_page_label", "block_type", "content", "bbox")
    e = evidence.join(b, "source_block_id").groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    out = facts_.drop("claim_id").join(e.withColumnRenamed("claim_id", "id"), "id", "left").join(relationship_degree(relationships), "id", "left")
    return out.withColumn("relationship_count", F.coalesce("relationship_count", F.lit(0)))


def bounding_box() -> Column:
    """Struct of the four sides, null unless all are there."""
    sides = ("bbox_x", "bbox_y", "bbox_width", "bbox_height")
    whole = F.lit(True)
    for s in sides:
        whole = whole & F.col(s).isNotNull()
    return F.when(whole, F.struct(*[F.col(s).alias(s[5:]) for s in sides]))


def relationship_degree(relationships: DataFrame) -> DataFrame:
    ends = relationships.select(F.explode(F.array("claim_a_id", "claim_b_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("relationship_count"))


def predicates_of(claims: DataFrame) -> DataFrame:
    """Distinct predicates of each collection."""
    return claims.select("collection_id", "predicate").distinct()


def units_in_use(claims: DataFrame) -> DataFrame:
    """Distinct (predicate, unit) of each document."""
    return claims.select("document_id", "predicate", "unit").distinct()


def relationship_list(relationships: DataFrame, claims: DataFrame, label: str | None = None, claim_id: str | None = None) -> DataFrame:
    """Relationships with both claims; those with a missing claim are left out."""
    r = relationships
    if label is not None:
        r = r.where(F.col("label") == label)
    if claim_id is not None:
        r = r.where((F.col("claim_a_id") == claim_id) | (F.col("claim_b_id") == claim_id))
    side = lambda s: claims.select(F.col("id").alias(f"claim_{s}_id"), F.struct("document_id", "subject", "predicate", "raw_value", "status").alias(f"claim_{s}"))
    return r.join(side("a"), "claim_a_id").join(side("b"), "claim_b_id")


def relationship_page(listed: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a relationship list, newest first, then by id."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return listed.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def relationship_details(relationships: DataFrame, claims: DataFrame) -> DataFrame:
    """Relationships with both claims whole (structs a and b) and the checks of the pair, made anew."""
    whole = claims.select("id", F.struct(*claims.columns).alias("c"))
    side = lambda s: whole.select(F.col("id").alias(f"claim_{s}_id"), F.col("c").alias(s))
    return run_checks(relationships.join(side("a"), "claim_a_id").join(side("b"), "claim_b_id"))


def collection_list(collections: DataFrame) -> DataFrame:
    """Collections, newest first."""
    return collections.orderBy(F.col("created_at").desc(), "id")


def label_counts(relationships: DataFrame) -> DataFrame:
    """Relationships of each collection by label, zero where there are none."""
    names = relationships.select("collection_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    n = relationships.groupBy("collection_id", "label").agg(F.count("*").alias("total"))
    return names.join(n, ["collection_id", "label"], "left").withColumn("total", F.coalesce("total", F.lit(0)))


def document_list(documents: DataFrame, runs: DataFrame, issues: DataFrame, now: Column) -> DataFrame:
    """Documents in order of their creation, with their newest run, whether it has stalled, and the number of its issues."""
    last = latest_runs(runs).withColumn("stalled", is_stalled(now)).withColumn("terminal", is_terminal(F.col("stage")))
    n = issues.groupBy("run_id").agg(F.count("*").alias("issue_count"))
    r = last.join(n, "run_id", "left").select("document_id", "run_id", "stage", "stalled", "terminal", F.coalesce("issue_count", F.lit(0)).alias("issue_count"))
    return documents.join(r.withColumnRenamed("document_id", "id"), "id", "left").orderBy("created_at", "id")


def run_detail(runs: DataFrame, documents: DataFrame, issues: DataFrame, now: Column) -> DataFrame:
    """Runs with filename and their issues, newest first."""
    i = issues.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "failure_kind", "physical_page", "message", "resolution")), asc=False).alias("issues"))
    d = documents.select(F.col("id").alias("document_id"), "filename", "collection_id")
    return runs.join(d, "document_id").join(i, "run_id", "left").withColumn("stalled", is_stalled(now))


def issues_by_kind(issues: DataFrame) -> DataFrame:
    """Issues by kind, and how many of them are not resolved."""
    return issues.groupBy("failure_kind").agg(F.count("*").alias("n"), F.count_if(F.col("resolution") != "resolved").alias("unresolved"))


def runs_by_stage(runs: DataFrame) -> DataFrame:
    return runs.groupBy("stage").agg(F.count("*").alias("n"))


def progress(done: Column, total: Column) -> Column:
    """Share of a run's work that is done, 0 to 1; null without a total."""
    return F.when(total > 0, F.least(F.lit(1.0), done / total))


def visual_pages(blocks: DataFrame, page_kinds: DataFrame, producer: str, most: int = 40) -> DataFrame:
    """Structured pages of each document that this producer has not transcribed yet, the first `most`."""
    done = blocks.where(F.col("produced_by") == producer).select("document_id", "physical_page").distinct()
    todo = page_kinds.where("visual_route").select("document_id", "physical_page").distinct().join(done, ["document_id", "physical_page"], "left_anti")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("physical_page"))
    return todo.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def collections_by_key(collections: DataFrame, key: str) -> DataFrame:
    """By id if the key looks like a UUID, else by name."""
    uuid_like = F.lit(key).rlike("^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return collections.where(F.when(uuid_like, F.col("id") == key).otherwise(F.col("name") == key))


QUALIFIER = "array<struct<name:string,value:string>>"


def _read_json(raw: Column, strict: Column | None, of_variants: Callable[[Column], Column], of_texts: Callable[[Column], Column]) -> Column:
    """What the members of a JSON array give. A text of strict JSON (`strict`: its try_parse_json, if it is at hand) is parsed once and its
    members read as variants; only others, such as objects that repeat a key, go member by member as texts."""
    strict = F.try_parse_json(raw) if strict is None else strict

    def members(x: Column) -> Column:
        none = F.array().cast("array<variant>")
        return F.when(x.isNotNull() | raw.isNull(), of_variants(F.coalesce(F.try_variant_get(x, "$", "array<variant>"), none))).otherwise(of_texts(_members(raw)))

    return members(strict)


def _members(raw: Column) -> Column:
    """Members of a JSON array, each as JSON text; none if the text is no array."""
    return F.coalesce(F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def _field(member: Column, name: str) -> Column:
    """A field of an object that is a text; null for other kinds of values."""
    field = F.try_variant_get(member, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def _text(member: Column, name: str) -> Column:
    """The same of an object's JSON text."""
    return _field(F.try_parse_json(member), name)


def lenient_qualifiers(raw: Column, strict: Column | None = None) -> Column:
    """Qualifiers of a JSON array; members without two texts are left out."""

    def read(members: Column, text: Callable[[Column, str], Column]) -> Column:
        each = F.transform(members, lambda m: F.struct(text(m, "name").alias("name"), text(m, "value").alias("value")))
        return F.filter(each, lambda q: q["name"].isNotNull() & q["value"].isNotNull())

    return _read_json(raw, strict, lambda m: read(m, _field), lambda m: read(m, _text))


def lenient_differences(raw: Column, strict: Column | None = None) -> Column:
    """Context differences of a JSON array; members of no known dimension are left out, sides that are no texts are null."""

    def read(members: Column, text: Callable[[Column, str], Column], plain: Callable[[Column], Column]) -> Column:
        known = F.filter(members, lambda m: text(m, "dimension").isin(*DIMENSIONS))
        return F.transform(known, lambda m: F.struct(text(m, "dimension").alias("dimension"), text(m, "a").alias("a"), text(m, "b").alias("b"), (F.coalesce(plain(m), F.lit("")) == "true").alias("could_explain_gap")))

    gap = "$.couldExplainGap"
    return _read_json(raw, strict, lambda m: read(m, _field, lambda x: F.try_variant_get(x, gap, "string")), lambda m: read(m, _text, lambda x: F.get_json_object(x, gap)))


def lenient_strings(raw: Column, strict: Column | None = None) -> Column:
    """Texts of a JSON array; members of other kinds are left out."""
    members = F.coalesce(F.try_variant_get(F.try_parse_json(raw) if strict is None else strict, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(members, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


def lenient_aliases(raw: Column, strict: Column | None = None) -> Column:
    """Aliases of a registry row: the texts of a JSON array, blank ones left out."""
    return F.filter(lenient_strings(raw, strict), lambda x: F.length(F.trim(x)) > 0)
