"""Set-based resolution of subjects to entities, predicate registration, and normalised claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.entities import is_generic_subject, normalize_entity_label, scoped_label
from factloom.functions.numbers import normalize_value, significant_digits
from factloom.functions.periods import fiscal_convention, resolve_period
from factloom.functions.predicates import normalize_predicate
from factloom.functions.text import fact_group_id, uuid5
from factloom.operators.sinks import insert_if_absent
from factloom.sources.scratch import read_once, stored


#: Parts that a frequent word's entities are dealt to before its first ones are chosen.
PARTS = 64


def claim_labels(claims: DataFrame) -> DataFrame:
    """Claims with the label to resolve: generic subjects are tied to their document."""
    scope = F.when(is_generic_subject("subject"), F.col("document_id"))
    return claims.withColumn("label", scoped_label("subject", scope))


def resolve_entities(labels: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each distinct (collection_id, label): entity_id and method exact, alias or created; never null.

    entities: id, collection_id, normalized_label; aliases: entity_id, normalized_alias. A new
    entity's id follows from collection and label, so the order of rows does not matter.
    """
    d = labels.select("collection_id", "label").distinct()
    exact = entities.groupBy("collection_id", F.col("normalized_label").alias("label")).agg(F.min("id").alias("exact_id"))
    owner = aliases.join(entities.select(F.col("id").alias("entity_id"), "collection_id"), "entity_id")
    alias = owner.groupBy("collection_id", F.col("normalized_alias").alias("label")).agg(F.min("entity_id").alias("alias_id"))
    j = d.join(exact, ["collection_id", "label"], "left").join(alias, ["collection_id", "label"], "left")
    new = uuid5(F.concat_ws("\u001f", F.lit("entity"), "collection_id", "label"))
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("alias_id").isNotNull(), "alias").otherwise("created")
    return j.select("collection_id", "label", F.coalesce("exact_id", "alias_id", new).alias("entity_id"), method.alias("method"))


def entity_candidates(labels: DataFrame, entities: DataFrame, part_rows: int = 512) -> DataFrame:
    """Entities of the same collection that share a word of more than two letters with a label, each pair once.

    Labels and entities meet under every shared word, and a pair is kept under the least of them. A word that many share is
    cut by its counts into parts of about `part_rows` on either side, and only parts meet. Nulls have no words.
    """
    word = ["collection_id", "word"]
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2))
    left = labels.select("collection_id", "label", words(F.col("label")).alias("own")).distinct().withColumn("word", F.explode("own"))
    right = entities.select(F.col("id").alias("entity_id"), "collection_id", "normalized_label", words(F.col("normalized_label")).alias("other")).distinct().withColumn("word", F.explode("other"))
    cuts = F.ceil(F.count("*") / part_rows).cast("int")
    shared = left.groupBy(*word).agg(cuts.alias("cuts")).join(right.groupBy(*word).agg(cuts.alias("other_cuts")), word)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = left.join(shared, word).select(*word, "label", "own", part("label", "cuts").alias("part"), each("other_cuts").alias("other_part"))
    r = right.join(shared, word).select(*word, "entity_id", "normalized_label", "other", part("entity_id", "other_cuts").alias("other_part"), each("cuts").alias("part"))
    j = l.join(r, [*word, "part", "other_part"]).where(F.col("word") == F.array_min(F.array_intersect("own", "other")))
    return j.select("collection_id", "label", "entity_id", "normalized_label")


def first_candidates(labels: DataFrame, entities: DataFrame, budget: int = 1) -> DataFrame:
    """The rows of entity_candidates that asked_candidates keeps: the first `budget` of a label by name, found without the others.

    An entity that is among the first of a label is among the first of any word that they share, so each word offers only
    its first `budget` entities, and labels meet those.
    """
    word = ["collection_id", "word"]
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2)))
    least = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, budget)
    e = entities.select(F.col("id").alias("entity_id"), "collection_id", "normalized_label").distinct().select("collection_id", words(F.col("normalized_label")).alias("word"), F.struct("normalized_label", "entity_id").alias("e"))
    # A word's entities are cut down in parts first, so that no task gathers all of a frequent word.
    e = e.groupBy(*word, F.pmod(F.xxhash64("e"), F.lit(PARTS)).alias("part")).agg(least("e").alias("e")).select(*word, F.explode("e").alias("e"))
    offered = e.groupBy(*word).agg(least("e").alias("offered"))
    own = labels.select("collection_id", "label").distinct().select("collection_id", "label", words(F.col("label")).alias("word"))
    asked = own.join(offered, word).select("collection_id", "label", F.explode("offered").alias("e")).groupBy("collection_id", "label").agg(least("e").alias("e"))
    return asked.select("collection_id", "label", F.explode("e").alias("e")).select("collection_id", "label", "e.entity_id", "e.normalized_label")


def document_conventions(blocks: DataFrame) -> DataFrame:
    """Each document's fiscal convention: the first native block, in page order, that states one."""
    c = blocks.where("extraction_method = 'native_text'").withColumn("convention", fiscal_convention("content")).where("convention is not null")
    return c.groupBy("document_id").agg(F.min_by("convention", F.struct("physical_page", "block_index")).alias("convention"))


def normalize_claims(claims: DataFrame, conventions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims with base value and unit, precision, period dates, entity and fact group."""
    own = ["id", "collection_id", "document_id", "subject", "predicate", "numeric_value", "scale", "unit", "currency", "period_label", "period_type", "scope"]
    c = stored(claims.select(*own).join(conventions.select("document_id", "convention"), "document_id", "left"), "claims")
    c = read_once(c, ["subject"], {"generic": is_generic_subject("subject"), "name": normalize_entity_label("subject")}, "subjects")
    c = read_once(c, ["numeric_value", "scale", "unit", "currency"], {"n": normalize_value("numeric_value", "scale", "unit", "currency"), "digits": significant_digits("numeric_value")}, "values")
    c = read_once(c, ["period_label", "period_type", "convention"], {"p": resolve_period("period_label", "period_type", "convention")}, "periods")
    c = read_once(c, ["predicate"], {"measure": normalize_predicate("predicate")}, "measures")
    c = c.withColumn("label", F.concat_ws("#", "name", F.when(F.col("generic"), F.col("document_id"))))
    c = c.join(resolve_entities(c, entities, aliases), ["collection_id", "label"], "left")
    context = F.concat_ws("|", F.coalesce(F.col("p.period_type"), F.lit("")), F.coalesce(F.col("p.start").cast("string"), F.lit("")), F.coalesce(F.col("p.end").cast("string"), F.lit("")), F.coalesce(F.lower("scope"), F.lit("")))
    return c.withColumn("fact_group_id", fact_group_id(F.col("collection_id"), F.col("entity_id"), F.col("measure"), context)).select(
        "id", "collection_id", "document_id", "entity_id", "method", F.col("n.value").alias("normalized_value"), F.col("n.unit").alias("normalized_unit"),
        F.col("digits").alias("value_precision"), F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), "fact_group_id",
    )


def asked_candidates(candidates: DataFrame, budget: int = 1) -> DataFrame:
    """Candidates (collection_id, label, entity_id, normalized_label) that a model is asked about: the first `budget` of a label by name."""
    n = F.row_number().over(Window.partitionBy("collection_id", "label").orderBy("normalized_label", "entity_id"))
    return candidates.withColumn("turn", n).where(F.col("turn") <= budget)


def adjudicated_entities(resolved: DataFrame, candidates: DataFrame, verdicts: DataFrame | None, budget: int = 1, shown: int = 3) -> DataFrame:
    """resolve_entities with the model's rung: method model where a verdict says same, with reason and rejected names.

    verdicts: collection_id, label, entity_id, same, reason of the seam; without it names stay separate. A
    label's candidates are asked in turn until one is confirmed; those before it are the rejected ones.
    """
    key = ["collection_id", "label"]
    open_ = resolved.where("method = 'created'")
    if verdicts is None:
        c = asked_candidates(candidates, shown).withColumn("same", F.lit(False)).withColumn("why", F.lit("no judge was there"))
    else:
        v = verdicts.select(*key, "entity_id", "same", F.col("reason").alias("why"))
        c = asked_candidates(candidates, budget).join(v, [*key, "entity_id"], "left").withColumn("same", F.coalesce("same", F.lit(False)))
    c = c.withColumnRenamed("entity_id", "candidate_id").join(open_.select(*key), key, "left_semi")
    hit = c.where("same").groupBy(*key).agg(F.min("turn").alias("hit"), F.min_by("candidate_id", "turn").alias("found_id"), F.min_by("why", "turn").alias("found_why"))
    c = c.join(hit.select(*key, "hit"), key, "left").where(F.col("hit").isNull() | (F.col("turn") < F.col("hit")))
    line = F.struct("turn", F.concat("normalized_label", F.lit(": "), F.coalesce("why", F.lit("unanswered"))).alias("said"))
    rejected = c.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["said"]).alias("rejected"))
    j = resolved.join(hit.drop("hit"), key, "left").join(rejected, key, "left").withColumn("rejected", F.coalesce("rejected", F.array().cast("array<string>")))
    method = F.when(F.col("found_id").isNotNull(), "model").otherwise(F.col("method"))
    reason = F.when(method == "model", F.col("found_why")).when(method == "exact", "the name is known").when(method == "alias", "an alias is known").when(F.size("rejected") > 0, "names alike, none confirmed").otherwise("a new name")
    return j.select(*key, F.coalesce("found_id", "entity_id").alias("entity_id"), method.alias("method"), reason.alias("reason"), "rejected")


def new_aliases(resolved: DataFrame, labelled: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias rows to append for labels that a model has merged; one a label, none that is stored.

    labelled: claims with label and subject; the subject of the least claim id is the alias as written.
    """
    key = ["collection_id", "label"]
    written = labelled.groupBy(*key).agg(F.min_by("subject", "id").alias("alias"), F.min_by("block_id", "id").alias("source_block_id"))
    rows = resolved.where("method = 'model'").join(written, key).select("entity_id", "alias", F.col("label").alias("normalized_alias"), F.lit("model_suggested").alias("established_by"), "source_block_id")
    return insert_if_absent(aliases, rows, ["entity_id", "normalized_alias"], ["alias"])


def new_entities(resolved: DataFrame, labelled: DataFrame) -> DataFrame:
    """Entity rows to append for labels that nothing matched."""
    key = ["collection_id", "label"]
    written = labelled.groupBy(*key).agg(F.min_by("subject", "id").alias("subject"))
    return resolved.where("method = 'created'").join(written, key).select(F.col("entity_id").alias("id"), "collection_id", F.trim("subject").alias("canonical_label"), F.col("label").alias("normalized_label"), F.lit("unknown").alias("entity_type"))


def canonical_predicates(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims (id, collection_id, predicate) with the registry's name for their predicate, found by name or alias; null if there is none."""
    names = registry.select("collection_id", "canonical_name", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    known = names.groupBy("collection_id", normalize_predicate("name").alias("p")).agg(F.min("canonical_name").alias("canonical_name"))
    return claims.select("id", "collection_id", "predicate", normalize_predicate("predicate").alias("p")).join(known, ["collection_id", "p"], "left").drop("p")


def register_predicates(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """New registry rows (collection_id, canonical_name, unit, first_claim_id): one a normal form not known by name or alias.

    registry: collection_id, canonical_name, aliases.
    """
    new = claims.withColumn("canonical_name", normalize_predicate("predicate")).where("canonical_name != ''")
    first = F.row_number().over(Window.partitionBy("collection_id", "canonical_name").orderBy("id"))
    new = new.withColumn("__n", first).where("__n = 1").select("collection_id", "canonical_name", "unit", F.col("id").alias("first_claim_id"))
    known = registry.select("collection_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return new.join(known.select("collection_id", normalize_predicate("name").alias("canonical_name")).distinct(), ["collection_id", "canonical_name"], "left_anti")


def render_vocabulary(registry: DataFrame, most: int = 60) -> DataFrame:
    """The first predicates of each collection by name, one a line with description and unit where there are any, as one text."""
    n = F.row_number().over(Window.partitionBy("collection_id").orderBy("canonical_name"))
    rows = registry.withColumn("__n", n).where(F.col("__n") <= most)
    some = lambda c: F.when(F.length(c) > 0, F.col(c)) if c in registry.columns else F.lit(None).cast("string")
    line = F.concat_ws(" ", F.concat(F.lit("- "), F.col("canonical_name")), F.concat(F.lit("— "), some("description")), F.concat(F.lit("(usually "), some("unit"), F.lit(")")))
    return rows.groupBy("collection_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))), lambda x: x["line"]), "\n").alias("vocabulary"))
