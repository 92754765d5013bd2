"""Queries over the read layer, the gold set and the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import numbers
from factloom.plans import evaluation, reads
from factloom.plans.fixture import table, with_tables
from factloom.plans.queries_values import NORMAL as NORMAL_FIGURES
from factloom.plans.queries_values import RULED
from factloom.sources import exports, gold


def _facts(spark: SparkSession, sf_dir: str, **equal: str) -> DataFrame:
    names = ("claims", "documents", "entities", "evidence", "blocks")
    return reads.facts(*[table(spark, sf_dir, n) for n in names], **equal)


FACTS = """
ei AS (SELECT claim_id, list_sort(list(DISTINCT physical_page)) AS pages, count(*) AS evidence_count, min(physical_page) AS first_page FROM evidence e JOIN blocks b ON b.block_id = e.source_block_id GROUP BY claim_id),
facts AS (SELECT c.id, c.document_id, d.filename, d.collection_id, c.predicate, c.status, c.entity_id, e.canonical_label AS entity_label, coalesce(ei.pages, []) AS pages, coalesce(ei.evidence_count, 0) AS evidence_count, ei.first_page
  FROM claims c JOIN x_documents d ON d.id = c.document_id LEFT JOIN entities e ON e.id = c.entity_id LEFT JOIN ei ON ei.claim_id = c.id)
"""


def j02_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages")
    return f.select("id", "document_id", "filename", "collection_id", "predicate", "status", "entity_id", "entity_label", pages, "evidence_count", "first_page")


J02 = f"""
{with_tables("claims", "documents", "entities", "evidence", "blocks")}, {FACTS}
SELECT id, document_id, filename, collection_id, predicate, status, entity_id, entity_label, array_to_string(pages, ',') AS pages, evidence_count, first_page FROM facts
"""


def o01_fact_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of facts with all their fields."""
    f = _facts(spark, sf_dir, collection_id="col1", status="accepted")
    n = numbers.normalize_value("numeric_value", "scale", "unit", "currency")
    f = f.withColumn("n", n).withColumn("normalized_value", F.col("n.value").cast("double")).withColumn("normalized_unit", F.col("n.unit")).withColumn("status_reason", F.concat(F.lit("as "), "status")).withColumn("created_at", F.col("orderkey"))
    return reads.fact_page(f, 50, 20).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


O01 = f"""
{with_tables("claims", "documents", "entities", "evidence", "blocks")}, {FACTS}, {NORMAL_FIGURES}
SELECT f.id, f.document_id, f.filename, n.subject, f.predicate, n.original_statement, n.raw_value, n.numeric_value, n.value AS normalized_value, n.nunit AS normalized_unit, n.currency, n.scale, n.unit, n.period_label, n.period_type, n.scope, n.assertion_status, f.status, 'as ' || f.status AS status_reason,
  f.entity_id, f.entity_label, array_to_string(f.pages, ',') AS pages, f.evidence_count, n.orderkey AS created_at
FROM facts f JOIN normal n ON n.id = f.id WHERE f.collection_id = 'col1' AND f.status = 'accepted' ORDER BY f.filename, f.first_page NULLS LAST, f.id LIMIT 50 OFFSET 20
"""


def a01_fact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy("collection_id", "status").agg(F.count("*").alias("total"))


A01 = f"""
{with_tables("claims", "documents")}
SELECT d.collection_id, c.status, count(*) AS total FROM claims c JOIN x_documents d ON d.id = c.document_id GROUP BY ALL
"""


def p07_fact_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "evidence").withColumn("quote", F.lit("q")).withColumn("support_role", F.lit("value"))
    d = reads.fact_details(_facts(spark, sf_dir, status="accepted"), e, table(spark, sf_dir, "blocks"), table(spark, sf_dir, "relationships"))
    shown = F.array_join(F.transform("evidence", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["block_index"].cast("string"), F.lit(":"), x["evidence_id"], F.lit(":"), F.when(x["bbox"].isNotNull(), "box").otherwise("none"))), " ")
    return d.select("id", shown.alias("evidence"), "relationship_count")


P07 = f"""
{with_tables("claims", "evidence", "blocks", "relationships")},
e AS (SELECT claim_id, string_agg(physical_page || ':' || block_index || ':' || evidence_id || ':' || CASE WHEN bbox_x IS NULL OR bbox_height IS NULL THEN 'none' ELSE 'box' END, ' ' ORDER BY physical_page, block_index, evidence_id) AS evidence FROM evidence v JOIN blocks b ON b.block_id = v.source_block_id GROUP BY claim_id),
g AS (SELECT id, count(*) AS n FROM (SELECT claim_a_id AS id FROM relationships UNION ALL SELECT claim_b_id FROM relationships) GROUP BY id)
SELECT c.id, e.evidence, coalesce(g.n, 0) AS relationship_count FROM claims c LEFT JOIN e ON e.claim_id = c.id LEFT JOIN g ON g.id = c.id WHERE c.status = 'accepted'
"""


def j06_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads.relationship_list(table(spark, sf_dir, "relationships"), table(spark, sf_dir, "claims"), label="contradicts")
    return r.select("id", "claim_a_id", "claim_b_id", F.col("claim_a.predicate").alias("predicate_a"), F.col("claim_b.predicate").alias("predicate_b"), F.col("claim_a.status").alias("status_a"), F.col("claim_b.status").alias("status_b"))


J06 = f"""
{with_tables("relationships", "claims")}
SELECT r.id, claim_a_id, claim_b_id, a.predicate AS predicate_a, b.predicate AS predicate_b, a.status AS status_a, b.status AS status_b FROM relationships r JOIN claims a ON a.id = r.claim_a_id JOIN claims b ON b.id = r.claim_b_id WHERE label = 'contradicts'
"""


def p05_relationships_of_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "relationships")
    return reads.relationship_list(r, table(spark, sf_dir, "claims"), claim_id="c3-6").select("id", "label")


P05 = f"""
{with_tables("relationships", "claims")}
SELECT r.id, label FROM relationships r JOIN claims a ON a.id = r.claim_a_id JOIN claims b ON b.id = r.claim_b_id WHERE 'c3-6' IN (claim_a_id, claim_b_id)
"""


def a02_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.label_counts(table(spark, sf_dir, "relationships"))


A02 = f"""
{with_tables("relationships")}, l AS (SELECT unnest(['corroborates', 'contradicts', 'reconciled_by_context', 'likely_contradiction', 'insufficient_context', 'unrelated']) AS label),
c AS (SELECT DISTINCT collection_id FROM relationships)
SELECT c.collection_id, l.label, count(r.id) AS total FROM c CROSS JOIN l LEFT JOIN relationships r ON r.collection_id = c.collection_id AND r.label = l.label GROUP BY ALL
"""


def a05_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.relationship_degree(table(spark, sf_dir, "relationships"))


A05 = f"""
{with_tables("relationships")}
SELECT id, count(*) AS relationship_count FROM (SELECT claim_a_id AS id FROM relationships UNION ALL SELECT claim_b_id FROM relationships) GROUP BY id
"""


def a06_predicates_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims")
    p = reads.predicates_of(c).groupBy("collection_id").agg(F.count("*").alias("predicates"))
    u = reads.units_in_use(c).join(c.select("document_id", "collection_id").distinct(), "document_id").groupBy("collection_id").agg(F.count("*").alias("units"))
    return p.join(u, "collection_id")


A06 = f"""
{with_tables("claims")}, u AS (SELECT DISTINCT collection_id, document_id, predicate, unit FROM claims), v AS (SELECT collection_id, count(*) AS units FROM u GROUP BY collection_id)
SELECT c.collection_id, count(DISTINCT predicate) AS predicates, any_value(v.units) AS units FROM claims c JOIN v ON v.collection_id = c.collection_id GROUP BY c.collection_id
"""


def a08_issues_and_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "issue_events").groupBy(F.col("failure_kind").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("issue"))
    s = table(spark, sf_dir, "runs").groupBy(F.col("stage").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("stage"))
    return i.unionByName(s)


A08 = f"""
{with_tables("issue_events", "runs")}
SELECT failure_kind AS name, count(*) AS n, 'issue' AS kind FROM issue_events GROUP BY ALL UNION ALL SELECT stage, count(*), 'stage' FROM runs GROUP BY ALL
"""


def a09_run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_cost(table(spark, sf_dir, "runs"))


A09 = f"""
{with_tables("runs")}
SELECT {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in evaluation.COUNTERS)}, (epoch_ms(max(finished_at)) - epoch_ms(min(started_at)))::BIGINT AS wall_clock_ms FROM runs
"""


def a10_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.structure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "blocks"))


A10 = f"""
{with_tables("documents", "blocks")},
p AS (SELECT collection_id, coalesce(sum(page_count), 0)::BIGINT AS pages_total FROM x_documents GROUP BY collection_id),
b AS (SELECT d.collection_id, count(*) AS blocks, count(DISTINCT (document_id, physical_page)) AS pages_with_blocks, count(*) FILTER (block_type = 'heading') AS heading, count(*) FILTER (block_type = 'paragraph') AS paragraph, count(*) FILTER (block_type = 'table') AS "table", count(*) FILTER (block_type = 'list') AS list,
  count(printed_page_label) AS with_label, count(bbox_x) AS with_box, count(*) FILTER (extraction_method = 'model_transcription') AS transcribed FROM blocks JOIN x_documents d ON d.id = document_id GROUP BY d.collection_id)
SELECT p.collection_id, pages_total, coalesce(blocks, 0) AS blocks, coalesce(pages_with_blocks, 0) AS pages_with_blocks, coalesce(heading, 0) AS heading, coalesce(paragraph, 0) AS paragraph, coalesce("table", 0) AS "table", coalesce(list, 0) AS list, coalesce(with_label, 0) AS with_label, coalesce(with_box, 0) AS with_box, coalesce(transcribed, 0) AS transcribed
FROM p LEFT JOIN b ON b.collection_id = p.collection_id
"""


def o09_export_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = exports.sample_claims(table(spark, sf_dir, "claims")).select(F.lit("claim").alias("kind"), "id", F.col("status").alias("name"))
    r = exports.sample_relationships(table(spark, sf_dir, "relationships")).select(F.lit("relationship").alias("kind"), "id", F.col("label").alias("name"))
    return c.unionByName(r)


O09 = f"""
{with_tables("claims", "relationships")},
c AS (SELECT 'claim' AS kind, id, status AS name FROM claims ORDER BY status, numeric_value::DECIMAL(38,10) DESC NULLS FIRST, id LIMIT 40),
r AS (SELECT 'relationship' AS kind, id, label AS name FROM relationships ORDER BY method = 'model' DESC, list_position(['contradicts', 'likely_contradiction', 'reconciled_by_context', 'corroborates', 'insufficient_context', 'unrelated'], label), id LIMIT 30)
SELECT * FROM c UNION ALL SELECT * FROM r
"""


# --- gold set -----------------------------------------------------------------------------------

def gold_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold claims, produced claims, gold pairs): every claim has a gold claim, some with other figures or scopes."""
    c = table(spark, sf_dir, "claims").withColumn("document", F.concat("document_id", F.lit(".pdf"))).withColumn("pages", F.array((F.col("orderkey") % 5).cast("int"), (F.col("line") % 5).cast("int")))
    produced = c.select("id", "document", "pages", "subject", "predicate", "numeric_value", "scale", "period_label", "scope", "status", F.col("line").alias("position"), "orderkey", "line", "partkey")
    g = produced.select(
        F.concat(F.lit("g"), "id").alias("gold_id"), "document", (F.col("orderkey") % 5).cast("int").alias("physical_page"), F.upper("subject").alias("subject"), "predicate",
        F.when(F.col("partkey") % 11 == 0, F.lit("7")).otherwise(F.col("numeric_value")).alias("numeric_value"), "scale", F.upper("period_label").alias("period_label"), F.when(F.col("partkey") % 2 == 0, F.col("scope")).alias("scope"),
        F.when(F.col("line") == 1, "table").when(F.col("line") == 2, "narrative").when(F.col("line") == 3, "chart").otherwise("list").alias("evidence_kind"), "orderkey", "line", "partkey",
    )
    a, b = g, g.select("orderkey", (F.col("line") - 1).alias("line"), F.col("gold_id").alias("claim_b"))
    pairs = a.join(b, ["orderkey", "line"]).select(F.concat(F.lit("p"), F.col("gold_id")).alias("pair_id"), F.col("gold_id").alias("claim_a"), "claim_b", F.when(F.col("partkey") % 3 == 0, "contradicts").when(F.col("partkey") % 3 == 1, "corroborates").otherwise("insufficient_context").alias("expected_label"))
    return g, produced, pairs


MATCH = f"""
pr AS (SELECT *, document_id || '.pdf' AS document, [orderkey % 5, line % 5] AS pages, {RULED.format(x='predicate')} AS n,
  CASE lower(trim(coalesce(scale, ''))) WHEN '' THEN 1 WHEN 'million' THEN 1000000 WHEN 'crore' THEN 10000000 WHEN 'lakh' THEN 100000 END AS f FROM claims),
go AS (SELECT *, 'g' || id AS gold_id, orderkey % 5 AS page, CASE WHEN partkey % 11 = 0 THEN '7' ELSE numeric_value END AS gv, CASE WHEN partkey % 2 = 0 THEN scope END AS gs, CASE line WHEN 1 THEN 'table' WHEN 2 THEN 'narrative' WHEN 3 THEN 'chart' ELSE 'list' END AS evidence_kind FROM pr),
ca AS (SELECT g.gold_id, p.id, p.status, p.line, CASE WHEN gv IS NULL THEN 'both_absent' ELSE 'equal' END AS verdict, p.period_label IS NOT DISTINCT FROM g.period_label OR regexp_replace(replace(upper(p.period_label), ' ', ''), '^FY([0-9]{{2}})$', 'FY20\\1') = regexp_replace(replace(upper(g.period_label), ' ', ''), '^FY([0-9]{{2}})$', 'FY20\\1') AS pa,
  CASE WHEN gs IS NULL THEN coalesce(p.scope, '') = '' ELSE lower(trim(coalesce(p.scope, ''))) = lower(trim(gs)) END AS sa
  FROM go g JOIN pr p ON p.document = g.document AND list_contains(p.pages, g.page) AND p.n = g.n
  WHERE (gv IS NULL AND p.numeric_value IS NULL AND regexp_replace(replace(replace(lower(p.subject), '.', ''), ',', ''), '\\s+', ' ', 'g') = regexp_replace(replace(replace(lower(g.subject), '.', ''), ',', ''), '\\s+', ' ', 'g'))
    OR gv::DECIMAL(38,10) * g.f = p.numeric_value::DECIMAL(38,10) * p.f),
be AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY gold_id ORDER BY coalesce(pa, false)::INT * 2 + sa::INT DESC, line, id) = 1),
matched AS (SELECT go.gold_id, evidence_kind, be.id, be.status, be.verdict, be.pa AS period_agrees, be.sa AS scope_agrees FROM go LEFT JOIN be ON be.gold_id = go.gold_id)
"""


def m01_gold_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p, _ = gold_tables(spark, sf_dir)
    return evaluation.match_claims(g, p)


M01 = f"{with_tables('claims')}, {MATCH} SELECT gold_id, evidence_kind, id, status, verdict, CASE WHEN id IS NOT NULL THEN coalesce(period_agrees, false) END AS period_agrees, scope_agrees FROM matched"


def m03_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p, _ = gold_tables(spark, sf_dir)
    return evaluation.coverage(evaluation.match_claims(g, p)).drop("recall", "context_agreement")


M03 = f"""
{with_tables('claims')}, {MATCH}, k AS (SELECT *, unnest(['all', evidence_kind]) AS kind FROM matched)
SELECT kind, count(*) AS gold, count(id) AS found, count(*) FILTER (id IS NOT NULL AND period_agrees AND scope_agrees) AS in_context FROM k GROUP BY kind
"""


def m04_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p, _ = gold_tables(spark, sf_dir)
    return evaluation.grounding(g, p, evaluation.match_claims(g, p)).drop("precision")


M04 = f"""
{with_tables('claims')}, {MATCH}, s AS (SELECT DISTINCT p.id FROM pr p JOIN go g ON g.document = p.document AND list_contains(p.pages, g.page) WHERE p.status = 'accepted')
SELECT (SELECT count(*) FROM s) AS in_scope, (SELECT count(*) FROM s WHERE id IN (SELECT id FROM matched WHERE id IS NOT NULL)) AS matched, (SELECT count(*) FROM matched WHERE id IS NOT NULL AND status = 'accepted' AND NOT (coalesce(period_agrees, false) AND scope_agrees)) AS wrong_context
"""


def m05_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "evidence").join(table(spark, sf_dir, "blocks").select(F.col("block_id").alias("source_block_id"), "content"), "source_block_id")
    return evaluation.evidence_measures(e.withColumn("quote", F.when(F.length("claim_id") % 2 == 0, "REVENUE from services").otherwise("section 1-urgent")))


M05 = f"""
{with_tables('evidence', 'blocks')}, e AS (SELECT v.*, CASE WHEN len(claim_id) % 2 = 0 THEN contains(lower(regexp_replace(content, '\\s+', ' ', 'g')), 'revenue from services') ELSE contains(lower(content), 'section 1-urgent') END AS found FROM evidence v JOIN blocks b ON b.block_id = v.source_block_id)
SELECT count(*) AS evidence, count(*) FILTER (found) AS located, count(*) FILTER (verification = 'verified_native_text') AS verified, count(*) FILTER (entailment = 'supported') AS supported, count(*) FILTER (verification = 'visual_only') AS visual_only, count(*) FILTER (found <> (verification = 'verified_native_text')) AS disagreements FROM e
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p, pairs = gold_tables(spark, sf_dir)
    return evaluation.scored_pairs(pairs, evaluation.match_claims(g, p), table(spark, sf_dir, "relationships"))


SCORED = """
pp AS (SELECT 'p' || a.gold_id AS pair_id, a.gold_id AS ga, b.gold_id AS gb, CASE a.partkey % 3 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'corroborates' ELSE 'insufficient_context' END AS expected_label FROM go a JOIN go b ON b.orderkey = a.orderkey AND b.line = a.line + 1),
rr AS (SELECT least(claim_a_id, claim_b_id) AS x, greatest(claim_a_id, claim_b_id) AS y, arg_max(label, id) AS label FROM relationships GROUP BY ALL),
pq AS (SELECT pp.*, a.id AS ia, b.id AS ib FROM pp JOIN matched a ON a.gold_id = pp.ga JOIN matched b ON b.gold_id = pp.gb),
sc AS (SELECT pair_id, expected_label, rr.label AS predicted FROM pq LEFT JOIN rr ON rr.x = least(ia, ib) AND rr.y = greatest(ia, ib) AND ia IS NOT NULL AND ib IS NOT NULL)
"""


def m06_candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p, pairs = gold_tables(spark, sf_dir)
    c = table(spark, sf_dir, "relationships").where("method = 'model'").select("claim_a_id", "claim_b_id")
    return evaluation.candidate_recall(pairs, evaluation.match_claims(g, p), c).drop("recall")


M06 = f"""
{with_tables('claims', 'relationships')}, {MATCH}, {SCORED}, c AS (SELECT DISTINCT least(claim_a_id, claim_b_id) AS x, greatest(claim_a_id, claim_b_id) AS y FROM relationships WHERE method = 'model')
SELECT count(*) AS pairs, count(*) FILTER (ia IS NOT NULL AND ib IS NOT NULL) AS reachable, count(*) FILTER (c.x IS NOT NULL) AS found FROM pq LEFT JOIN c ON ia IS NOT NULL AND ib IS NOT NULL AND c.x = least(ia, ib) AND c.y = greatest(ia, ib)
"""


def a19_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_scored(spark, sf_dir))


_L = ("corroborates", "contradicts", "reconciled_by_context", "likely_contradiction", "insufficient_context", "unrelated")
A19 = f"""
{with_tables('claims', 'relationships')}, {MATCH}, {SCORED}, l AS (SELECT unnest([{", ".join(f"'{x}'" for x in _L)}]) AS expected_label)
SELECT l.expected_label, {", ".join(f"count(*) FILTER (predicted = '{x}') AS {x}" for x in _L)} FROM l LEFT JOIN sc ON sc.expected_label = l.expected_label GROUP BY ALL
"""


def m07_relationship_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.relationship_measures(_scored(spark, sf_dir)).drop("agreement", "abstentions")


M07 = f"""
{with_tables('claims', 'relationships')}, {MATCH}, {SCORED}
SELECT count(*) AS scored, count(*) FILTER (expected_label = predicted) AS agreed, count(*) FILTER (predicted = 'insufficient_context') AS abstained, count(*) FILTER (predicted IN ('contradicts', 'likely_contradiction') AND expected_label NOT IN ('contradicts', 'likely_contradiction')) AS false_contradictions,
  count(*) FILTER (predicted NOT IN ('contradicts', 'likely_contradiction') AND expected_label IN ('contradicts', 'likely_contradiction')) AS missed_contradictions FROM sc WHERE predicted IS NOT NULL
"""


def s09_gold_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, pairs = gold_tables(spark, sf_dir)
    claims = g.select(F.when(F.col("partkey") % 29 == 0, "g-twice").otherwise(F.col("gold_id")).alias("id"), "document", "physical_page")
    docs = table(spark, sf_dir, "documents").where("page_count is not null").select(F.concat("id", F.lit(".pdf")).alias("id"), F.col("page_count").alias("pages"))
    pairs = pairs.select(F.col("pair_id").alias("id"), "claim_a", F.when(F.col("expected_label") == "contradicts", F.col("claim_a")).otherwise(F.col("claim_b")).alias("claim_b"))
    return gold.gold_problems(docs, claims, pairs)


S09 = f"""
{with_tables('claims', 'documents')}, {MATCH},
c AS (SELECT CASE WHEN partkey % 29 = 0 THEN 'g-twice' ELSE gold_id END AS id, document, page FROM go), d AS (SELECT id || '.pdf' AS document, page_count FROM x_documents WHERE page_count IS NOT NULL),
p AS (SELECT 'p' || a.gold_id AS id, a.gold_id AS x, CASE WHEN a.partkey % 3 = 0 THEN a.gold_id ELSE b.gold_id END AS y FROM go a JOIN go b ON b.orderkey = a.orderkey AND b.line = a.line + 1)
SELECT 'duplicate claim' AS problem, id FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown document', id FROM c WHERE document NOT IN (SELECT document FROM d) UNION ALL SELECT 'page past the end', c.id FROM c JOIN d ON d.document = c.document WHERE page >= page_count
UNION ALL SELECT 'duplicate pair', id FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown claim', id FROM p WHERE x NOT IN (SELECT id FROM c) OR y NOT IN (SELECT id FROM c) UNION ALL SELECT 'compares a claim with itself', id FROM p WHERE x = y
"""

_ALL = {
    j02_facts: J02, o01_fact_page: O01, a01_fact_totals: A01, p07_fact_details: P07, j06_relationships: J06, p05_relationships_of_claim: P05, a02_label_counts: A02, a05_degree: A05, a06_predicates_and_units: A06, a08_issues_and_stages: A08,
    a09_run_cost: A09, a10_structure: A10, o09_export_samples: O09, m01_gold_matches: M01, m03_coverage: M03, m04_grounding: M04, m05_evidence: M05, m06_candidate_recall: M06, a19_confusion: A19, m07_relationship_measures: M07, s09_gold_problems: S09,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL.items()}
