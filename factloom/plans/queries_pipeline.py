"""Queries over the pipeline's operators: verification, candidates, chunks, layout, entities, jobs and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import candidates, chunks, evidence, layout, resolution, sinks, state
from factloom.plans import reads
from factloom.functions.predicates import MODIFIERS
from factloom.plans.fixture import duck, table, with_tables
from factloom.plans.queries_values import LABEL, RULED
from factloom.sources import uploads


# --- sources and sinks --------------------------------------------------------------------------

def s01_validate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every fourth begins like a PDF, some cannot be opened or have odd page counts."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("junk"), F.lit("%PDF-1.7\n"), F.col("text"))).when(F.col("doc_id") % 11 == 5, F.lit("")).otherwise(F.concat(F.lit("%PDF-1.4\n"), F.col("text")))
    head = F.when(F.col("doc_id") % 7 == 3, F.col("text")).otherwise(head)
    f = d.select(F.col("doc_id").cast("string").alias("path"), F.encode(head, "UTF-8").alias("content"), "doc_id")
    f = f.withColumn("size", F.length("content").cast("long")).withColumn("page_count", (F.col("doc_id") % 400).cast("int"))
    f = f.withColumn("open_error", F.when(F.col("doc_id") % 13 == 0, "PasswordException: No password given").when(F.col("doc_id") % 17 == 0, "InvalidPDFException: bad xref"))
    v = uploads.validate_uploads(f)
    return v.select("path", "reason", "content_hash", uploads.document_key(F.col("content_hash")).alias("key"), uploads.page_key(F.col("content_hash"), F.col("page_count")).alias("first_page_key"))


S01 = """
WITH h AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN text WHEN doc_id % 4 = 0 THEN 'junk%PDF-1.7' || chr(10) || text WHEN doc_id % 11 = 5 THEN '' ELSE '%PDF-1.4' || chr(10) || text END AS c FROM documents),
r AS (SELECT *, CASE WHEN strlen(c) = 0 THEN 'empty_file' WHEN strlen(c) > 52428800 THEN 'too_large' WHEN NOT contains(c[:1024], '%PDF-') THEN 'not_a_pdf' WHEN doc_id % 13 = 0 THEN 'encrypted' WHEN doc_id % 17 = 0 THEN 'malformed'
  WHEN doc_id % 400 = 0 THEN 'no_pages' WHEN doc_id % 400 > 300 THEN 'too_many_pages' END AS reason FROM h),
k AS (SELECT *, CASE WHEN reason IS NULL THEN sha256(c) END AS x FROM r)
SELECT doc_id::VARCHAR AS path, reason, x AS content_hash, 'documents/' || x[:2] || '/' || x || '.pdf' AS key, 'pages/' || x[:2] || '/' || x || '/' || lpad((doc_id % 400)::VARCHAR, 4, '0') || '.png' AS first_page_key FROM k
"""


def s02_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every file when every tenth file (doc_id % 10 = 4) is stored already; files are the same if their whole texts are."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    f = d.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.when(F.col("doc_id") % 9 == 0, "not_a_pdf").alias("reason"), uploads.content_hash(F.encode("text", "UTF-8")).alias("content_hash"), "doc_id")
    stored = f.where("doc_id % 10 = 4 and reason is null").select(F.lit("col1").alias("collection_id"), "content_hash")
    _, outcome = uploads.ingest(f, stored, "col1")
    return outcome


S02 = """
WITH f AS (SELECT doc_id, lpad(doc_id::VARCHAR, 9, '0') AS path, CASE WHEN doc_id % 9 = 0 THEN 'not_a_pdf' END AS reason, text AS h FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY h, reason IS NULL ORDER BY path) AS n FROM f)
SELECT path, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN n = 1 AND h NOT IN (SELECT h FROM f WHERE doc_id % 10 = 4 AND reason IS NULL) THEN 'accepted' ELSE 'duplicate' END AS outcome, reason FROM n
"""


def s10_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims").select("document_id", "predicate", "id", "partkey")
    return sinks.insert_if_absent(c.where("partkey % 3 = 0"), c.where("partkey % 3 <> 0"), ["document_id", "predicate"], ["id"]).select("document_id", "predicate", "id")


S10 = f"""
{with_tables("claims")}
SELECT document_id, predicate, min(id) AS id FROM claims WHERE partkey % 3 <> 0 AND (document_id, predicate) NOT IN (SELECT (document_id, predicate) FROM claims WHERE partkey % 3 = 0) GROUP BY ALL
"""


def s11_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "relationships").select("claim_a_id", "claim_b_id", "method_version", "label", "method")
    new = r.withColumn("method", F.when(F.col("label") == "contradicts", "deterministic").otherwise("model")).withColumn("label", F.lit("unrelated"))
    return sinks.upgrade(r, new, ["claim_a_id", "claim_b_id", "method_version"])


S11 = f"""
{with_tables("relationships")}
SELECT claim_a_id, claim_b_id, method_version, CASE WHEN method = 'model' OR label = 'contradicts' THEN label ELSE 'unrelated' END AS label, CASE WHEN method = 'model' OR label <> 'contradicts' THEN 'model' ELSE method END AS method FROM relationships
"""


# --- evidence -----------------------------------------------------------------------------------

def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = table(spark, sf_dir, "blocks")
    c = table(spark, sf_dir, "claims").withColumn("claim_id", F.col("id")).withColumn("batch_id", F.col("block_id"))
    own = F.concat(F.lit("b"), F.col("orderkey").cast("string"))
    refs = F.array(F.when(F.col("partkey") % 4 == 0, "B1").otherwise(own), F.when(F.col("partkey") % 5 == 0, own).otherwise(F.concat(F.lit("b"), (F.col("orderkey") + 1).cast("string"))))
    quote = F.when(F.col("partkey") % 3 == 0, F.lit("Revenue from services was")).when(F.col("partkey") % 3 == 1, F.concat(F.lit("services was "), F.col("numeric_value"))).otherwise(F.lit("crore in FY"))
    c = c.withColumn("evidence_block_ids", refs).withColumn("quote", F.coalesce(quote, F.lit("services")))
    handles = b.select(F.col("block_id").alias("batch_id"), F.lit("B1").alias("handle"), "block_id")
    return c, handles, b


def f5_06_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.verify_claims(*_cited(spark, sf_dir))


F5_06 = f"""
{with_tables("claims", "blocks")},
c AS (SELECT *, coalesce(CASE WHEN partkey % 3 = 0 THEN 'Revenue from services was' WHEN partkey % 3 = 1 THEN 'services was ' || numeric_value ELSE 'crore in FY' END, 'services') AS quote,
  [CASE WHEN partkey % 4 = 0 THEN 'B1' ELSE 'b' || orderkey END, CASE WHEN partkey % 5 = 0 THEN 'b' || orderkey ELSE 'b' || (orderkey + 1) END] AS refs FROM claims),
e AS (SELECT c.*, p AS position, refs[p + 1] AS cited_ref, CASE WHEN refs[p + 1] = 'B1' THEN block_id ELSE refs[p + 1] END AS wanted FROM c, (VALUES (0), (1)) AS v(p)),
j AS (SELECT e.*, b.block_id AS found_id, b.document_id = e.document_id AS is_here, trim(regexp_replace(b.content, '\\s+', ' ', 'g')) AS content, b.extraction_method, b.physical_page FROM e LEFT JOIN blocks b ON b.block_id = e.wanted),
u AS (SELECT * FROM j QUALIFY NOT coalesce(is_here, false) OR row_number() OVER (PARTITION BY id, wanted ORDER BY position) = 1),
s AS (SELECT *, coalesce(contains(rtrim(regexp_replace(quote, '[^0-9.]', '', 'g'), '.'), rtrim(regexp_replace(coalesce(numeric_value, raw_value), '[^0-9.]', '', 'g'), '.')), false) AS carries,
  CASE WHEN NOT coalesce(is_here, false) THEN 'block_not_found' WHEN NOT contains(content, quote) THEN 'quote_not_found' WHEN extraction_method = 'native_text' THEN 'verified_native_text' ELSE 'visual_only' END AS verification FROM u),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(original_statement), '[^a-z0-9]+'), lambda x: len(x) > 2)) AS sw, list_filter(regexp_split_to_array(lower(quote), '[^a-z0-9]+'), lambda x: len(x) > 2) AS qw FROM s),
r AS (SELECT *, CASE WHEN verification LIKE '%not_found' THEN 'unchecked' WHEN raw_value IS NOT NULL OR numeric_value IS NOT NULL THEN CASE WHEN carries THEN 'supported' ELSE 'unsupported' END
  WHEN len(list_intersect(sw, qw)) >= ceil(len(sw) * 0.6) THEN 'supported' ELSE 'unclear' END AS entailment FROM w),
x AS (SELECT r.id, r.position, arg_min(b.block_id, (b.block_index, b.block_id)) AS found FROM r JOIN blocks b ON b.document_id = r.document_id AND b.physical_page = r.physical_page AND b.extraction_method = 'native_text'
  WHERE r.verification = 'visual_only' AND r.entailment = 'supported' AND contains(rtrim(regexp_replace(b.content, '[^0-9.]', '', 'g'), '.'), rtrim(regexp_replace(coalesce(numeric_value, raw_value), '[^0-9.]', '', 'g'), '.'))
  AND rtrim(regexp_replace(coalesce(numeric_value, raw_value), '[^0-9.]', '', 'g'), '.') <> '' GROUP BY ALL)
SELECT id AS claim_id, position, CASE WHEN is_here THEN found_id END AS source_block_id, cited_ref, verification, entailment, CASE WHEN verification = 'block_not_found' OR carries THEN 'value' ELSE 'context' END AS support_role,
  CASE verification WHEN 'block_not_found' THEN CASE WHEN found_id IS NULL THEN 'no such block was given to the reader of this claim' ELSE 'the block is one of another document' END WHEN 'quote_not_found' THEN 'this block does not hold the quote' WHEN 'visual_only' THEN 'found on a transcribed page only, which is no second witness' END AS note FROM r
UNION ALL SELECT id, position, found, 'cross-check', 'verified_native_text', 'supported', 'value', 'native text of the page states the figure as well' FROM x
"""


def f5_07_claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims").select(F.col("id").alias("claim_id"), F.coalesce("raw_value", "numeric_value").alias("value_label"))
    return evidence.claim_status(c, table(spark, sf_dir, "evidence"))


F5_07 = f"""
{with_tables("claims", "evidence")},
f AS (SELECT claim_id, bool_or(verification IN ('verified_native_text', 'visual_only')) AS l, bool_or(verification = 'block_not_found') AS i, bool_or(verification IN ('verified_native_text', 'visual_only') AND entailment = 'unsupported') AS u,
  bool_or(verification = 'verified_native_text' AND entailment = 'supported') AS n, bool_or(verification = 'visual_only') AS v FROM evidence GROUP BY claim_id)
SELECT c.id AS claim_id, CASE WHEN l IS NULL OR NOT l OR u THEN 'rejected' WHEN n THEN 'accepted' ELSE 'needs_review' END AS status,
  CASE WHEN l IS NULL THEN 'no evidence was cited' WHEN NOT l AND i THEN 'none of the cited blocks was given to the reader' WHEN NOT l THEN 'no cited block holds the quote'
    WHEN u THEN 'the quote leaves out ' || coalesce(raw_value, numeric_value, 'the figure claimed') WHEN n THEN 'native text holds the quote'
    WHEN v THEN 'only a transcribed page holds the quote' ELSE 'the quote was found, its bearing on the claim is open' END AS status_reason
FROM claims c LEFT JOIN f ON f.claim_id = c.id
"""


# --- candidates ---------------------------------------------------------------------------------

def j07_exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comparable claims as they are, generic subjects too: without entity ids these pair by name."""
    c = candidates.comparable_claims(table(spark, sf_dir, "claims"))
    return candidates.exact_candidates(c, c)


J07 = f"""
{with_tables("claims")},
m AS (SELECT *, {RULED.format(x="predicate")} AS n, {LABEL.format(x="subject")} AS label FROM claims WHERE status IN ('accepted', 'needs_review')),
w AS (SELECT *, list_filter(string_split(n, '_'), lambda t: t NOT IN {MODIFIERS}) AS c FROM m)
SELECT a.collection_id, a.id AS claim_a_id, b.id AS claim_b_id FROM w a JOIN w b ON a.collection_id = b.collection_id AND a.label = b.label AND a.document_id <> b.document_id AND a.id < b.id
WHERE (a.entity_id IS NULL OR b.entity_id IS NULL OR a.entity_id = b.entity_id)
  AND (a.n = b.n OR len(list_intersect(a.c, b.c)) > 0) AND (a.n, b.n) NOT IN (('revenue_from_operation', 'total_income'), ('total_income', 'revenue_from_operation'), ('profit_after_tax', 'profit_before_tax'), ('profit_before_tax', 'profit_after_tax'))
"""


def j08_semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors")
    s = candidates.semantic_candidates(v, v, k=15)
    return s.select("left_id", "right_id", F.round("distance", 5).alias("distance"))


J08 = f"""
WITH v AS ({duck("vectors")})
SELECT a.id AS left_id, b.id AS right_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM v a JOIN v b ON a.collection_id = b.collection_id AND a.model = b.model AND a.document_id <> b.document_id
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.id) <= 15
"""


def u01_union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels over all claims with vectors; subjects and predicates follow from the vectors' numbers."""
    v = table(spark, sf_dir, "vectors")
    c = v.select("id", "collection_id", "document_id", F.lit(None).cast("string").alias("entity_id"), F.concat(F.lit("Firm "), (F.col("vec_id") % 23).cast("string"), F.lit(" Ltd.")).alias("subject"), F.when(F.col("vec_id") % 2 == 0, "Net Revenues").otherwise("revenue").alias("predicate"))
    u = candidates.union_of_channels(c, candidates.semantic_candidates(v, v))
    return u.withColumn("sources", F.array_join("sources", "+")).withColumn("distance", F.round("distance", 5))


U01 = f"""
WITH v AS ({duck("vectors")}),
e AS (SELECT DISTINCT a.collection_id, least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM v a JOIN v b ON a.collection_id = b.collection_id AND a.vec_id % 23 = b.vec_id % 23 AND a.document_id <> b.document_id),
k AS (SELECT a.collection_id, a.id AS l, b.id AS r, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM v a JOIN v b ON a.collection_id = b.collection_id AND a.document_id <> b.document_id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d, b.id) <= 15),
s AS (SELECT collection_id, least(l, r) AS x, greatest(l, r) AS y, min(d) AS d FROM k GROUP BY ALL)
SELECT coalesce(e.collection_id, s.collection_id) AS collection_id, coalesce(e.x, s.x) AS claim_a_id, coalesce(e.y, s.y) AS claim_b_id, CASE WHEN e.x IS NULL THEN 'semantic' WHEN s.x IS NULL THEN 'exact' ELSE 'exact+semantic' END AS sources, CASE WHEN e.x IS NULL THEN round(s.d, 5) END AS distance
FROM e FULL JOIN s ON e.collection_id = s.collection_id AND e.x = s.x AND e.y = s.y
"""


def j15_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "relationships")
    return candidates.not_yet_classified(r.select("claim_a_id", "claim_b_id"), r, "compare@2")


J15 = f"{with_tables('relationships')} SELECT claim_a_id, claim_b_id FROM relationships WHERE method <> 'model'"


def j16_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors").select(F.col("id").alias("claim_id"), F.when(F.col("vec_id") % 5 == 0, "m2").otherwise("m1").alias("model"), "vec_id")
    return candidates.missing_embeddings(v.select(F.col("claim_id").alias("id")), v.where("vec_id % 7 <> 0"), "m1")


J16 = f"WITH v AS ({duck('vectors')}) SELECT id FROM v WHERE NOT (vec_id % 5 <> 0 AND vec_id % 7 <> 0)"


# --- entities and normalisation -----------------------------------------------------------------

def f4_04_resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").withColumn("normalized_label", F.concat(F.lit("supplier "), F.substring("id", 2, 9)))
    r = resolution.resolve_entities(resolution.claim_labels(table(spark, sf_dir, "claims")), e, table(spark, sf_dir, "aliases"))
    return r.select("collection_id", "label", "method", F.when(F.col("method") != "created", F.col("entity_id")).alias("known_id"))


F4_04 = f"""
{with_tables("claims", "entities", "aliases")},
l AS (SELECT DISTINCT collection_id, {LABEL.format(x="subject")} || CASE WHEN suppkey % 7 = 0 THEN '#' || document_id ELSE '' END AS label FROM claims),
x AS (SELECT collection_id, 'supplier ' || id[2:] AS label, id FROM entities), y AS (SELECT e.collection_id, a.normalized_alias AS label, e.id FROM aliases a JOIN entities e ON e.id = a.entity_id)
SELECT l.collection_id, l.label, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN y.id IS NOT NULL THEN 'alias' ELSE 'created' END AS method, coalesce(x.id, y.id) AS known_id
FROM l LEFT JOIN x ON x.collection_id = l.collection_id AND x.label = l.label LEFT JOIN y ON y.collection_id = l.collection_id AND y.label = l.label
"""


def j17_entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").withColumn("normalized_label", F.concat(F.lit("firm "), F.substring("id", 2, 9), F.lit(" no"), F.substring("id", 2, 9)))
    labels = table(spark, sf_dir, "claims").select("collection_id", F.concat(F.lit("firma no"), (F.col("suppkey") % 50).cast("string"), F.lit(" "), F.col("suppkey").cast("string")).alias("label"))
    return resolution.entity_candidates(labels, e).select("collection_id", "label", "entity_id")


J17 = f"""
{with_tables("claims", "entities")}, l AS (SELECT DISTINCT collection_id, suppkey, 'firma no' || (suppkey % 50) || ' ' || suppkey AS label FROM claims)
SELECT DISTINCT l.collection_id, label, e.id AS entity_id FROM l JOIN entities e ON e.collection_id = l.collection_id AND (('no' || (suppkey % 50) = 'no' || e.id[2:] AND len('no' || (suppkey % 50)) > 2) OR (suppkey::VARCHAR = e.id[2:] AND len(suppkey::VARCHAR) > 2))
"""


def f3_07_register_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "collections").select(F.col("id").alias("collection_id"), F.lit("total_income").alias("canonical_name"), F.array(F.lit("EBITDA"), F.lit("the delivery box")).alias("aliases"))
    return resolution.register_predicates(table(spark, sf_dir, "claims"), registry).select("collection_id", "canonical_name", "first_claim_id")


F3_07 = f"""
{with_tables("claims")},
m AS (SELECT *, {RULED.format(x="predicate")} AS n FROM claims)
SELECT collection_id, n AS canonical_name, min(id) AS first_claim_id FROM m WHERE n NOT IN ('total_income', 'ebitda', 'delivery_box') GROUP BY ALL
"""


# --- chunks -------------------------------------------------------------------------------------

def p02_extraction_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.extraction_blocks(table(spark, sf_dir, "blocks")).select("block_id", "block_type")


P02 = f"""
{with_tables("blocks")}
SELECT block_id, block_type FROM blocks b WHERE NOT (extraction_method = 'native_text' AND block_type IN ('table', 'chart') AND EXISTS (SELECT 1 FROM blocks x WHERE x.document_id = b.document_id AND x.physical_page = b.physical_page AND x.extraction_method = 'model_transcription'))
"""


def w04_carried_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks").withColumn("block_index", F.substring("block_id", 2, 12).cast("int"))
    return chunks.carried_heading(b).select("block_id", "heading")


W04 = f"""
{with_tables("blocks")}
SELECT block_id, last_value(CASE WHEN block_type = 'heading' AND trim(content) <> '' THEN trim(content) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY physical_page, block_id[2:]::INT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM blocks
"""


def w08_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks").withColumn("block_index", F.substring("block_id", 2, 12).cast("int"))
    c = chunks.chunk_blocks(b, target=40, most=30)
    return c.select("document_id", "chunk_index", "physical_page", "heading", "text", F.array_join("source_block_ids", ",").alias("blocks"), "estimated_tokens")


W08 = f"""
{with_tables("blocks")},
b AS (SELECT *, trim(content) AS c, block_id[2:]::INT AS i, last_value(CASE WHEN block_type = 'heading' AND trim(content) <> '' THEN trim(content) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY physical_page, block_id[2:]::INT ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading,
  count(*) FILTER (WHERE block_type = 'heading' AND trim(content) <> '') OVER (PARTITION BY document_id, physical_page ORDER BY block_id[2:]::INT) AS section FROM blocks),
t AS (SELECT *, row_number() OVER (PARTITION BY document_id, physical_page, section ORDER BY i) AS n FROM b WHERE block_type <> 'heading' AND c <> ''),
w AS (WITH RECURSIVE w AS (
  SELECT document_id, physical_page, section, n, heading, printed_page_label, block_id, 1 AS chunk, 1 AS ref, '[B1]' || chr(10) || c AS body, block_id AS ids FROM t WHERE n = 1
  UNION ALL SELECT t.document_id, t.physical_page, t.section, t.n, t.heading, t.printed_page_label, t.block_id,
    CASE WHEN ceil(len(w.body || chr(10) || chr(10) || t.c) / 4) > 40 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN ceil(len(w.body || chr(10) || chr(10) || t.c) / 4) > 40 THEN 1 ELSE w.ref + 1 END,
    CASE WHEN ceil(len(w.body || chr(10) || chr(10) || t.c) / 4) > 40 THEN '[B1]' || chr(10) || t.c ELSE w.body || chr(10) || chr(10) || '[B' || (w.ref + 1) || ']' || chr(10) || t.c END,
    CASE WHEN ceil(len(w.body || chr(10) || chr(10) || t.c) / 4) > 40 THEN t.block_id ELSE w.ids || ',' || t.block_id END
  FROM w JOIN t ON t.document_id = w.document_id AND t.physical_page = w.physical_page AND t.section = w.section AND t.n = w.n + 1) SELECT * FROM w),
z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY document_id, physical_page, section, chunk ORDER BY n DESC) = 1),
o AS (SELECT *, '[page ' || physical_page || CASE WHEN printed_page_label IS NOT NULL THEN ' (printed ' || printed_page_label || ')' ELSE '' END || ']' || chr(10) || CASE WHEN heading IS NOT NULL THEN '[section: ' || heading || ']' || chr(10) ELSE '' END || chr(10) || body AS text FROM z)
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY physical_page, section, chunk) - 1)::INT AS chunk_index, physical_page, heading, text, ids AS blocks, ceil(len(text) / 4)::INT AS estimated_tokens FROM o
"""


def w09_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims").select("document_id", (F.col("orderkey") * 8 + F.col("line")).alias("chunk_index"), (F.col("partkey") % 1800).cast("int").alias("estimated_tokens"))
    return chunks.plan_batches(c)


W09 = f"""
{with_tables("claims")}, c AS (SELECT document_id, orderkey * 8 + line AS chunk_index, (partkey % 1800)::INT AS t, row_number() OVER (PARTITION BY document_id ORDER BY orderkey * 8 + line) AS n FROM claims),
w AS (WITH RECURSIVE w AS (SELECT document_id, chunk_index, t, n, 0 AS batch_index, 0 AS place, t AS held FROM c WHERE n = 1
  UNION ALL SELECT c.document_id, c.chunk_index, c.t, c.n, CASE WHEN w.place = 3 OR w.held + c.t > 3000 THEN w.batch_index + 1 ELSE w.batch_index END, CASE WHEN w.place = 3 OR w.held + c.t > 3000 THEN 0 ELSE w.place + 1 END, CASE WHEN w.place = 3 OR w.held + c.t > 3000 THEN c.t ELSE w.held + c.t END
  FROM w JOIN c ON c.document_id = w.document_id AND c.n = w.n + 1) SELECT * FROM w)
SELECT document_id, chunk_index, t AS estimated_tokens, batch_index, place FROM w
"""


# --- layout -------------------------------------------------------------------------------------

def l02_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = layout.gutters(table(spark, sf_dir, "text_runs"))
    return g.select("document_id", *[F.col(c).cast("long").alias(c) for c in ("x0", "x1", "gutter_width")])


HEIGHTS = "h AS (SELECT document_id, coalesce(nullif(quantile_cont(height, 0.5) FILTER (WHERE height > 0), 0), 10) AS th FROM text_runs GROUP BY document_id)"

GUTTERS = f"""{HEIGHTS},
e AS (SELECT t.document_id, h.th, greatest(0, floor(x)) AS f, least(ceil(width_pt), ceil(x + width)) AS z FROM text_runs t JOIN h ON h.document_id = t.document_id),
m AS (SELECT *, max(z) OVER (PARTITION BY document_id ORDER BY f, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e),
g AS (SELECT document_id, (far + 1)::BIGINT AS x0, (f - 1)::BIGINT AS x1, (f - far - 1)::BIGINT AS gutter_width FROM m WHERE f - far > 1 AND f - far - 1 >= 2.5 * th)"""

L02 = f"{with_tables('text_runs')}, {GUTTERS} SELECT * FROM g"


def l04_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = layout.lines(table(spark, sf_dir, "text_runs"))
    return l.select("document_id", F.col("region").cast("long").alias("region"), F.col("line").cast("long").alias("line"), "text", "y", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"), "height")


REGIONS = f"""{GUTTERS},
r0 AS (SELECT t.*, (SELECT count(*) FROM g WHERE g.document_id = t.document_id AND (g.x0 + g.x1) / 2.0 <= t.x + t.width / 2) AS slot FROM text_runs t),
r AS (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY slot) - 1 AS region FROM r0),
o AS (SELECT r.*, h.th, row_number() OVER (PARTITION BY r.document_id, region ORDER BY y DESC, x, reading_index) AS n FROM r JOIN h ON h.document_id = r.document_id),
f AS (WITH RECURSIVE f AS (SELECT document_id, region, n, y AS anchor, 0 AS line FROM o WHERE n = 1
  UNION ALL SELECT o.document_id, o.region, o.n, CASE WHEN abs(f.anchor - o.y) <= o.th * 0.5 THEN f.anchor ELSE o.y END, CASE WHEN abs(f.anchor - o.y) <= o.th * 0.5 THEN f.line ELSE f.line + 1 END
  FROM f JOIN o ON o.document_id = f.document_id AND o.region = f.region AND o.n = f.n + 1) SELECT * FROM f),
lines AS (SELECT o.document_id, o.region, f.line::BIGINT AS line, string_agg(text, ' ' ORDER BY x, -y, reading_index) AS text, arg_min(y, (x, -y, reading_index)) AS y, min(x) AS x0, max(x + width) AS x1, max(height) AS height, count(*) AS n_runs, any_value(th) AS th
  FROM o JOIN f ON f.document_id = o.document_id AND f.region = o.region AND f.n = o.n GROUP BY ALL)"""

L04 = f"{with_tables('text_runs')}, {REGIONS} SELECT document_id, region, line, text, y, round(x0, 4) AS x0, round(x1, 4) AS x1, height FROM lines"


def l05_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layout.blocks(layout.lines(table(spark, sf_dir, "text_runs")))
    return b.select("document_id", F.col("region").cast("long").alias("region"), "text", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"), "y_top", "y_bottom", "n_lines", F.size("items").cast("long").alias("n_runs"))


BLOCKS = f"""{REGIONS},
nb AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY document_id, region ORDER BY line) - y > 1.6 * th, false)::INT AS new FROM lines),
bb AS (SELECT *, sum(new) OVER (PARTITION BY document_id, region ORDER BY line) AS block FROM nb)"""

L05 = f"""
{with_tables("text_runs")}, {BLOCKS}
SELECT document_id, region, string_agg(text, chr(10) ORDER BY line) AS text, round(min(x0), 4) AS x0, round(max(x1), 4) AS x1, max(y) AS y_top, min(y) AS y_bottom, count(*) AS n_lines, sum(n_runs)::BIGINT AS n_runs FROM bb GROUP BY document_id, region, block
"""


def l06_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds with many runs a page: the runs of 40 orders share one."""
    t = table(spark, sf_dir, "text_runs").withColumn("document_id", F.concat(F.lit("p"), F.floor(F.substring("document_id", 2, 12).cast("long") / 40).cast("string")))
    runs = t.withColumn("region", F.when(F.col("x") < 250, 0).otherwise(1)).withColumn("block", F.floor(F.col("y") / 30))
    kinds = layout.classify_regions(runs, runs)
    pages = layout.classify_pages(t, kinds).select("document_id", F.col("kind").alias("page_kind"), "visual_route")
    return kinds.select("document_id", F.col("region").cast("long").alias("region"), "chars", "runs", F.round("numeric_ratio", 6).alias("numeric_ratio"), "aligned_columns", F.round("mean_run", 6).alias("mean_run"), "kind").join(pages, "document_id")


NUMERIC_RUN = "regexp_matches(text, '^[₹$€£]?\\s?\\(?-?[0-9][0-9,]*(\\.[0-9]+)?\\)?\\s?%?$')"

L06 = f"""
{with_tables("text_runs")},
t AS (SELECT 'p' || (document_id[2:]::BIGINT // 40) AS document_id, CASE WHEN x < 250 THEN 0 ELSE 1 END::BIGINT AS region, floor(y / 30) AS block, text, floor(x / 3 + 0.5) AS bucket FROM text_runs),
fr AS (SELECT document_id, region, sum(len(text))::BIGINT AS chars, count(*) AS runs, count(*) FILTER ({NUMERIC_RUN}) / count(*) AS numeric_ratio, sum(len(text)) / count(*) AS mean_run FROM t GROUP BY ALL),
cr AS (SELECT document_id, region, count(*) FILTER (n >= 3) AS aligned_columns FROM (SELECT document_id, region, bucket, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
fb AS (SELECT document_id, region, block, count(*) AS runs, count(*) FILTER ({NUMERIC_RUN}) / count(*) AS nr, sum(len(text)) / count(*) AS mr FROM t GROUP BY ALL),
cb AS (SELECT document_id, region, block, count(*) FILTER (n >= 3) AS ac FROM (SELECT document_id, region, block, bucket, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
tb AS (SELECT document_id, region, bool_or(runs >= 8 AND (nr >= 0.3)::INT + (ac >= 4)::INT + (mr <= 15)::INT >= 2) AS tab FROM fb JOIN cb USING (document_id, region, block) GROUP BY ALL),
k AS (SELECT fr.*, cr.aligned_columns, CASE WHEN chars < 700 AND runs < 25 THEN 'sparse' WHEN (numeric_ratio >= 0.3)::INT + (aligned_columns >= 4)::INT + (mean_run <= 15)::INT >= 2 OR tab THEN 'structured' ELSE 'narrative' END AS kind FROM fr JOIN cr USING (document_id, region) JOIN tb USING (document_id, region)),
p AS (SELECT document_id, CASE WHEN sum(chars) = 0 THEN 'empty' WHEN bool_or(kind = 'structured') THEN 'structured' WHEN bool_or(kind = 'narrative') THEN 'narrative' ELSE 'sparse' END AS page_kind FROM k GROUP BY document_id)
SELECT k.document_id, region, chars, runs, round(numeric_ratio, 6) AS numeric_ratio, aligned_columns, round(mean_run, 6) AS mean_run, kind, page_kind, page_kind = 'structured' AS visual_route FROM k JOIN p ON p.document_id = k.document_id
"""


def l10_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_runs").withColumn("y", F.col("y") * 0.9 + F.when(F.col("reading_index") % 2 == 0, 120).otherwise(0))
    t = t.withColumn("text", F.when(F.col("reading_index") == 2, "iv").otherwise(F.expr("right(text, 4)")))
    return layout.page_labels(t).select("document_id", "printed_page_label")


L10 = f"""
{with_tables("text_runs")},
t AS (SELECT document_id, x, reading_index, CASE WHEN reading_index = 2 THEN 'iv' ELSE right(text, 4) END AS text, y * 0.9::DOUBLE + CASE WHEN reading_index % 2 = 0 THEN 120 ELSE 0 END AS y, height_pt AS hp FROM text_runs),
c AS (SELECT document_id, x, reading_index, text FROM t WHERE (y <= hp * 0.07::DOUBLE OR y >= hp - hp * 0.07::DOUBLE) AND regexp_matches(text, '^([0-9]{{1,4}}|[ivxlcdmIVXLCDM]{{1,7}})$')),
u AS (SELECT document_id, text, min((x, reading_index)) AS place, count(*) AS n FROM c GROUP BY document_id, text)
SELECT document_id, string_agg(text, '-' ORDER BY place) AS printed_page_label FROM u GROUP BY document_id HAVING sum(n) <= 2
"""


def j11_axis_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "text_runs")
    labels = t.where("reading_index <= 3").select("document_id", "physical_page", F.concat(F.lit("L"), F.col("reading_index").cast("string")).alias("label"), "x")
    values = t.where("reading_index > 3").select("document_id", "physical_page", F.col("reading_index").alias("value_id"), "x")
    b = layout.bind_to_axis(values, labels)
    return b.select("document_id", "value_id", "label", F.round("delta_x", 4).alias("delta_x"), "ambiguous")


J11 = f"""
{with_tables("text_runs")},
l AS (SELECT document_id, 'L' || reading_index AS label, x, x - lag(x) OVER (PARTITION BY document_id ORDER BY x, reading_index) AS gap FROM text_runs WHERE reading_index <= 3),
p AS (SELECT document_id, CASE WHEN quantile_cont(gap, 0.5) > 0 THEN quantile_cont(gap, 0.5) END AS pitch FROM l GROUP BY document_id),
v AS (SELECT document_id, reading_index AS value_id, x FROM text_runs WHERE reading_index > 3),
d AS (SELECT v.document_id, value_id, label, abs(l.x - v.x) AS d, row_number() OVER (PARTITION BY v.document_id, value_id ORDER BY abs(l.x - v.x), l.x, label) AS n FROM v LEFT JOIN l ON l.document_id = v.document_id),
e AS (SELECT document_id, value_id, max(label) FILTER (n = 1) AS label, max(d) FILTER (n = 1) AS d1, max(d) FILTER (n = 2) AS d2 FROM d GROUP BY ALL)
SELECT e.document_id, value_id, CASE WHEN pitch IS NULL OR NOT (d1 > pitch * 0.5 OR coalesce(d2 - d1 < pitch * 0.25, false)) THEN label END AS label, round(d1, 4) AS delta_x, pitch IS NULL OR d1 > pitch * 0.5 OR coalesce(d2 - d1 < pitch * 0.25, false) AS ambiguous
FROM e LEFT JOIN p ON p.document_id = e.document_id
"""


# --- runs and issues ----------------------------------------------------------------------------

def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert_issues(table(spark, sf_dir, "issue_events"))


def t03_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _issues(spark, sf_dir)
    return i.select("run_id", "failure_kind", "physical_page", "attempt_count", F.col("created_at").cast("string").alias("created_at"), F.col("last_attempt_at").cast("string").alias("last_attempt_at"), "message", "resolution")


ISSUES = """
i AS (SELECT run_id, failure_kind, physical_page, count(*) AS attempt_count, min(seen_at) AS created_at, max(seen_at) AS last_attempt_at, arg_max(message, (seen_at, message)) AS message, CASE WHEN count(*) > 1 THEN 'retrying' ELSE 'open' END AS resolution FROM issue_events GROUP BY ALL)
"""

T03 = f"""
{with_tables("issue_events")}, {ISSUES}
SELECT run_id, failure_kind, physical_page, attempt_count, {{c}} AS created_at, {{l}} AS last_attempt_at, message, resolution FROM i
""".format(
    c="regexp_replace(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '')", l="regexp_replace(strftime(last_attempt_at, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '')"
)


def t05_final_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _issues(spark, sf_dir)
    starts = i.groupBy("run_id").agg(F.max("created_at").alias("attempt_started_at")).where(F.length("run_id") % 2 == 0)
    i = state.abandon_issues(state.resolve_issues(i, starts), ["purchase"])
    runs = i.select("run_id").distinct().withColumn("failed", F.col("run_id").endswith("7"))
    return state.final_stages(runs, i).select("run_id", "stage", "unresolved")


T05 = f"""
{with_tables("issue_events")}, {ISSUES},
s AS (SELECT run_id, max(created_at) AS started FROM i WHERE len(run_id) % 2 = 0 GROUP BY run_id),
r AS (SELECT i.*, CASE WHEN failure_kind = 'purchase' THEN 'abandoned' WHEN last_attempt_at < started THEN 'resolved' ELSE resolution END AS res FROM i LEFT JOIN s ON s.run_id = i.run_id)
SELECT run_id, CASE WHEN run_id LIKE '%7' THEN 'failed' WHEN count(*) FILTER (res <> 'resolved') > 0 THEN 'completed_with_issues' ELSE 'completed' END AS stage, count(*) FILTER (res <> 'resolved') AS unresolved FROM r GROUP BY run_id
"""


def a20_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")
    r = state.latest_runs(table(spark, sf_dir, "runs"))
    return r.select("document_id", "run_id", "stage", state.is_stalled(now).alias("stalled"), state.is_terminal(F.col("stage")).alias("terminal"))


A20 = f"""
{with_tables("runs")}
SELECT document_id, run_id, stage, stage NOT IN ('completed', 'completed_with_issues', 'failed', 'queued') AND epoch(TIMESTAMP '1996-06-01') - epoch(coalesce(heartbeat_at, started_at, created_at)) > 300 AS stalled, stage IN ('completed', 'completed_with_issues', 'failed') AS terminal
FROM runs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC) = 1
"""


def p13_visual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks")
    kinds = b.groupBy("document_id", "physical_page").agg(F.bool_or(F.col("block_type") == "table").alias("visual_route"))
    return reads.visual_pages(b, kinds, "transcribe@1")


P13 = f"""
{with_tables("blocks")}, k AS (SELECT document_id, physical_page FROM blocks GROUP BY ALL HAVING bool_or(block_type = 'table') AND NOT bool_or(produced_by = 'transcribe@1'))
SELECT document_id, physical_page FROM k QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY physical_page) <= 40
"""

_ALL = {
    s01_validate_uploads: S01, s02_ingest: S02, s10_insert_if_absent: S10, s11_upgrade: S11, f5_06_verify: F5_06, f5_07_claim_status: F5_07, j07_exact_candidates: J07, j08_semantic_candidates: J08, u01_union_candidates: U01,
    j15_unclassified: J15, j16_missing_embeddings: J16, f4_04_resolve_entities: F4_04, j17_entity_candidates: J17, f3_07_register_predicates: F3_07, p02_extraction_blocks: P02, w04_carried_heading: W04, w08_chunks: W08, w09_batches: W09,
    l02_gutters: L02, l04_lines: L04, l05_blocks: L05, l06_page_kinds: L06, l10_page_labels: L10, j11_axis_binding: J11, t03_issues: T03, t05_final_stages: T05, a20_latest_runs: A20, p13_visual_pages: P13,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL.items()}
