"""Claim tables derived from the TPC-H-like test tables, in SQL that Spark and DuckDB both read.

Names in braces are the test tables; Spark gets DataFrames for them, DuckDB their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {}

#: One row a line number: the test table repeats some of them.
LINES = """(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_discount) AS l_discount,
  min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""

TABLES["collections"] = """
SELECT concat('col', r_regionkey) AS id, r_name AS name FROM {region}
"""

TABLES["documents"] = """
SELECT concat('d', c_custkey) AS id, concat('col', n_regionkey) AS collection_id, concat(lower(c_mktsegment), '-', c_custkey % 50, '.pdf') AS filename,
  CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE 1 + c_custkey % 7 END AS page_count
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

TABLES["entities"] = """
SELECT concat('e', s_suppkey) AS id, concat('col', n_regionkey) AS collection_id, s_name AS canonical_label, lower(replace(s_name, '#', '')) AS normalized_label
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0
"""

TABLES["aliases"] = """
SELECT concat('e', s_suppkey) AS entity_id, concat('alias ', s_suppkey) AS normalized_alias FROM {supplier} WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0
"""

TABLES["blocks"] = """
SELECT concat('b', o_orderkey) AS block_id, concat('d', o_custkey) AS document_id, CAST(o_orderkey % 5 AS INT) AS physical_page, CAST(o_orderkey % 13 AS INT) AS block_index,
  CASE WHEN o_orderkey % 9 = 0 THEN 'model_transcription' ELSE 'native_text' END AS extraction_method,
  CASE o_orderkey % 8 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' WHEN 2 THEN 'list' WHEN 3 THEN 'chart' ELSE 'paragraph' END AS block_type,
  CASE WHEN o_orderkey % 31 = 0 THEN '  ' WHEN o_orderkey % 8 = 0 THEN concat('Section ', o_orderpriority)
    ELSE concat('Revenue   from  services was ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' crore in FY', 2020 + o_orderkey % 5, '. Year ended March ', 28 + o_orderkey % 4, '.') END AS content,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 5 + 1 AS STRING) END AS printed_page_label,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS bbox_x, CAST(10 AS DOUBLE) AS bbox_y, CAST(20 AS DOUBLE) AS bbox_width,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(5 AS DOUBLE) END AS bbox_height,
  CASE WHEN o_orderkey % 9 = 0 THEN 'transcribe@1' ELSE 'parse@1' END AS produced_by
FROM {orders}
"""

TABLES["claims"] = """
SELECT concat('c', l_orderkey, '-', l_linenumber) AS id, concat('d', o_custkey) AS document_id, concat('col', n_regionkey) AS collection_id,
  CASE WHEN l_suppkey % 7 = 0 OR l_suppkey % 4 = 0 THEN NULL ELSE concat('e', l_suppkey) END AS entity_id,
  CASE l_suppkey % 7 WHEN 0 THEN 'The  Company.' WHEN 1 THEN concat('Supplier ', l_suppkey, ' Pvt. Ltd.') WHEN 2 THEN concat('Alias ', l_suppkey) ELSE concat('Supplier ', l_suppkey, ' Limited') END AS subject,
  CASE l_partkey % 9 WHEN 0 THEN 'revenue_from_operations' WHEN 1 THEN 'Total Income' WHEN 2 THEN 'adjusted_ebitda' WHEN 3 THEN 'ebitda' WHEN 4 THEN 'profits_after_tax' WHEN 5 THEN 'profit before tax'
    WHEN 6 THEN 'number of employees' WHEN 7 THEN 'net revenue per employee' ELSE 'delivery_boxes' END AS predicate,
  concat('In the year the company stated a figure of ', CAST(CAST(l_quantity AS INT) AS STRING), ' for measure ', l_partkey % 9) AS original_statement,
  CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_linenumber = 5 THEN concat('(', CAST(CAST(l_quantity AS INT) AS STRING), ')') ELSE concat('Rs ', CAST(CAST(l_quantity AS INT) AS STRING), ' crore') END AS raw_value,
  CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.', l_suppkey % 10, '0') ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS numeric_value,
  CASE WHEN l_linenumber % 4 = 0 THEN 'USD' WHEN l_linenumber % 4 = 1 THEN NULL ELSE 'INR' END AS currency,
  CASE l_linenumber % 6 WHEN 0 THEN 'million' WHEN 1 THEN ' Crore ' WHEN 2 THEN NULL WHEN 3 THEN 'myriad' WHEN 4 THEN 'lakh' ELSE '' END AS scale,
  CASE WHEN l_partkey % 13 = 0 THEN '%' WHEN l_partkey % 13 = 1 THEN 'bps' WHEN l_partkey % 13 = 2 THEN 'boxes' ELSE NULL END AS unit,
  CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('FY', 2020 + l_partkey % 4) WHEN 2 THEN concat('Q', 1 + l_partkey % 4, ' FY2', l_partkey % 4) WHEN 3 THEN CAST(2020 + l_partkey % 4 AS STRING) WHEN 4 THEN concat('H', 1 + l_partkey % 2, ' FY2', l_partkey % 4) ELSE concat('FY2', l_partkey % 4) END AS period_label,
  CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'fiscal_year' WHEN 2 THEN 'quarter' WHEN 3 THEN 'calendar_year' WHEN 4 THEN 'half_year' ELSE 'fiscal_year' END AS period_type,
  CASE l_orderkey % 4 WHEN 0 THEN 'Consolidated' WHEN 1 THEN NULL WHEN 2 THEN 'unconsolidated basis' ELSE 'segment' END AS scope,
  CASE l_returnflag WHEN 'A' THEN 'reported' WHEN 'R' THEN 'projected' ELSE NULL END AS assertion_status,
  CASE l_linestatus WHEN 'F' THEN 'accepted' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'needs_review' ELSE 'rejected' END END AS status,
  concat('b', l_orderkey) AS block_id, l_linenumber AS line, l_orderkey AS orderkey, l_suppkey AS suppkey, l_partkey AS partkey
FROM {lines} AS li JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

TABLES["evidence"] = """
SELECT concat('v', l_orderkey, '-', l_linenumber, '-', k) AS evidence_id, concat('c', l_orderkey, '-', l_linenumber) AS claim_id,
  CASE WHEN (l_partkey + k) % 5 = 0 THEN NULL ELSE concat('b', l_orderkey + k) END AS source_block_id,
  CASE (l_partkey + k) % 5 WHEN 0 THEN 'block_not_found' WHEN 1 THEN 'quote_not_found' WHEN 2 THEN 'visual_only' ELSE 'verified_native_text' END AS verification,
  CASE WHEN (l_partkey + k) % 5 < 2 THEN 'unchecked' WHEN l_suppkey % 9 = 0 THEN 'unsupported' WHEN l_suppkey % 9 = 1 THEN 'unclear' ELSE 'supported' END AS entailment
FROM {lines} AS li JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) AS twice ON l_linenumber + k < 7
"""

TABLES["relationships"] = """
SELECT concat('r', a.l_orderkey, '-', a.l_linenumber) AS id, concat('col', n_regionkey) AS collection_id, concat('c', a.l_orderkey, '-', a.l_linenumber) AS claim_a_id, concat('c', a.l_orderkey, '-', a.l_linenumber + 1) AS claim_b_id,
  CASE a.l_partkey % 7 WHEN 0 THEN 'corroborates' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'reconciled_by_context' WHEN 3 THEN 'insufficient_context' WHEN 4 THEN 'likely_contradiction' ELSE 'insufficient_context' END AS label,
  CASE WHEN a.l_suppkey % 3 = 0 THEN 'model' ELSE 'deterministic' END AS method, 'compare@2' AS method_version
FROM {lines} AS a JOIN {orders} ON a.l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

TABLES["runs"] = """
SELECT concat('run', o_orderkey) AS run_id, concat('d', o_custkey) AS document_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'parsing' WHEN 2 THEN 'extracting' WHEN 3 THEN 'normalizing' WHEN 4 THEN 'comparing' WHEN 5 THEN 'completed' WHEN 6 THEN 'completed_with_issues' ELSE 'failed' END AS stage,
  o_orderdate AS created_at, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate END AS started_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS heartbeat_at,
  CASE WHEN o_orderkey % 8 >= 5 THEN o_orderdate ELSE NULL END AS finished_at, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 90 END AS pages_total,
  o_orderkey % 80 AS pages_processed, o_orderkey % 70 AS chunks_total, o_orderkey % 60 AS chunks_processed, o_orderkey % 5000 AS input_tokens, o_orderkey % 700 AS output_tokens,
  o_orderkey % 50 AS claims_extracted, o_orderkey % 40 AS claims_accepted, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 30 END AS relationships_created
FROM {orders}
"""

TABLES["issue_events"] = """
SELECT concat('run', user_id) AS run_id, event_type AS failure_kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END AS physical_page, concat('attempt ', event_id) AS message, ts AS seen_at FROM {events}
"""

TABLES["text_runs"] = """
SELECT concat('d', l_orderkey) AS document_id, 0 AS physical_page, CASE WHEN l_partkey % 3 = 0 THEN concat('word ', l_partkey % 100) ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END AS text,
  CAST((l_suppkey * 37) % 500 AS DOUBLE) + l_discount * 10 AS x, CAST(700 - (l_partkey % 12) * 7 AS DOUBLE) AS y, CAST(20 + l_quantity AS DOUBLE) AS width, CAST(8 + l_linenumber % 3 AS DOUBLE) AS height,
  CAST(l_linenumber AS INT) AS reading_index, CAST(600 AS DOUBLE) AS width_pt, CAST(800 AS DOUBLE) AS height_pt
FROM {lines} AS li
"""

TABLES["vectors"] = """
SELECT concat('c', vec_id) AS id, concat('col', label % 3) AS collection_id, concat('d', vec_id % 40) AS document_id, 'm1' AS model, embedding, vec_id FROM {embeddings}
"""

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


for _name in TABLES:
    TABLES[_name] = TABLES[_name].replace("{lines}", LINES)

#: Lines meet their orders. For Spark orders meet their customers first: the joins are inner ones, so the rows are the same, and lines move once, by order.
_ORDERED = "JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"
_PLACED = "JOIN (SELECT * FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) AS placed ON l_orderkey = o_orderkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A claim table as a Spark DataFrame; what is made of lines and their orders is dealt by order, where it need not move again to meet its like."""
    sql = TABLES[name].replace(_ORDERED, _PLACED)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in sql}
    if sql != TABLES[name]:
        used["lineitem"] = used["lineitem"].repartition("l_orderkey")
    return spark.sql(sql, **used)


def duck(name: str) -> str:
    """A claim table as a DuckDB subquery."""
    sql = TABLES[name].replace("AS STRING", "AS VARCHAR")
    return re.sub(r"\{(\w+)\}", r"\1", sql).strip()


def with_tables(*names: str) -> str:
    """WITH clause that defines claim tables; a name that is also a test table gets the prefix x_."""
    return "WITH " + ", ".join(f"{'x_' if n in BASE else ''}{n} AS ({duck(n)})" for n in names)
