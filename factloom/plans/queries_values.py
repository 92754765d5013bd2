"""Queries over the scalar functions: figures, periods, predicates, names, fingerprints, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import entities, numbers, periods, predicates, text
from factloom.operators import checks
from factloom.plans.fixture import LINES, duck, table, with_tables
from factloom.sources.scratch import read_once, stored

QUALIFIERS = "array<struct<name:string,value:string>>"

SEP = "chr(31)"


def duck_uuid5(name: str) -> str:
    """DuckDB's expression for the version 5 UUID of a name in this package's namespace."""
    h = f"sha1(unhex('{text.NAMESPACE.hex}') || encode({name}))"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || printf('%02x', (('0x' || {h}[17:18])::INT & 63) | 128) || {h}[19:20] || '-' || {h}[21:32]"


#: A predicate's normal form, by its rules: words, fillers, singular.
RULED = """array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('the', 'a', 'an', 'of', 'for', 'in', 'on', 'to')),
  lambda w: CASE WHEN len(w) <= 3 THEN w WHEN w LIKE '%ies' THEN w[:-4] || 'y' WHEN w LIKE '%ses' OR w LIKE '%xes' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' THEN w[:-2] ELSE w END), '_')"""

#: A name's normal form, by its rules: no punctuation, no legal forms at the end.
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[.,]', ' ', 'g'), '[^a-z0-9&\s-]', '', 'g'), '\s+', ' ', 'g'))"
LABEL = f"regexp_replace({CLEAN}, '( ({'|'.join(entities.LEGAL)}))+$', '')"

RAW_VALUES = """
SELECT concat('n', l_orderkey, '-', l_linenumber) AS id, CASE l_partkey % 12
  WHEN 0 THEN concat('about ', CAST(CAST(l_quantity AS INT) AS STRING), '.50 Crore') WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '-', CAST(CAST(l_quantity AS INT) + 5 AS STRING), ' %')
  WHEN 2 THEN concat('₹', CAST(CAST(l_quantity AS INT) AS STRING), ',142 Cr') WHEN 3 THEN concat('(1,', CAST(CAST(l_quantity AS INT) + 100 AS STRING), ')')
  WHEN 4 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' to ', CAST(CAST(l_quantity AS INT) + 2 AS STRING), ' basis points') WHEN 5 THEN concat('US$ ', CAST(CAST(l_quantity AS INT) AS STRING), '.25  mn')
  WHEN 6 THEN concat('~', CAST(CAST(l_quantity AS INT) AS STRING), ' lakhs') WHEN 7 THEN 'not stated' WHEN 8 THEN '   ' WHEN 9 THEN concat('Rs. -', CAST(CAST(l_quantity AS INT) AS STRING), ' million')
  WHEN 10 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING), ' EUR') ELSE concat('8,14,', CAST(CAST(l_quantity AS INT) + 10 AS STRING), ' percentage points') END AS raw
FROM """ + LINES + " AS li"


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "documents", "embeddings", "part", "customer") if "{" + n + "}" in sql}
    return spark.sql(sql, **names)


def _duck(sql: str) -> str:
    out = sql.replace("AS STRING", "AS VARCHAR")
    for n in ("lineitem", "orders", "documents", "embeddings", "part", "customer"):
        out = out.replace("{" + n + "}", n)
    return out


def f1_04_parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_once(stored(_sql(spark, sf_dir, RAW_VALUES), "raw-values"), ["raw"], {"n": numbers.parse_numeric("raw")}, "parsed")
    d = lambda c: F.col(f"n.{c}").cast("double").alias(c)
    return n.select("id", d("value"), "n.kind", d("low"), d("high"), F.col("n.decimal_places").cast("long").alias("decimal_places"), "n.scale", "n.currency", "n.unit", "n.negative")


F1_04 = f"""
WITH r AS (SELECT id, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS t FROM ({_duck(RAW_VALUES)})),
b AS (SELECT id, regexp_matches(t, '^\\(.*\\)$') AS wrapped, CASE WHEN regexp_matches(t, '^\\(.*\\)$') THEN t[2:-2] ELSE t END AS body FROM r),
n AS (SELECT *, regexp_extract_all(body, '-?[0-9]+(?:[.,][0-9]+)*(?:\\.[0-9]+)?') AS m,
  CASE WHEN regexp_matches(body, '(^|[ 0-9])percentage points($| )') THEN 'percentage_point' WHEN regexp_matches(body, '(^|[ 0-9])basis points( |$)') THEN 'basis_point' WHEN contains(body, '%') THEN 'percent' END AS unit,
  CASE WHEN contains(body, '₹') THEN 'INR' WHEN regexp_matches(body, '(^| )rs( |[0-9]|$)') THEN 'INR' WHEN regexp_matches(body, '(^| )rs\\.( |[0-9]|$)') THEN 'INR' WHEN contains(body, '$') THEN 'USD' WHEN regexp_matches(body, '(^| )eur( |[0-9]|$)') THEN 'EUR' END AS currency,
  CASE WHEN regexp_matches(body, '(^|[ 0-9])million\\b') THEN 'million' WHEN regexp_matches(body, '(^|[ 0-9])crore\\b') THEN 'crore' WHEN regexp_matches(body, '(^|[ 0-9])lakhs\\b') THEN 'lakhs' WHEN regexp_matches(body, '(^|[ 0-9])cr\\b') THEN 'cr' WHEN regexp_matches(body, '(^|[ 0-9])mn\\b') THEN 'mn' END AS scale FROM b),
v AS (SELECT *, replace(m[1], ',', '')::DECIMAL(38,10) AS a, len(m) >= 2 AND regexp_matches(replace(body, ',', ''), '[0-9]\\s*(-|to|–|—)\\s*[0-9]') AS ranged,
  CASE WHEN len(m) >= 2 THEN replace(m[2], ',', '')::DECIMAL(38,10) END AS z, CASE WHEN wrapped OR starts_with(trim(body), '-') THEN -1 ELSE 1 END AS sign FROM n)
SELECT id, CASE WHEN ranged THEN (a * sign + z * sign) / 2 ELSE a * sign END::DOUBLE AS value,
  CASE WHEN len(m) = 0 THEN NULL WHEN ranged THEN 'range' WHEN regexp_matches(body, '\\b(about|approx\\.?|approximately|around|circa)\\b|^~') THEN 'approximate' ELSE 'point' END AS kind,
  CASE WHEN ranged THEN a * sign END::DOUBLE AS low, CASE WHEN ranged THEN z * sign END::DOUBLE AS high, CASE WHEN len(m) > 0 THEN len(regexp_extract(replace(m[1], ',', ''), '\\.([0-9]+)$', 1)) END AS decimal_places,
  CASE WHEN len(m) > 0 AND unit IS NULL THEN scale END AS scale, CASE WHEN len(m) > 0 THEN currency END AS currency, CASE WHEN len(m) > 0 THEN unit END AS unit, a * sign < 0 AS negative FROM v
"""


def f1_08_normalize_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims").withColumn("n", numbers.normalize_value("numeric_value", "scale", "unit", "currency"))
    return c.select("id", F.col("n.value").cast("double").alias("value"), "n.unit", F.col("n.half_width").cast("double").alias("half_width"), F.get("n.steps", F.lit(0))["step"].alias("step"), F.get("n.steps", F.lit(0))["to"].alias("to_value"))


NORMAL = """
n AS (SELECT *, lower(trim(scale)) AS word, numeric_value::DECIMAL(38,10) AS v, CASE trim(lower(unit)) WHEN '%' THEN 'percent' WHEN 'bps' THEN 'basis_point' END AS prop,
  CASE lower(trim(scale)) WHEN 'million' THEN 1000000 WHEN 'crore' THEN 10000000 WHEN 'lakh' THEN 100000 END AS f,
  CASE WHEN contains(numeric_value, '.') THEN 0.005 ELSE 0.5 END::DECIMAL(38,10) AS h FROM claims),
normal AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN prop = 'basis_point' THEN v / 100.0 WHEN prop IS NOT NULL THEN v WHEN f IS NOT NULL THEN v * f ELSE v END::DOUBLE AS value,
  CASE WHEN v IS NULL THEN NULL WHEN prop IS NOT NULL THEN 'percent' WHEN f IS NULL AND word <> '' THEN coalesce(currency, unit, 'count') || '/' || word ELSE coalesce(nullif(currency, ''), nullif(unit, ''), 'count') END AS nunit,
  CASE WHEN v IS NULL THEN NULL WHEN prop = 'basis_point' THEN h / 100.0 WHEN prop IS NOT NULL THEN h WHEN f IS NOT NULL THEN h * f ELSE h END::DOUBLE AS half_width FROM n)
"""

F1_08 = f"""
{with_tables("claims")}, {NORMAL}
SELECT id, value, nunit AS unit, half_width,
  CASE WHEN v IS NULL OR prop = 'percent' THEN NULL WHEN prop = 'basis_point' THEN 'basis_points_to_percent' WHEN f IS NOT NULL THEN 'apply_scale' WHEN word <> '' THEN 'unrecognised_scale' END AS step,
  CASE WHEN v IS NULL OR prop = 'percent' THEN NULL WHEN prop = 'basis_point' OR f IS NOT NULL THEN CASE WHEN contains(value::DECIMAL(38,10)::VARCHAR, '.') THEN regexp_replace(value::DECIMAL(38,10)::VARCHAR, '\\.?0+$', '') END WHEN word <> '' THEN 'left unconverted' END AS to_value
FROM normal
"""

#: The same, with values and half widths as decimals, as the checks compare them: closed intervals that just touch do so in doubles by chance only.
EXACT = NORMAL.replace("v / 100.0", "v * 0.01").replace("h / 100.0", "h * 0.01").replace("END::DOUBLE AS value", "END AS value").replace("END::DOUBLE AS half_width", "END AS half_width")

PAIRS = """
SELECT a.id AS a_id, b.id AS b_id FROM {claims} a JOIN {claims} b ON a.orderkey = b.orderkey AND a.line < b.line
"""


def claim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of claims of one order, as structs a and b, with what the checks need."""
    c = table(spark, sf_dir, "claims")
    # Every third line counts as of another document, so that pairs cross documents.
    c = c.withColumn("document_id", F.concat("document_id", F.when(F.col("line") % 3 == 0, "x").otherwise("")))
    c = c.withColumn("qualifiers", F.when(F.col("partkey") % 3 == 0, F.array(F.struct(F.lit(" Basis ").alias("name"), F.lit("diluted").alias("value")))).otherwise(F.array().cast(QUALIFIERS)))
    c = c.withColumn("source_block_ids", F.array("block_id")).withColumn("period_start", F.lit(None).cast("date")).withColumn("period_end", F.lit(None).cast("date"))
    c = c.withColumn("source_block_ids", F.when(F.col("line") % 2 == 0, F.array(F.concat("block_id", F.lit("y")))).otherwise(F.col("source_block_ids")))
    c = checks.with_readings(c)
    s = c.select("orderkey", "line", F.struct(*c.columns).alias("c"))
    a, b = s.select("orderkey", F.col("line").alias("la"), F.col("c").alias("a")), s.select("orderkey", F.col("line").alias("lb"), F.col("c").alias("b"))
    j = a.join(b, "orderkey").where("la < lb")
    return j.select(F.col("a.id").alias("claim_a_id"), F.col("b.id").alias("claim_b_id"), "a", "b")


def f1_09_compare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = claim_pairs(spark, sf_dir).select("claim_a_id", "claim_b_id", F.col("a.figure").alias("x"), F.col("b.figure").alias("y"))
    p = p.withColumn("v", numbers.compare_values(F.col("x"), F.col("y"))).withColumn("ratio", numbers.scale_ratio(F.col("x"), F.col("y")))
    return p.select("claim_a_id", "claim_b_id", "v.agreement", F.round(F.col("v.difference").cast("double"), 4).alias("difference"), F.round(F.col("v.relative").cast("decimal(20,12)") / F.lit(7).cast("decimal(1,0)"), 6).cast("double").alias("relative"), F.col("ratio").cast("double").alias("ratio"))


F1_09 = f"""
{with_tables("claims")}, {EXACT}
SELECT a.id AS claim_a_id, b.id AS claim_b_id,
  CASE WHEN a.value IS NULL OR b.value IS NULL THEN NULL WHEN a.nunit <> b.nunit THEN 'incomparable' WHEN a.value - a.half_width <= b.value + b.half_width AND b.value - b.half_width <= a.value + a.half_width THEN 'agree' ELSE 'disagree' END AS agreement,
  CASE WHEN a.nunit = b.nunit THEN round(abs(a.value - b.value)::DOUBLE, 4) END AS difference, CASE WHEN a.nunit = b.nunit AND greatest(abs(a.value), abs(b.value)) > 0 THEN ((((abs(a.value - b.value)::DOUBLE / greatest(abs(a.value), abs(b.value)))::DECIMAL(18,12) * 1000000000000)::HUGEINT + 3500000) // 7000000)::DOUBLE / 1000000 END AS relative,
  CASE WHEN a.value <> 0 AND b.value <> 0 AND a.value <> b.value AND abs(log10(a.value::DOUBLE / b.value) - round(log10(a.value::DOUBLE / b.value))) < 1e-12 AND round(log10(a.value::DOUBLE / b.value)) <> 0 THEN power(10::DOUBLE, round(log10(a.value::DOUBLE / b.value))) END AS ratio
FROM normal a JOIN normal b ON a.orderkey = b.orderkey AND a.line < b.line
"""


def f1_11_digits_and_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").select("id", numbers.significant_digits("numeric_value").cast("long").alias("digits"), numbers.base_units("numeric_value", "scale").cast("double").alias("base"))


F1_11 = f"""
{with_tables("claims")}
SELECT id, len(ltrim(regexp_replace(numeric_value, '[^0-9]', '', 'g'), '0')) AS digits,
  (numeric_value::DECIMAL(38,10) * CASE lower(trim(coalesce(scale, ''))) WHEN '' THEN 1 WHEN 'million' THEN 1000000 WHEN 'crore' THEN 10000000 WHEN 'lakh' THEN 100000 END)::DOUBLE AS base FROM claims
"""


def f2_02_parse_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims").withColumn("p", periods.parse_period_label("period_label"))
    return c.select("id", "p.kind", "p.year", "p.quarter", "p.half", periods.fold_period_label("period_label").alias("folded"))


PERIOD = """
p AS (SELECT *, CASE WHEN period_label LIKE 'Q%' THEN 'quarter' WHEN period_label LIKE 'H%' THEN 'half_year' WHEN period_label LIKE 'FY%' THEN 'fiscal_year' WHEN period_label IS NOT NULL THEN 'calendar_year' END AS kind,
  CASE WHEN regexp_matches(period_label, 'FY[0-9]{4}$') THEN right(period_label, 4)::INT WHEN contains(period_label, 'FY') THEN 2000 + right(period_label, 2)::INT ELSE period_label::INT END AS year,
  CASE WHEN period_label LIKE 'Q%' THEN period_label[2]::INT END AS quarter, CASE WHEN period_label LIKE 'H%' THEN period_label[2]::INT END AS half FROM claims)
"""

F2_02 = f"""
{with_tables("claims")}, {PERIOD}
SELECT id, kind, year, quarter, half, CASE WHEN regexp_matches(replace(upper(period_label), ' ', ''), '^FY[0-9]{{2}}$') THEN 'FY20' || right(period_label, 2) ELSE replace(upper(period_label), ' ', '') END AS folded FROM p
"""


def f2_03_resolve_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    convention = F.when(F.col("suppkey") % 3 == 0, F.lit(None).cast("string")).when(F.col("suppkey") % 3 == 1, "april-march").otherwise("january-december")
    c = table(spark, sf_dir, "claims").withColumn("r", periods.resolve_period("period_label", "period_type", convention))
    return c.select("id", "r.period_type", F.col("r.start").cast("string").alias("period_start"), F.col("r.end").cast("string").alias("period_end"), F.col("r.note").isNull().alias("settled"))


F2_03 = f"""
{with_tables("claims")}, {PERIOD},
s AS (SELECT *, CASE WHEN kind = 'calendar_year' THEN make_date(year, 1, 1) WHEN suppkey % 3 = 1 THEN make_date(year - 1, 4, 1) WHEN suppkey % 3 = 2 THEN make_date(year, 1, 1) END AS base,
  CASE kind WHEN 'quarter' THEN (quarter - 1) * 3 WHEN 'half_year' THEN (half - 1) * 6 ELSE 0 END AS off, CASE kind WHEN 'quarter' THEN 3 WHEN 'half_year' THEN 6 ELSE 12 END AS n FROM p)
SELECT id, coalesce(kind, period_type, 'unknown') AS period_type, (base + to_months(off))::DATE::VARCHAR AS period_start, (base + to_months(off + n) - INTERVAL 1 DAY)::DATE::VARCHAR AS period_end, base IS NOT NULL AS settled FROM s
"""


def f2_01_conventions_and_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks").select("block_id", periods.fiscal_convention("content").alias("convention"))
    c = table(spark, sf_dir, "claims").select("block_id", "id", periods.normalize_scope("scope").alias("scope"))
    return c.join(b, "block_id")


F2_01 = f"""
{with_tables("claims", "blocks")}
SELECT c.block_id, c.id, CASE WHEN lower(scope) LIKE '%unconsolidated%' THEN 'standalone' ELSE lower(trim(scope)) END AS scope, CASE WHEN contains(lower(content), 'year ended march 31') THEN 'april-march' END AS convention
FROM claims c JOIN blocks b ON b.block_id = c.block_id
"""


def f2_06_compare_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = claim_pairs(spark, sf_dir).withColumn("d", periods.compare_context(F.col("a"), F.col("b")))
    return p.select("claim_a_id", "claim_b_id", F.array_join(F.transform("d", lambda d: d["dimension"]), ",").alias("dimensions"), F.exists("d", lambda d: ~d["could_explain_gap"]).alias("blocked"))


CONTEXT = """
k AS (SELECT p.*, replace(lower(period_label), ' ', '') AS lab, CASE WHEN lower(scope) LIKE '%unconsolidated%' THEN 'standalone' ELSE lower(trim(scope)) END AS nscope, partkey % 3 = 0 AS qual,
  document_id || CASE WHEN line % 3 = 0 THEN 'x' ELSE '' END AS doc, CASE WHEN line % 2 = 0 THEN block_id || 'y' ELSE block_id END AS blk FROM p),
d AS (SELECT a.id AS claim_a_id, b.id AS claim_b_id, a.orderkey, a.line AS la, b.line AS lb,
  NOT coalesce(a.lab IS NOT DISTINCT FROM b.lab OR (a.lab IS NOT NULL AND b.lab IS NOT NULL AND a.lab NOT SIMILAR TO '[qh].*fy.*' AND b.lab NOT SIMILAR TO '[qh].*fy.*' AND a.kind = b.kind AND a.year = b.year)
    OR (a.lab SIMILAR TO '[qh].*fy.*' AND b.lab SIMILAR TO '[qh].*fy.*' AND a.lab = b.lab), false) AS d_period,
  a.period_type <> b.period_type AS d_type, a.nscope <> b.nscope AS d_scope, a.assertion_status <> b.assertion_status AS d_status, lower(trim(a.unit)) <> lower(trim(b.unit)) AS d_unit, lower(trim(a.currency)) <> lower(trim(b.currency)) AS d_currency, a.qual <> b.qual AS d_qual
  FROM k a JOIN k b ON a.orderkey = b.orderkey AND a.line < b.line)
"""

F2_06 = f"""
{with_tables("claims")}, {PERIOD}, {CONTEXT}
SELECT claim_a_id, claim_b_id, array_to_string(list_filter([CASE WHEN d_period THEN 'period' END, CASE WHEN d_type THEN 'period_type' END, CASE WHEN d_scope THEN 'scope' END, CASE WHEN d_status THEN 'assertion_status' END,
  CASE WHEN d_unit THEN 'unit' END, CASE WHEN d_currency THEN 'currency' END, CASE WHEN d_qual THEN 'qualifier' END], lambda x: x IS NOT NULL), ',') AS dimensions, coalesce(d_currency, false) AS blocked FROM d
"""


def f3_01_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").select("id", predicates.normalize_predicate("predicate").alias("normal"), predicates.predicate_head("predicate").alias("head"))


def _normal(x: str) -> str:
    return RULED.format(x=x)


F3_01 = f"""
{with_tables("claims")}
SELECT id, {_normal("predicate")} AS normal, coalesce(list_extract(list_filter(string_split({_normal("predicate")}, '_'), lambda w: w NOT IN {predicates.MODIFIERS}), -1), {_normal("predicate")}) AS head FROM claims
"""


def f3_05_predicate_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = claim_pairs(spark, sf_dir).withColumn("r", predicates.predicate_relation("a.measure", "b.measure", normal=True))
    return p.select("claim_a_id", "claim_b_id", "r.relation", "r.comparable", "r.reason")


RELATION = """
m AS (SELECT id, orderkey, line, n, string_split(n, '_') AS w, list_filter(string_split(n, '_'), lambda t: t NOT IN ('adjusted','normalised','normalized','underlying','pro','forma','proforma','restated','reported','organic','like','total','net','gross','excluding','including','ex','before','after','per','average','median','estimated','projected','annualised','annualized')) AS c
  FROM (SELECT *, NORMAL AS n FROM claims)),
rel AS (SELECT a.id AS claim_a_id, b.id AS claim_b_id, a.n AS an, b.n AS bn, a.w AS aw, b.w AS bw, a.c AS ac, b.c AS bc, list_filter(a.c, lambda t: list_contains(b.c, t)) AS shared,
  CASE WHEN a.n = b.n THEN 'same' WHEN (a.n, b.n) IN (('revenue_from_operation','total_income'),('total_income','revenue_from_operation'),('profit_after_tax','profit_before_tax'),('profit_before_tax','profit_after_tax')) THEN 'explicitly_distinct'
    WHEN a.c = b.c AND len(a.c) > 0 THEN 'modifier_variant' WHEN len(list_filter(a.c, lambda t: list_contains(b.c, t))) > 0 THEN 'related_form' ELSE 'unrelated' END AS relation
  FROM m a JOIN m b ON a.orderkey = b.orderkey AND a.line < b.line)
""".replace("NORMAL", _normal("predicate"))

F3_05 = f"""
{with_tables("claims")}, {RELATION}
SELECT claim_a_id, claim_b_id, relation, relation = 'same' AS comparable, CASE relation WHEN 'same' THEN 'one and the same measure' WHEN 'explicitly_distinct' THEN an || ' and ' || bn || ' are never the same'
  WHEN 'modifier_variant' THEN 'apart from these words alike: adjusted' WHEN 'related_form' THEN 'words in common: ' || array_to_string(shared, ', ') ELSE 'no word in common' END AS reason FROM rel
"""


def f4_01_entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    generic = entities.is_generic_subject("subject")
    return table(spark, sf_dir, "claims").select(
        "id", entities.normalize_entity_label("subject").alias("label"), F.array_join(entities.stripped_suffixes("subject"), " ").alias("suffixes"), generic.alias("generic"),
        entities.scoped_label("subject", F.when(generic, F.col("document_id"))).alias("scoped"),
    )


F4_01 = f"""
{with_tables("claims")}, x AS (SELECT *, {LABEL.format(x="subject")} AS label, {CLEAN.format(x="subject")} AS clean, regexp_replace(trim(regexp_replace(lower(subject), '\\s+', ' ', 'g')), '[.,]$', '') IN {entities.GENERIC} AS generic FROM claims)
SELECT id, label, ltrim(clean[len(label) + 1:]) AS suffixes, generic, CASE WHEN generic THEN label || '#' || document_id ELSE label END AS scoped FROM x
"""


def _claim_struct(c: DataFrame) -> DataFrame:
    q = F.array(F.struct(F.lit("Unit").alias("name"), F.col("unit").alias("value")), F.struct(F.lit(" basis").alias("name"), F.lit("Diluted  EPS").alias("value")))
    c = c.withColumn("qualifiers", F.when(F.col("unit").isNotNull(), q).otherwise(F.array().cast(QUALIFIERS)))
    return c.withColumn("s", F.struct(*c.columns))


def f6_01_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claim_struct(table(spark, sf_dir, "claims"))
    return c.select("id", text.assertion_fingerprint(F.col("s")).alias("fingerprint"), text.describe_claim(F.col("s")).alias("description"), text.estimate_tokens("original_statement").alias("tokens"))


F6_01 = f"""
{with_tables("claims")}, f AS (SELECT *, lambda_free FROM (SELECT *, 1 AS lambda_free FROM claims))
SELECT id, sha256(concat_ws(' ', trim(regexp_replace(lower(subject), '\\s+', ' ', 'g')), predicate, trim(lower(coalesce(numeric_value, raw_value, ''))), lower(coalesce(currency, '')), trim(lower(coalesce(scale, ''))), lower(coalesce(unit, '')), trim(lower(coalesce(period_label, ''))),
  coalesce(period_type, ''), trim(lower(coalesce(scope, ''))), coalesce(assertion_status, ''), CASE WHEN unit IS NULL THEN '' ELSE 'basis=diluted eps|unit=' || lower(unit) END)) AS fingerprint,
  concat_ws(', ', subject, replace(predicate, '_', ' '), nullif(scope, ''), nullif(period_label, ''), 'measured in ' || nullif(unit, ''), CASE WHEN unit IS NOT NULL THEN 'Unit ' || unit END, CASE WHEN unit IS NOT NULL THEN ' basis Diluted  EPS' END) AS description,
  ceil(len(original_statement) / 4)::INT AS tokens FROM f
"""


def f6_03_fact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "claims").withColumn("g", text.fact_group_id(F.col("collection_id"), F.col("entity_id"), predicates.normalize_predicate("predicate"), F.coalesce("period_label", F.lit(""))))
    return c.where("g is not null").groupBy("g").agg(F.count("*").alias("claims"), F.min("id").alias("first_id"))


F6_03 = f"""
{with_tables("claims")}
SELECT {duck_uuid5(f"collection_id || {SEP} || entity_id || {SEP} || {_normal('predicate')} || {SEP} || coalesce(period_label, '')")} AS g, count(*) AS claims, min(id) AS first_id FROM claims WHERE entity_id IS NOT NULL GROUP BY ALL
"""


def f6_08_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "claims").groupBy("orderkey").agg(F.array_sort(F.collect_list(F.struct("line", (F.col("partkey") % 5).alias("w")))).alias("x"))
    shares = text.apportion(F.col("orderkey") % 997, F.transform("x", lambda e: e["w"]))
    return w.select("orderkey", F.posexplode(shares).alias("place", "share"))


F6_08 = f"""
{with_tables("claims")}, w AS (SELECT orderkey, orderkey % 997 AS total, partkey % 5 AS w, row_number() OVER (PARTITION BY orderkey ORDER BY line) - 1 AS place, sum(partkey % 5) OVER (PARTITION BY orderkey) AS s, count(*) OVER (PARTITION BY orderkey) AS n FROM claims),
f AS (SELECT *, CASE WHEN s > 0 THEN floor(total * w / s) ELSE floor(total / n) END::BIGINT AS share FROM w)
SELECT orderkey, place::INT AS place, (CASE WHEN place = n - 1 THEN share + total - sum(share) OVER (PARTITION BY orderkey) ELSE share END)::BIGINT AS share FROM f
"""


def f7_01_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checks.run_checks(claim_pairs(spark, sf_dir), ())
    return c.select(
        "claim_a_id", "claim_b_id", "entity_match", F.col("predicate.relation").alias("relation"), F.size("differences").cast("long").alias("n_differences"), "context_confirmed", F.col("value.agreement").alias("agreement"),
        "same_document", "both_accepted", F.size("shared_blocks").cast("long").alias("n_shared"), "worth_comparing", checks.deterministic_label().alias("label"), checks.promise().alias("promise"),
    )


F7_01 = f"""
{with_tables("claims")}, {PERIOD}, {CONTEXT}, {EXACT}, {RELATION}, v AS (
SELECT a.id AS claim_a_id, b.id AS claim_b_id, a.value IS NOT NULL AND b.value IS NOT NULL AS has,
  CASE WHEN a.value IS NULL OR b.value IS NULL THEN NULL WHEN a.nunit <> b.nunit THEN 'incomparable' WHEN a.value - a.half_width <= b.value + b.half_width AND b.value - b.half_width <= a.value + a.half_width THEN 'agree' ELSE 'disagree' END AS agreement,
  a.value <> 0 AND b.value <> 0 AND round(log10(abs(a.value::DOUBLE / b.value))) <> 0 AND abs(log10(abs(a.value::DOUBLE / b.value)) - round(log10(abs(a.value::DOUBLE / b.value)))) < 1e-12 AS ratio FROM normal a JOIN normal b ON a.orderkey = b.orderkey AND a.line < b.line),
g AS (SELECT d.claim_a_id, d.claim_b_id, CASE WHEN a.entity_id IS NULL OR b.entity_id IS NULL THEN 'unresolved' WHEN a.entity_id = b.entity_id THEN 'same' ELSE 'different' END AS entity_match, rel.relation,
  (d_period::INT + coalesce(d_type, false)::INT + coalesce(d_scope, false)::INT + coalesce(d_status, false)::INT + coalesce(d_unit, false)::INT + coalesce(d_currency, false)::INT + d_qual::INT)::BIGINT AS n_differences,
  a.period_label IS NOT NULL AND b.period_label IS NOT NULL AS stated, v.agreement, v.has, coalesce(v.ratio, false) AS ratio, a.doc = b.doc AS same_document, a.status = 'accepted' AND b.status = 'accepted' AS both_accepted, (a.blk = b.blk)::BIGINT AS n_shared,
  a.doc <> b.doc AND a.suppkey % 7 = 0 AND b.suppkey % 7 = 0 AS generic FROM d JOIN k a ON a.id = d.claim_a_id JOIN k b ON b.id = d.claim_b_id JOIN rel USING (claim_a_id, claim_b_id) JOIN v USING (claim_a_id, claim_b_id)),
h AS (SELECT *, n_differences = 0 AND stated AS context_confirmed, entity_match <> 'different' AND relation NOT IN ('unrelated', 'explicitly_distinct') AND NOT generic AS worth_comparing FROM g)
SELECT claim_a_id, claim_b_id, entity_match, relation, n_differences, context_confirmed, agreement, same_document, both_accepted, n_shared, worth_comparing,
  CASE WHEN entity_match = 'different' OR relation IN ('unrelated', 'explicitly_distinct') THEN 'unrelated' WHEN entity_match = 'same' AND relation = 'same' AND context_confirmed AND agreement = 'agree' AND both_accepted AND NOT same_document AND n_shared = 0 THEN 'corroborates' ELSE 'insufficient_context' END AS label,
  CASE WHEN NOT worth_comparing THEN -1 ELSE (NOT same_document)::INT * 8 + (entity_match = 'same')::INT * 6 + (relation = 'same')::INT * 5 + (relation = 'modifier_variant')::INT * 2 + both_accepted::INT * 4 + has::INT * 3 + coalesce(agreement IN ('agree', 'disagree'), false)::INT * 3 - (n_shared > 0)::INT * 5 + ratio::INT * 2 END AS promise FROM h
"""
F7_01 = F7_01.replace("v AS (\nSELECT a.id", "v AS (SELECT a.id")


def f7_08_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors")
    n = v.select("collection_id", (F.col("vec_id") - 3).alias("vec_id"), F.col("id").alias("other"), F.col("embedding").alias("e2"))
    return v.join(n, ["collection_id", "vec_id"]).select("id", "other", F.round(text.cosine_distance(F.col("embedding"), F.col("e2")), 6).alias("distance"))


F7_08 = f"""
WITH v AS ({duck("vectors")})
SELECT a.id, b.id AS other, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM v a JOIN v b ON a.collection_id = b.collection_id AND b.vec_id = a.vec_id + 3
"""

QUERIES = {f.__name__: f for f in (
    f1_04_parse_numeric, f1_08_normalize_value, f1_09_compare_values, f1_11_digits_and_base, f2_01_conventions_and_scopes, f2_02_parse_period, f2_03_resolve_period, f2_06_compare_context,
    f3_01_predicates, f3_05_predicate_relation, f4_01_entity_labels, f6_01_fingerprint, f6_03_fact_groups, f6_08_apportion, f7_01_checks, f7_08_cosine,
)}
ORACLES = {
    "f1_04_parse_numeric": F1_04, "f1_08_normalize_value": F1_08, "f1_09_compare_values": F1_09, "f1_11_digits_and_base": F1_11, "f2_01_conventions_and_scopes": F2_01, "f2_02_parse_period": F2_02, "f2_03_resolve_period": F2_03,
    "f2_06_compare_context": F2_06, "f3_01_predicates": F3_01, "f3_05_predicate_relation": F3_05, "f4_01_entity_labels": F4_01, "f6_01_fingerprint": F6_01, "f6_03_fact_groups": F6_03, "f6_08_apportion": F6_08,
    "f7_01_checks": F7_01, "f7_08_cosine": F7_08,
}
