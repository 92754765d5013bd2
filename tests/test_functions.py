"""Golden examples of the scalar functions."""

from __future__ import annotations

import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions import entities, numbers, periods, predicates, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "value", "kind", "scale", "currency", "unit"),
    [
        ("8,14,15", "81415", "point", None, None, None), ("(1,229)", "-1229", "point", None, None, None), ("₹8,142 Cr", "8142", "point", "cr", "INR", None), ("about 12.5%", "12.5", "approximate", None, None, "percent"),
        ("10 to 20 crore", "15", "range", "crore", None, None), ("10-20 crore", "-5", "range", "crore", None, None), ("70 bps", "70", "point", None, None, "basis_point"), ("US$ 4.50 mn", "4.5", "point", "mn", "USD", None),
    ],
)
def test_parse_numeric(spark, raw, value, kind, scale, currency, unit):
    n = one(spark, numbers.parse_numeric("raw"), raw=raw)
    assert (n["value"], n["kind"], n["scale"], n["currency"], n["unit"]) == (Decimal(value), kind, scale, currency, unit)


@pytest.mark.parametrize("raw", ["", "   ", "none stated", None])
def test_parse_numeric_without_number(spark, raw):
    assert one(spark, numbers.parse_numeric("raw"), raw=raw) is None


def figure(spark, value, scale=None, unit=None, currency=None):
    return one(spark, numbers.normalize_value("v", "s", "u", "c"), v=value, s=scale, u=unit, c=currency)


def test_normalize_value(spark):
    x = figure(spark, "8142", "crore", None, "INR")
    assert (x["value"], x["unit"], x["half_width"]) == (Decimal("81420000000"), "INR", Decimal("5000000"))
    assert figure(spark, "70", None, "bps")["value"] == Decimal("0.7")
    assert figure(spark, "5", "myriad", None, "INR")["unit"] == "INR/myriad"
    assert figure(spark, "many") is None


def test_compare_values(spark):
    def compare(a, b):
        row = spark.range(1).select(*[numbers.normalize_value(*[F.lit(v).cast("string") for v in x]).alias(n) for n, x in (("a", a), ("b", b))])
        return row.select(numbers.compare_values(F.col("a"), F.col("b")).alias("v"), numbers.scale_ratio(F.col("a"), F.col("b")).alias("r")).first()

    assert compare(("8142", "crore", None, "INR"), ("81415", "million", None, "INR"))["v"]["agreement"] == "agree"
    apart = compare(("-1229", "crore", None, "INR"), ("-12290.79", "million", None, "INR"))
    assert apart["v"]["agreement"] == "agree"
    assert compare(("-1229", "million", None, "INR"), ("-1003.79", "million", None, "INR"))["v"]["difference"] == Decimal("225210000")
    assert compare(("8142", "crore", None, "INR"), ("8142", "million", None, "INR"))["r"] == Decimal(10)
    assert compare(("1", None, None, "INR"), ("1", None, None, "USD"))["v"]["agreement"] == "incomparable"


@pytest.mark.parametrize(
    ("label", "kind", "year", "quarter", "half"),
    [("FY2024", "fiscal_year", 2024, None, None), ("FY 24", "fiscal_year", 2024, None, None), ("2023-24", "fiscal_year", 2024, None, None), ("Q3 FY24", "quarter", 2024, 3, None), ("H1 FY25", "half_year", 2025, None, 1), ("2021", "calendar_year", 2021, None, None), ("March 31, 2024", "as_of_date", 2024, None, None)],
)
def test_parse_period(spark, label, kind, year, quarter, half):
    p = one(spark, periods.parse_period_label("label"), label=label)
    assert (p["kind"], p["year"], p["quarter"], p["half"]) == (kind, year, quarter, half)


def test_resolve_period(spark):
    r = lambda label, c: one(spark, periods.resolve_period("l", "t", "c"), l=label, t=None, c=c)
    assert (str(r("FY24", "april-march")["start"]), str(r("FY24", "april-march")["end"])) == ("2023-04-01", "2024-03-31")
    assert (str(r("Q4 FY24", "april-march")["start"]), str(r("Q4 FY24", "april-march")["end"])) == ("2024-01-01", "2024-03-31")
    assert r("FY24", None)["start"] is None
    assert str(r("March 31, 2024", None)["end"]) == "2024-03-31"
    assert r(None, "april-march")["period_type"] == "unknown"


def test_predicates(spark):
    n = lambda p: one(spark, predicates.normalize_predicate("p"), p=p)
    assert n("The Revenues from Operations") == "revenue_from_operation"
    assert n("boxes of companies") == "box_company"
    rel = lambda a, b: one(spark, predicates.predicate_relation("a", "b"), a=a, b=b)["relation"]
    assert rel("adjusted_ebitda", "ebitda") == "modifier_variant"
    assert rel("revenue", "total_income") == "explicitly_distinct"
    assert rel("revenue_from_services", "revenue_per_box") == "related_form"
    assert rel("headcount", "ebitda") == "unrelated"


def test_entities(spark):
    n = lambda s: one(spark, entities.normalize_entity_label("s"), s=s)
    assert n("Delhi Express Pvt. Ltd.") == "delhi express"
    assert n("Limited") == "limited"
    assert one(spark, entities.is_generic_subject("s"), s="The  Company.") is True


def test_quotes(spark):
    span = one(spark, text.locate_quote("q", "c"), q="net profit", c="a “net­  profit” \U0001f600")
    assert (span["start"], span["end"]) == (3, 15)
    assert one(spark, text.contains_quote("q", "c"), q='"x-y"', c="say “x–y”") is True
    assert one(spark, text.states_value("n", "r", "q"), n="8142", r=None, q="₹8,142 crore") is True
    assert one(spark, text.extract_json("t"), t="ok ```json\n{\"a\": 1}\n```") == '{"a": 1}'
    assert one(spark, text.quote_locates("q", "c"), q="A—b", c="xx a-B yy") is True


def test_uuid5(spark):
    assert one(spark, text.uuid5(F.col("n")), n="some name") == str(uuid.uuid5(text.NAMESPACE, "some name"))


def test_apportion(spark):
    share = lambda total, w: one(spark, text.apportion(F.lit(total), F.array(*[F.lit(x) for x in w])))
    assert (share(100, [1, 1, 2]), share(10, [1, 1, 1]), share(9, [0, 0, 0])) == ([25, 25, 50], [3, 3, 4], [3, 3, 3])


def test_figures_of_any_length(spark):
    from decimal import getcontext

    from factloom.functions import figures

    getcontext().prec = 200
    texts = ["0", "-0.0", "1", "-1", "0.000000000000001", "-0.000000000000002", "999999999", "1000000000", "-999999999.999999999", "123456789012345678901234567890.5", "5e-7"[:1], "12345678901234567890123456789012345678901234567890", "0.5", ".25", "7."]
    pairs = [(a, b, k) for a in texts for b in texts for k in (0, 3)]
    d = spark.createDataFrame(pairs, "a string, b string, k int")
    a, b = figures.shifted(figures.figure(F.col("a")), F.col("k")), figures.figure(F.col("b"))
    rows = d.withColumn("r", figures.compare(a, b)).withColumn("t", figures.as_text(a)).collect()
    for r in rows:
        x, y = Decimal(r["a"]) * 10 ** r["k"], Decimal(r["b"])
        half = lambda t, k: Decimal(5).scaleb(-len(t.partition(".")[2]) + k - 1)
        assert Decimal(r["t"]) == x and Decimal(r["r"]["apart"]) == abs(x - y), r
        assert r["r"]["meets"] == (abs(x - y) <= half(r["a"], r["k"]) + half(r["b"], 0)), r
    assert [r["f"] for r in spark.createDataFrame([("1,5",), ("x",), ("",), ("1e5",)], "v string").select(figures.figure(F.col("v")).alias("f")).collect()] == [None] * 4


def test_small_basis_points_keep_their_rounding(spark):
    x = figure(spark, "0.123456789", None, "bps")
    assert (x["half_width"], x["precision"], x["exact"]["digits"], x["exact"]["places"]) == (None, 11, "0123456789", 11)
    assert figure(spark, "0.1234567", None, "bps")["half_width"] == Decimal("0.0000000005")
    assert figure(spark, "1" * 40, "crore", None, "INR")["value"] is None and figure(spark, "1" * 40, "crore")["exact"]["precision"] == -7

    def compare(a, b, unit):
        row = spark.range(1).select(*[numbers.normalize_value(*[F.lit(v).cast("string") for v in (x, None, unit, None)]).alias(n) for n, x in (("a", a), ("b", b))])
        return row.select(numbers.compare_values(F.col("a"), F.col("b")).alias("v")).first()["v"]

    assert compare("0.123456789", "0.123456790", "bps")["agreement"] == "agree"
    assert compare("0.123456789", "0.123456791", "bps")["reason"] == "0.00000000002 percent apart, beyond rounding"
    assert compare("0.12", "0.123456789", "bps")["agreement"] == "agree"


def test_replies_are_judged_strictly(spark):
    import json

    from factloom.functions import contract

    good = {"subject": "s", "predicate": "p_q", "original_statement": "o", "numeric_value": None, "raw_value": None, "currency": None, "scale": None, "unit": None, "period_label": None, "period_type": None, "scope": None, "assertion_status": None, "qualifiers": [], "evidence_block_ids": ["B1"], "quote": "q"}
    changed = lambda **more: json.dumps({"claims": [{**good, **more}]})
    without = lambda name: json.dumps({"claims": [{k: v for k, v in good.items() if k != name}]})
    cases = {
        changed(): None, changed(extra=[1]): None, f"Here: ```json\n{changed()}\n```": None, changed(subject=5): "claims.0.subject: a text is needed", changed(numeric_value=12.5): "claims.0.numeric_value: a text or null is needed",
        without("raw_value"): "claims.0.raw_value: a text or null is needed", json.dumps({"claims": [good, 7]}): "claims.1: a claim is needed", changed(subject=None): "claims.0.subject: a text is needed", changed(qualifiers=None): "claims.0.qualifiers: 12 at most, each with name and value",
        changed(qualifiers=[{"name": "a", "value": 1}]): "claims.0.qualifiers: 12 at most, each with name and value", changed(evidence_block_ids=["B1", 2]): "claims.0.evidence_block_ids: 1 to 8 handles", changed(evidence_block_ids=[]): "claims.0.evidence_block_ids: 1 to 8 handles",
        json.dumps({"claims": [good] * 61}): "claims: 60 at most", "{}": "claims: missing", '{"claims": null}': "claims: a list is needed", "nothing": "claims: missing", changed(quote="\U0001F600" * 601): "claims.0.quote: 1 to 1200 characters", changed(period_type="decade"): "claims.0.period_type: not one of the known ones",
    }
    d = spark.createDataFrame(list(enumerate(cases)), "reply_id int, reply string")
    assert {r["reply_id"]: r["feedback"] for r in contract.read_replies(d).collect()} == dict(enumerate(cases.values()))


def test_verdicts_are_judged_strictly(spark):
    import json

    from factloom.functions import contract

    good = {"label": "unrelated", "rationale": "r", "evidence_ids": ["E2", "E9", "E1", "E2"], "differing_context": ["scope"], "uncertainty_reasons": []}
    cases = [good, {**good, "label": "equal"}, {**good, "rationale": ""}, {**good, "evidence_ids": [1]}, {k: v for k, v in good.items() if k != "differing_context"}, {**good, "uncertainty_reasons": ["x"] * 9}]
    d = spark.createDataFrame([(i, json.dumps(c), [("E1", "a"), ("E2", "b")]) for i, c in enumerate(cases)], "reply_id int, reply string, handles array<struct<handle:string,evidence_id:string>>")
    got = {r["reply_id"]: r for r in contract.read_verdicts(d).collect()}
    assert tuple(got[0])[1:] == ("unrelated", "r", ["b", "a"], ["scope"], [], None)
    assert [got[i]["problem"].split(":")[0] for i in range(1, 6)] == ["label", "rationale", "evidence_ids", "differing_context", "uncertainty_reasons"] and got[1]["label"] is None


def plain_place(quote, content):
    """The search spelled out: normal forms, and for each kept character its place in UTF-16 units."""
    def normal(t):
        out, at, pending = [], 0, False
        for ch in t:
            if ch.isspace() and ch not in "\x1c\x1d\x1e\x1f\x85" or ch == "\ufeff":
                pending = bool(out)
            elif ch not in text.INVISIBLE:
                if pending:
                    out.append((" ", at, at))
                    pending = False
                out.append((dict(zip(text.SAME_FROM, text.SAME_TO)).get(ch, ch), at, at + (2 if ord(ch) > 0xFFFF else 1)))
            at += 2 if ord(ch) > 0xFFFF else 1
        return out

    q, c = normal(quote), normal(content)
    k = "".join(x for x, *_ in c).find("".join(x for x, *_ in q)) if q else -1
    return None if k < 0 else (c[k][1], c[k + len(q) - 1][2])


def test_places_of_quotes(spark):
    import random

    rng = random.Random(3)
    letters = "aab-–'’\"“ \u00a0\u00ad\u200b\n.\\\\E$\U0001f600[]("
    rows = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 4))), "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for _ in range(1500)]
    rows += [("a b", " " * 50_000 + "a" + " \u00ad" * 20_000 + "b"), ("x" * 1200, "y" * 5000 + "x" * 1300), ("\\Q", "a\\Qb"), (None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "q string, c string").select("q", "c", text.locate_quote("q", "c").alias("p")).collect()
    found = 0
    for r in got:
        want = plain_place(r["q"], r["c"]) if r["q"] is not None and r["c"] is not None else None
        assert (tuple(r["p"]) if r["p"] else None) == want, (r["q"], r["c"][:60] if r["c"] else None)
        found += want is not None
    assert found > 200


def test_comparison_keeps_exact_powers_and_twelve_places(spark):
    figure = lambda v: numbers.normalize_value(F.lit(v), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("INR"))
    assert [one(spark, numbers.scale_ratio(figure("3"), figure("3" + "0" * k))) for k in range(1, 12)] == [float(f"1e-{k}") for k in range(1, 12)]
    assert one(spark, numbers.compare_values(figure("0.01"), figure("32")))["relative"] == Decimal("0.999687500000")


def test_closed_intervals_that_just_touch_agree_in_the_sql_as_in_the_query(spark):
    import duckdb

    from factloom.plans.queries_values import EXACT

    rows = [("a", "5", "bps"), ("b", "6", "bps"), ("c", "50.01", None), ("d", "50.02", None)]
    c = duckdb.connect()
    c.execute("create table claims(id varchar, numeric_value varchar, unit varchar, scale varchar, currency varchar)")
    c.executemany("insert into claims values (?, ?, ?, null, null)", rows)
    meets = lambda x, y: c.sql(f"with {EXACT} select a.value - a.half_width <= b.value + b.half_width and b.value - b.half_width <= a.value + a.half_width from normal a, normal b where a.id = '{x}' and b.id = '{y}'").fetchall()[0][0]
    figure = lambda r: numbers.normalize_value(F.lit(r[1]), F.lit(None).cast("string"), F.lit(r[2]).cast("string"), F.lit(None).cast("string"))
    for x, y in ((0, 1), (2, 3)):
        assert one(spark, numbers.compare_values(figure(rows[x]), figure(rows[y])))["agreement"] == "agree" and meets(rows[x][0], rows[y][0])


def test_sizes_at_half_a_place_are_rounded_up_in_the_sql_as_in_the_query(spark):
    import duckdb

    from factloom.plans import queries_stages

    sql = queries_stages.F6_10[queries_stages.F6_10.rindex("CASE WHEN partkey * orderkey * 4 < 1024"):queries_stages.F6_10.rindex(" AS size")]
    n = (1 << 20) + (1 << 18)  # 1.25 MB
    assert duckdb.sql(f"select {sql} from (select {n // 4}::BIGINT as partkey, 1::BIGINT as orderkey)").fetchall()[0][0] == one(spark, text.format_bytes(F.lit(n))) == "1.3 MB"


def test_word_tables_are_dealt_to_tasks(spark):
    from factloom.plans import queries_stages

    assert queries_stages._word_rows(spark, "/root/testdata/sf0.001", numbers.SCALES).rdd.getNumPartitions() >= 4


def test_pairs_are_checked_from_readings_of_each_claim(spark):
    from factloom.operators import checks
    from factloom.plans.queries_values import claim_pairs

    pairs = claim_pairs(spark, "/root/testdata/sf0.001").where("a.orderkey % 40 = 0")
    assert set(checks.READINGS) <= set(pairs.schema["a"].dataType.names)
    bare = pairs.withColumn("a", F.col("a").dropFields(*checks.READINGS)).withColumn("b", F.col("b").dropFields(*checks.READINGS))
    shown = lambda p: sorted(checks.run_checks(p).select("claim_a_id", "claim_b_id", "predicate", "differences", "value_a", "value_b", "value", "ratio", "context_confirmed", "notes").collect(), key=repr)
    got = shown(pairs)
    assert got and got == shown(bare)


def test_figures_at_the_width_of_decimals(spark):
    """Figures that decimals hold when aligned and those that they do not compare alike (F18); the plain way goes by decimals only up to there."""
    from decimal import Decimal, getcontext

    from factloom.functions import figures

    getcontext().prec = 120
    texts = ["0", "-0.0", "1", "-1.5", "9" * 32, "-" + "9" * 33, "9" * 34, "9" * 20 + "." + "9" * 12, "-" + "9" * 20 + "." + "9" * 13, "9" * 36, "-" + "9" * 37, "9" * 38, "1" + "0" * 37, "0." + "0" * 35 + "1", "0." + "0" * 36 + "1", "-0." + "0" * 37 + "1", "9" * 20 + "." + "9" * 17, "-" + "9" * 20 + "." + "9" * 16, "9" * 45 + ".5", ".5", "12."]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    both = figures.compare(figures.figure(F.col("a")), figures.figure(F.col("b")))
    for a, b, r in rows.select("a", "b", both.alias("r")).collect():
        half = lambda t: Decimal(5).scaleb(-len(t.partition(".")[2]) - 1)
        apart = abs(Decimal(a) - Decimal(b))
        assert (r["meets"], Decimal(r["apart"])) == (apart <= half(a) + half(b), apart), (a, b)
        assert "E" not in r["apart"]
    plan = rows.select(both.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(38,0)" in plan


def test_replies_are_judged_claim_by_claim_in_batches(spark):
    """Members are judged in Python, on the JSON that Spark finds valid: odd texts give what reading them as VARIANT gave."""
    from factloom.functions import contract

    d = spark.createDataFrame([(0, '{"claims":[]} {"claims":7}'), (1, '{"claims":[],"claims":[1]}'), (2, '{"claims":[],"x":' + "9" * 900 + "}"), (3, '{"claims":[],"x":' + "[" * 900 + "]" * 900 + "}"), (4, '{"claims":[],"x":NaN}'), (5, '{"cl\\u0061ims":[null]}'), (6, None), (7, '[{"claims":[]}]')], "reply_id int, reply string")
    read = contract.read_replies(d)
    assert {r["reply_id"]: r["feedback"] for r in read.collect()} == {0: None, 1: "claims: missing", 2: None, 3: None, 4: "claims: missing", 5: "claims.0: a claim is needed", 6: "claims: missing", 7: "claims: missing"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "schema_of_variant" not in plan
    forms = {"a_b": True, "a_b\n": True, "a_b\r\n": True, "a_b\u2028": True, "a_b\n\n": False, "a_b ": False, "A": False}  # as Java reads `$`
    assert {x: not any(v.startswith(".predicate: words") for v in contract.claim_violations({"predicate": x})) for x in forms} == forms
