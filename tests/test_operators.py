"""Operators on small frames."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from factloom.operators import candidates, chunks, layout, resolution, seams, sinks, spending, state
from factloom.plans import evaluation, reads
from factloom.plans.fixture import table
from factloom.plans.queries_reads import gold_tables
from factloom.sources import exports, gold, uploads
from factloom.streaming import jobs


SF = "/root/testdata/sf0.001"


def test_axis_binding(spark):
    labels = spark.createDataFrame([("d", 0, f"FY{20 + i}", 100.0 + 20 * i) for i in range(5)], "document_id string, physical_page int, label string, x double")
    values = spark.createDataFrame([("d", 0, i, x) for i, x in enumerate((101.0, 159.0, 110.0, 300.0))], "document_id string, physical_page int, value_id int, x double")
    got = {r["value_id"]: r["label"] for r in layout.bind_to_axis(values, labels).collect()}
    assert got == {0: "FY20", 1: "FY23", 2: None, 3: None}


def test_gutter_and_lines(spark):
    rows = [("d", 0, "hello", 0.0, 100.0, 50.0, 10.0, 0, 300.0, 400.0), ("d", 0, "world", 200.0, 100.0, 50.0, 10.0, 1, 300.0, 400.0)]
    runs = spark.createDataFrame(rows, "document_id string, physical_page int, text string, x double, y double, width double, height double, reading_index int, width_pt double, height_pt double")
    g = layout.gutters(runs, F.lit(50)).collect()
    assert [(r["x0"], r["x1"]) for r in g] == [(51, 199)]
    assert {r["text"] for r in layout.lines(runs).collect()} == {"hello", "world"}
    assert layout.lines(runs.withColumn("region", F.lit(0))).first()["text"] == "hello world"


def test_batches(spark):
    c = spark.createDataFrame([("d", i, t) for i, t in enumerate((100, 100, 100, 100, 100, 5000, 100))], "document_id string, chunk_index int, estimated_tokens int")
    got = [(r["batch_index"], r["place"]) for r in chunks.plan_batches(c).orderBy("chunk_index").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0)]


def test_semantic_candidates_over_blocks(spark):
    import random

    random.seed(3)
    rows = [(f"c{i}", "k", f"d{i % 7}", "m", [random.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    v = spark.createDataFrame(rows, "id string, collection_id string, document_id string, model string, embedding array<double>")
    one = candidates.semantic_candidates(v.where("id like 'c1_'"), v, k=5).select("left_id", "right_id").collect()
    many = candidates.semantic_candidates(v.where("id like 'c1_'"), v, k=5, block_rows=16).select("left_id", "right_id").collect()
    assert set(one) == set(many) and len(one) == 50


def test_insert_if_absent_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([("x", None)], "k string, p int")
    b = spark.createDataFrame([("x", None), ("y", None), ("y", None)], "k string, p int")
    assert [tuple(r) for r in sinks.insert_if_absent(a, b, ["k", "p"], ["k"]).collect()] == [("y", None)]


def test_retry_delay(spark):
    got = spark.range(1, 9).select(state.retry_delay(F.col("id")).alias("s")).collect()
    assert [r["s"] for r in got] == [5, 10, 20, 40, 80, 160, 300, 300]


def test_seams(spark):
    c = spark.createDataFrame([("a", "revenue growth"), ("b", "revenue growth"), ("c", "")], "claim_id string, description string")
    rows = {r["claim_id"]: r["embedding"] for r in seams.embed_claims(c, seams.HashEmbedder(16)).collect()}
    assert rows["a"] == rows["b"] and len(rows["c"]) == 16
    p = spark.createDataFrame([("a", "b", "?", 3)], "claim_a_id string, claim_b_id string, prompt string, promise int")
    assert spending.spend(p, seams.AbstainingClassifier(), 100).first()["label"] == "insufficient_context"


def test_gold_source(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text('{"documents": [{"id": "d", "pages": 2}], "claims": [{"id": "a", "document": "d", "physical_page": 5}], "pairs": [{"id": "p", "claim_a": "a", "claim_b": "z"}]}')
    problems = {r["problem"] for r in gold.gold_problems(*gold.read_gold(spark, str(path))).collect()}
    assert problems == {"page past the end", "unknown claim"}


def test_uploads_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "in" / "c.txt").write_bytes(b"text")
    prepare = lambda files: uploads.with_page_counts(files, lambda raw: 3)
    args = [str(tmp_path / x) for x in ("in", "documents", "outcomes", "checkpoint")]
    jobs.watch_uploads(spark, *args, "col1", prepare).awaitTermination()
    (tmp_path / "in" / "d.pdf").write_bytes(b"%PDF-1.4 one")
    jobs.watch_uploads(spark, *args, "col1", prepare).awaitTermination()
    out = {r["path"].rsplit("/", 1)[1]: r["outcome"] for r in spark.read.parquet(args[2]).collect()}
    assert out == {"a.pdf": "accepted", "b.pdf": "duplicate", "c.txt": "rejected", "d.pdf": "duplicate"}
    assert spark.read.parquet(args[1]).count() == 1


def test_claims_stream(spark, tmp_path):
    schema = "id string, collection_id string, document_id string, entity_id string, subject string, predicate string, status string"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    args = (str(tmp_path / "in"), schema, str(tmp_path / "stored"), str(tmp_path / "pairs"), str(tmp_path / "checkpoint"))
    put([("a", "k", "d1", "e", "X Ltd", "revenue", "accepted")])
    jobs.watch_claims(spark, *args).awaitTermination()
    put([("b", "k", "d2", "e", "X", "net revenue", "accepted"), ("c", "k", "d3", None, "Y", "revenue", "accepted")])
    jobs.watch_claims(spark, *args).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(args[3]).select("claim_a_id", "claim_b_id").collect()] == [("a", "b")]


def test_bucketed_tables_rewrite_only_what_is_touched(spark, tmp_path):
    from pathlib import Path

    path, schema = str(tmp_path / "t"), "k string, n int"
    latest = lambda old, new: old.unionByName(new).groupBy("k", "bucket").agg(F.max("n").alias("n"))
    sinks.upsert(spark, path, spark.createDataFrame([], schema), ["k"], latest, 8)
    sinks.upsert(spark, path, spark.createDataFrame([(f"k{i}", i) for i in range(40)], schema), ["k"], latest, 8)
    before = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    for _ in range(2):  # the second is a replay
        sinks.upsert(spark, path, spark.createDataFrame([("k1", 100), ("k1", 7)], schema), ["k"], latest, 8)
    after = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    assert {r["k"]: r["n"] for r in spark.read.parquet(path).collect()} == {f"k{i}": 100 if i == 1 else i for i in range(40)}
    assert len({f.parent for f in before if f not in after}) == 1 and sum(f in after for f in before) == len(before) - sum(f not in after for f in before)
    sinks.append_new(spark, path, spark.createDataFrame([("k1", 3), ("new", 1), ("new", 2)], schema), ["k"], ["n"], ["k"], 8)
    assert {r["k"]: r["n"] for r in spark.read.parquet(path).where("k in ('k1', 'new')").collect()} == {"k1": 100, "new": 1}
    pruned = sinks.touched(spark, path, spark.createDataFrame([("k1", 1)], schema).withColumn("bucket", sinks.bucket_of("k", buckets=8)))
    assert len({r["bucket"] for r in pruned.collect()}) == 1 and "PartitionFilters: [isnotnull(bucket" in pruned._jdf.queryExecution().toString()


def test_objects_are_written_whole_or_not_at_all(spark, tmp_path):
    import pytest

    from factloom.sources import store

    root = str(tmp_path / "objects")
    rows = [(f"pages/{i % 5}/{i}.png", bytes([i]) * 1000) for i in range(40)]
    files = spark.createDataFrame(rows, "key string, content binary").repartition(3)
    for _ in range(2):  # the second time changes nothing
        store.write_objects(files, root)
    keys = files.select("key")
    assert {r["key"]: bytes(r["content"]) for r in store.read_objects(spark, root, keys).collect()} == dict(rows)
    bad = spark.createDataFrame([("new/a", b"a"), ("../out", b"b")], "key string, content binary").coalesce(1)
    with pytest.raises(Exception, match="no key inside the store"):
        store.write_objects(bad, root)
    left = [p for p in (tmp_path / "objects").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert not (tmp_path / "out").exists() and not list((tmp_path / "objects").glob(".aside*")) and len(left) in (40, 41)


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    assert exports.markdown_table(df, "T").startswith("## T\n\n| k | n |\n|---|---|\n")


def test_settings():
    import pytest

    from factloom.config import Settings, load_settings

    assert load_settings({"SEMANTIC_TOP_K": "7", "OTHER": "x"}).semantic_top_k == 7
    for bad in ({"SEMANTIC_TOP_K": "0"}, {"MOST_PAGES": "many"}, {"CHUNK_TARGET_TOKENS": "3000"}):
        with pytest.raises(ValueError):
            load_settings(bad)
    assert Settings().embedding_width == 768


def test_store(spark, tmp_path):
    from factloom.sources import store

    (tmp_path / "documents" / "ab").mkdir(parents=True)
    (tmp_path / "documents" / "ab" / "x.pdf").write_bytes(b"one")
    keys = spark.createDataFrame([("documents/ab/x.pdf",), ("../x",)], "key string")
    assert [bytes(r["content"]) for r in store.read_objects(spark, str(tmp_path), keys).collect()] == [b"one"]
    assert store.writable(spark, str(tmp_path)) and store.missing_tables(spark) == list(store.CORE_TABLES)


def packed(blocks, target, most):
    """Chunks of one document by the rules, joining texts anew at each step; blocks: (page, id, kind, content, label)."""
    tokens = lambda t: -(-(len(t.encode("utf-16-le")) // 2) // 4)
    out, heading, body, refs, at = [], None, [], {}, (None, None)

    def close():
        nonlocal body, refs
        if body:
            head = f"[page {at[0]}]" if at[1] is None else f"[page {at[0]} (printed {at[1]})]"
            text = "\n".join([head, *([] if heading is None else [f"[section: {heading}]"]), "", "\n\n".join(body)])
            out.append((at[0], text, list(refs), tokens(text)))
        body, refs = [], {}

    for page, block, kind, content, label in blocks:
        content = (content or "").strip()
        if not content:
            continue
        if page != at[0]:
            close()
        if kind == "heading":
            close()
            at, heading = (page, label), content
            continue
        pieces, held = [], []
        for line in content.split("\n"):
            if held and tokens("\n".join([*held, line])) > most:
                pieces.append("\n".join(held))
                held = []
            held.append(line)
        for piece in [*pieces, "\n".join(held)]:
            if body and tokens("\n\n".join([*body, piece])) > target:
                close()
            at = (page, label)
            ref = refs.setdefault(block, f"B{len(refs) + 1}")
            body.append(f"[{ref}]\n{piece}")
    close()
    return out


def test_chunks_split_oversize_blocks_on_lines(spark):
    import random

    rng = random.Random(6)
    line = lambda: "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 60)))
    rows = []
    for i in range(160):
        kind = "heading" if rng.random() < 0.15 else "paragraph"
        content = rng.choice([None, "  ", "\n".join(line() for _ in range(rng.randint(1, 14))), line() * 4])
        rows.append((i // 20, f"b{i}", kind, content, rng.choice([None, "iv"])))
    b = spark.createDataFrame([("d", p, i, *r) for i, (p, *r) in enumerate(rows)], "document_id string, physical_page int, block_index int, block_id string, block_type string, content string, printed_page_label string").repartition(5)
    for target, most in ((40, 30), (60, 15), (1200, 2000)):
        got = [(r["physical_page"], r["text"], r["source_block_ids"], r["estimated_tokens"]) for r in chunks.chunk_blocks(b, target, most).orderBy("chunk_index").collect()]
        assert got == packed(rows, target, most)


class _Pages:
    """A reader of made-up documents: a page called bad fails, a document called broken cannot be opened."""

    def read(self, content):
        if content == b"broken":
            raise ValueError("no pdf")
        for page, name in enumerate(content.decode().split(",")):
            yield page, 600.0, 800.0, self.runs(name)

    def runs(self, name):
        yield " first ", 1.0, 2.0, 3.0, 4.0
        if name == "bad":
            raise ValueError("bad page")
        yield "  ", 0.0, 0.0, 0.0, 0.0
        yield name, 10.0, 2.0, 4.0, 4.0


def test_a_failing_page_leaves_the_others(spark):
    files = spark.createDataFrame([("d1", b"one,bad,three"), ("d2", b"broken"), ("d3", b"last")], "document_id string, content binary")
    rows = seams.read_runs(files, _Pages()).collect()
    assert sorted((r["document_id"], r["physical_page"], r["reading_index"], r["text"], r["center_x"]) for r in rows if r["error"] is None) == [
        ("d1", 0, 0, "first", 2.5), ("d1", 0, 1, "one", 12.0), ("d1", 2, 0, "first", 2.5), ("d1", 2, 1, "three", 12.0), ("d3", 0, 0, "first", 2.5), ("d3", 0, 1, "last", 12.0)]
    assert sorted((r["document_id"], r["physical_page"], r["error"]) for r in rows if r["error"]) == [("d1", 1, "page_parse_failed: bad page"), ("d2", None, "page_parse_failed: no pdf")]


def test_a_replayed_batch_of_uploads_changes_nothing(spark, tmp_path):
    files = spark.createDataFrame([("a", b"%PDF-1.4 one", 12, 3, None), ("b", b"%PDF-1.4 one", 12, 3, None), ("c", b"%PDF-1.4 two", 12, 3, None)], "path string, content binary, size long, page_count int, open_error string")
    documents, outcomes = str(tmp_path / "documents"), str(tmp_path / "outcomes")
    for _ in range(3):
        jobs.settle_uploads(spark, files, 0, documents, outcomes, "col1")
    jobs.settle_uploads(spark, files.where("path = 'c'").withColumn("path", F.lit("d")), 1, documents, outcomes, "col1")
    got = {(r["path"], r["batch_id"]): r["outcome"] for r in spark.read.parquet(outcomes).collect()}
    assert got == {("a", 0): "accepted", ("b", 0): "duplicate", ("c", 0): "accepted", ("d", 1): "duplicate"}
    assert spark.read.parquet(documents).count() == 2


class _Judge:
    def judge(self, names):
        if (names["candidate"] == "fail").any():
            raise RuntimeError("away")
        return names.assign(same=names["label"].str[0] == names["candidate"].str[0], reason="by letter")[["same", "reason"]]


class _Away:
    model_name, width = "away", 3

    def embed(self, texts):
        raise ConnectionError("no network")


def test_adjudicator_and_embedder_may_fail(spark):
    asked = spark.createDataFrame([("k", "abc", "e1", "a firm"), ("k", "abc", "e2", "b firm")], "collection_id string, label string, entity_id string, normalized_label string")
    assert {(r["entity_id"], r["same"]) for r in seams.adjudicate(asked, _Judge()).collect()} == {("e1", True), ("e2", False)}
    failed = seams.adjudicate(asked.withColumn("normalized_label", F.lit("fail")), _Judge()).collect()
    assert not any(r["same"] for r in failed) and failed[0]["reason"] == "no answer: away"
    c = spark.createDataFrame([("a", "x")], "claim_id string, description string")
    assert seams.embed_or_reason(c, _Away()) == (None, "ConnectionError: no network") and seams.embed_or_reason(c, None)[0] is None
    assert seams.embed_or_reason(c, seams.HashEmbedder(4))[0].count() == 1


class _Costly:
    model_name = "costly"

    def classify(self, prompts):
        import pandas as pd

        n = len(prompts)
        return pd.DataFrame({"label": ["unrelated"] * n, "rationale": [""] * n, "prompt_tokens": [1] * n, "completion_tokens": [1] * n})


def test_spending_stops_at_the_budget_and_goes_by_promise(spark):
    p = spark.createDataFrame([(f"a{i}", f"b{i}", "?", i % 3) for i in range(90)], "claim_a_id string, claim_b_id string, prompt string, promise int")
    got = {r["claim_a_id"] for r in spending.spend(p, _Costly(), budget=61).collect()}
    # 30 pairs promise most; the one more starts at 60 tokens and overshoots.
    assert {f"a{i}" for i in range(90) if i % 3 == 2} <= got and not any(int(a[1:]) % 3 == 0 for a in got) and len(got) == 31
    assert spending.spend(p, _Costly(), budget=10**6).count() == 90 and spending.spend(p, _Costly(), budget=0).count() == 0 == spending.spend(p.limit(0), _Costly(), 9).count()


class _Lengths:
    model_name = "lengths"

    def classify(self, prompts):
        import pandas as pd

        return pd.DataFrame({"label": "unrelated", "rationale": "", "prompt_tokens": prompts.str.len(), "completion_tokens": prompts.str.len() % 7})


def test_spending_calls_what_one_call_after_the_other_would(spark):
    import random

    rng = random.Random(6)
    rows = [(f"a{i:03}", f"b{i % 9}", "x" * rng.randint(1, 90), rng.randrange(4)) for i in range(300)]
    p = spark.createDataFrame(rows, "claim_a_id string, claim_b_id string, prompt string, promise int").withColumn("estimate", F.length("prompt") * 3 + 1)
    for budget in (1, 777, 4000):
        want, spent = set(), 0
        for a, _, prompt, _ in sorted(rows, key=lambda r: (-r[3], r[0], r[1])):
            if spent >= budget:
                break
            want.add(a)
            spent += len(prompt) + len(prompt) % 7
        got = {r["claim_a_id"] for r in spending.spend(p, _Lengths(), budget, ranges=5).collect()}
        assert want <= got and len(got - want) <= 2


def test_exact_candidates_meet_along_groups(spark):
    import random

    from factloom.functions.predicates import predicate_relation

    rng = random.Random(9)
    subjects, said = ("Acme Ltd", "acme", "The Company.", "Beta Inc", None), ("Revenue", "net revenue", "Total Income", "revenue from operations", "profit after tax", "profit before tax", "employees", "")
    rows = [(f"c{i:04}", f"k{i % 2}", f"d{rng.randrange(30)}", rng.choice(("e1", "e2", None)), rng.choice(subjects), rng.choice(said)) for i in range(160)]
    rows += [(f"h{i:04}", "k0", f"d{i % 40}", None, "We", "ebitda") for i in range(1300)]  # one group that must be cut
    c = spark.createDataFrame(rows, "id string, collection_id string, document_id string, entity_id string, subject string, predicate string")
    name = {s: {"Acme Ltd": "acme", "acme": "acme", "The Company.": "the", "Beta Inc": "beta"}.get(s) for s in subjects}
    related = {(r["a"], r["b"]) for r in spark.createDataFrame([(a, b) for a in said for b in said], "a string, b string").where(~predicate_relation("a", "b")["relation"].isin("unrelated", "explicitly_distinct")).collect()}
    one = lambda x, y: x[3] == y[3] if x[3] and y[3] else name[x[4]] is not None and name[x[4]] == name[y[4]]
    some = rows[:160]
    want = {(x[0], y[0]) for x in some for y in some if x[0] < y[0] and x[1] == y[1] and x[2] != y[2] and one(x, y) and (x[5], y[5]) in related}
    hot = sum(1 for i in range(1300) for j in range(i) if i % 40 != j % 40)
    got = [(r["claim_a_id"], r["claim_b_id"]) for r in candidates.exact_candidates(c, c).collect()]
    assert len(got) == len(set(got)) == len(want) + hot and {p for p in got if p[0][0] == "c"} == want
    new = c.where("id between 'c0100' and 'c0159'")
    found = [(r["claim_a_id"], r["claim_b_id"]) for r in candidates.exact_candidates(new, c.where("id < 'd'")).collect()]
    assert len(found) == len(set(found)) and set(found) == {p for p in want if max(p) >= "c0100"}
    assert {(r["who"], r["p"], r["n"]) for r in candidates.claim_groups(c).where("p = 'ebitda'").collect()} == {("n:we", "ebitda", 1300)}


def test_without_a_judge_names_stay_apart(spark):
    from factloom.operators import resolution

    resolved = spark.createDataFrame([("k", "acme north", "n1", "created"), ("k", "other", "n2", "created"), ("k", "acme", "e1", "exact")], "collection_id string, label string, entity_id string, method string")
    c = spark.createDataFrame([("k", "acme north", "e1", "acme"), ("k", "acme north", "e2", "north")], "collection_id string, label string, entity_id string, normalized_label string")
    got = {r["label"]: (r["entity_id"], r["method"], r["reason"], r["rejected"]) for r in resolution.adjudicated_entities(resolved, c, None).collect()}
    assert got == {"acme north": ("n1", "created", "names alike, none confirmed", ["acme: no judge was there", "north: no judge was there"]), "other": ("n2", "created", "a new name", []), "acme": ("e1", "exact", "the name is known", [])}


def test_an_empty_region_is_empty(spark):
    runs = spark.createDataFrame([("d", 0, 0, 0, "x", 1.0)], "document_id string, physical_page int, region int, block int, text string, x double")
    every = spark.createDataFrame([("d", 0, 0), ("d", 0, 1)], "document_id string, physical_page int, region int")
    assert {r["region"]: r["kind"] for r in layout.classify_regions(runs, runs, every).collect()} == {0: "sparse", 1: "empty"}


def test_versions_are_those_that_were_frozen():
    from factloom import config
    from factloom.plans import evaluation

    assert evaluation.freeze_differences(config.VERSIONS, config.frozen_versions()) == []
    assert evaluation.freeze_differences({"a": "1", "b": "1"}, {"a": "2", "c": "1"}) == [("a", "1", "2"), ("b", "1", None), ("c", None, "1")]


def test_report_is_whole_or_refused(spark, monkeypatch):
    import pytest

    df = spark.range(5)
    assert exports.markdown_report("R", {"one": df, "two": df}).count("\n| ") == 12
    monkeypatch.setattr(exports, "MOST_ROWS", 4)
    with pytest.raises(ValueError):
        exports.markdown_table(df, "T")


def test_entity_candidates_of_hot_words_come_once(spark):
    rng = random.Random(11)
    names = ["bank", "trust", "north", "south", "of", "co", "first", "holding"]
    name = lambda: " ".join(["bank", *rng.choices(names, k=rng.randint(0, 3))])
    labels = [(f"c{rng.randint(0, 1)}", name()) for _ in range(120)] + [("c0", None), ("c0", ""), ("c0", "of co"), (None, "bank")]
    entities = [(f"e{i}", f"c{i % 2}", name()) for i in range(90)]
    entities += [*entities[:5], ("e90", "c0", None), ("e91", None, "bank")]
    words = lambda t: {w for w in (t or "").split(" ") if len(w) > 2}
    want = {(c, t, e, n) for c, t in labels for e, k, n in entities if c is not None and c == k and words(t) & words(n)}
    l, e = spark.createDataFrame(labels, "collection_id string, label string"), spark.createDataFrame(entities, "id string, collection_id string, normalized_label string")
    for part_rows in (512, 7):
        got = [tuple(r) for r in resolution.entity_candidates(l, e, part_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert resolution.entity_candidates(l.limit(0), e).count() == 0


def test_repairs_join_nothing(spark):
    """Answers compress so well that a join would send them to every task; a batch's columns go along instead, also where ids repeat."""
    from factloom.plans.queries_stages import Mender

    rows = [(1, "no answer"), (2, '{"claims":[]}'), (2, '{"claims":[7]}'), (None, '{"claims":[7,8]}')]
    batches = spark.createDataFrame(rows, "batch_id long, prompt string").withColumn("refs", F.expr("array(named_struct('handle', 'B1', 'block_id', 'b'))"))
    out = seams.extract(batches, Mender())
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r["batch_id"], r["repaired"], r["prompt_tokens"], r["failure_kind"]) for r in out.collect()), key=repr) == sorted([(1, True, 20, None), (2, False, 10, None), (2, True, 20, None), (None, True, 20, "schema_violation_after_repair")], key=repr)


def test_channels_counted_without_pairs(spark):
    """Counts from groups are those of the pairs, with names and entities, silent documents, apart measures and repeated rows."""
    r = random.Random(5)
    rows = [(f"c{i}", f"col{i % 2}", r.choice(["d1", "d2", "d3", None]), r.choice([None, None, "e1", "e2"]), r.choice(["Firm 1 Ltd", "firm 1", "Other", None]), r.choice(["net revenue", "Revenues", "total income", "revenue from operations", "profit before tax", "profit after tax"])) for i in range(80)]
    c = spark.createDataFrame(rows + rows[:5], "id string, collection_id string, document_id string, entity_id string, subject string, predicate string")
    near = [(f"col{i % 2}", f"c{i}", f"c{j}", 0.5) for i, j in ((r.randrange(80), r.randrange(80)) for _ in range(200)) if i % 2 == j % 2 and i != j]
    s = spark.createDataFrame(near, "collection_id string, left_id string, right_id string, distance double")
    want = candidates.channel_counts(candidates.union_candidates(candidates.exact_candidates(c, c), s))
    got = candidates.count_channels(c, s)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_groups_are_dealt_a_fixed_number_of_times(spark):
    """A generic subject's claims are sent to MOST_PARTS parts at most, however many there are; all pairs come out once."""
    n = 600
    c = spark.range(n).selectExpr("concat('c', id) AS id", "'col' AS collection_id", "concat('d', id) AS document_id", "cast(NULL AS string) AS entity_id", "'the company' AS subject", "'revenue' AS predicate")
    before = candidates.HOT_KEY
    candidates.HOT_KEY = 10
    try:
        pairs = candidates.exact_candidates(c, c)
        assert pairs.count() == pairs.distinct().count() == n * (n - 1) // 2
        dealt = []
        node = pairs._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "Join":
            node = node.children().apply(0)
        for i in range(2):
            dealt.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.children().apply(i)).count())
        assert dealt == [n * candidates.MOST_PARTS] * 2
    finally:
        candidates.HOT_KEY = before


def test_first_candidates_are_those_of_all(spark):
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "of", "supplier"]
    name = lambda: " ".join(r.choice(words) for _ in range(3))
    labels = spark.createDataFrame([("c", name()) for _ in range(60)] + [("d", "supplier alpha"), ("c", None)], "collection_id string, label string")
    entities = spark.createDataFrame([(f"e{i}", r.choice(["c", "d"]), name()) for i in range(200)] + [("e0", "c", "supplier"), ("x", "c", None)], "id string, collection_id string, normalized_label string")
    for budget in (1, 3):
        want = resolution.asked_candidates(resolution.entity_candidates(labels, entities), budget).drop("turn")
        got = resolution.first_candidates(labels, entities, budget)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gold_claims_are_read_before_they_meet(spark):
    """Subjects are folded below the join with the produced claims, and a summary reads the matches once (F17, F24, F26 to F29)."""
    gold, produced, pairs = gold_tables(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    matched = evaluation.match_claims(gold, produced)
    lines = plan(matched).split("\n")
    meet = next(i for i, x in enumerate(lines) if "Join" in x and "document" in x)
    python = [i for i, x in enumerate(lines) if "EvalPython" in x]
    assert len(python) == 2 and min(python) > meet
    assert plan(evaluation.grounding(gold, produced, matched)).count("Window [row_number()") == 1
    assert "Window" not in plan(evaluation.scored_pairs(pairs, matched, table(spark, "/root/testdata/sf0.001", "relationships")))


def test_lenient_readers_parse_a_text_once(spark):
    inner = '"{\\"name\\":\\"x\\",\\"value\\":\\"y\\",\\"dimension\\":\\"unit\\"}"'
    rows = [(0, f"[{inner}]"), (1, '[{"name":"a","value":"b","dimension":"unit","dimension":"scope"},{"name":"c","value":"d"}]'), (2, '[{"name":"e","value":"f"},[1],3,null,"g"]'), (3, None), (4, "{"), (5, "7"), (6, '[{"dimension":"unit","a":1,"b":"z","couldExplainGap":true}]')]
    d = spark.createDataFrame(rows, "id int, raw string").withColumn("strict", F.try_parse_json("raw"))
    raw, strict = F.col("raw"), F.col("strict")
    out = d.select("id", F.transform(reads.lenient_qualifiers(raw, strict), lambda q: q["value"]).alias("q"), F.transform(reads.lenient_differences(raw, strict), lambda x: F.concat_ws("/", x["dimension"], x["a"], x["b"], x["could_explain_gap"].cast("string"))).alias("d"))
    # A text that holds JSON is a text, no object; an object that repeats a key is left out, but not its neighbours.
    assert {r["id"]: (r["q"], r["d"]) for r in out.collect()} == {0: ([], []), 1: (["d"], []), 2: (["f"], []), 3: ([], []), 4: ([], []), 5: ([], []), 6: ([], ["unit/z/true"])}


def test_citations_are_resolved_once_for_rows_and_cross_checks(spark):
    from factloom.operators import evidence
    from factloom.plans.queries_pipeline import _cited

    plan = evidence.verify_claims(*_cited(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_read_once_gives_the_same_rows_few_or_many(spark, monkeypatch):
    from factloom.functions.numbers import parse_numeric
    from factloom.sources import scratch

    raws = ["Rs 35 crore", None, "", "(1,135)", "35-40 %", "us$ 5.25 mn", "5 bps", "~7\u00a0lakhs", "12cr", "no figure", "gbp 4", "eur 9 percentage points", "rs.\u00a05k"]
    rows = scratch.stored(spark.createDataFrame([(i, raws[i % len(raws)], i % 2) for i in range(60)], "id int, raw string, side int"), "t")
    made = lambda: sorted(scratch.read_once(rows, ["raw", "side"], {"n": parse_numeric("raw"), "s": F.col("side") + 1}, "t").collect(), key=lambda r: r["id"])
    few = made()
    monkeypatch.setattr(scratch, "MOST_READINGS", 5)
    assert few == made() == rows.select("*", parse_numeric("raw").alias("n"), (F.col("side") + 1).alias("s")).orderBy("id").collect()
    got = {r["raw"]: (r["n"] or {}) and (r["n"]["scale"], r["n"]["currency"], r["n"]["unit"]) for r in few}
    assert got["~7\u00a0lakhs"] == ("lakhs", None, None) and got["12cr"] == ("cr", None, None) and got["rs.\u00a05k"] == ("k", "INR", None) and got["eur 9 percentage points"] == (None, "EUR", "percentage_point") and got["5 bps"] == (None, None, "basis_point")


def test_readings_of_several_keys_are_read_once_each(spark, monkeypatch):
    from factloom.sources import scratch

    rows = spark.createDataFrame([(1, "a", None, "x"), (2, "a", 3, "x"), (3, None, 3, "y"), (4, "b", None, None), (5, "a", 3, "z")], "id int, s string, n int, t string")
    readings = {"both": (["s", "n"], F.struct(F.upper("s").alias("s"), (F.col("n") + 1).alias("n"))), "own": (["t"], F.concat("t", F.lit("!")))}
    made = lambda: scratch.read_each_once(rows, readings, "test").orderBy("id").collect()
    want = rows.select("*", *[c.alias(n) for n, (_, c) in readings.items()]).orderBy("id").collect()
    assert made() == want
    monkeypatch.setattr(scratch, "MOST_READINGS", 3)  # of s and n four differ, of t too
    assert made() == want


def test_checked_pairs_keep_what_is_asked_for(spark):
    from factloom.operators import checks
    from factloom.plans.queries_values import claim_pairs

    pairs = claim_pairs(spark, SF).where("a.orderkey % 40 = 0")
    whole, part, none = checks.run_checks(pairs), checks.run_checks(pairs, ("partkey",)), checks.run_checks(pairs, ())
    shown = [c for c in whole.columns if c not in ("a", "b")]
    assert whole.schema["a"] == pairs.schema["a"] and part.schema["a"].dataType.names == ["partkey"] and none.columns == shown
    got = [sorted(d.select(*shown).collect(), key=repr) for d in (whole, part, none)]
    assert got[0] and got[0] == got[1] == got[2]


def test_claims_meet_under_numbers_of_their_groups(spark, monkeypatch):
    """Names of groups are not shuffled with every part that a claim is sent to, and pairs are the same whether groups are broadcast or not."""
    c = table(spark, SF, "claims").where("orderkey % 4 = 0")
    got = []
    for most in (candidates.MOST_BROADCAST, 0):
        monkeypatch.setattr(candidates, "MOST_BROADCAST", most)
        pairs = candidates.exact_candidates(c, c)
        node = pairs._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "Join":
            node = node.children().apply(0)
        sides = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.children().apply(i)) for i in range(2)]
        assert all(not {"who", "p", "q"} & set(s.columns()) and "meet" in s.columns() for s in sides)
        got.append(sorted(pairs.collect()))
    assert got[0] and got[0] == got[1]


def test_union_of_channels_is_that_of_their_pairs(spark):
    rows = [(f"c{i:03}", "k", f"d{i % 9}", f"e{i % 4}" if i % 3 else None, ("Acme", "Beta Ltd", "We")[i % 3], ("revenue", "net revenue", "ebitda")[i % 5 % 3]) for i in range(60)]
    c = spark.createDataFrame(rows + rows[:3], "id string, collection_id string, document_id string, entity_id string, subject string, predicate string")
    s = spark.createDataFrame([("k", f"c{i:03}", f"c{(i * m + 1) % 60:03}", m / 10) for i in range(60) for m in (1, 7, 8) if (i * m + 1) % 60 % 9 != i % 9], "collection_id string, left_id string, right_id string, distance double")
    want = candidates.union_candidates(candidates.exact_candidates(c.distinct(), c.distinct()), s)
    found = candidates.union_of_channels(c, s)
    got = sorted(found.collect(), key=repr)
    assert {tuple(r["sources"]) for r in got} == {("exact",), ("semantic",), ("exact", "semantic")} and got == sorted(want.select(*found.columns).collect(), key=repr)
    gathered = found._jdf.queryExecution().optimizedPlan().children().apply(0)  # the exact pairs, as they are made
    while gathered.nodeName() == "Project":
        gathered = gathered.children().apply(0)
    assert gathered.nodeName() == "Join"
