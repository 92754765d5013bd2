"""The corpus operators against plain versions, on real rows and on awkward ones."""

from __future__ import annotations

import base64
import random
import re
import subprocess
import sys
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import chat_format, exact_dedup, jaccard_join, language_id, mixing, quality_classifier, quality_rules, secret_scan, sentencepiece_bpe, suffix_dedup
from factloom.llm.common import store
from factloom.llm.queries import tokenizer_path
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty and very long texts, copies, near copies, odd white space, low-entropy strings."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(120)]
    texts = [None, "", " ", "\n\t ", "one", "One", "one two", "a\x0bb", "a b", "a  b ", "é" * 300, "a" * 1000, "ab" * 300, "x " * 30_000, " ".join(word() for _ in range(20_000)), "  ", "▁mark", "\x00nul"]
    texts += [" ".join(base)] * 5 + [" ".join(base).upper(), "\n".join(base)]
    for k in range(40):
        w = list(base)
        for i in rng.sample(range(120), k % 5):
            w[i] = word()
        texts.append(" ".join(w))
    for n in range(1, 12):
        texts += [" ".join(base[:n]), " ".join(base[:n])]
    common = " ".join(base[:50])
    texts += [f"{word()} {common} {' '.join(word() for _ in range(60))}" for _ in range(30)]
    return texts


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def real_texts(real):
    return [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]


def test_exact_dedup(spark, awkward):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, awkward), capacity=4).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(awkward):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[:5] == (i, ids[0], len(ids), i == ids[0], plain.sha(text))


def _entries(docs):
    norm = exact_dedup.normalised(docs)
    return docs.select("doc_id", F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256"))


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    texts = [f"text {k} of {k % 7}" for k in range(3000)] + ["copy"] * 500
    entries = _entries(frame(spark, texts))
    index = exact_dedup.build_index(entries, 8)
    rows = index.collect()
    depths = {r["depth"] for r in rows}
    assert len(depths) > 1 and min(depths) == exact_dedup.first_depth(3001, 8)
    held: dict = {}
    owners: dict = {}
    for r in rows:
        assert (r["h"] % 2**64) >> (64 - r["depth"]) == r["bucket"]
        held.setdefault((r["depth"], r["bucket"]), []).append(r["h"])
        owners.setdefault((r["depth"], r["bucket"]), set()).add(r["owner"])
    assert max(map(len, held.values())) <= 8 and all(len(o) == 1 for o in owners.values())
    assert sorted(r["h"] for r in rows) == sorted({r["h"] for r in entries.collect()})
    # No slot of the directory is filled by two buckets, and buckets deeper than the opening have overfull parents.
    slots = sorted((r["first_slot"], r["slots"]) for r in exact_dedup.directory(index).collect())
    assert all(a + n <= b for (a, n), (b, _) in zip(slots, slots[1:], strict=False))
    for depth, bucket in held:
        if depth > min(depths):
            assert len([1 for r in rows if (r["h"] % 2**64) >> (64 - depth + 1) == bucket >> 1]) > 8


def test_the_index_decides_the_groups(spark):
    d = frame(spark, ["a", "a", "b", "c", "c", "c"])
    entries = _entries(d)
    index = exact_dedup.build_index(entries, 2)
    whole = exact_dedup.answer(entries, d, index).count()
    gone = index.where("n < 3")  # without the entry of the key met three times
    assert (whole, exact_dedup.answer(entries, d, gone).count(), exact_dedup.answer(entries, d, index.limit(0)).count()) == (6, 3, 0)


def test_colliding_keys_are_told_apart_by_their_bytes(spark):
    d = frame(spark, ["a", "b", "a"])
    h = F.xxhash64(F.lit("a"))
    index = exact_dedup.build_index(_entries(d).withColumn("h", h), 2)
    assert [r["n"] for r in index.collect()] == [3]
    # Both texts under one key: the chain's rows that do hash to it are one group, of the bytes "a".
    assert [tuple(r)[2:] for r in exact_dedup.compare_chains(d, index).collect()] == [(0, 2)]


def test_exact_copies_removed_keeps_one_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (3, "b", "en", "s", 1), (None, None, None, None, None)], SCHEMA)
    assert sorted(r["text"] or "" for r in exact_dedup.exact_copies_removed(d).collect()) == ["", "a", "b"]


def test_exact_copies_removed_judges_rows_without_own_ids_by_text(spark):
    rows = [(None, "x"), (None, "y"), (5, "x"), (None, "z"), (None, "z"), (7, "p"), (8, "p"), (8, "q"), (9, "r"), (9, "s t"), (9, "s  t")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], " ".join(r["text"].split())) for r in exact_dedup.exact_copies_removed(d).collect()), key=repr)
    assert got == sorted([(5, "x"), (None, "y"), (None, "z"), (7, "p"), (8, "q"), (9, "r"), (9, "s t")], key=repr)


def test_exact_copies_removed_shuffles_only_rows_that_may_go(spark, monkeypatch):
    parts = []
    split = exact_dedup.apart
    monkeypatch.setattr(exact_dedup, "apart", lambda *a: parts.append(split(*a)) or parts[-1])
    rows = [(i, f"text {i % 1950}", "en", "s", 1) for i in range(2000)] + [(None, "none", "en", "s", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["doc_id"] for r in exact_dedup.exact_copies_removed(d).collect()), key=repr) == sorted([*range(1950), None], key=repr)
    clear, rest = parts[0]
    assert "Exchange hashpartitioning" not in clear._jdf.queryExecution().executedPlan().toString()
    assert clear.count() + rest.count() == 2001 and 50 <= rest.count() < 250


def test_near_duplicates_removed_judges_repeated_ids_by_text(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (5, a), (5, b), (8, b + " more"), (None, a), (6, None), (6, "one two three"), (4, "alone here")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.near_duplicates_removed(d).collect()), key=repr)
    assert got == sorted([(3, a), (5, b), (None, a), (6, None), (6, "one two three"), (4, "alone here")], key=repr)


def test_sentencepiece_equals_the_library(spark, awkward):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = {r["doc_id"]: r for r in sentencepiece_bpe.encode_digests(frame(spark, awkward), tokenizer_path()).collect()}
    for i, t in enumerate(awkward):
        ids = [*lib.encode(t or ""), lib.eos_id()]
        assert tuple(got[i]) == (i, len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(lib.decode(ids)))
    encoded = sentencepiece_bpe.encode(frame(spark, awkward), tokenizer_path())
    back = {r["doc_id"]: r["text"] for r in sentencepiece_bpe.decode(encoded, tokenizer_path()).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(awkward))


def test_sentencepiece_decodes_ids_of_real_texts(real_texts):
    import sentencepiece

    lib, ours = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), sentencepiece_bpe.PrefixTableBPE(tokenizer_path())
    for _, t in real_texts:
        ids = lib.encode(t or "") + [lib.eos_id()]
        back = ours.decode(ids)
        assert ours.encode(t or "") == ids and back == lib.decode(ids) and ours.digests(t or "")[2] == plain.sha(back)


def test_sentencepiece_decodes_any_ids():
    import sentencepiece

    lib, ours = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), sentencepiece_bpe.PrefixTableBPE(tokenizer_path())
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(0, 31_999), 28_705, 0, 1, 2]) for _ in range(rng.randint(0, 8))]
        assert ours.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize(("crowd", "throng"), [(4096, 4096), (2, 4096), (2, 2), (0, 0)])
def test_suffix_dedup(spark, awkward, crowd, throng):
    rng = random.Random(3)
    long_ = max((t for t in awkward if t), key=len)
    texts = [*awkward, long_[:15_000] + " other " + long_[15_400:], long_[5:40_000], "é" + "".join(chr(rng.randint(97, 122)) for _ in range(40_000))]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(frame(spark, texts), crowd, throng).collect()}
    assert [got[i] for i in range(len(texts))] == plain.repeated_bytes(texts)


def test_suffix_dedup_settles_and_splits_an_anchor_of_many_stretches(spark):
    """One line of 60 bytes in all documents: its anchor has as many different stretches as there are documents."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = " ".join(word() for _ in range(9))
    shared = " ".join(word() for _ in range(40))
    texts = [" ".join([*(word() for _ in range(40)), line, *(word() for _ in range(40))]) for _ in range(150)]
    texts += [f"{word()} {shared[k:]} {line} {shared[: 200 + k]}" for k in range(40)]
    want = plain.repeated_bytes(texts)
    for crowd, throng in ((1024, 1024), (20, 1024), (20, 50), (0, 0)):
        got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(frame(spark, texts), crowd, throng).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_suffix_dedup_of_a_throng(spark):
    """A core of 190 bytes within 5,000 different edges: its windows meet one by one, and no bucket that is sorted exceeds the bound."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    core = " ".join(word() for _ in range(40))[:190]
    sides = [f"{k % 70:05d}".translate(str.maketrans("0123456789", "klmnopqrst")) for k in range(5000)]
    texts = [f"{word()} {word()} {a}{core}{word()} {word()}" for a in sides]
    docs = frame(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(docs, 50, 50).collect()}
    assert [got[i] for i in range(len(texts))] == plain.repeated_bytes(texts)
    table = store(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(suffix_dedup._compress, "row long, doc_id long, z binary"), "t")
    found = table.select("row", "z").mapInArrow(suffix_dedup._stretches, suffix_dedup._STRETCH)

    def largest(crowd, throng):
        asked = suffix_dedup.sort_requests(found, crowd, throng)[1].groupBy("row").agg(F.collect_list(F.struct("key", "row", "first", "windows", "offset", "known", "crowd")).alias("asked"))
        cut = table.join(asked, "row").select("z", "asked").mapInArrow(suffix_dedup._cut, suffix_dedup._PIECE)
        return cut.where("octet_length(bytes) > 0").groupBy("key").count().agg(F.max("count")).first()[0] or 0

    assert largest(50, 50) <= 50 < largest(50, 100_000)


def test_difference_cover():
    v, cover = suffix_dedup.V, suffix_dedup.COVER
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert all((a + suffix_dedup.MEET[a, b]) % v in cover and (b + suffix_dedup.MEET[a, b]) % v in cover for a in range(v) for b in range(v)) and suffix_dedup.MEET.max() < 32


def test_network_sorts_groups_of_any_size():
    rng = np.random.default_rng(5)
    for n in [*range(1, 20), 33, 100]:
        x = rng.integers(0, 9, n)
        want = sorted(x)
        for _, k, low in suffix_dedup.network(n):
            a, b = np.minimum(x[low], x[low + k]), np.maximum(x[low], x[low + k])
            x[low], x[low + k] = a, b
        assert x.tolist() == want


def test_ties_of_windows_with_different_residues_are_settled_by_the_cover(monkeypatch):
    """Windows that agree in more than 32 bytes and then differ, at all residues; without the cover's ranks they end in a wrong order."""
    rng = random.Random(11)
    common = bytes(rng.randrange(97, 100) for _ in range(150))
    texts, windows = [], []
    for _ in range(60):
        text = bytes(rng.randrange(97, 123) for _ in range(rng.randrange(1, 40))) + common + bytes(rng.randrange(97, 99) for _ in range(9)) + b"x" * 41
        texts.append(text + text[:3])
        windows.append(len(texts[-1]) - 199)
    flat = [t[i : i + 200] for t, n in zip(texts, windows, strict=True) for i in range(n)]
    got = suffix_dedup.repeated_windows(texts, np.array(windows))
    want = [flat.count(x) > 1 for x in flat]
    assert got.tolist() == want and got.any()
    monkeypatch.setattr(suffix_dedup, "settle_ties", lambda *_: None)
    assert suffix_dedup.repeated_windows(texts, np.array(windows)).tolist() != want


def test_language_id(spark, real):
    langs, table = language_id.fit_models(real)
    got = language_id.identify(language_id.from_documents(real), langs, table).join(real.select("doc_id", F.col("lang").alias("true")), "doc_id")
    n, right = got.count(), got.where(F.col("lang") == F.col("true")).count()
    assert right >= 0.95 * n
    odd = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "http://x.example.de/a", "<html lang='DE'><body></body>")], "page_id long, url string, html string")
    rows = {r["doc_id"]: r for r in language_id.identify(language_id.from_pages(odd), langs, table).collect()}
    assert rows[3]["declared"] == "de" and rows[1]["text_lang"] is None and len(rows) == 3


def test_language_id_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(3)))
    langs, table = language_id.fit_models(d.where("fold > 0"))
    held = d.where("fold = 0")
    got = language_id.identify(language_id.from_documents(held), langs, table).join(held.select("doc_id", F.col("lang").alias("true")), "doc_id")
    n, right = got.count(), got.where(F.col("lang") == F.col("true")).count()
    assert n > 200 and right >= 0.93 * n


def test_language_posteriors_equal_plain_sums(spark, real, awkward):
    langs, table = language_id.fit_models(real)
    texts = [r["text"] for r in real.orderBy("doc_id").limit(25).collect()] + [None, "", "ab", awkward[14]]
    rng = random.Random(4)
    facts = [(rng.choice([None, "de", "en", "xx"]), rng.choice([None, "a.example.de", "b.example.fr"]), None) for _ in texts]
    facts = [(d, h, h and h[-2:]) for d, h, _ in facts]
    facts[3] = facts[4]
    rows = [("pages", f"id{k}", t or "", *f) for k, (t, f) in enumerate(zip(texts, facts, strict=True))]
    records = spark.createDataFrame(rows, "kind string, doc_id string, text string, declared string, host string, suffix string").withColumn("own", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: r for r in language_id.identify(records, langs, table).collect()}
    ll = []
    for _, _, t, *_ in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        gram = language_id.trigrams(raw) if len(raw) > 2 else np.zeros(0, np.int64)
        ll.append([round(float(sum(float(x) for x in table[k][gram])) * language_id.TEMPER / max(len(gram), language_id.TEMPER), 6) for k in range(len(langs))])
    for k, p in enumerate(plain.language_posteriors(facts, ll)):
        assert got[f"id{k}"]["lang"] == langs[p.index(max(p))] and got[f"id{k}"]["posterior"] == pytest.approx(max(p), abs=2e-4)


def test_language_models_cover_rare_languages(spark):
    rare = ["da", "fi", "hu", "nl", "pl", "sv"]
    rows = [(i, f"the words of document {i} and the rest", "en", "s", 1) for i in range(20_000)] + [(i, f"harvinainen teksti {x}", x, "s", 1) for i, x in enumerate(rare, 50_000)]
    rows += [(None, "sans identifiant", "fr", "s", 1)]
    langs, table = language_id.fit_models(spark.createDataFrame(rows, SCHEMA))
    assert langs == sorted(["en", "fr", *rare]) and table.shape[0] == len(langs)


def test_secret_scan(spark, awkward):
    texts = [*awkward, 'password = "abc" token:abcdefgh12', "secret=token:longvalue123", "PassWD:=x.y_z-12345678", "AKIAABCDEFGHIJKL12 AKIA1", "0123456789abcdef0123456789abcdef0 ABC", 'api_key: deadbeefdeadbeefdeadbeefdeadbeef', "x" + "9f" * 20 + "g", "key Zx8Qw3rTy6UiOp1AsDf5Gh7J end", "the_quick_brown_fox_jumps_over_12", "é password=éabcdefgh password=abcdefgh"]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:5] == plain.base_spans(t or "")
    found = {t: got[i] for i, t in enumerate(texts)}
    assert found["key Zx8Qw3rTy6UiOp1AsDf5Gh7J end"]["spans"] == "random:4:28"
    assert found["the_quick_brown_fox_jumps_over_12"]["n_random"] == 0


def test_secret_scan_finds_keys_without_digits(spark):
    rng = random.Random(8)
    mixed = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(24)) for _ in range(100)]
    plain_ = ["-" * 80, "=" * 40, "_" * 30, "a" * 1000, "e" * 60, "ab" * 300, "Donaudampfschifffahrtsgesellschaft", "Rechtsschutzversicherungsgesellschaften", "anticonstitutionnellement", "counterrevolutionaries",
             "electroencefalografista", "https//example/path/to/some/page", "getUserAccountSettingsFromRequest", "MAX_NUMBER_OF_OPEN_FILES", "state-of-the-art-language-model", "internationalization"]
    got = {r["doc_id"]: r["n_random"] for r in secret_scan.scan_secrets(frame(spark, [f"key {t} end" for t in mixed + plain_])).collect()}
    assert sum(got[i] for i in range(100)) >= 98
    assert [t for i, t in enumerate(plain_, 100) if got[i]] == []


def test_secret_scan_equals_a_plain_scan(spark):
    """Training, scores, overlaps and spans against plain Python, on texts that mix all kinds."""
    samples = secret_scan.labelled_samples(spark, 800)
    ratios = plain.markov_ratios([(r["text"], r["random"]) for r in samples.collect()], secret_scan.ALPHABET)
    rng = random.Random(12)
    letters = secret_scan.ALPHABET
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    makers = [lambda: key(rng.randint(15, 45)), lambda: f"token={key(24)}", lambda: "AKIA" + key(18).upper(), lambda: "9f" * rng.randint(10, 20), lambda: "some_ordinary_identifier_name", lambda: "é", lambda: "word", lambda: "api_key : " + "deadbeef" * 5]
    texts = ["".join(rng.choice(makers)() + rng.choice([" ", "", "\n", ";"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    got = {r["doc_id"]: (r["spans"], r["n_random"]) for r in secret_scan.scan_secrets(frame(spark, texts), samples).collect()}
    want = {i: plain.all_spans(t, ratios) for i, t in enumerate(texts)}
    assert got == want and sum(n for _, n in want.values()) > 50


def test_secret_scan_of_one_text_with_many_tokens(spark):
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(26))
    row = secret_scan.scan_secrets(frame(spark, [" ".join(key() for _ in range(16_000))])).first()
    spans = row["spans"].split(",")
    assert row["n_random"] >= 15_900 and spans[-1] == f"random:{27 * 16_000 - 27}:{27 * 16_000 - 1}"


def test_secret_model_tells_held_out_samples_apart(spark):
    s = secret_scan.labelled_samples(spark, 4000).where("length(text) >= 20").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(4)))
    ratios = secret_scan.train(s.where("fold > 0").select("text", "random"))
    held = s.where("fold = 0").select("random", (secret_scan.token_score(F.col("text"), ratios) > 0).alias("said"))
    n, right = held.count(), held.where("random = said").count()
    assert right >= 0.98 * n


def test_secret_samples_of_a_table(spark):
    """Values of the patterns and words of different texts, against plain Python; copies, nulls and words as passwords change nothing."""
    rng = random.Random(5)
    texts = [None, "", "password: necessary-information", "copied Zx8Qw3rTy6UiOp1AsDf", "copied Zx8Qw3rTy6UiOp1AsDf"]
    texts += [f"shared words n{i} token={rng.randbytes(12).hex()} {rng.randbytes(20).hex()} AKIA{rng.randbytes(8).hex().upper()} {'long' * 5}" for i in range(30)]
    docs = frame(spark, texts)
    start = secret_scan.train(secret_scan.labelled_samples(spark))
    got = secret_scan.table_samples(docs, secret_scan.find_matches(docs), start).collect()
    values = {m[2] for t in texts for m in plain.ASSIGN.finditer(t or "") if len(m[2]) >= 8} | {m[0] for t in texts for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", t or "")}
    random_ = {r["text"] for r in got if r["random"]}
    assert random_ <= values - {"necessary-information"} and len(random_) >= 0.9 * len(values)
    words: dict[str, set] = {}
    for t in texts:
        for w in re.findall(r"[A-Za-z0-9+/_=-]+", t or ""):
            if 2 <= len(w) <= 19:
                words.setdefault(w, set()).add(t)
    assert sorted(r["text"] for r in got if not r["random"]) == sorted(w for w, of in words.items() if len(of) > 1)
    assert secret_scan.table_samples(docs.limit(0), secret_scan.find_matches(docs.limit(0)), start).count() == 0


def test_secret_models_learn_from_the_table(spark, real):
    """Keys planted in real documents are found, in alphabets that the made-up samples lack as well; real documents have no false finding."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    makers = {
        "base62": (0.99, lambda: "".join(rng.choice(letters) for _ in range(24))), "base64": (0.99, lambda: base64.b64encode(rng.randbytes(30)).decode()),
        "base32": (0.99, lambda: base64.b32encode(rng.randbytes(20)).decode()), "uuid": (0.9, lambda: str(uuid.UUID(bytes=rng.randbytes(16)))), "hex24": (0.9, lambda: rng.randbytes(12).hex()),
    }
    whole = real.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    base = [r["text"] for r in real.where("length(text) > 0").orderBy("doc_id").limit(100).collect()]
    rows, extra = [], [rng.randbytes(20).hex() for _ in range(300)]
    for kind, (_, make) in makers.items():
        for i, t in enumerate(base):
            w = t.split(" ")
            at = rng.randint(0, len(w))
            rows.append((f"{kind}-{i}", " ".join(w[:at] + [make()] + w[at:])))
    rows += [(f"hex-{i}", f"key {x} end") for i, x in enumerate(extra)]
    docs = whole.unionByName(spark.createDataFrame(rows, "doc_id string, text string"))
    got = {r["doc_id"]: r["n_random"] for r in secret_scan.scan_secrets(docs).collect()}
    for kind, (least, _) in makers.items():
        assert sum(got[f"{kind}-{i}"] > 0 for i in range(len(base))) >= least * len(base), kind
    assert sum(n for k, n in got.items() if k.isdigit()) == 0


def test_jaccard_join(spark, awkward, real, real_texts):
    for docs, texts in ((frame(spark, awkward), list(enumerate(awkward))), (real, real_texts)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
        assert got == plain.near_components(texts)


def test_jaccard_join_with_repeated_and_null_ids(spark):
    t = "a b c d e f g h i j"
    d = spark.createDataFrame([(1, t), (1, t), (2, t.upper()), (None, t), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(d).collect()), key=repr)
    assert got == sorted([(1, 6, 1), (1, 6, 1), (2, 6, 1), (None, 6, None), (3, 0, 3)], key=repr)


def test_jaccard_join_with_ids_repeated_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (8, b + " more"), (9, c), (10, None), (10, c + " more"), (11, "alone")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 56, 3), (5, 56, 3), (8, 57, 3), (9, 56, 9), (10, 0, 9), (10, 57, 9), (11, 1, 11)}


def test_families_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(80)]
    texts = []
    for k in range(120):
        w = list(base)
        for i in rng.sample(range(80), k % 4):
            w[i] = f"x{rng.randint(0, 10**9)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == plain.near_components(list(enumerate(texts)))


def test_linked_sets_share_the_promised_signatures():
    rng = np.random.default_rng(4)
    low = jaccard_join.bands(1 << 12)
    for n in [3, 4, 5, 7, 9, 12, 20, 41, 90, 200, 700, 2000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = rng.integers(0, len(a) // 4 + 1)
            new = rng.integers(0, len(a) // 4 + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common < 75 * (len(a) + len(b) - common) or gone + new == 0 or len(b) < 3:
                continue
            left, right = ({band: (set(sig.tolist()), bound) for band, sig, bound in jaccard_join.signatures(x, low)} for x in (a, b))
            assert any(len(left[i][0] & right[i][0]) >= max(1, left[i][1], right[i][1]) for i in left.keys() & right.keys())


def test_signatures_enumerate_the_subsets_of_partitions():
    low = jaccard_join.bands(1 << 12)
    s = np.sort(np.random.default_rng(1).integers(0, 2**64, 600, dtype=np.uint64))
    for band, sig, promise in jaccard_join.signatures(s, low):
        k, n1 = jaccard_join.instance(low, band)
        assert jaccard_join.N2 * n1 >= len(sig) > 0.9 * jaccard_join.N2 * n1 and promise > 0
        part = (s >> np.uint64(32)) * np.uint64(3 * n1) >> np.uint64(32)
        own, spoilt = set(sig.tolist()), {}
        for x in (0, 300):  # without a shingle, the two subsets with its part change, and the partition's third does not
            (_, other, _), = [y for y in jaccard_join.signatures(np.delete(s, x), low) if y[0] == band] or [(0, sig, 0)]
            spoilt[int(part[x])] = len(own - set(other.tolist()))
        assert set(spoilt.values()) <= {0, 1, 2} and 2 in spoilt.values()


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(21)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    zigzag = [(2000 + k, 2000 + (k * 37 + 11) % 83) for k in range(83)]
    star = [(5000, 3000 + k) for k in range(40)]
    some = [(rng.randint(6000, 6120), rng.randint(6000, 6120)) for _ in range(60)]
    links = chain + zigzag + star + some + [(7000, 7000)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["label"] for r in jaccard_join.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)} and jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint32)) for _ in range(12)]
    got = jaccard_join.common_counts(sets[:5], sets[5:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_mixing(spark, real):
    rows = mixing.mix_sources(real).join(real.select("doc_id", "source"), "doc_id").collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain.source_targets(sizes)
    taken: dict = {}
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - want[s]) <= max(0.1 * want[s], largest) for s in want)
    emitted = mixing.emit_mix(real)
    assert emitted.columns == real.columns and emitted.count() == sum(r["copies"] for r in rows)


def test_mixing_with_null_source_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (None, None, "en", "x", 0), (2, "d e", "en", "x", 3)], SCHEMA)
    rows = mixing.mix_sources(d).collect()
    assert len(rows) == 4 and {r["source_size"] for r in rows} == {6, 2}
    assert mixing.emit_mix(d).count() == sum(r["copies"] for r in rows)


def test_mixing_cuts_hot_blocks_and_agrees_on_reruns(spark, monkeypatch):
    """One size, ids that are all multiples of 64, ids repeated with other texts, and one id and text many times."""
    rows = [(64 * k, f"a b c{k}", "en", "hot", k) for k in range(600)] + [(7, f"x y z{k}", "en", "hot", k) for k in range(40)] + [(8, "same text here", "en", "hot", 3)] * 25 + [(None, "p q r", "en", None, 3)]
    d = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, mixing.emit_mix(d).collect()), key=repr)
    monkeypatch.setattr(mixing, "PART_ROWS", 16)
    assert sorted(map(tuple, mixing.emit_mix(d.repartition(7)).collect()), key=repr) == whole
    taken = sum(r["taken"] for r in mixing.mix_sources(d).where("size > 0 and source_size > 3").collect())
    assert abs(taken - sum(len(r[1].split()) for r in whole if r[3])) == 0
    other = sorted(map(tuple, mixing.emit_mix(d, seed="another").collect()), key=repr)
    assert abs(len(other) - len(whole)) <= 2


def test_quality_rules(spark, awkward):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, awkward)).collect()}
    for i, t in enumerate(awkward):
        want = plain.rules(t)
        assert tuple(got[i])[1:6] == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_rules_remove_frequent_lines(spark):
    rng = random.Random(4)
    body = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30))
    line = "this line stands in every document of the host and says nothing at all today"
    texts = [f"{line}\n{body()}" for _ in range(30)] + [f"{line}\nshort {k}" for k in range(10)]
    rows = [(i, t, "en", "h", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), least_documents=20).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 15 for i in range(30))
    assert not any(got[i]["kept"] for i in range(30, 40))


def test_quality_rules_remove_lines_at_every_host_size(spark):
    rng = random.Random(6)
    body = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30))
    line = "this line stands in some documents of the host and says nothing at all today"
    rows = [(k, f"{line}\n{body()}" if k < 11 else body(), "en", "small", 1) for k in range(12)]
    rows += [(100 + k, f"{line}\n{body()}" if k < 11 else body(), "en", "large", 1) for k in range(900)]
    rows += [(2000 + k, f"{line}\n{body()}" if k < 10 else body(), "en", "below", 1) for k in range(12)]
    got = {r["doc_id"]: r["n_removed_words"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, n in got.items() if n} == {*range(11), *range(100, 111)} and {n for n in got.values() if n} == {15}


def test_quality_rules_count_documents_not_texts(spark, monkeypatch):
    copy = "one line of a page that was copied many times over and over again by all"
    rows = [(k, copy, "en", "h", 1) for k in range(11)] + [(100, copy, "en", "other", 1)] * 11 + [(None, copy, "en", "none", 1)] * 11
    for few in (quality_rules.MOST_BROADCAST, 0):
        monkeypatch.setattr(quality_rules, "MOST_BROADCAST", few)
        got = sorted((r["doc_id"] is None, r["doc_id"], r["n_removed_words"], r["kept"]) for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect() if r["doc_id"] is not None)
        assert got == [(False, k, 16, False) for k in range(11)] + [(False, 100, 0, True)] * 11


def test_quality_classifier_on_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_classifier.quality_scores(d).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert quality_classifier.quality_kept(d).count() == quality_classifier.quality_scores(d).where("kept").count()


def test_label_model_equals_plain_em():
    rng = random.Random(7)
    n = len(quality_classifier.LABELLERS)
    votes = [tuple(rng.random() < (0.5 if bad else 0.03) for _ in range(n)) for bad in (rng.random() < 0.25 for _ in range(400))]
    code = lambda v: sum(1 << k for k, x in enumerate(v) if x)
    times: dict[int, int] = {}
    for v in votes:
        times[code(v)] = times.get(code(v), 0) + 1
    patterns = np.array(sorted(times))
    post, _, _ = quality_classifier.label_model(patterns, np.array([times[p] for p in patterns], float))
    want = {code(v): p for v, p in plain.weak_labels(votes).items()}
    assert dict(zip(patterns.tolist(), post.tolist(), strict=True)) == pytest.approx(want, abs=1e-6)


def test_scorer_equals_plain_steps():
    rng = random.Random(2)
    rows = [{"pattern": k % 3, "feature": sorted(rng.sample(range(30), 6)), "share": [rng.random() for _ in range(6)]} for k in range(20)]
    posterior = {0: 0.9, 1: 0.2, 2: 0.6}
    got = quality_classifier.fit_scorer(rows, posterior, rounds=25)
    w, bias = plain.scorer_weights(rows, posterior, 25)
    assert [got[f] for f in sorted(w)] == pytest.approx([w[f] for f in sorted(w)], abs=1e-6) and got[-1] == pytest.approx(bias, abs=1e-9)


def test_quality_classifier_with_awkward_rows(spark, awkward):
    d = frame(spark, [*awkward, *awkward[-3:]]).withColumn("pattern", F.lit("clash")).withColumn("weak_label", F.lit("clash")).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = {r["doc_id"]: r for r in quality_classifier.quality_scores(d).collect()}
    assert len(got) == len(awkward) + 3 and not any(got[str(i)]["kept"] for i in range(4))
    for k in range(3):
        a, b = got[str(len(awkward) - 3 + k)], got[str(len(awkward) + k)]
        assert (a["score"], a["kept"]) == (b["score"], b["kept"])
    assert set(quality_classifier.quality_kept(d).columns) == set(d.columns)


def test_chat_format(spark):
    talk = lambda c, *turns: [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]
    rows = talk(1, "a") + talk(2, "a", "b") + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "a", "b", "c") + talk(6, "z") + [(7, 0, None, None)]
    got = {r["conv_id"]: (r["n_turns"], r["kept"], r["keep_id"]) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (1, False, 3), 2: (2, False, 3), 3: (3, True, 3), 4: (2, True, 4), 5: (3, False, 3), 6: (1, True, 6), 7: (1, True, 7)}


def test_chat_format_tells_null_from_the_text_null(spark):
    rows = [(None, 0, "user", "a"), ("null", 0, "user", "b"), ("null", 1, "user", "c"), ("x", 0, "user", "b"), ("x", 0, "user", "b")]
    d = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("place", F.lit("clash")).withColumn("leader", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["kept"], r["keep_id"]) for r in chat_format.format_chats(d).collect()}
    assert got == {None: (1, True, None), "null": (2, True, "null"), "x": (2, True, "x")}


def test_chat_format_takes_long_texts_whole(spark):
    long_ = "word " * 60_000
    rows = [(1, 0, "user", long_), (2, 0, "user", long_), (2, 1, "user", "b"), (3, 0, "user", long_ + "x")]
    got = {r["conv_id"]: (r["kept"], r["keep_id"], len(r["rendered"] or "")) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    spelled = lambda *turns: len("".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns))
    assert got == {1: (False, 2, 0), 2: (True, 2, spelled(("user", long_), ("user", "b"))), 3: (True, 3, spelled(("user", long_ + "x")))}


def test_chat_format_over_blocks(spark):
    long_ = [(1, k, "user", f"t{k}") for k in range(700)]
    rows = long_ + [(2, k, r, t) for _, k, r, t in long_[:600]]
    got = {r["conv_id"]: (r["n_turns"], r["kept"], r["keep_id"]) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (700, True, 1), 2: (600, False, 1)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    langs = language_id.fit_models(d)
    outs = [
        exact_dedup.exact_dedup(d), sentencepiece_bpe.encode_digests(d, tokenizer_path()), suffix_dedup.suffix_dedup(d), language_id.identify(language_id.from_documents(d), *langs), secret_scan.scan_secrets(d),
        jaccard_join.jaccard_components(d), mixing.mix_sources(d), mixing.emit_mix(d), quality_rules.quality_rules(d), quality_classifier.quality_scores(d), quality_classifier.quality_kept(d),
        chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_extra_columns_and_null_ids_do_no_harm(spark, awkward):
    d = frame(spark, awkward[:30])
    for c in ("h", "bucket", "size", "rank", "row", "n", "words", "label", "copies", "norm", "z", "score"):
        d = d.withColumn(c, F.lit("clash"))
    d = d.unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")))
    n = d.count()
    for f in (exact_dedup.exact_dedup, suffix_dedup.suffix_dedup, secret_scan.scan_secrets, jaccard_join.jaccard_components, mixing.mix_sources, quality_rules.quality_rules, quality_classifier.quality_scores):
        assert f(d).count() == n
    assert sentencepiece_bpe.encode_digests(d, tokenizer_path()).count() == n
    assert set(mixing.emit_mix(d).columns) == set(exact_dedup.exact_copies_removed(d).columns) == set(jaccard_join.near_duplicates_removed(d).columns) == set(d.columns)


CLASHES = ("__digest", "__one", "__times", "__turn", "__rows", "__copies", "copies", "rows", "row", "key", "digest", "times", "turn", "kept", "text_sha256", "component_id", "n", "label")


def clashing(spark, rows):
    """Documents with further columns, each value of which names its row and column."""
    schema = SCHEMA + "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *[f"{k}.{c}" for c in CLASHES]) for k, r in enumerate(rows)], schema).repartition(3)


def test_rows_come_back_with_their_own_columns(spark):
    rows = [(i % 7 if i < 20 else i, f"text {i % 12} " * (i % 5 + 1), "en", f"s{i % 3}", 1) for i in range(60)] + [(None, None, None, None, None)] * 3
    d = clashing(spark, rows)
    came = {tuple(r): k for k, r in enumerate(d.collect())}
    for out in (mixing.emit_mix(d), exact_dedup.exact_copies_removed(d), jaccard_join.near_duplicates_removed(d)):
        got = out.collect()
        assert out.columns == d.columns and got and all(tuple(r) in came for r in got)
    plan = {}
    for r in mixing.mix_sources(d).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    sent: dict = {}
    for r in mixing.emit_mix(d).collect():
        sent[r["doc_id"]] = sent.get(r["doc_id"], 0) + 1
    assert sent == {i: n for i, n in plan.items() if n}


def test_pipeline_takes_nulls_repeats_and_clashing_columns(spark, real_texts):
    words = " ".join(t for _, t in real_texts[:8] if t).split()
    long_ = " ".join(words[k % len(words)] for k in range(30_000))
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, long_, "en", "a", 1), (3, long_, "en", "a", 1), (4, long_.replace(" ", "\n"), None, "b", 1)]
    rows += [(100 + i, t, "en", f"s{i % 2}", 1) for i, (_, t) in enumerate(real_texts[:60])]
    docs = clashing(spark, rows)
    came = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "SentencePiece":
            assert out.count() == docs.count()
            break
        out = store(out, "stages")
        got = out.collect()
        assert out.columns == docs.columns and all(tuple(r) in came for r in got)
        if name == "exact dedup":
            seen = [(r["text"] or "").replace("\n", " ") for r in got]
            assert len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in seen}) == len(seen)
        docs = out
    empty = clashing(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline(spark, real):
    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    docs = real
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == real.columns
    kept = {r["doc_id"]: r["text"] for r in quality_classifier.quality_kept(real).collect()}
    first: dict[str, int] = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
    left = [(i, kept[i]) for i in first.values()]
    want = {i for i, (_, c) in plain.near_components(left).items() if i == c}
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(real.where(F.col("doc_id").isin(*want))).collect()}
    assert ids == {i for i, c in mixed.items() if c}
    assert out.count() == sum(mixed.values())


def test_many_keys_narrow_what_is_shuffled(spark, monkeypatch):
    """A bitmap of the keys lets through every row that has one, null keys none, and few of the others."""
    from factloom.llm import common

    rows = spark.range(40_000).selectExpr("IF(id = 7, NULL, id * 1000003 - 9000000000) AS key", "id AS row")
    keys = store(spark.range(0, 40_000, 37).selectExpr("id * 1000003 - 9000000000 AS key", "id % 2 = 0 AS differ"), "keys")
    want = rows.join(keys, "key").collect()
    monkeypatch.setattr(common, "MOST_BROADCAST", 10)
    got = common.narrowed(rows, keys, "key")
    assert len(want) == 1082 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    let_through = common.narrowed(rows, keys.withColumn("key", F.col("key")), "key")._jdf.queryExecution().optimizedPlan()
    while let_through.nodeName() != "Join":
        let_through = let_through.children().apply(0)
    left = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, let_through.children().apply(0)).count()
    assert len(want) <= left < 6000


def test_workers_give_arrow_memory_back():
    """A worker that has filtered large batches holds less than one of them afterwards (it kept several before)."""
    code = """
import gc, re
import pyarrow as pa, pyarrow.compute as pc
from factloom.llm.common import lean
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
def batches():
    for _ in range(6):
        yield pa.RecordBatch.from_arrays([pa.array(["word " * 800] * 10_000)], ["text"])
def run(each):
    for b in each:
        yield b.filter(pc.greater(pc.binary_length(b.column("text")), 0))
gc.collect()
start = held()
for out in lean(run)(batches()):
    del out
gc.collect()
print(held() - start)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 40
