"""Language identification by Bayesian evidence fusion.

Evidence of a record: (1) likelihoods of its text under byte-trigram models, one a language, tempered
because neighbouring trigrams are not independent; (2) the language its markup declares, weighed by
how often each declaration goes with each language over all records; (3) the address suffix and the
host, as a hierarchical prior: language counts of the host are smoothed by those of the suffix, those
by the counts of all records. Counts are sums of the texts' posteriors, by grouped aggregation over
all records; a record's own share is taken out of its host's and suffix's counts before they are used.

The languages are all those that label any document with a text of three bytes or more. Labelled
documents are counted by language over all rows, and each language's trigram model is fitted on about
`rows_per_language` of them, chosen by hash: all of a rarer one, and one at least whatever the size of
the input. In fitting, a trigram counts `most_repeats` times a document at most, so that one repetitive
document does not make a model; judging takes every trigram of the whole text. All counts cover all records.

Nulls: a null or empty text gives no text evidence, a null declaration or host none of its kind; with
no evidence at all the general prior decides. Ties go to the language whose name comes first. Repeated
rows are judged each for itself and count each for itself. Very long texts are taken whole. Ids may be of
any type (of one type in all records). An empty table gives no rows. Clashing further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import CHUNK_BYTES, column_bytes, id_type, pieces, sized, store, text_of

BITS = 16
TEMPER = 40.0
SMOOTH_HOST, SMOOTH_SUFFIX = 5.0, 20.0

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams, one for each position but the last two."""
    f = _FOLD[data]
    x = (f[:-2] * np.uint32(0x9E3779B1)) ^ (f[1:-1] * np.uint32(0x85EBCA6B)) ^ (f[2:] * np.uint32(0xC2B2AE35))
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int64)


def _rows(offsets: np.ndarray, n: int) -> np.ndarray:
    """For each trigram its row, or -1 if it crosses two rows."""
    at = np.arange(n)
    row = np.searchsorted(offsets, at, side="right") - 1
    return np.where(at + 3 <= offsets[1:][row], row, -1)


def _count(most_repeats: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = column_bytes(b.column("text"))
            for k, lang in enumerate(b.column("lang").to_pylist()):
                part = data[offsets[k] : offsets[k + 1]]
                if len(part) >= 3:
                    one = np.bincount(trigrams(part), minlength=1 << BITS)
                    sums[lang] = sums.get(lang, 0) + np.minimum(one, most_repeats)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.astype(np.int64).tobytes() for s in sums.values()], pa.binary())], ["lang", "counts"])

    return run


def fit_models(docs: DataFrame, rows_per_language: int = 1000, most_repeats: int = 20) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities [language, trigram] with additive smoothing."""
    labelled = docs.where("lang is not null and octet_length(text) >= 3").select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("at"))
    share = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.count("*"))
    # The least place of a language is always within its limit, so that no language goes without a model.
    # Values of lang may be garbage without end, so the limits are counted before they are sent to every task.
    limits = sized(store(labelled.groupBy("lang").agg(F.greatest((share * (1 << 30)).cast("long"), F.min("at")).alias("limit")), "language-limits"))
    # All tasks filter and write the sample; it is bounded, so few tasks can count it.
    sample = store(labelled.join(limits, "lang").where("at <= limit").select("lang", "text"), "language-sample")
    parts = sample.coalesce(8).mapInArrow(_count(most_repeats), "lang string, counts binary").collect()
    sums: dict[str, np.ndarray] = {}
    for r in parts:
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    langs = sorted(sums)
    table = np.array([np.log((sums[x] + 0.5) / (sums[x].sum() + 0.5 * (1 << BITS))) for x in langs]).reshape(len(langs), 1 << BITS)
    return langs, table.astype(np.float32)


def _likelihoods(table: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            data, offsets = column_bytes(b.column("text"))
            found = []
            for i, j in pieces(offsets, CHUNK_BYTES):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if len(part) < 3:
                    found.append(np.zeros((j - i, len(table))))
                    continue
                gram = trigrams(part)
                row = _rows(off, len(gram))
                gram, row = gram[row >= 0], row[row >= 0]
                ll = np.stack([np.bincount(row, t[gram], j - i) for t in table], axis=1) if len(table) else np.zeros((j - i, 0))
                n = np.bincount(row, minlength=j - i)
                found.append(ll * (TEMPER / np.maximum(n, TEMPER))[:, None])
            ll = np.round(np.concatenate(found), 6) if found else np.zeros((0, len(table)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(ll.ravel()), len(table)).cast(pa.list_(pa.float64())) if len(table) else pa.array([[]] * len(ll), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("kind", "doc_id", "declared", "host", "suffix")], lists], ["kind", "doc_id", "declared", "host", "suffix", "ll"])

    return run


def from_pages(pages: DataFrame) -> DataFrame:
    """Records (kind, doc_id, text, declared, host, suffix) of raw web pages; doc_id holds the page_id."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"&[#A-Za-z0-9]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    some = lambda c: F.when(F.length(c) > 0, c)
    return pages.select(F.lit("pages").alias("kind"), F.col("page_id").alias("doc_id"), text.alias("text"), some(declared).alias("declared"), some(host).alias("host"), some(F.substring_index(host, ".", -1)).alias("suffix"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Records of plain documents: no markup, the source as host, no suffix."""
    none = F.lit(None).cast("string")
    return docs.select(F.lit("documents").alias("kind"), "doc_id", text_of(docs).alias("text"), none.alias("declared"), F.col("source").alias("host"), none.alias("suffix"))


def identify(records: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """One row per record: kind, doc_id, lang, posterior, text_lang, declared, host."""
    n = len(langs)
    if n == 0:
        none = F.lit(None).cast("string")
        return records.select("kind", "doc_id", none.alias("lang"), F.lit(None).cast("double").alias("posterior"), none.alias("text_lang"), "declared", "host")
    rows = records.mapInArrow(_likelihoods(table), f"kind string, doc_id {id_type(records)}, declared string, host string, suffix string, ll array<double>")

    def normal(x):
        """Probabilities from logarithms."""
        top = F.transform(F.array(x), lambda a: F.transform(a, lambda v: F.exp(v - F.array_max(a))))[0]
        return F.transform(F.array(top), lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]

    # Rounded to whole millionths, so that sums do not depend on the order of tasks.
    whole = F.transform(normal(F.col("ll")), lambda p: F.round(p * 1_000_000).cast("long"))
    rows = store(rows.withColumn("own", whole), "language-text")
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.array(*[F.sum(F.get("own", F.lit(k))) for k in range(n)]).alias("c"))
    general = rows.agg(*[F.sum(F.get("own", F.lit(k))) for k in range(n)]).first()  # one number a language
    suffixes = sums(rows.where("suffix is not null"), "suffix").withColumnRenamed("c", "c_suffix")
    hosts = sums(rows.where("host is not null"), "host", "suffix").withColumnRenamed("c", "c_host")
    declared = sums(rows.where("declared is not null"), "declared").withColumnRenamed("c", "c_declared")
    zero = F.array(*[F.lit(0).cast("long")] * n)
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    hosts = hosts.select(F.col("host"), key(F.col("suffix")).alias("suffix_key"), "c_host")
    out = rows.withColumn("suffix_key", key(F.col("suffix"))).join(store(hosts, "language-hosts"), ["host", "suffix_key"], "left")
    out = out.join(store(suffixes, "language-suffixes"), "suffix", "left").join(store(declared, "language-declared"), "declared", "left")
    less = lambda c: F.zip_with(F.coalesce(c, zero), F.when(F.col(c).isNull(), zero).otherwise(F.col("own")), lambda a, b: (a - b) / F.lit(1_000_000.0))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)

    def smoothed(counts, parent, weight):
        both = F.array(F.struct(counts.alias("c"), parent.alias("p")))
        return F.transform(both, lambda b: F.zip_with(b["c"], b["p"], lambda c, p: (c + weight * p) / (total(b["c"]) + weight)))[0]

    all_counts = F.array(*[F.lit((c or 0) / 1_000_000.0) for c in general])
    out = out.withColumn("p_all", smoothed(all_counts, F.array(*[F.lit(1.0 / n)] * n), F.lit(1.0)))
    out = out.withColumn("p_suffix", smoothed(less("c_suffix"), F.col("p_all"), F.lit(SMOOTH_SUFFIX)))
    out = out.withColumn("p_host", smoothed(less("c_host"), F.col("p_suffix"), F.lit(SMOOTH_HOST)))
    # P(declaration | language) up to a factor: the share of the language among records so declared, over its share at large.
    says = F.zip_with(smoothed(less("c_declared"), F.col("p_all"), F.lit(1.0)), F.col("p_all"), lambda d, p: F.log(d / p))
    log_prior = F.zip_with(F.transform("p_host", lambda p: F.log(p)), says, lambda a, b: a + b)
    out = out.withColumn("post", normal(F.zip_with("ll", log_prior, lambda a, b: a + b)))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda x: F.get(names, (F.array_position(x, F.array_max(x)) - 1).cast("int"))
    text_lang = F.when(F.exists("ll", lambda v: v != 0), best(F.col("ll")))
    return out.select("kind", "doc_id", best(F.col("post")).alias("lang"), F.round(F.array_max("post"), 6).alias("posterior"), text_lang.alias("text_lang"), "declared", "host")
