"""The replaceable parts: a classifier of pairs, an embedder of texts, and a reader of pages.

Each is a plain Python object that is called in Arrow or pandas batches; defaults need no network and
give the same answer every time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.contract import read_replies
from factloom.sources.scratch import stored


class Classifier(Protocol):
    """Judges pairs: from a frame with `prompt` to one with label, rationale, prompt_tokens, completion_tokens."""

    model_name: str

    def classify(self, prompts: pd.Series) -> pd.DataFrame: ...


class Embedder(Protocol):
    """Vectors of a fixed width for texts."""

    model_name: str
    width: int

    def embed(self, texts: pd.Series) -> list[np.ndarray]: ...


class Completer(Protocol):
    """Answers prompts: a frame with text, prompt_tokens, completion_tokens."""

    model_name: str

    def complete(self, prompts: pd.Series) -> pd.DataFrame: ...


class PageReader(Protocol):
    """Pages of a PDF: (physical_page, width_pt, height_pt, runs), runs an iterable of (text, x, y, width, height).

    A page that cannot be read raises when its runs are gone through, so the pages after it are still read.
    """

    def read(self, content: bytes) -> Iterator[tuple[int, float, float, Iterable[tuple[str, float, float, float, float]]]]: ...


class Adjudicator(Protocol):
    """Whether a subject is an entity that is named alike: from a frame with label and candidate to one with same and reason."""

    def judge(self, names: pd.DataFrame) -> pd.DataFrame: ...


class AbstainingClassifier:
    """Never decides."""

    model_name = "none"

    def classify(self, prompts: pd.Series) -> pd.DataFrame:
        n = len(prompts)
        return pd.DataFrame({"label": ["insufficient_context"] * n, "rationale": ["no classifier was available"] * n, "prompt_tokens": [0] * n, "completion_tokens": [0] * n})


class HashEmbedder:
    """Unit vectors from hashed words: equal words point the same way."""

    model_name = "hashed-words"

    def __init__(self, width: int = 768) -> None:
        self.width = width

    def embed(self, texts: pd.Series) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(self.width, np.float32)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            size = float(np.linalg.norm(v))
            out.append(v / size if size else v)
        return out


def embed_claims(claims: DataFrame, embedder: Embedder, most_chars: int = 1200) -> DataFrame:
    """claims (claim_id, description) to (claim_id, model, embedding); a vector of another width is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = embedder.embed(b["description"])
            if any(len(v) != embedder.width for v in vectors):
                raise ValueError(f"{embedder.model_name} gave a vector that is not {embedder.width} wide")
            yield pd.DataFrame({"claim_id": b["claim_id"], "model": embedder.model_name, "embedding": [np.asarray(v, np.float32) for v in vectors]})

    texts = claims.select("claim_id", F.substring("description", 1, most_chars).alias("description"))
    return texts.mapInPandas(run, "claim_id string, model string, embedding array<float>")


def classify_pairs(pairs: DataFrame, classifier: Classifier) -> DataFrame:
    """pairs (claim_a_id, claim_b_id, prompt) to verdict rows of method `model`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = classifier.classify(b["prompt"]).reset_index(drop=True)
            ids = b[["claim_a_id", "claim_b_id"]].reset_index(drop=True)
            yield pd.concat([ids, out], axis=1).assign(method="model", model_name=classifier.model_name)

    schema = "claim_a_id string, claim_b_id string, label string, rationale string, prompt_tokens int, completion_tokens int, method string, model_name string"
    return pairs.select("claim_a_id", "claim_b_id", "prompt").mapInPandas(run, schema)


def embed_or_reason(claims: DataFrame, embedder: Embedder | None) -> tuple[DataFrame | None, str | None]:
    """(vectors, None), or (None, why there are none): a failing embedder leaves the exact channel, it does not fail the job.

    A claim is tried first, so that an embedder that is not there is noticed before the work is dealt out.
    """
    if embedder is None:
        return None, "no embedder is configured"
    probe = claims.limit(1).toPandas()
    try:
        if len(probe):
            embedder.embed(probe["description"])
    except Exception as e:  # whatever the provider raises
        return None, f"{type(e).__name__}: {e}"
    return embed_claims(claims, embedder), None


def adjudicate(asked: DataFrame, judge: Adjudicator) -> DataFrame:
    """Verdicts (collection_id, label, entity_id, same, reason) on asked candidates; a call that fails counts as not the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                out = judge.judge(b[["label", "normalized_label"]].rename(columns={"normalized_label": "candidate"})).reset_index(drop=True)
            except Exception as e:  # the pairs stay apart, and say why
                out = pd.DataFrame({"same": [False] * len(b), "reason": [f"no answer: {e}"] * len(b)})
            yield pd.concat([b[["collection_id", "label", "entity_id"]].reset_index(drop=True), out[["same", "reason"]]], axis=1)

    schema = "collection_id string, label string, entity_id string, same boolean, reason string"
    return asked.select("collection_id", "label", "entity_id", "normalized_label").mapInPandas(run, schema)


def read_runs(files: DataFrame, reader: PageReader) -> DataFrame:
    """files (document_id, content) to positioned runs; a page that fails is a row with its number and an error, and the next page goes on.

    A document that cannot be opened at all is one row with an error and no page.
    """
    schema = "document_id string, physical_page int, width_pt double, height_pt double, text string, x double, y double, width double, height double, center_x double, reading_index int, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def failed(document: str, page: int | None, error: Exception) -> tuple:
        return (document, page, *[None] * 9, f"page_parse_failed: {error}")

    def page_rows(document: str, page: int, width: float, height: float, runs) -> list[tuple]:
        try:
            kept = [(t.strip(), *box) for t, *box in runs if t.strip()]
        except Exception as e:
            return [failed(document, page, e)]
        return [(document, page, width, height, t, x, y, w, h, x + w / 2, i, None) for i, (t, x, y, w, h) in enumerate(kept)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for document, content in zip(b["document_id"], b["content"], strict=True):
                try:
                    for page, width, height, runs in reader.read(bytes(content)):
                        rows += page_rows(document, page, width, height, runs)
                except Exception as e:
                    rows.append(failed(document, None, e))
            yield pd.DataFrame(rows, columns=names).astype({"physical_page": "Int32", "reading_index": "Int32"})

    return files.select("document_id", "content").mapInPandas(run, schema)


def _complete(prompts: DataFrame, model: Completer) -> DataFrame:
    """Stored answers: the rows of prompts (with a column `prompt`) and their reply, prompt_tokens, completion_tokens. A call is not made again when a task is."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = model.complete(b.column("prompt").to_pandas())
            answers = [pa.array(out[c].tolist(), k) for c, k in (("text", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *answers], [*b.schema.names, "reply", "prompt_tokens", "completion_tokens"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema]
    return stored(prompts.mapInArrow(run, ", ".join([*kinds, "reply string", "prompt_tokens bigint", "completion_tokens bigint"])), "answers")


REPAIR = "\n\nThe answer below does not keep to the form that was asked for. Give the whole answer again, mended.\n\nproblems: "


def extract(batches: DataFrame, model: Completer, repair: bool = True) -> DataFrame:
    """Claims of batches (batch_id, prompt, refs: array of (handle, block_id)); a reply that breaks the contract is repaired once.

    batch_id, claims (with `evidence`: cited handle and block, null for a handle that was not given out), repaired, the tokens of all
    calls, and where there are no claims failure_kind and feedback.
    """
    # What belongs to a batch goes along with it from call to call. Nothing is joined: answers compress so well that their files would pass for tables small enough to send to every task.
    first = _complete(batches.select("batch_id", "prompt", "refs"), model)
    read = stored(read_replies(first.withColumnRenamed("batch_id", "reply_id"), ("prompt", "refs", "reply", "prompt_tokens", "completion_tokens")).withColumnRenamed("reply_id", "batch_id"), "replies")
    told = ["batch_id", "claims", "repaired", "prompt_tokens", "completion_tokens", "failure_kind", "feedback", "refs"]
    good = read.where("ok").withColumn("repaired", F.lit(False)).withColumn("failure_kind", F.lit(None).cast("string"))
    bad = read.where("not ok")
    if repair:
        again = F.concat("prompt", F.lit(REPAIR), "feedback", F.lit("\n\nanswer: "), F.coalesce("reply", F.lit("")))
        second = _complete(bad.select("batch_id", again.alias("prompt"), "refs", F.col("prompt_tokens").alias("__p"), F.col("completion_tokens").alias("__c")), model)
        rest = read_replies(second.withColumnRenamed("batch_id", "reply_id"), ("refs", "prompt_tokens", "completion_tokens", "__p", "__c")).withColumnRenamed("reply_id", "batch_id")
        rest = rest.withColumn("repaired", F.lit(True)).withColumn("prompt_tokens", F.col("prompt_tokens") + F.col("__p")).withColumn("completion_tokens", F.col("completion_tokens") + F.col("__c"))
        rest = rest.withColumn("failure_kind", F.when(~F.col("ok"), "schema_violation_after_repair"))
    else:
        rest = bad.withColumn("repaired", F.lit(False)).withColumn("failure_kind", F.lit("schema_violation"))
    out = good.select(*told).unionByName(rest.select(*told))
    known = F.map_from_entries("refs")
    cited = lambda c: F.transform(c["evidence_block_ids"], lambda h: F.struct(h.alias("cited_ref"), F.try_element_at(known, h).alias("source_block_id")))
    return out.withColumn("claims", F.transform("claims", lambda c: c.withField("evidence", cited(c)))).drop("refs")
