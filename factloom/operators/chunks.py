"""Blocks to chunks of bounded size, and chunks to batches for one model call."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.base import SPACE

TARGET_TOKENS, MOST_TOKENS = 1200, 2000
BATCH_TOKENS, BATCH_CHUNKS = 3000, 4

_CHUNK = "document_id string, physical_page int, part int, heading string, text string, source_block_ids array<string>, block_refs array<struct<ref:string,block_id:string>>, estimated_tokens int"


def extraction_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks to read claims from: on pages with a transcription, native tables and charts give way to it."""
    page = Window.partitionBy("document_id", "physical_page")
    seen = F.max((F.col("extraction_method") == "model_transcription").cast("int")).over(page) == 1
    out = blocks.withColumn("__seen", seen)
    return out.where(~F.col("__seen") | (F.col("extraction_method") != "native_text") | ~F.col("block_type").isin("table", "chart")).drop("__seen")


def carried_heading(blocks: DataFrame) -> DataFrame:
    """Blocks with the last heading before them in the document, over pages; blank headings do not count."""
    order = Window.partitionBy("document_id").orderBy("physical_page", "block_index")
    text = F.trim(F.regexp_replace("content", f"^{SPACE}+|{SPACE}+$", ""))
    heading = F.when((F.col("block_type") == "heading") & (text != ""), text)
    return blocks.withColumn("heading", F.last(heading, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))


def _width(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text.encode("utf-16-le")) // 2


def _tokens(width: int) -> int:
    return -(-width // 4)


def _pieces(content: str, most: int) -> Iterator[str]:
    """The content in pieces of whole lines, each of `most` tokens at most (a longer line stays whole)."""
    held: list[str] = []
    width = 0
    for line in content.split("\n"):
        w = _width(line)
        if held and _tokens(width + 1 + w) > most:
            yield "\n".join(held)
            held, width = [], 0
        width += w + (1 if held else 0)
        held.append(line)
    if held:
        yield "\n".join(held)


class _Packer:
    """Folds the blocks of a page, in order, into chunks; keeps running lengths instead of joined texts."""

    def __init__(self, target: int, most: int) -> None:
        self.target, self.most, self.out, self.page = target, most, [], None

    def begin(self, page: tuple, heading: str | None) -> None:
        self.close()
        self.page, self.part, self.heading, self.label = page, 0, heading, None
        self.body: list[str] = []
        self.width, self.refs = 0, {}

    def close(self) -> None:
        if self.page is None or not self.body:
            return
        place = f"page {self.page[1]}" if self.label is None else f"page {self.page[1]} (printed {self.label})"
        head = [f"[{place}]"] + ([] if self.heading is None else [f"[section: {self.heading}]"])
        text = "\n".join([*head, "", "\n\n".join(self.body)])
        self.out.append((*self.page, self.part, self.heading, text, list(self.refs), [{"ref": r, "block_id": b} for b, r in self.refs.items()], _tokens(_width(text))))
        self.part += 1
        self.body, self.width, self.refs = [], 0, {}

    def add(self, block_id: str, block_type: str, content: str | None, label: str | None) -> None:
        content = (content or "").strip()
        if not content:
            return
        if block_type == "heading":
            self.close()
            self.heading, self.label = content, label
            return
        for piece in _pieces(content, self.most):
            if self.body and _tokens(self.width + 2 + _width(piece)) > self.target:
                self.close()
            self.label = label
            ref = self.refs.setdefault(block_id, f"B{len(self.refs) + 1}")
            entry = f"[{ref}]\n{piece}"
            self.width += _width(entry) + (2 if self.body else 0)
            self.body.append(entry)


def chunk_blocks(blocks: DataFrame, target: int = TARGET_TOKENS, most: int = MOST_TOKENS) -> DataFrame:
    """Chunks of each document: chunk_index, text with handles [B1].., heading, block ids, tokens.

    A chunk never spans pages, so with the heading carried in beforehand pages are dealt over the cluster and
    arrive at a task sorted; each is folded as it streams by, and a task holds one open chunk.
    """
    cols = ["document_id", "physical_page", "block_index", "block_id", "block_type", "content", "printed_page_label", "heading"]

    def pack(frames):
        import pyarrow as pa

        packer = _Packer(target, most)
        for batch in frames:
            for doc, page, block_id, kind, content, label, heading in zip(*[batch.column(c).to_pylist() for c in ("document_id", "physical_page", "block_id", "block_type", "content", "printed_page_label", "heading")], strict=True):
                if packer.page != (doc, page):
                    packer.begin((doc, page), heading)
                packer.add(block_id, kind, content, label)
            done, packer.out = packer.out, []
            yield _record(done)
        packer.close()
        yield _record(packer.out)

    def _record(rows):
        import pyarrow as pa

        refs = pa.list_(pa.struct([("ref", pa.string()), ("block_id", pa.string())]))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), refs, pa.int32())
        names = ("document_id", "physical_page", "part", "heading", "text", "source_block_ids", "block_refs", "estimated_tokens")
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    page = ["document_id", "physical_page"]
    sorted_ = carried_heading(blocks).select(*cols).repartition(*page).sortWithinPartitions(*page, "block_index")
    parts = sorted_.mapInArrow(pack, _CHUNK)
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("physical_page", "part")) - 1
    return parts.withColumn("chunk_index", index).drop("part")


def plan_batches(chunks: DataFrame, most_tokens: int = BATCH_TOKENS, most_chunks: int = BATCH_CHUNKS) -> DataFrame:
    """Chunks with batch_index and place in the batch; a batch closes before it would overflow.

    A document's chunks reach one task in order and are folded as they stream by.
    """

    def fold(frames):
        import pyarrow as pa

        document, n, tokens, batch = None, 0, 0, 0
        for f in frames:
            where, places = [], []
            for doc, size in zip(f.column("document_id").to_pylist(), f.column("estimated_tokens").to_pylist(), strict=True):
                if doc != document:
                    document, n, tokens, batch = doc, 0, 0, 0
                elif n >= most_chunks or (n and tokens + size > most_tokens):
                    n, tokens, batch = 0, 0, batch + 1
                where.append(batch)
                places.append(n)
                n, tokens = n + 1, tokens + size
            yield pa.RecordBatch.from_arrays([*f.columns, pa.array(where, pa.int32()), pa.array(places, pa.int32())], [*f.schema.names, "batch_index", "place"])

    c = chunks.select("document_id", "chunk_index", "estimated_tokens")
    schema = ", ".join(f"{n} {t}" for n, t in c.dtypes) + ", batch_index int, place int"
    return c.repartition("document_id").sortWithinPartitions("document_id", "chunk_index").mapInArrow(fold, schema)


def batch_passages(chunks: DataFrame, batches: DataFrame) -> DataFrame:
    """Passages of each batch in order: label P1.., and the chunk's text, with its handles marked by the label where a batch has several."""
    j = chunks.select("document_id", "chunk_index", "text").join(batches.drop("estimated_tokens"), ["document_id", "chunk_index"])
    size = F.count("*").over(Window.partitionBy("document_id", "batch_index"))
    label = F.concat(F.lit("P"), (F.col("place") + 1).cast("string"))
    marked = F.regexp_replace("text", F.lit(r"(?m)^\[(B[0-9]+)\]$"), F.concat(F.lit("["), label, F.lit("$1]")))
    return j.withColumn("size", size).select("document_id", "batch_index", "chunk_index", "place", label.alias("label"), F.when(F.col("size") > 1, marked).otherwise(F.col("text")).alias("text"))


def batch_handles(chunks: DataFrame, batches: DataFrame) -> DataFrame:
    """Handles of each batch: with one chunk B1, B2, ..; with more P1B1, P2B1, .."""
    j = chunks.join(batches.drop("estimated_tokens"), ["document_id", "chunk_index"])
    size = F.count("*").over(Window.partitionBy("document_id", "batch_index"))
    j = j.withColumn("size", size).select("document_id", "batch_index", "chunk_index", "place", "size", F.explode("block_refs").alias("r"))
    handle = F.when(F.col("size") > 1, F.concat(F.lit("P"), (F.col("place") + 1).cast("string"), F.col("r.ref"))).otherwise(F.col("r.ref"))
    return j.select("document_id", "batch_index", "chunk_index", handle.alias("handle"), F.col("r.block_id").alias("block_id"))


def output_allowance(n_chunks: Column) -> Column:
    """Tokens a reply may take for a batch of n chunks."""
    return F.least(F.lit(8000), 4000 + 2000 * (n_chunks - 1))


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks (with fingerprint) that no stored extraction covers."""
    return chunks.join(done.select("document_id", "fingerprint", "prompt_version", "model_name"), ["document_id", "fingerprint", "prompt_version", "model_name"], "left_anti")


def tally_chunks(claims: DataFrame, handles: DataFrame) -> DataFrame:
    """Extracted, accepted, under review and rejected per chunk; a claim belongs to its first cited handle that resolves.

    claims: document_id, batch_index, claim_id, status, evidence_block_ids.
    """
    cited = claims.select("document_id", "batch_index", "claim_id", "status", F.posexplode("evidence_block_ids").alias("position", "handle"))
    hit = cited.join(handles, ["document_id", "batch_index", "handle"])
    owner = hit.groupBy("document_id", "batch_index", "claim_id", "status").agg(F.min_by("chunk_index", "position").alias("chunk_index"))
    by = lambda s: F.count_if(F.col("status") == s)
    return owner.groupBy("document_id", "chunk_index").agg(F.count("*").alias("extracted"), by("accepted").alias("accepted"), by("needs_review").alias("needs_review"), by("rejected").alias("rejected"))


_IDENTITY = ["document_id", "fingerprint", "prompt_version", "model_name"]
COUNTS = ("claims_extracted", "claims_accepted", "claims_needing_review", "claims_rejected", "prompt_tokens", "completion_tokens")


def resumed_counts(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Per document: chunks, those that a stored extraction covers, and the sums of what is stored for these."""
    stored = done.select(*_IDENTITY, *COUNTS).dropDuplicates(_IDENTITY)
    j = chunks.join(stored.withColumn("hit", F.lit(1)), _IDENTITY, "left")
    return j.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("hit").alias("resumed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def unattributed_claims(claims: DataFrame, handles: DataFrame) -> DataFrame:
    """(document_id, batch_index, unattributed): claims none of whose cited handles resolves."""
    cited = claims.select("document_id", "batch_index", "claim_id", F.explode_outer("evidence_block_ids").alias("handle"))
    hit = cited.join(handles.select("document_id", "batch_index", "handle", "block_id"), ["document_id", "batch_index", "handle"], "left")
    per = hit.groupBy("document_id", "batch_index", "claim_id").agg(F.count("block_id").alias("n"))
    return per.groupBy("document_id", "batch_index").agg(F.count_if(F.col("n") == 0).alias("unattributed"))


def chunks_to_record(batches: DataFrame, claims: DataFrame, handles: DataFrame) -> DataFrame:
    """Chunks that count as done: nothing was rejected in them, and no claim of their batch lacks a chunk. With their counts."""
    counts = tally_chunks(claims, handles)
    j = batches.join(counts, ["document_id", "chunk_index"], "left").join(unattributed_claims(claims, handles), ["document_id", "batch_index"], "left")
    j = j.where((F.coalesce("rejected", F.lit(0)) == 0) & (F.coalesce("unattributed", F.lit(0)) == 0))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return j.select("document_id", "chunk_index", "batch_index", zero("extracted"), zero("accepted"), zero("needs_review"))
