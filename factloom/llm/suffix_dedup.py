"""Suffix-array deduplication: bytes covered by a 200-byte string that also starts elsewhere go.

The windows of 200 bytes are the suffixes to sort, each to that depth. They are dealt to buckets by
content: a window belongs to its anchor, the 48-byte string in it with the least hash, so equal
windows share the anchor's bytes and their offset from it. Neighbouring windows with one anchor form a
stretch. A stretch whose anchor occurs once in the corpus has no repeated window, and one whose anchor
only comes with that very stretch has only repeated windows; the rest are sorted, a bucket at a time:

* the stretches of a bucket stand one after the other, as they come; positions whose residue modulo V
  is in a difference cover are the sample (6 in 31 of all);
* the sample is ranked beforehand by doubling (V, 2V, 4V, 8V bytes);
* the windows are sorted by their first 32 bytes. Windows that tie there have any residues: two of them,
  i and j, are settled by the ranks of i + d and j + d, where d < V is the distance at which both
  meet the cover. All ties of the bucket are settled together, by the exchanges of a sorting network;
* neighbours in the sorted order are compared over all 200 bytes.

Memory: buckets reach a task in order of their key and are sorted as they come, about `BUCKET_BYTES`
of them at once; a task never holds its partition. A bucket of an anchor with up to `crowd` different
stretches, each shorter than 400 bytes, is sorted whole. One with more is cut further by the bytes that all windows at 16
of its offsets share, and only what still agrees there stays together: up to `throng` pieces, each shorter
than 216 bytes. An anchor with more than `throng` stretches (a passage whose surroundings differ everywhere) is
cut into single windows, which nothing sorts: equal ones meet by their hash and are settled one by one as
they stream by. So no bucket grows with the corpus.

Skew: a task's batch settles stretches that it holds twice or more by itself and passes on one of
them, so a passage in a third of all documents costs a row a batch; so it is with single windows. Anchors
and twins are counted with map-side sums, and stretches are grouped by anchor and content, so an anchor that many different stretches hold is spread
over tasks.

Nulls: a null text is empty; a null doc_id is kept as it is. Repeated rows are copies of each other
and go whole (if 200 bytes or longer). Ties do not arise. An empty table gives no rows. Only doc_id and text
are read, clashing further columns do no harm; ids may be of any type; texts of any length are taken
whole. Two stretches count as the same if anchor and stretch agree in two independent 64-bit hashes, two
single windows if they agree in one of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BYTE_CODE, CHUNK_BYTES, id_type, mix, narrowed, partitions, pieces, powers, prefix_sums, release, sized, store

LENGTH, GRAM = 200, 48
SPAN = LENGTH - GRAM + 1
#: A perfect difference cover: every residue modulo V is a difference of two members.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK = 16
BUCKET_BYTES = 2 << 20

_covered = np.zeros(V, bool)
_covered[list(COVER)] = True
#: Place of a residue in the cover, -1 if it is not in it.
SLOT = np.full(V, -1)
SLOT[list(COVER)] = np.arange(len(COVER))
#: Distance at which two residues meet the cover at once; below V, so within the bytes compared before.
MEET = np.array([[next(d for d in range(V) if _covered[(a + d) % V] and _covered[(b + d) % V]) for b in range(V)] for a in range(V)])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours."""
    n = len(x) - width + 1
    pad = -len(x) % width
    full = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor - first window, anchor hash, stretch hash) of all stretches."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums, (_, down) = prefix_sums(data, BYTE_CODE), powers(n + 1)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = sliding_least((gram & ~low) | np.arange(len(gram), dtype=np.uint64), SPAN)
    anchor = (least & low).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    whole = np.arange(len(anchor)) + LENGTH <= offsets[1:][row]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    a, r = anchor[at], row[at]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1))))
    count = np.diff(np.append(first, len(at)))
    p, a, r = at[first], a[first], r[first]
    text = (sums[p + count - 1 + LENGTH] - sums[p]) * down[p]
    stretch = mix(mix(text) ^ ((a - p).astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
    return r, p - offsets[r], count, a - p, gram[a], stretch


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted spans."""
    if not len(start):
        return start, end
    far = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.concatenate(([True], start[1:] > far[:-1])))
    return start[cut], far[np.append(cut[1:], len(end)) - 1]


def _compress(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = [z.compress((t or "").encode()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(raw, pa.binary())], ["row", "doc_id", "z"])


def _texts(b) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [z.decompress(x.as_buffer()) for x in b.column("z")]


#: Of a stretch: key (its anchor), stretch, row, first, windows, offset (of the anchor), known (has a twin in
#: the batch). Of a settled span: key, row, first, windows; stretch is null.
_STRETCH = "key long, stretch long, row long, first int, windows int, offset int, known boolean"


def _stretches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        texts, rows = _texts(b), np.array(b.column("row").to_pylist(), np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        parts = []
        for i, j in pieces(offsets, CHUNK_BYTES):
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            r, *rest = stretches(data, offsets[i : j + 1] - offsets[i])
            parts.append((rows[i + r], *rest))
        if not parts:
            continue
        row, first, count, offset, key, stretch = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((stretch, key))
        row, first, count, offset, key, stretch = (x[order] for x in (row, first, count, offset, key, stretch))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])))[: len(key)]
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(key)))
        known = times > 1
        twin = np.repeat(known, times)
        cols = lambda at, s, kn: pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), s, pa.array(row[at]), pa.array(first[at].astype(np.int32)), pa.array(count[at].astype(np.int32)), pa.array(offset[at].astype(np.int32)), pa.array(kn)], ["key", "stretch", "row", "first", "windows", "offset", "known"])
        yield cols(begin, pa.array(stretch[begin].view(np.int64)), known)
        settled = np.flatnonzero(twin)
        if len(settled):  # joined to maximal runs, to pass on few rows
            at = settled[np.lexsort((first[settled], row[settled]))]
            shift = np.cumsum(np.concatenate(([0], (row[at][1:] != row[at][:-1]).astype(np.int64)))) << 40
            s, e = _union(shift + first[at], shift + first[at] + count[at] - 1 + LENGTH)
            who = row[at][np.searchsorted(shift + first[at], s)]
            s, e = s & ((1 << 40) - 1), e & ((1 << 40) - 1)
            spread = mix(who.astype(np.uint64) ^ s.astype(np.uint64)).view(np.int64)
            n = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(n, pa.int64()), pa.array(who), pa.array(s.astype(np.int32)), pa.array((e - s - LENGTH + 1).astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, bool))], ["key", "stretch", "row", "first", "windows", "offset", "known"])


#: A single window has no bytes but the second half of its hash; a span that is settled has empty bytes.
_PIECE = "key long, twin long, row long, first int, windows int, known boolean, bytes binary"


def _cut(batches: Iterator) -> Iterator:
    """The bytes of the stretches asked for; those of crowded anchors in blocks of 16 offsets, those of thronged ones as single windows."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        out: list[tuple] = []
        single: dict[bytes, list[tuple]] = {}
        for text, asked in zip(_texts(b), b.column("asked").to_pylist(), strict=True):
            row = None
            for x in asked:
                row, p, n, a = x["row"], x["first"], x["windows"], x["first"] + x["offset"]
                if x["crowd"] == 0:
                    out.append((x["key"], None, row, p, n, x["known"], text[p : p + n - 1 + LENGTH]))
                    continue
                if x["crowd"] == 2:
                    for i in range(p, p + n):
                        single.setdefault(xxhash.xxh3_128_digest(text[i : i + LENGTH]), []).append((row, i, x["known"]))
                    continue
                for block in range((a - p - n + 1) // BLOCK, (a - p) // BLOCK + 1):
                    s, e = max(p, a - BLOCK * block - BLOCK + 1), min(p + n - 1, a - BLOCK * block)
                    core = text[a - BLOCK * block : a - BLOCK * block - BLOCK + 1 + LENGTH]
                    key = xxhash.xxh64_intdigest(core, (x["key"] + block) & (2**64 - 1)) - 2**63
                    out.append((key, None, row, s, e - s + 1, x["known"], text[s : e + LENGTH]))
        for digest, held in single.items():
            key, twin = np.frombuffer(digest, np.int64).tolist()
            row, i, known = held[0]
            out.append((key, twin, row, i, 1, known or len(held) > 1, None))
            if len(held) > 1:  # settled here, one goes on to be met by others; spans are dealt by their row
                out += [((row + i * 1_000_003) & (2**63 - 1), None, row, i, 1, True, b"") for row, i, known in held if not known]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        names = ("key", "twin", "row", "first", "windows", "known", "bytes")
        for i in range(0, len(out), 20_000):
            cols = zip(*out[i : i + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def rank_sample(words: np.ndarray, blocks: int) -> np.ndarray:
    """Ranks of the cover's positions (V * q + COVER[j] at index q * len(COVER) + j) by 8 V bytes."""
    m = len(COVER)
    at = (np.arange(blocks)[:, None] * V + np.array(COVER)[None, :]).ravel()
    keys = [words[at + d] for d in (24, 16, 8, 0)]
    order = np.lexsort(keys)
    differ = np.zeros(len(at), bool)
    for k in keys:
        differ[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(at), np.uint64)
    rank[order] = np.cumsum(differ).astype(np.uint64)
    for far in (1, 2, 4):
        later = np.zeros(len(at), np.uint64)
        later[: max(0, len(at) - far * m)] = rank[far * m :] + np.uint64(1)
        both = (rank << np.uint64(32)) | later
        order = np.argsort(both, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], both[order][1:] != both[order][:-1]))).astype(np.uint64)
    return rank


def network(size: int):
    """(p, k, pairs): Batcher's odd-even merge exchanges of places below `size`; groups of at most p places are in order by then."""
    p = 1
    while p < size:
        k = p
        while k:
            low = np.arange(size - k)
            at = low[(low >= k % p) & ((low - k % p) % (2 * k) < k) & (low // (2 * p) == (low + k) // (2 * p))]
            yield p, k, at
            k //= 2
        p *= 2


def settle_ties(starts: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, rank: np.ndarray) -> None:
    """Sort each run order[begin : begin + size] of windows that agree in their first 32 bytes, in place, by the cover."""
    by_size = np.argsort(-size, kind="stable")
    begin, size = begin[by_size], size[by_size]
    m = len(COVER)
    for p, k, low in network(int(size[0]) if len(size) else 0):
        # Runs come largest first: those not in order yet that hold place low + k are the first `live` of them.
        live = np.searchsorted(-size, -np.maximum(low + k, p), side="left")
        low, live = low[live > 0], live[live > 0]
        run = np.arange(int(live.sum())) - np.repeat(np.cumsum(live) - live, live)
        x = begin[run] + np.repeat(low, live)
        y = x + k
        i, j = starts[order[x]], starts[order[y]]
        d = MEET[i % V, j % V]
        swap = rank[(i + d) // V * m + SLOT[(i + d) % V]] > rank[(j + d) // V * m + SLOT[(j + d) % V]]
        x, y = x[swap], y[swap]
        order[x], order[y] = order[y], order[x]


def repeated_windows(texts: list[bytes], windows: np.ndarray) -> np.ndarray:
    """For each window of each text, in order: whether another window of the bucket has the same bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    total = int(size.sum())
    blocks = total // V + 2
    data = np.zeros(blocks * V + LENGTH + 2 * V + 8, np.uint8)
    data[:total] = np.frombuffer(b"".join(texts), np.uint8)
    words = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | data[k : k + len(words)]
    starts = np.repeat(begin - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(int(windows.sum()))
    out = np.zeros(len(starts), bool)
    order = np.lexsort((words[starts + 24], words[starts + 16], words[starts + 8], words[starts]))

    def alike(x: np.ndarray, depth: int) -> np.ndarray:
        """The places of x whose window agrees with the next in so many bytes."""
        for d in range(0, depth, 8):
            x = x[words[starts[order[x]] + d] == words[starts[order[x + 1]] + d]]
        return x

    tied = np.zeros(len(order) + 1, bool)
    tied[alike(np.arange(len(order) - 1), 32) + 1] = True  # agrees with the window before
    first = np.flatnonzero(tied[1:] & ~tied[:-1])
    if not len(first):
        return out
    last = np.flatnonzero(~tied[1:] & tied[:-1])
    settle_ties(starts, order, first, last - first + 1, rank_sample(words, blocks))
    same = alike(np.flatnonzero(tied[1:]), LENGTH)
    out[order[same]] = True
    out[order[same + 1]] = True
    return out


def _repeats(part: list[tuple]):
    """Spans (row, first, end) of repeated windows among the stretches that are not known ones."""
    import pyarrow as pa

    windows = np.array([r[3] for r in part], np.int64)
    again = repeated_windows([r[5] for r in part], windows)
    again &= ~np.repeat(np.array([r[4] for r in part]), windows)
    at = np.flatnonzero(again)
    if not len(at):
        return None
    which = np.repeat(np.arange(len(part)), windows)[at]
    place = at - np.concatenate(([0], np.cumsum(windows)[:-1]))[which]
    new = np.concatenate(([True], (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = place[first] + np.array([r[2] for r in part], np.int64)[which[first]]
    row = np.array([r[1] for r in part], np.int64)[which[first]]
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start.astype(np.int32)), pa.array((start + n - 1 + LENGTH).astype(np.int32))], ["row", "first", "end"])


def _sort(batches: Iterator) -> Iterator:
    """Sorts the buckets of a task, which come in order of their key, about `BUCKET_BYTES` of whole buckets at a time.

    Single windows come in order of their hash, so of them only the one before is held.
    """
    import pyarrow as pa

    part: list[tuple] = []
    held = 0
    before = None
    for b in batches:
        spans: list[tuple] = []
        for k, twin, *rest in zip(*[b.column(c).to_pylist() for c in ("key", "twin", "row", "first", "windows", "known", "bytes")], strict=True):
            r = (k, *rest)
            if not r[5]:
                again = r[5] is None and before is not None and before[:2] == (k, twin)
                if again and not before[4]:
                    spans.append(before[2:4])
                if r[5] is not None or (again and not r[4]):
                    spans.append(r[1:3])
                if r[5] is None:
                    before = (k, twin, r[1], r[2], again or r[4])
                continue
            if held >= BUCKET_BYTES and r[0] != part[-1][0]:
                found = _repeats(part)
                if found is not None:
                    yield found
                part, held = [], 0
            part.append(r)
            held += len(r[5])
        if spans:
            row, first = zip(*spans, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(first, pa.int32()), pa.array([i + LENGTH for i in first], pa.int32())], ["row", "first", "end"])
    found = _repeats(part) if part else None
    if found is not None:
        yield found


def _remove(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        out = []
        for text, spans in zip(_texts(b), b.column("spans").to_pylist(), strict=True):
            spans = sorted((x["first"], x["end"]) for x in spans or ())
            s, e = _union(np.array([x[0] for x in spans], np.int64), np.array([x[1] for x in spans], np.int64))
            kept, at = [], 0
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                kept.append(text[at:x])
                at = y
            kept.append(text[at:])
            left = b"".join(kept)
            out.append((len(text), len(text) - len(left), len(s), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def sort_requests(found: DataFrame, crowd: int, throng: int) -> tuple[DataFrame, DataFrame]:
    """(spans settled by counting, stretches that must be sorted) of all stretches; crowd is 1 or 2 where their anchor has many."""
    each = found.where("stretch is not null")
    keys = each.groupBy("key").agg(F.count("*").alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most")).where("n > 1")
    keys = store(keys.select("key", (F.col("least") != F.col("most")).alias("differ")), "suffix-anchors")
    met = store(narrowed(each, keys, "key"), "suffix-met")
    mixed = met.where("differ")
    twins = mixed.groupBy("key", "stretch").agg(F.count("*").alias("times"), F.min(F.struct("row", "first", "windows", "offset", "known")).alias("one"))
    twins = store(twins.select("key", "stretch", "times", "one.*"), "suffix-twins")
    several = twins.where("times > 1").select("key", "stretch")
    span = lambda df: df.select("row", "first", (F.col("first") + F.col("windows") - 1 + LENGTH).alias("end"))
    spans = span(found.where("stretch is null")).unionByName(span(met.where("not differ and not known"))).unionByName(span(mixed.where("not known").join(sized(several), ["key", "stretch"])))
    one = twins.withColumn("known", F.col("known") | (F.col("times") > 1))
    crowds = one.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key", F.when(F.col("n") > throng, 2).otherwise(1).alias("crowd"))
    asked = one.join(sized(store(crowds, "suffix-crowds")), "key", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0)))
    return spans, asked.select("key", "row", "first", "windows", "offset", "known", "crowd")


def suffix_dedup(docs: DataFrame, crowd: int = 1024, throng: int = 65_536) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    kept_text is the remaining bytes as text; where a cut splits a character, its rest becomes U+FFFD.
    """
    n, kind = partitions(docs.sparkSession), id_type(docs)
    table = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_compress, f"row long, doc_id {kind}, z binary")
    table = store(table, "suffix-texts")
    found = store(table.select("row", "z").mapInArrow(_stretches, _STRETCH), "suffix-stretches")
    whole, requests = sort_requests(found, crowd, throng)
    asked = requests.groupBy("row").agg(F.collect_list(F.struct("key", "row", "first", "windows", "offset", "known", "crowd")).alias("asked"))
    cut = table.select("row", "z").join(asked, "row").select("z", "asked").mapInArrow(_cut, _PIECE)
    sorted_ = store(cut.repartition(n, "key").sortWithinPartitions("key", "twin").mapInArrow(_sort, "row long, first int, end int"), "suffix-sorted")
    spans = store(whole.unionByName(sorted_).groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "suffix-spans")
    release(found, sorted_)
    out = table.join(spans, "row", "left").select("doc_id", "z", "spans")
    return out.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
